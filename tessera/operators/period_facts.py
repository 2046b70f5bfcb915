"""Period features of documents and all facts about them, from one typed union instead of a chain of joins.

Documents and their facts (events, predicates of events, entity links, factors,
rule hits, annotations) become rows of one shape, keyed by document.  One
aggregation by document, combined before the shuffle, gives each document's sums
and sets, and drops facts of documents that aren't canonical, as these have no
row that names a period.  Periods add those up; what must be counted once a period
(sources, stocks) and factor values for quantiles are taken from the same
documents' sets, in a second stage whose rows are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: documents from which a period counts as covered.
SUFFICIENT = 5
KINDS = ("document", "event", "predicate", "link", "factor", "rule", "annotation")


def canonical(docs: DataFrame, same: Column, day: str = "publish_time", key: str = "doc_id") -> DataFrame:
    """The earliest document of each group that ``same`` names, the smallest key of one day; only keys and the group's name are shuffled."""
    first = docs.select(same.alias("__same"), F.struct(day, key).alias("__at")).groupBy("__same").agg(F.min("__at").alias("__at"))
    return docs.join(first.select(F.col(f"__at.{key}").alias(key)), key, "left_semi")


def _fact(df: DataFrame, kind: str, name: Column | None = None, item: Column | None = None, x: Column | None = None, confidence: Column | None = None, more: list[Column] = []) -> DataFrame:
    none = F.lit(None)
    return df.select("doc_id", F.lit(kind).alias("kind"), (none if name is None else name).cast("string").alias("name"), (none if item is None else item).cast("string").alias("item"), (none if x is None else x).cast("double").alias("x"), (none if confidence is None else confidence).cast("double").alias("confidence"), *more)


def union_of_facts(docs: DataFrame, facts: dict[str, DataFrame], topics: list[str]) -> DataFrame:
    """Rows (doc_id, kind, name, item, x, confidence, period_end, source_type, topics).

    docs: doc_id, period_end, source_name, source_type, topics (booleans); facts, each with doc_id: event (event_id, stock, strength),
    predicate (name, value: text, confidence), link (confidence), factor (value), rule (rule_id), annotation.  A missing kind is empty.
    """
    only = [F.lit(None).cast("date").alias("period_end"), F.lit(None).cast("string").alias("source_type"), *[F.lit(None).cast("boolean").alias(t) for t in topics]]
    rows = _fact(docs, "document", item=F.col("source_name"), more=["period_end", F.col("source_type").cast("string").alias("source_type"), *[F.col(t).cast("boolean").alias(t) for t in topics]])
    truth = F.when(F.lower("value") == "true", 1.0).when(F.lower("value") == "false", 0.0)
    shapes = {
        "event": {"name": F.col("event_id"), "item": F.col("stock"), "x": F.col("strength")} if "event" in facts else {},
        "predicate": {"name": F.col("name"), "x": truth, "confidence": F.col("confidence")}, "link": {"confidence": F.col("confidence")},
        "factor": {"x": F.col("value")}, "rule": {"item": F.col("rule_id")}, "annotation": {},
    }
    for kind, df in facts.items():
        rows = rows.unionByName(_fact(df, kind, more=only, **shapes[kind]))
    return rows


def by_document(rows: DataFrame, names: list[str], topics: list[str]) -> DataFrame:
    """One row for each canonical document: its sums, and its sets of events, stocks and rules; facts of other documents go."""
    is_ = lambda kind: F.col("kind") == kind
    of = lambda kind, value: F.when(is_(kind), value)
    n = lambda condition: F.count_if(condition)
    fold = [
        F.max("period_end").alias("period_end"), F.max("source_type").alias("source_type"), F.max(of("document", F.col("item"))).alias("source"), n(is_("document")).alias("documents"),
        F.collect_set(of("event", F.col("item"))).alias("stocks"), F.collect_set(of("event", F.col("name"))).alias("events"), n(is_("event")).alias("event_rows"), F.sum(of("event", F.col("x"))).alias("strength"),
        n(is_("predicate")).alias("predicates"), n(is_("predicate") & (F.col("x") == 1)).alias("true"), n(is_("predicate") & F.col("x").isNotNull()).alias("boolean"), F.sum(of("predicate", F.coalesce("confidence", F.lit(0.0)))).alias("predicate_confidence"),
        n(is_("link")).alias("links"), F.sum(of("link", F.coalesce("confidence", F.lit(0.0)))).alias("link_confidence"),
        F.collect_list(of("factor", F.col("x"))).alias("factors"), F.collect_set(of("rule", F.col("item"))).alias("rules"), n(is_("annotation")).alias("annotations"),
        *[F.bool_or(t).alias(t) for t in topics],
        *[x for p in names for x in (F.sum(F.when(is_("predicate") & (F.col("name") == p), F.col("x"))).alias(f"s_{p}"), n(is_("predicate") & (F.col("name") == p) & F.col("x").isNotNull()).alias(f"n_{p}"))],
    ]
    return rows.groupBy("doc_id").agg(*fold).filter("documents > 0 AND period_end IS NOT NULL")


def period_features(docs: DataFrame, facts: dict[str, DataFrame], names: list[str], topics: list[str], source_types: list[str]) -> DataFrame:
    """All wide features of each period that has documents; means and rates of nothing are 0, quantiles are interpolated, deviations are of the population."""
    own = by_document(union_of_facts(docs, facts, topics), names, topics)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rate = lambda a, b: F.when(total(b) > 0, total(a) / total(b)).otherwise(0.0)
    sums = own.groupBy("period_end").agg(
        F.count(F.lit(1)).alias("document_count"), total(F.size("events")).alias("event_count"), total("predicates").alias("predicate_count"), total("true").alias("true_predicate_count"),
        rate("true", "boolean").alias("positive_predicate_rate"), rate("predicate_confidence", "predicates").alias("avg_predicate_confidence"), rate("strength", "event_rows").alias("avg_event_evidence"),
        rate("link_confidence", "links").alias("avg_entity_confidence"), total(F.size("rules")).alias("qualified_rule_hits"), F.count_if(F.size("rules") > 0).alias("rule_supporting_document_count"),
        (F.count_if(F.col("annotations") > 0) / F.count(F.lit(1))).alias("annotation_coverage"), F.when(F.count(F.lit(1)) >= SUFFICIENT, "sufficient").otherwise("insufficient").alias("coverage_status"),
        *[F.count_if(F.col("source_type") == s).alias(f"{s}_count") for s in source_types], *[F.count_if(F.col(t)).alias(t) for t in topics],
        *[rate(f"s_{p}", f"n_{p}").alias(f"predicate_{p}") for p in names],
    )
    item = lambda kind, value, x=None: F.struct(F.lit(kind).alias("kind"), value.alias("item"), (F.lit(None) if x is None else x).cast("double").alias("x"))
    no = F.lit(None).cast("string")
    few = own.select("period_end", F.explode(F.concat(F.array(item("source", F.nullif(F.col("source"), F.lit("")))), F.transform("stocks", lambda s: item("stock", s)), F.transform("factors", lambda v: item("factor", no, v)))).alias("i"))
    # stage one: each source and stock of a period once; equal factor values once, with how often
    once = few.groupBy("period_end", "i.kind", "i.item", "i.x").agg(F.count(F.lit(1)).alias("n"))
    factor = F.col("kind") == "factor"
    value, times = F.when(factor, F.col("x")), F.when(factor, F.col("n")).otherwise(0)
    quantiles = F.percentile(value, [0.25, 0.5, 0.75], F.when(factor, F.col("n")).otherwise(F.lit(1)))
    count, mean = F.sum(times), F.sum(value * F.col("n")) / F.sum(times)
    second = F.sum(value * value * F.col("n")) / count
    more = once.groupBy("period_end").agg(
        F.count_if((F.col("kind") == "source") & F.col("item").isNotNull()).alias("unique_source_count"), F.count_if(F.col("kind") == "stock").alias("stock_count"),
        F.coalesce(F.when(count > 0, mean), F.lit(0.0)).alias("factor_mean"), *[F.coalesce(F.get(quantiles, F.lit(i)), F.lit(0.0)).alias(f"factor_{q}") for i, q in enumerate(("p25", "median", "p75"))],
        F.coalesce(F.when(count > 1, F.sqrt(F.greatest(second - mean * mean, F.lit(0.0)))), F.lit(0.0)).alias("factor_std"), F.coalesce(F.when(count > 0, F.sum(F.when(value > 0, F.col("n")).otherwise(0)) / count), F.lit(0.0)).alias("factor_positive_rate"),
    )
    return sums.join(more, "period_end")
