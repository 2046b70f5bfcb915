"""Short conjunctive rules mined from predicates and labels.

Records carry the array ``names`` of their true predicates (a fixed schema of some
twenty names).  Each record is spread over the combinations of its own true names,
at most a few hundred whatever the corpus, and everything after that is grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.dates import half_year
from tessera.functions.scoring import rule_score


def combinations(names: Column, most: int = 2, least: int = 1) -> Column:
    """Sorted combinations of ``least`` to ``most`` (3 at the highest) of an array of names."""
    a = F.array_sort(F.array_distinct(names))
    one = F.transform(a, lambda x: F.array(x))
    two = F.flatten(F.transform(a, lambda x: F.transform(F.filter(a, lambda y: y > x), lambda y: F.array(x, y))))
    three = F.flatten(F.transform(a, lambda x: F.flatten(F.transform(F.filter(a, lambda y: y > x), lambda y: F.transform(F.filter(a, lambda z: z > y), lambda z: F.array(x, y, z))))))
    return F.concat(*[c for k, c in enumerate((one, two, three), 1) if least <= k <= most])


def rule_coverage(records: DataFrame, targets: list[str], most: int = 2, anchors: list[str] | None = None, day: str = "publish_time", label: str = "direction_label") -> DataFrame:
    """(conditions, target_label, coverage_positive, coverage_negative, support_documents, support_dates) of every combination that occurs."""
    known = records.filter(F.col(label).isNotNull())
    spread = known.select("doc_id", day, label, F.explode(combinations(F.col("names"), most)).alias("conditions"))
    if anchors is not None:
        spread = spread.filter(F.arrays_overlap("conditions", F.array(*[F.lit(a) for a in anchors])))
    hits = spread.groupBy("conditions").agg(
        *[F.count_if(F.col(label) == t).alias(f"__p{i}") for i, t in enumerate(targets)], F.count(F.lit(1)).alias("__n"),
        F.count_distinct("doc_id").alias("support_documents"), F.count_distinct(day).alias("support_dates"),
    )
    totals = known.agg(F.count(F.lit(1)).alias("__all"), *[F.count_if(F.col(label) == t).alias(f"__all{i}") for i, t in enumerate(targets)])
    met = hits.crossJoin(F.broadcast(totals))  # one row of totals
    entries = F.array(*[F.struct(F.lit(t).alias("target_label"), F.col(f"__p{i}").alias("p"), F.col(f"__all{i}").alias("all")) for i, t in enumerate(targets)])
    long = met.withColumn("__t", F.explode(entries)).filter("__t.all > 0 AND __all > __t.all")
    return long.select("conditions", "__t.target_label", (F.col("__t.p") / F.col("__t.all")).alias("coverage_positive"), ((F.col("__n") - F.col("__t.p")) / (F.col("__all") - F.col("__t.all"))).alias("coverage_negative"), "support_documents", "support_dates")


def induce_rulebook(records: DataFrame, targets: list[str] = ["bullish", "bearish"], most: int = 2, least_documents: int = 5, least_dates: int = 3, top: int = 5, penalty: float = 1.0, anchors: list[str] | None = None, day: str = "publish_time", label: str = "direction_label") -> DataFrame:
    """The ``top`` rules of each target by covered positives less penalised negatives; ties: fewer conditions, more support, names."""
    covered = rule_coverage(records, targets, most, anchors, day, label)
    scored = covered.withColumn("score", F.col("coverage_positive") - penalty * F.col("coverage_negative"))
    good = scored.filter((F.col("score") > 0) & (F.col("support_documents") >= least_documents) & (F.col("support_dates") >= least_dates))
    order = W.partitionBy("target_label").orderBy(F.desc("score"), F.size("conditions"), F.desc("support_documents"), "conditions")
    return good.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def rule_stability(records: DataFrame, rulebook: DataFrame, day: str = "publish_time", label: str = "direction_label") -> DataFrame:
    """For each rule and half-year: score and support."""
    known = records.filter(F.col(label).isNotNull()).withColumn("half", half_year(F.col(day)))
    rules = F.broadcast(rulebook.select("conditions", "target_label"))  # top rules of each target
    met = known.crossJoin(rules).withColumn("__hit", F.size(F.array_except("conditions", "names")) == 0).withColumn("__pos", F.col(label) == F.col("target_label"))
    sums = met.groupBy("conditions", "target_label", "half").agg(
        F.count_if(F.col("__hit") & F.col("__pos")).alias("a"), F.count_if("__pos").alias("b"), F.count_if(F.col("__hit") & ~F.col("__pos")).alias("c"), F.count_if(~F.col("__pos")).alias("d"),
    )
    return sums.select("conditions", "target_label", "half", (F.coalesce(F.col("a") / F.nullif("b", F.lit(0)), F.lit(0.0)) - F.coalesce(F.col("c") / F.nullif("d", F.lit(0)), F.lit(0.0))).alias("half_score"), (F.col("a") + F.col("c")).alias("half_support"))


def stable_rules(rulebook: DataFrame, stability: DataFrame, records: DataFrame, halves: list[str], least_support: int = 3) -> DataFrame:
    """Rules with a positive score and enough support in all ``halves``, one for each set of documents that a target's rules cover."""
    good = stability.filter(F.col("half").isin(*halves) & (F.col("half_score") > 0) & (F.col("half_support") >= least_support)).groupBy("conditions", "target_label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(halves))
    kept = rulebook.join(good.drop("n"), ["conditions", "target_label"], "left_semi")
    covers = records.crossJoin(F.broadcast(kept.select("conditions", "target_label"))).filter(F.size(F.array_except("conditions", "names")) == 0)
    # a set of documents is named by its size and a sum of hashes, so no group is collected
    named = covers.groupBy("conditions", "target_label").agg(F.count_distinct("doc_id").alias("covered"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("cover"))
    first = W.partitionBy("target_label", "covered", "cover").orderBy("rank")
    return kept.join(named, ["conditions", "target_label"]).withColumn("__f", F.row_number().over(first)).filter("__f = 1").drop("__f", "cover")


def return_rules(events: DataFrame, least_terms: int = 2, most_terms: int = 3, least_documents: int = 3) -> DataFrame:
    """Rules over events (event_id, doc_id, entity, event_time, names, excess, evidence): two-level means, components and score of each combination."""
    documents = events.groupBy("doc_id").agg(F.avg("excess").alias("r"))
    whole = documents.agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("all_mean"), F.coalesce(F.stddev_pop("r"), F.lit(0.01)).alias("all_scale"))
    spread = events.withColumn("conditions", F.explode(combinations(F.col("names"), most_terms, least_terms)))
    by_document = spread.groupBy("conditions", "doc_id").agg(F.avg("excess").alias("r"), F.avg("evidence").alias("e"), F.max(half_year(F.col("event_time"))).alias("half"))
    means = by_document.groupBy("conditions").agg(F.count(F.lit(1)).alias("support_count"), F.count_if(F.col("r") > 0).alias("positive_count"), F.avg("r").alias("avg_return"), F.coalesce(F.avg("e"), F.lit(0.0)).alias("avg_evidence"))
    halves = by_document.groupBy("conditions", "half").agg(F.avg("r").alias("m")).groupBy("conditions").agg(F.count(F.lit(1)).alias("period_count"), F.count_if(F.col("m") > 0).alias("positive_period_count"))
    breadth = spread.groupBy("conditions").agg(F.count_distinct("entity").alias("entity_count"), F.count_distinct("event_time").alias("date_count"), F.count(F.lit(1)).alias("covered"), F.sum(F.xxhash64("event_id").cast("decimal(38,0)")).alias("cover"))
    met = means.filter(F.col("support_count") >= least_documents).join(halves, "conditions").join(breadth, "conditions").crossJoin(F.broadcast(whole))
    parts = rule_score(F.col("positive_count"), F.col("support_count"), F.col("avg_return"), F.col("all_mean"), F.col("all_scale"), F.col("positive_period_count"), F.col("period_count"), F.col("support_count"), F.col("entity_count"), F.col("avg_evidence"), F.size("conditions"))
    return met.withColumn("components", parts).withColumn("score", F.col("components.score"))


#: What a return rule needs to qualify, and how many qualified ones are kept.
LEAST_SUPPORT, LEAST_WIN_RATE, LEAST_RETURN, LEAST_EVIDENCE, LEAST_ENTITIES, LEAST_DATES, MOST_QUALIFIED = 5, 0.50, 0.0, 0.75, 5, 5, 12


def select_rules(rules: DataFrame, most: int = MOST_QUALIFIED, least_evidence: float = LEAST_EVIDENCE) -> DataFrame:
    """Rules of ``return_rules`` with status and rule_id, best first: qualified ones, then by score and support; of rules that cover the same events the first.

    The list ends with the ``most``-th qualified rule.  If none qualifies, it is the first ``most`` candidates, whatever they cover.  A rulebook is a dimension.
    """
    good = (F.col("support_count") >= LEAST_SUPPORT) & (F.col("positive_count") / F.col("support_count") >= LEAST_WIN_RATE) & (F.col("avg_return") >= LEAST_RETURN)
    good = good & (F.col("avg_evidence") >= least_evidence) & (F.col("entity_count") >= LEAST_ENTITIES) & (F.col("date_count") >= LEAST_DATES)
    order = [F.desc("__q"), F.desc("score"), F.desc("support_count"), F.size("conditions"), "conditions"]
    # equal sets of events have the same size and the same sum of their ids' hashes
    ranked = rules.withColumn("__q", good.cast("int")).withColumn("__first", F.row_number().over(W.partitionBy("covered", "cover").orderBy(*order)) == 1).withColumn("__any", F.max("__q").over(W.partitionBy()))
    kept = ranked.filter(F.col("__first") | (F.col("__any") == 0))
    before = F.coalesce(F.sum("__q").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = kept.withColumns({"__b": before, "__i": F.row_number().over(W.orderBy(*order))})
    chosen = numbered.filter(F.when(F.col("__any") == 1, F.col("__b") < most).otherwise(F.col("__i") <= most))
    return chosen.withColumns({"rule_id": F.format_string("R%03d", "__i"), "status": F.when(F.col("__q") == 1, "qualified").otherwise("candidate")}).drop("__q", "__first", "__any", "__b", "__i", "cover")


def rule_diagnostics(rules: DataFrame, events: DataFrame, until: str, since: str, least_terms: int = 2, most_terms: int = 3) -> DataFrame:
    """(rule_id, discovery_documents, discovery_dates, discovery_entities, discovery_return, oos_documents, oos_return): what a rule's events did up to ``until`` and from ``since``."""
    spread = events.withColumn("conditions", F.explode(combinations(F.col("names"), most_terms, least_terms))).join(F.broadcast(rules.select("rule_id", "conditions")), "conditions")
    early, late = F.col("event_time") <= F.lit(until).cast("date"), F.col("event_time") >= F.lit(since).cast("date")
    documents = spread.groupBy("rule_id", "doc_id").agg(F.avg(F.when(early, F.col("excess"))).alias("a"), F.avg(F.when(late, F.col("excess"))).alias("b"))
    means = documents.groupBy("rule_id").agg(F.count("a").alias("discovery_documents"), F.coalesce(F.avg("a"), F.lit(0.0)).alias("discovery_return"), F.count("b").alias("oos_documents"), F.coalesce(F.avg("b"), F.lit(0.0)).alias("oos_return"))
    breadth = spread.filter(early).groupBy("rule_id").agg(F.count_distinct("event_time").alias("discovery_dates"), F.count_distinct("entity").alias("discovery_entities"))
    return means.join(breadth, "rule_id", "left").na.fill(0, ["discovery_dates", "discovery_entities"])


def rule_matches(conditions: Column, values: Column, least: float = 0.5) -> Column:
    """All of a rule's conditions (``a AND b``) reach ``least`` in a map of predicate scores."""
    return F.forall(F.split(conditions, " AND "), lambda c: F.coalesce(F.element_at(values, F.trim(c)), F.lit(0.0)) >= least)
