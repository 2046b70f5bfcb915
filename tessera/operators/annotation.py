"""Second annotations: their validation, fusion with rules, what they may trigger, and which documents may be learnt from.

Predicates are rows (doc_id, name, ...); rules and schemas are dimensions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.html import text_vector
from tessera.functions.numbers import bounded, tri_state
from tessera.operators.features import lag_bucket
from tessera.operators.retrieval import dot

#: Months that a rule may lead by, candidates of a document, share of its confidence that a candidate scores, and value from which a predicate counts as met.
MOST_LAG, MOST_CANDIDATES, CANDIDATE_SHARE, MET, EVIDENCE_LENGTH = 12, 3, 0.8, 0.5, 240


def matched_rules(gated: DataFrame, rules: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, rule_id) of rules whose conditions are all among the gated names of a document; a condition on an event type is the name ``event_type=...``.

    ``gated`` (key, name) holds only what both annotators agreed on, so a disputed predicate never meets a condition.  Rules without conditions match nothing.
    """
    terms = rules.select("rule_id", F.size(F.array_distinct("conditions")).alias("__n"), F.explode(F.array_distinct("conditions")).alias("name"))
    met = gated.select(key, "name").distinct().join(terms, "name")
    return met.groupBy(key, "rule_id").agg(F.count(F.lit(1)).alias("__k"), F.first("__n").alias("__n")).filter("__k = __n").select(key, "rule_id")


def candidate_scores(candidates: DataFrame, fused: DataFrame, gate: DataFrame) -> DataFrame:
    """(doc_id, position, conditions, hits, score) of a document's first candidates, where the document's gate is open.

    ``candidates``: doc_id, position, conditions, confidence; ``fused``: doc_id, name, fused; ``gate``: doc_id of open ones.  A candidate scores its confidence times
    the share of its conditions that are met; one without conditions is left out.
    """
    first = candidates.join(gate.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("__r", F.row_number().over(W.partitionBy("doc_id").orderBy("position"))).filter(F.col("__r") <= MOST_CANDIDATES)
    kept = first.filter(F.size("conditions") > 0).select("doc_id", "position", "conditions", bounded(F.col("confidence"), 0.5).alias("confidence"))
    terms = kept.select("doc_id", "position", F.explode("conditions").alias("name"))
    hits = terms.join(fused.select("doc_id", "name", "fused"), ["doc_id", "name"], "left").groupBy("doc_id", "position").agg(F.count_if(F.coalesce(tri_state(F.col("fused")), F.lit(0.0)) >= MET).alias("hits"))
    return kept.join(hits, ["doc_id", "position"]).select("doc_id", "position", "conditions", "hits", F.round(CANDIDATE_SHARE * F.col("confidence") * F.col("hits") / F.size("conditions"), 6).alias("score"))


def similar_rules(conditions: DataFrame, rules: DataFrame, k: int = 2) -> DataFrame:
    """(condition, rule_id, similarity, rank): the ``k`` frozen rules whose text is nearest to each distinct condition text, by hashed vectors.  Both are rulebooks, no facts."""
    left = conditions.select("condition").distinct().withColumn("__a", text_vector("condition"))
    right = rules.select("rule_id", text_vector("condition").alias("__b"))
    near = left.join(F.broadcast(right)).select("condition", "rule_id", F.round(dot(F.col("__a"), F.col("__b")), 4).alias("similarity"))
    return near.withColumn("rank", F.row_number().over(W.partitionBy("condition").orderBy(F.desc("similarity"), "rule_id"))).filter(F.col("rank") <= k)


def traceable(snippet: Column, text: Column) -> Column:
    """The snippet isn't blank and stands in the text."""
    bare = F.trim(F.coalesce(snippet, F.lit("")))
    return (bare != "") & F.contains(F.coalesce(text, F.lit("")), bare)


def fuse_signed(rules: DataFrame, other: DataFrame, keys: list[str] = ["doc_id", "name"]) -> DataFrame:
    """Rows of ``rules`` (keys, value, direction, intensity, confidence, lag, evidence_text), drawn towards the second annotator's signed intensity by at most half."""
    second = other.select(*keys, F.struct("value", "direction", "intensity", "confidence", "lag", "evidence_text").alias("__o"))
    met = rules.join(second, keys, "left")
    own, its = F.col("direction") * F.col("intensity"), F.col("__o.direction") * F.col("__o.intensity")
    score = own + (its - own) * F.least(F.col("__o.confidence"), F.lit(0.5))
    alone, theirs = F.col("__o").isNull(), F.coalesce(F.col("__o.value"), F.lit(False))
    pick = lambda fused, name: F.when(alone, F.col(name)).otherwise(fused).alias(name)
    return met.select(
        *keys, pick(F.abs(score) > 1e-12, "value"), pick(F.signum(score).cast("int"), "direction"), pick(F.round(F.abs(score), 4), "intensity"),
        pick(F.round(F.greatest("confidence", "__o.confidence"), 4), "confidence"), pick(F.when(theirs, F.col("__o.lag")).otherwise(F.col("lag")), "lag"),
        pick(F.when(theirs, F.col("__o.evidence_text")).otherwise(F.col("evidence_text")), "evidence_text"), F.when(alone, "deterministic").otherwise("fused").alias("source"),
    )


def signed_errors(other: DataFrame, texts: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, name, error): what is wrong with a second annotator's signed predicates (doc_id, name, value, direction, intensity, confidence, lag, evidence_text) on texts (doc_id, text)."""
    counted = other.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("doc_id", "name")))
    met = counted.join(texts.select("doc_id", "text"), "doc_id", "left")
    true, false = F.lower(F.col("value").cast("string")) == "true", F.lower(F.col("value").cast("string")) == "false"
    grounded = F.col("direction").isin(-1, 1) & traceable(F.col("evidence_text"), F.col("text"))
    empty = (F.col("direction") == 0) & (F.col("intensity") == 0) & (F.trim(F.coalesce("evidence_text", F.lit(""))) == "")
    sure = lambda c: F.coalesce(c, F.lit(False))
    errors = F.array_compact(F.array(
        F.when(~sure(F.col("name").isin(*names)), "unknown_predicate"), F.when(F.col("__n") > 1, "repeated_predicate"), F.when(~sure(true | false), "not_boolean"),
        F.when(sure(true) & ~sure(grounded), "ungrounded"), F.when(sure(false) & ~sure(empty), "false_with_content"), F.when(~sure(F.col("lag").between(0, MOST_LAG)), "lag_out_of_range"), F.when(F.col("confidence").isNull(), "no_confidence"),
    ))
    wanted = texts.select("doc_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    absent = wanted.join(other.select("doc_id", "name"), ["doc_id", "name"], "left_anti").withColumn("error", F.lit("missing_predicate"))
    return met.select("doc_id", "name", F.explode(errors).alias("error")).unionByName(absent)


def candidate_rules(candidates: DataFrame, predicates: DataFrame, texts: DataFrame, names: list[str]) -> DataFrame:
    """Valid candidate rules (doc_id, conditions, direction, intensity, confidence, lag, lag_bucket, evidence_text, proposed_by) of each document.

    ``candidates``: doc_id, position, conditions, direction, intensity, confidence, lag, evidence_text.  One is valid if it is among the first MOST_CANDIDATES, has 1 to 4 known
    conditions, evidence that stands in the text, and a direction and a lag within bounds.  A document without any is given its strongest true predicates instead.
    """
    first = candidates.withColumn("__r", F.row_number().over(W.partitionBy("doc_id").orderBy("position"))).filter(F.col("__r") <= MOST_CANDIDATES)
    own = F.array_sort(F.array_distinct("conditions"))
    met = first.withColumn("conditions", own).withColumn("evidence_text", F.substring(F.trim(F.coalesce("evidence_text", F.lit(""))), 1, EVIDENCE_LENGTH)).join(texts.select("doc_id", "text"), "doc_id")
    known = F.size(F.array_except("conditions", F.array(*[F.lit(n) for n in names]))) == 0
    good = F.size("conditions").between(1, 4) & known & traceable(F.col("evidence_text"), F.col("text")) & F.col("direction").isin(-1, 1) & F.col("lag").between(0, MOST_LAG)
    columns = ["doc_id", "conditions", "direction", "intensity", "confidence", "lag", "evidence_text"]
    valid = met.filter(F.coalesce(good, F.lit(False))).select(*columns, F.lit("annotator").alias("proposed_by"))
    open_docs = predicates.filter("value").join(valid.select("doc_id").distinct(), "doc_id", "left_anti")
    best = open_docs.withColumn("__r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc(F.col("intensity") * F.col("confidence")), "name"))).filter(F.col("__r") <= MOST_CANDIDATES)
    instead = best.withColumn("conditions", F.array("name")).select(*columns, F.lit("predicate").alias("proposed_by"))
    return valid.unionByName(instead).withColumn("lag_bucket", lag_bucket(F.col("lag")))


def purged(records: DataFrame, until: str, day: str = "publish_time", known: str = "exit_trade_date") -> DataFrame:
    """Records whose whole label was known by ``until``: a record published before it, but settled after it, would leak."""
    return records.filter((F.col(day) <= F.lit(until).cast("date")) & (F.col(known) <= F.lit(until).cast("date")))


def eligible(docs: DataFrame, labels: DataFrame, prospective_from: str, status: str = "review_status") -> DataFrame:
    """Accepted documents that are prospective, or have a label."""
    accepted = docs.filter(F.col(status) == "accepted")
    labelled = accepted.join(labels.select("doc_id").distinct().withColumn("__l", F.lit(True)), "doc_id", "left")
    return labelled.filter((F.col("publish_time") >= F.lit(prospective_from).cast("date")) | F.col("__l")).drop("__l")


def relabelled(rows: DataFrame, start: str, end: str, split: str, day: str = "trade_date") -> DataFrame:
    """The rows of a range of days, as another split."""
    return rows.filter(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))).withColumn("split", F.lit(split))
