"""Agreement of two annotators on a fixed set of predicates, and what it gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scoring import consensus_status, fused_value


def consensus(rules: DataFrame, other: DataFrame, keys: list[str] = ["doc_id", "name"]) -> DataFrame:
    """Rows of ``rules`` (keys, value) with the other annotator's value and confidence, the status, the fused value and whether a rule may use it."""
    second = other.select(*keys, F.col("value").alias("other_value"), "confidence")
    met = rules.join(second, keys, "left").withColumn("status", consensus_status(F.col("value"), F.col("other_value")))
    return met.withColumn("fused", fused_value(F.col("value"), F.col("other_value"), F.col("confidence"))).withColumn("accepted", (F.col("status") == "agreed_true") & (F.lower("value") == "true"))


def schema_errors(other: DataFrame, texts: DataFrame, names: list[str], key: str = "doc_id") -> DataFrame:
    """(key, name, error): missing or unknown predicates, evidence that isn't in the text, confidences outside [0, 1]."""
    wanted = texts.select(key, F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    absent = wanted.join(other.select(key, "name"), [key, "name"], "left_anti").withColumn("error", F.lit("missing_predicate"))
    met = other.join(texts.select(key, "text"), key, "left")
    errors = F.array_compact(F.array(
        F.when(~F.col("name").isin(*names), "unknown_predicate"), F.when(~F.coalesce(F.lower("value"), F.lit("")).isin("true", "false"), "not_boolean"),
        F.when((F.lower("value") == "true") & ~F.coalesce((F.trim("evidence") != "") & F.contains("text", F.trim("evidence")), F.lit(False)), "ungrounded_evidence"),
        F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence_out_of_range"),
    ))
    return absent.unionByName(met.select(key, "name", F.explode(errors).alias("error")))


def agreed_names(consensus_json: Column) -> Column:
    """Names of agreed_true entries of a consensus stored as JSON."""
    entries = F.from_json(consensus_json, "array<struct<name:string,status:string,confidence:double,evidence_text:string>>")
    return F.transform(F.filter(entries, lambda e: e["status"] == "agreed_true"), lambda e: e["name"])


def activated(conditions: Column, agreed: Column) -> Column:
    """All conditions of a rule are agreed."""
    return F.size(F.array_except(conditions, agreed)) == 0


def grounded_direction(score: Column, evidence: Column, text: Column, cut: float = 0.10) -> Column:
    """Direction label of a score, whose score counts 0 where its evidence isn't in the text."""
    kept = F.when(F.contains(text, evidence) & (evidence != ""), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))).otherwise(0.0)
    return F.struct(kept.alias("direction_score"), F.when(kept >= cut, "bullish").when(kept <= -cut, "bearish").otherwise("neutral").alias("direction_label"))


def event_gate(events: DataFrame, other: DataFrame, key: str = "event_id") -> DataFrame:
    """Add event_status: both name the same event type, and its evidence is grounded."""
    met = events.join(other.select(key, F.col("event_type").alias("other_type"), "grounded"), key, "left")
    return met.withColumn("event_status", F.when(F.col("other_type").isNull(), "invalid").when((F.col("event_type") == F.col("other_type")) & F.col("grounded"), "agreed").otherwise("disputed"))


def entity_gate(links: DataFrame, other: DataFrame, keys: list[str] = ["doc_id", "entity"], least: float = 0.5) -> DataFrame:
    """Links that the other annotator grounds with confidence of at least ``least``."""
    good = other.filter(F.col("grounded") & (F.col("confidence") >= least)).select(*keys).distinct()
    return links.join(good, keys, "left_semi")
