"""A study in two phases: rules are induced from discovery alone, frozen, and only then applied to later documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.consensus import activated, consensus
from tessera.operators.iterate import saved
from tessera.operators.rules import induce_rulebook

#: Fixed value: scores beyond this are bullish, below its negative bearish.
CUT = 0.1


@dataclass(frozen=True)
class Rulebook:
    """The frozen rules (rule_id, conditions, target_label), written once, with their digest and the last day they could see."""

    rules: DataFrame
    digest: str
    until: str


def guarded(records: DataFrame, until: str, day: str = "publish_time") -> DataFrame:
    """The rows as they are; reading a row later than ``until``, or without a day, fails."""
    late = ~F.coalesce(F.col(day) <= F.lit(until).cast("date"), F.lit(False))
    return records.withColumn(day, F.when(late, F.raise_error(F.lit(f"a row later than {until} in discovery")).cast(records.schema[day].dataType)).otherwise(F.col(day)))


def rulebook_digest(rules: DataFrame) -> str:
    """Digest of a rulebook whatever the order of its rules: a row for each rule of a few."""
    lines = F.array_sort(F.collect_list(F.to_json(F.struct("target_label", "conditions"))))
    return rules.agg(F.sha2(F.array_join(lines, "\n"), 256)).first()[0]


def freeze_rulebook(records: DataFrame, until: str, day: str = "publish_time", **induction) -> Rulebook:
    """Induce rules from the rows up to ``until`` and write them, so that no later row, and no later run, changes them."""
    rules = induce_rulebook(guarded(records.filter(F.col(day) <= F.lit(until).cast("date")), until, day), day=day, **induction)
    name = F.concat(F.lit("R-"), F.substring(F.sha2(F.concat_ws("|", "target_label", F.array_join("conditions", "&")), 256), 1, 12))
    rules = saved(rules.select(name.alias("rule_id"), "conditions", "target_label"))
    return Rulebook(rules, rulebook_digest(rules), until)


def overridden(deterministic: DataFrame, stored: DataFrame, keys: list[str] = ["doc_id", "name"]) -> DataFrame:
    """A stored consensus decided anew, with deterministic values in place of the first annotator's; the second's stay as stored (other_value, confidence)."""
    return consensus(deterministic, stored.select(*keys, F.col("other_value").alias("value"), "confidence"), keys)


def signals(records: DataFrame, directions: DataFrame, rulebook: Rulebook, names: str = "names", day: str = "publish_time") -> DataFrame:
    """A signal for each document with a direction: its score where a rule is active, else 0.

    records: doc_id, day, agreed ``names``; directions: doc_id, score, confidence, zero_shot_score, evidence.  Discovery documents are
    judged without rules, as none was known then.
    """
    book = rulebook.rules.agg(F.array_sort(F.collect_list(F.struct("rule_id", "conditions"))).alias("__book"))  # one row of a few rules
    met = records.select("doc_id", day, names).join(directions, "doc_id").crossJoin(F.broadcast(book))
    later = F.col(day) > F.lit(rulebook.until).cast("date")
    active = F.when(later, F.transform(F.filter("__book", lambda r: activated(r["conditions"], F.col(names))), lambda r: r["rule_id"])).otherwise(F.array().cast("array<string>"))
    met = met.withColumn("activated_rules", active)
    on = F.size("activated_rules") > 0
    score = F.when(on, F.col("score")).otherwise(0.0)
    return met.select(
        "doc_id", day, F.when(score > CUT, "bullish").when(score < -CUT, "bearish").otherwise("neutral").alias("direction_label"), score.alias("direction_score"), "zero_shot_score", "confidence", "activated_rules",
        F.when(on, F.col("evidence")).otherwise("").alias("evidence_text"), F.when(on, "rules_active").otherwise("rulebook_inactive").alias("inference_mode"), F.lit(rulebook.digest).alias("rulebook_sha256"),
    )


def joined_study(signals_: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Signals with their text's title and, where the outcome is known, the realised label and whether the signal was right."""
    met = signals_.join(texts, "doc_id").join(labels, "doc_id", "left")
    return met.withColumn("right", F.when(F.col("realized_label").isNotNull(), F.col("direction_label") == F.col("realized_label")))
