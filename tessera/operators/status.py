"""Dashboards: counts of tables and splits, progress of a prospective test, work that is still to be annotated, and single predictions as positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import clip
from tessera.sources.tables import failure_category


def table_status(df: DataFrame, by: str, day: str, targets: dict[str, int] | None = None) -> DataFrame:
    """Rows, first and last day of each value of ``by``, and how many are missing to its target."""
    out = df.groupBy(F.col(by).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    wanted = F.lit(0)
    for k, n in (targets or {}).items():
        wanted = F.when(F.col("value") == k, n).otherwise(wanted)
    return out.withColumn("remaining", F.greatest(wanted - F.col("n"), F.lit(0)))


def failures(records: DataFrame, status: str = "status", reason: str = "reason") -> DataFrame:
    """Latest records by status and category of failure, most frequent first."""
    return records.groupBy(status, failure_category(F.col(reason)).alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def monitor(settled: DataFrame, required: int = 63) -> DataFrame:
    """Settled and pending decisions, and whether enough trading days are settled to judge."""
    days = F.count_distinct(F.when(F.col("settlement") == "settled", F.col("entry_date")))
    return settled.agg(F.count_if(F.col("settlement") == "settled").alias("settled"), F.count_if(F.col("settlement").endswith("_pending")).alias("pending"), days.alias("settled_days")).withColumns({"required_days": F.lit(required), "ready": F.col("settled_days") >= required})


def annotation_key(columns: list[str], model: str, version: str) -> Column:
    """Fingerprint of what an annotation depends on."""
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), F.lit(version).alias("version"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])), 256)


def to_annotate(docs: DataFrame, cache: DataFrame, columns: list[str], model: str, version: str) -> DataFrame:
    """Documents without a successful record for their present content, model and version: a run that broke off goes on from here."""
    done = cache.filter("status = 'success'").select("cache_key")
    return docs.withColumn("cache_key", annotation_key(columns, model, version)).join(done, "cache_key", "left_anti")


def prediction_position(score: Column, eligible: Column, baseline: Column, weight: float = 0.25) -> Column:
    """Status and position of one prediction on top of a day's baseline."""
    status = F.when(baseline.isNull(), "no_baseline").when(~F.coalesce(eligible, F.lit(False)), "text_not_eligible").when(baseline <= 0, "baseline_not_long").when(~F.coalesce(score > 0, F.lit(False)), "text_not_positive").otherwise("confirmed")
    return F.struct(status.alias("status"), F.when(status == "confirmed", clip(baseline + weight * score)).otherwise(F.coalesce(baseline, F.lit(0.0))).alias("position"))
