"""The two-phase study over labelled documents and the flags of their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbers import rounded as r
from tessera.operators import study
from tessera.plans import views as v

UNTIL = "1995-04-30"


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A direction of each document, by its number."""
    n = F.col("doc_id")
    return v.table(spark, sf_dir, "documents").select("doc_id", (((n * 37) % 41 - 20) / 20.0).alias("score"), ((n % 10) / 10.0).alias("confidence"), (((n * 13) % 21 - 10) / 10.0).alias("zero_shot_score"), F.concat(F.lit("evidence "), n.cast("string")).alias("evidence"))


def study_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = v.records(spark, sf_dir)
    book = study.freeze_rulebook(records, UNTIL)
    out = study.joined_study(study.signals(records, directions(spark, sf_dir), book), v.table(spark, sf_dir, "documents").select("doc_id", "source"), records.select("doc_id", F.col("direction_label").alias("realized_label")))
    return out.select("doc_id", "publish_time", "direction_label", r(F.col("direction_score")).alias("direction_score"), F.size("activated_rules").alias("active_rules"), "evidence_text", "inference_mode", "right")


QUERIES = {"study_signals": study_signals}
DATES = {"study_signals": ["publish_time"]}
SQL: dict[str, str] = {}
