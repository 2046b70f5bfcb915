"""Period features of documents: wide counts, rates and quantiles, and long (feature_name, feature_value) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.dates import period_end


def wide_features(docs: DataFrame, flags: list[str], values: list[str], sources: list[str], day: str = "publish_time") -> DataFrame:
    """One row for each observation period: documents, distinct sources, share and mean of flags, mean and quartiles of values, counts by source."""
    return docs.groupBy(period_end(F.col(day)).alias("period_end")).agg(
        F.count(F.lit(1)).alias("document_count"), F.count_distinct("source").alias("source_count"),
        *[F.avg(F.col(f).cast("double")).alias(f"{f}_share") for f in flags],
        *[x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.percentile(v, 0.5).alias(f"{v}_median"), F.percentile(v, 0.9).alias(f"{v}_p90"))],
        *[F.count_if(F.col("source") == s).alias(f"source_{s}_count") for s in sources],
    )


def predicate_features(rows: DataFrame, period: str = "period_end") -> DataFrame:
    """Long features of predicates (period, doc_id, name, active, signed): hit rate, and net score of each document's strongest score."""
    by_doc = rows.groupBy(period, "name", "doc_id").agg(F.max(F.col("active").cast("int")).alias("hit"), F.max_by("signed", F.struct(F.abs("signed"), "signed")).alias("net"))
    sums = by_doc.groupBy(period, "name").agg(F.avg(F.col("hit").cast("double")).alias("rate"), F.avg("net").alias("net"), F.log1p(F.sum("hit").cast("double")).alias("log_count"), F.count(F.lit(1)).alias("document_count"))
    return unpivoted(sums, [period, "name", "document_count"], ["rate", "net", "log_count"]).select(period, F.concat_ws("_", "name", "feature").alias("feature_name"), "feature_value", "document_count")


def unpivoted(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("feature_value")) for c in columns])
    return df.select(*keys, F.explode(pairs).alias("__p")).select(*keys, "__p.feature", "__p.feature_value")


def feature_matrix(rows: DataFrame, names: list[str], period: str = "period_end") -> DataFrame:
    """Long to wide for a given list of features; missing ones are 0.  Given names spare the pass that a pivot would need to find them."""
    return rows.groupBy(period).agg(*[F.coalesce(F.max(F.when(F.col("feature_name") == n, F.col("feature_value"))), F.lit(0.0)).alias(n) for n in names])


def routes(base: DataFrame, rules: DataFrame, weight: float = 0.25) -> DataFrame:
    """Base features for three routes; rules added in full to the second, by ``weight`` to the third."""
    cloned = base.withColumn("route", F.explode(F.array(F.lit("base"), F.lit("rules"), F.lit("weighted_rules"))))
    full = rules.withColumn("route", F.lit("rules"))
    part = rules.withColumns({"route": F.lit("weighted_rules"), "feature_value": F.col("feature_value") * weight})
    return cloned.unionByName(full).unionByName(part)


def active_score(direction: str = "direction", intensity: str = "intensity", confidence: str = "confidence", value: str = "value", evidence: str = "evidence_text"):
    """direction * intensity * confidence of a predicate that is true and has evidence; else 0."""
    live = (F.lower(F.col(value).cast("string")) == "true") & (F.trim(F.coalesce(evidence, F.lit(""))) != "")
    return F.when(live, F.col(direction) * F.col(intensity) * F.col(confidence)).otherwise(0.0)


def lag_bucket(months):
    return F.when(months <= 0, "0").when(months <= 3, "1_3").when(months <= 6, "4_6").otherwise("7_12")
