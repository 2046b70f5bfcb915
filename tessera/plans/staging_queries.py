"""Queries over rows that wait to be taken in: documents and targets in which every rule is broken somewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import staging
from tessera.plans import views as v

_KIND = "doc_id % 16"
_COLUMNS = {
    "doc_id_": f"CASE WHEN {_KIND} = 1 THEN concat('bad id ', doc_id) WHEN {_KIND} = 2 THEN NULL WHEN {_KIND} = 3 THEN concat('d', doc_id - 1 - doc_id % 2) ELSE concat('d', doc_id) END",
    "source_type": f"CASE WHEN {_KIND} = 4 THEN 'rumour' ELSE source END",
    "publish_day": f"CASE WHEN {_KIND} = 5 THEN '2024-02-30' WHEN {_KIND} = 6 THEN '5 May' ELSE CAST(publish_time AS STRING) END",
    "url": f"CASE WHEN {_KIND} = 7 THEN 'ftp://host/a' WHEN {_KIND} = 8 THEN 'https:///a' ELSE concat('https://host/', doc_id) END",
    "title": f"CASE WHEN {_KIND} = 9 THEN '  abc    ' ELSE concat('Document ', doc_id) END",
}


def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each broken rule of a manifest made of all documents."""
    docs = v.dated(spark, sf_dir, "source", "text")
    made = docs.select(F.col("doc_id").alias("number"), *[F.expr(e).alias(n) for n, e in _COLUMNS.items()], F.col("text").alias("content"))
    made = made.withColumnsRenamed({"doc_id_": "doc_id", "publish_day": "publish_time"})
    found = staging.broken_rules(made, staging.manifest_rules([f"src{i}" for i in range(100)]), "doc_id", ["doc_id", "url"])
    return found.groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def target_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each broken rule of released targets, by the number of their period."""
    rows = v.targets(spark, sf_dir).withColumn("k", (F.year("period_end") * 12 + F.month("period_end")) % 9)
    made = rows.select(
        F.col("period_end").cast("string").alias("id"), F.when(F.col("k") == 1, "other").otherwise("value").alias("target_name"), F.when(F.col("k") == 2, F.date_add("period_start", 1)).otherwise(F.col("period_start")).cast("string").alias("period_start"),
        F.col("period_end").cast("string").alias("period_end"), F.when(F.col("k") == 3, "many").when(F.col("k") == 4, " ").otherwise(F.col("orders").cast("string")).alias("target_value"),
        F.when(F.col("k") == 5, F.col("period_end")).otherwise(F.col("release_date")).cast("string").alias("release_date"), F.when(F.col("k") == 6, "host/x").otherwise("https://host/x").alias("source_url"),
    )
    return staging.broken_rules(made, staging.target_rules("value"), "id", ["id"]).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"manifest_violations": manifest_violations, "target_violations": target_violations}
DATES: dict[str, list[str]] = {}
SQL = {
    "manifest_violations": f"""WITH {v.DATED}, m AS (SELECT doc_id % 16 AS k, text, source, {_COLUMNS['doc_id_']} AS id, {_COLUMNS['url']} AS url FROM dated),
r AS (SELECT *, count(*) OVER (PARTITION BY id) AS ids, count(*) OVER (PARTITION BY url) AS urls FROM m),
x AS (SELECT unnest([CASE WHEN k = 1 THEN 'malformed_doc_id' END, CASE WHEN k = 2 THEN 'missing_doc_id' END, CASE WHEN k = 4 THEN 'invalid_source_type' END, CASE WHEN k IN (5, 6) THEN 'malformed_publish_time' END,
  CASE WHEN k IN (7, 8) THEN 'malformed_url' END, CASE WHEN k = 9 OR length(trim(coalesce(text, ''), ' ')) < 40 THEN 'short_text' END, CASE WHEN id IS NOT NULL AND ids > 1 THEN 'repeated_doc_id' END, CASE WHEN urls > 1 THEN 'repeated_url' END]) AS violation FROM r)
SELECT violation, count(*) AS n FROM x WHERE violation IS NOT NULL GROUP BY 1""",
    "target_violations": f"""WITH {v.TARGETS}, k AS (SELECT (year(period_end) * 12 + month(period_end)) % 9 AS k FROM targets)
SELECT e.violation, count(*) AS n FROM k JOIN (VALUES (1, 'invalid_target_name'), (2, 'wrong_period'), (3, 'not_a_number'), (4, 'missing_target_value'), (4, 'not_a_number'), (5, 'released_too_early'), (6, 'malformed_source_url')) e(k, violation) USING (k) GROUP BY 1""",
}
