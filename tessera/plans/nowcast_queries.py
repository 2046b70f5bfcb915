"""Queries over walk-forward forecasts of order values by priority, with evidence of dated documents."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dates import period_end
from tessera.functions.numbers import rounded as r
from tessera.operators import nowcast
from tessera.operators.iterate import saved
from tessera.plans import views as v

KEYS = ["o_orderpriority"]
FIELDS = ["document_count", "log_chars", *v.FLAGS]
SETS = {"shares": ["document_count", *v.FLAGS], "size": ["document_count", "log_chars", "has_digit"]}
MEANS = ["log_chars", *v.FLAGS]
TRAIN_END, VALIDATION_END, FIRST, LAST = "1998-02-28", "1999-04-30", "1995-01-01", "2001-12-31"
SINGLE = {"all": [*MEANS, "latest", "season_sin", "season_cos"], "state": ["long_text", "has_license", "latest", "season_sin", "season_cos"]}


def _split():
    day = F.col("period_end")
    return F.when(day <= F.lit(TRAIN_END).cast("date"), "train").when(day <= F.lit(VALIDATION_END).cast("date"), "validation").otherwise("oos")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt over the days from 1995 on, with flags as numbers."""
    docs = v.flagged(spark, sf_dir, "n_chars").drop("publish_time")
    day = F.date_add(F.lit(FIRST).cast("date"), ((F.col("doc_id") * 37) % 2400).cast("int"))
    flags = [F.col(f).cast("int").cast("double").alias(f) for f in v.FLAGS]
    return docs.select("doc_id", day.alias("publish_time"), period_end(day).alias("period_end"), F.log1p(F.col("n_chars").cast("double")).alias("log_chars"), *flags)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order value of each priority and period in log points, released 18 days after the period."""
    out = v.table(spark, sf_dir, "orders").groupBy(*KEYS, period_end(F.col("o_orderdate").cast("date")).alias("period_end")).agg((100 * F.log(F.avg("o_totalprice"))).alias("actual"))
    return out.withColumn("release_date", F.date_add("period_end", 18))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("period_end").agg(F.count(F.lit(1)).cast("double").alias("document_count"), *[F.avg(c).alias(c) for c in MEANS])


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines of each series and period; plans that read these few rows more than three times save them."""
    return nowcast.baseline_forecasts(series(spark, sf_dir), features(spark, sf_dir), FIELDS, KEYS, 12).withColumn("split", _split())


def released_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir).select(*KEYS, "period_end", "n_known", *[r(F.col(c), 5).alias(c) for c in ("persistence", "seasonal", "ar1")])


def period_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir).select(*KEYS, "period_end", *[r(F.col(c), 5).alias(c) for c in nowcast.BASELINES])


def walk_forward_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nowcast.walk_forward(saved(_base(spark, sf_dir)), SETS, KEYS)
    return out.select(*KEYS, "period_end", "split", "feature_set", "alpha", "text_weight", *[r(F.col(c), 5).alias(c) for c in ("no_text_ridge", "text_increment", "forecast", "lower_90", "upper_90", "acceleration")])


def marginal_text_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = saved(_base(spark, sf_dir))
    model = nowcast.residual_model(base, SETS, KEYS)
    docs = documents(spark, sf_dir).withColumn("copy", F.col("doc_id") % 10 == 3)
    out = nowcast.marginal_effects(docs, base, model, SETS, KEYS, MEANS, "copy")
    return out.select(*KEYS, "doc_id", "before_document_count", "after_document_count", *[r(F.col(c), 5).alias(c) for c in ("nowcast_before", "nowcast_after", "marginal_change")])


def single_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the value of their period, the latest value released by their day, and the season."""
    targets = v.targets(spark, sf_dir)
    docs = documents(spark, sf_dir).join(F.broadcast(nowcast.latest_by_day(targets, FIRST, LAST)), F.col("publish_time") == F.col("day"))
    month = F.month("period_end")
    met = docs.join(F.broadcast(targets.select("period_end", "actual")), "period_end").fillna(0.0, ["latest"])  # a row for each day, and for each period
    return met.withColumns({"season_sin": F.sin(month * math.pi / 6), "season_cos": F.cos(month * math.pi / 6), "split": _split()})


def single_text_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nowcast.single_text_model(single_texts(spark, sf_dir), SINGLE)
    return out.select("feature_set", "alpha", "ridge_weight", "n", "n_validation", "increment_status", *[r(F.col(c), 5).alias(c) for c in ("validation_mae", "validation_rmse", "half_width", "persistence_mae")])


def latest_at_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single_texts(spark, sf_dir).select("doc_id", "split", r(F.col("latest")).alias("latest"), r(F.col("actual")).alias("actual"))


QUERIES = {"released_baselines": released_baselines, "period_models": period_models, "walk_forward_forecasts": walk_forward_forecasts, "marginal_text_effects": marginal_text_effects, "single_text_model": single_text_model, "latest_at_documents": latest_at_documents}
DATES = {"released_baselines": ["period_end"], "period_models": ["period_end"], "walk_forward_forecasts": ["period_end"]}
_PERIOD = "CASE WHEN month({0}) <= 2 THEN last_day(make_date(year({0}), 2, 1)) ELSE last_day({0}::DATE) END"
SQL = {
    "released_baselines": f"""WITH s AS (SELECT o_orderpriority AS p, {_PERIOD.format("o_orderdate")} AS e, 100 * ln(avg(o_totalprice)) AS y FROM orders GROUP BY 1, 2),
k AS (SELECT *, lag(y) OVER (PARTITION BY p ORDER BY e) AS x, row_number() OVER (PARTITION BY p, month(e) ORDER BY e) AS nth FROM s),
a AS (SELECT t.p, t.e, count(*) AS n, arg_max(k.y, k.e) AS latest, count(k.x) AS m, avg(k.x) AS mx, avg(k.y) FILTER (k.x IS NOT NULL) AS my, stddev_pop(k.x) AS sx, covar_pop(k.y, k.x) AS c,
  max(k.nth) FILTER (month(k.e) = month(t.e)) AS seen FROM s t JOIN k ON k.p = t.p AND k.e + 18 <= t.e GROUP BY 1, 2),
five AS (SELECT a.p, a.e, avg(k.y) AS season FROM a JOIN k ON k.p = a.p AND month(k.e) = month(a.e) AND k.nth <= a.seen AND k.nth > a.seen - 5 GROUP BY 1, 2)
SELECT a.p AS o_orderpriority, a.e AS period_end, n AS n_known, round(latest, 5) + 0.0 AS persistence, round(coalesce(season, latest), 5) + 0.0 AS seasonal, round(my + c / sx * m / (m + 1) * (latest - mx) / sx, 5) + 0.0 AS ar1
FROM a LEFT JOIN five ON five.p = a.p AND five.e = a.e WHERE n >= 12""",
    "latest_at_documents": f"""WITH {v.TARGETS}, d AS (SELECT doc_id, CAST('{FIRST}' AS DATE) + CAST((doc_id * 37) % 2400 AS INTEGER) AS day FROM documents),
m AS (SELECT doc_id, day, {_PERIOD.format("day")} AS e FROM d),
l AS (SELECT d.doc_id, arg_max(t.actual, t.release_date) AS latest FROM d JOIN targets t ON t.release_date <= d.day GROUP BY 1)
SELECT m.doc_id, CASE WHEN e <= DATE '{TRAIN_END}' THEN 'train' WHEN e <= DATE '{VALIDATION_END}' THEN 'validation' ELSE 'oos' END AS split, round(coalesce(latest, 0), 6) + 0.0 AS latest, round(t.actual, 6) + 0.0 AS actual
FROM m JOIN targets t ON t.period_end = m.e LEFT JOIN l ON l.doc_id = m.doc_id""",
}
