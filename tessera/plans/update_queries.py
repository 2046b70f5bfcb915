"""Queries over the daily updater: runs of the ledger of each return flag and line status, from the days on which line items were shipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import views as v
from tessera.streaming import updater


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each ledger and day: how far it asks, what day it finds, when it runs, and errors, by the day's number."""
    days = v.table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("ledger"), F.col("l_shipdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("lines"))
    n = F.datediff("day", F.lit("1990-01-01").cast("date"))
    end = F.when(n % 17 == 0, F.date_sub("day", 9)).when(n % 4 == 1, F.date_sub("day", 1)).otherwise(F.col("day"))
    market = F.when(n % 5 == 2, F.date_sub(end, 2)).otherwise(end)
    return days.select("ledger", n.cast("long").alias("run"), end.alias("end"), market.alias("market_day"), F.date_add(end, F.when(n % 7 == 3, 6).when(n % 3 == 0, 1).otherwise(0)).alias("today"), F.when(n % 11 == 5, 2).otherwise(0).alias("errors"))


def updater_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updater.updates(runs(spark, sf_dir))


QUERIES = {"updater_runs": updater_runs}
DATES = {"updater_runs": ["market_day", "decision_day"]}
#: A ledger's market day is the running maximum; of the runs at one market day, the first that may decide does.
SQL = {
    "updater_runs": """WITH d AS (SELECT l_returnflag || l_linestatus AS ledger, l_shipdate::DATE AS day, (l_shipdate::DATE - DATE '1990-01-01')::BIGINT AS n FROM lineitem GROUP BY ALL),
e AS (SELECT ledger, n, CASE WHEN n % 17 = 0 THEN day - 9 WHEN n % 4 = 1 THEN day - 1 ELSE day END AS e FROM d),
r AS (SELECT ledger, n AS run, e, CASE WHEN n % 5 = 2 THEN e - 2 ELSE e END AS m, e + CASE WHEN n % 7 = 3 THEN 6 WHEN n % 3 = 0 THEN 1 ELSE 0 END AS today, n % 11 = 5 AS bad FROM e),
k AS (SELECT *, max(m) OVER (PARTITION BY ledger ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(m) OVER (PARTITION BY ledger ORDER BY run) AS now FROM r),
a AS (SELECT *, before IS NULL OR e > before AS asks, CASE WHEN before IS NULL OR e > before THEN NOT bad AND (before IS NULL OR now > before) AND now >= today - 3 ELSE e = before AND before >= today - 3 END AS may FROM k),
f AS (SELECT *, min(CASE WHEN may THEN run END) OVER (PARTITION BY ledger, now) AS first FROM a)
SELECT ledger, run, CASE WHEN e < before THEN 'refused_truncate'
    WHEN e = before THEN CASE WHEN first < run THEN 'no_new_market_data' WHEN may THEN 'decision_recovered' ELSE 'refused_stale' END
    WHEN bad THEN 'refused_fetch_errors' WHEN now <= before THEN 'no_new_trading_day' WHEN may THEN 'decision_recorded' ELSE 'refused_stale' END AS status,
  now::DATE AS market_day, max(CASE WHEN first = run THEN now END) OVER (PARTITION BY ledger ORDER BY run)::DATE AS decision_day FROM f""",
}
