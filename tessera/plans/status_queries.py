"""Queries over the state of tables, ledgers and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbers import rounded as r
from tessera.operators import market, status, strategy
from tessera.plans import views as v
from tessera.plans.views import DATED, MAIN


def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.dated(spark, sf_dir, "source")
    return status.table_status(docs, "source", "publish_time", {"src0": 1_000_000}).select("value", "n", "first_day", "last_day", F.col("remaining").cast("long").alias("remaining"))


def prospective_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v.bars(spark, sf_dir)
    day = F.date_add(F.lit("1995-01-02").cast("date"), (F.col("o_orderkey") % 2499).cast("int"))
    decisions = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("decision_id"), day.alias("signal_date"), day.cast("string").alias("recorded_at"), F.lit("NO").alias("selected_contract"))
    return status.monitor(strategy.settle(decisions, market.main_continuous(b), b))


def annotation_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that a cache (of those with an even id, one of five failed) doesn't cover."""
    items = v.table(spark, sf_dir, "benchmark")
    key = status.annotation_key(["item_id", "text"], "m", "1")
    cache = items.filter("item_id % 2 = 0").select(key.alias("cache_key"), F.when(F.col("item_id") % 5 == 0, "failed").otherwise("success").alias("status"))
    return status.to_annotate(items, cache, ["item_id", "text"], "m", "1").select("item_id")


def event_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as outcomes of runs."""
    events = v.table(spark, sf_dir, "events").select(F.when(F.col("value") > 50, "success").otherwise("failed").alias("status"), F.when(F.col("value") > 50, "").when(F.col("value") > 25, "HTTP 429").otherwise("read Timeout").alias("reason"))
    return status.failures(events)


def predicted_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals as predictions, over a baseline by their day."""
    signals = v.signals(spark, sf_dir).withColumn("baseline", F.when(F.col("doc_id") % 13 != 0, ((F.col("doc_id") % 21) - 10) / 10.0))
    out = signals.withColumn("p", status.prediction_position(F.col("score"), F.array_contains("agreed", "authoritative_source"), F.col("baseline")))
    return out.select("doc_id", "p.status", r(F.col("p.position")).alias("position"))


QUERIES = {q.__name__: q for q in (source_status, prospective_monitor, annotation_backlog, event_failures, predicted_positions)}
DATES = {"source_status": ["first_day", "last_day"]}
SQL = {
    "source_status": f"WITH {DATED} SELECT source AS value, count(*) AS n, min(publish_time) AS first_day, max(publish_time) AS last_day, (CASE WHEN source = 'src0' THEN greatest(1000000 - count(*), 0) ELSE 0 END)::BIGINT AS remaining FROM dated GROUP BY 1",
    "prospective_monitor": f"""WITH {MAIN},
days AS (SELECT trade_date AS signal_date, lead(trade_date, 1) OVER (ORDER BY day_idx) AS e, lead(trade_date, 2) OVER (ORDER BY day_idx) AS x FROM main),
d AS (SELECT (DATE '1995-01-02' + (o_orderkey % 2499)::INTEGER)::DATE AS signal_date FROM orders),
s AS (SELECT e, CASE WHEN days.signal_date IS NULL THEN 'signal_date_not_trading_day' WHEN e IS NULL THEN 'entry_pending' WHEN x IS NULL THEN 'exit_pending' WHEN i.open IS NULL OR o.open IS NULL THEN 'contract_bar_missing' ELSE 'settled' END AS t
  FROM d LEFT JOIN days USING (signal_date) LEFT JOIN bars i ON i.trade_date = e AND i.contract = 'NO' LEFT JOIN bars o ON o.trade_date = x AND o.contract = 'NO')
SELECT count(*) FILTER (t = 'settled') AS settled, count(*) FILTER (t LIKE '%_pending') AS pending, count(DISTINCT e) FILTER (t = 'settled') AS settled_days, 63 AS required_days, count(DISTINCT e) FILTER (t = 'settled') >= 63 AS ready FROM s""",
    "annotation_backlog": "SELECT item_id FROM benchmark WHERE item_id % 2 <> 0 OR item_id % 5 = 0",
    "event_failures": "SELECT CASE WHEN value > 50 THEN 'success' ELSE 'failed' END AS status, CASE WHEN value > 50 THEN 'none' WHEN value > 25 THEN 'rate_limit' ELSE 'timeout' END AS category, count(*) AS n FROM events GROUP BY 1, 2",
    "predicted_positions": f"""WITH {v.SIGNALS}, b AS (SELECT *, CASE WHEN doc_id % 13 <> 0 THEN ((doc_id % 21) - 10) / 10.0 END AS base FROM signals),
x AS (SELECT *, CASE WHEN base IS NULL THEN 'no_baseline' WHEN NOT authoritative THEN 'text_not_eligible' WHEN base <= 0 THEN 'baseline_not_long' WHEN NOT score > 0 THEN 'text_not_positive' ELSE 'confirmed' END AS status FROM b)
SELECT doc_id, status, round(CASE WHEN status = 'confirmed' THEN greatest(-1, least(1, base + 0.25 * score)) ELSE coalesce(base, 0) END, 6) + 0.0 AS position FROM x""",
}
