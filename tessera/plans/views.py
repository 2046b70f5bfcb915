"""Views of the given tables as bars, dated documents, annotations and targets; each with the SQL that defines the same view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dates import period_end, period_start
from tessera.operators.iterate import saved
from tessera.operators.market import main_continuous

#: Trading days up to which a bar counts as discovery or validation.
DISCOVERY_END, VALIDATION_END = "1998-12-31", "1999-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the contracts (return flag and line status) of line items: one aggregation, whose days times contracts rows are written once for the plans that read them often."""
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    price, key = 10000 + F.col("l_extendedprice") / F.col("l_quantity") / 10, F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    days = lines.groupBy(F.col("l_shipdate").cast("date").alias("trade_date"), F.concat("l_returnflag", "l_linestatus").alias("contract")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"),
        F.sum("l_quantity").alias("volume"), F.count_distinct("l_orderkey").cast("double").alias("open_interest"),
    )
    return saved(days)


BARS = """bars AS (
  SELECT CAST(l_shipdate AS DATE) AS trade_date, l_returnflag || l_linestatus AS contract,
         arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close,
         sum(l_quantity) AS volume, count(DISTINCT l_orderkey)::DOUBLE AS open_interest
  FROM (SELECT *, 10000 + l_extendedprice / l_quantity / 10 AS price,
               {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_extendedprice, 'f': l_quantity} AS k FROM lineitem)
  GROUP BY 1, 2)"""

MAIN = BARS + """,
main AS (
  SELECT *, row_number() OVER (ORDER BY trade_date) - 1 AS day_idx, coalesce(contract <> lag(contract) OVER (ORDER BY trade_date), false) AS rolled
  FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY open_interest DESC, volume DESC, contract DESC) AS rn FROM bars) WHERE rn = 1)"""

RETURNS = MAIN + """,
returns AS (
  SELECT p.day_idx, p.signal_date, p.entry_date AS trade_date, p.exit_date, p.contract, o.open / e.open - 1 AS market_open_return
  FROM (SELECT day_idx, trade_date AS signal_date, contract, lead(trade_date, 1) OVER (ORDER BY trade_date) AS entry_date, lead(trade_date, 2) OVER (ORDER BY trade_date) AS exit_date FROM main) p
  JOIN bars e ON e.trade_date = p.entry_date AND e.contract = p.contract
  JOIN bars o ON o.trade_date = p.exit_date AND o.contract = p.contract)"""

MOMENTUM = RETURNS + """,
momentum AS (
  SELECT m.day_idx, m.trade_date, m.contract, m.close / b20.close - 1 AS momentum_20d, m.close / b60.close - 1 AS momentum_60d, m.close / b120.close - 1 AS momentum_120d
  FROM main m
  LEFT JOIN main d20 ON d20.day_idx = m.day_idx - 20 LEFT JOIN bars b20 ON b20.trade_date = d20.trade_date AND b20.contract = m.contract
  LEFT JOIN main d60 ON d60.day_idx = m.day_idx - 60 LEFT JOIN bars b60 ON b60.trade_date = d60.trade_date AND b60.contract = m.contract
  LEFT JOIN main d120 ON d120.day_idx = m.day_idx - 120 LEFT JOIN bars b120 ON b120.trade_date = d120.trade_date AND b120.contract = m.contract)"""


def main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_continuous(bars(spark, sf_dir))


def dated(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents with a publication day.  Only the columns asked for are read."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", *columns).withColumn("publish_time", F.date_add(F.lit("1995-01-02").cast("date"), (F.col("doc_id") % 2499).cast("int")))


DATED = "dated AS (SELECT *, CAST('1995-01-02' AS DATE) + CAST(doc_id % 2499 AS INTEGER) AS publish_time FROM documents)"

#: Flags of a document's text: name, and its expression in both dialects.
FLAGS = {
    "has_digit": ("regexp_like(text, '[0-9]')", "regexp_matches(text, '[0-9]')"),
    "has_license": ("contains(lower(text), 'licens')", "contains(lower(text), 'licens')"),
    "has_percent": ("contains(text, '%')", "contains(text, '%')"),
    "long_text": ("length(text) >= 2000", "length(text) >= 2000"),
    "many_lines": ("length(text) - length(replace(text, '\\n', '')) >= 10", "length(text) - length(replace(text, chr(10), '')) >= 10"),
    "piped": ("contains(text, ' | ')", "contains(text, ' | ')"),
    "shouting": ("contains(text, '!!')", "contains(text, '!!')"),
}


def flagged(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = dated(spark, sf_dir, "text", *columns)
    return docs.select("doc_id", "publish_time", *columns, *[F.expr(e[0]).alias(n) for n, e in FLAGS.items()])


FLAGGED = DATED + ",\nflagged AS (SELECT doc_id, publish_time, lang, source, n_chars, " + ", ".join(f"{e[1]} AS {n}" for n, e in FLAGS.items()) + " FROM dated)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with the names of their true flags and a direction."""
    names = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in FLAGS]))
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "bullish").when(F.col("quality") == 0, "bearish").otherwise("neutral")
    return flagged(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "publish_time", names.alias("names"), label.alias("direction_label"))


RECORDS = FLAGGED + """,
records AS (
  SELECT doc_id, publish_time, list_filter([""" + ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in FLAGS) + """], lambda x: x IS NOT NULL) AS names,
         CASE WHEN quality = 1 AND toxic = 0 THEN 'bullish' WHEN quality = 0 THEN 'bearish' ELSE 'neutral' END AS direction_label
  FROM flagged JOIN labels USING (doc_id))"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored signals with the predicates that both annotators agree on."""
    agreed = F.array_compact(F.array(F.when(~F.col("piped"), "authoritative_source"), F.when(F.col("has_percent"), "uncertainty_high")))
    return flagged(spark, sf_dir, "source").select(
        "doc_id", "publish_time", F.when(F.col("doc_id") % 50 != 0, F.col("source")).alias("source_name"), agreed.alias("agreed"),
        (((F.col("doc_id") * 7919) % 201 - 100) / 100.0).alias("score"), ((F.col("doc_id") % 11) / 10.0).alias("confidence"),
    )


SIGNALS = FLAGGED + """,
signals AS (
  SELECT doc_id, publish_time, CASE WHEN doc_id % 50 <> 0 THEN source END AS source_name, NOT piped AS authoritative, has_percent AS uncertain,
         ((doc_id * 7919) % 201 - 100) / 100.0 AS score, (doc_id % 11) / 10.0 AS confidence FROM flagged)"""


def entity_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of suppliers, in five sectors, with a factor: the mean discount, added up in the order of the stored rows, as ranks and thresholds tell sums of another order apart."""
    lines = table(spark, sf_dir, "lineitem").select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    discounts = F.array_sort(F.collect_list(F.when(F.col("l_discount").isNotNull(), F.struct("__file", "__row", "l_discount"))))
    mean = lambda x: F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, d: a + d["l_discount"]), F.size(x))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    key = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return lines.groupBy(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("trade_date"), F.col("l_suppkey").alias("entity")).agg(
        F.min_by(price, key).alias("open"), F.max_by(price, key).alias("close"), discounts.alias("factor"),
    ).withColumn("factor", mean(F.col("factor"))).withColumn("sector", F.col("entity") % 5)


ENTITY_BARS = """ebars AS (
  SELECT date_trunc('month', l_shipdate)::DATE AS trade_date, l_suppkey AS entity, l_suppkey % 5 AS sector, arg_min(price, k) AS open, arg_max(price, k) AS close, avg(l_discount) AS factor
  FROM (SELECT *, l_extendedprice / l_quantity AS price, {'z': l_shipdate, 'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'e': l_extendedprice, 'f': l_quantity} AS k FROM lineitem)
  GROUP BY 1, 2, 3)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order value of each observation period, released 18 days after its end."""
    day = F.col("o_orderdate").cast("date")
    out = table(spark, sf_dir, "orders").groupBy(period_start(day).alias("period_start"), period_end(day).alias("period_end")).agg((F.avg("o_totalprice") / 1000).alias("actual"), F.count(F.lit(1)).alias("orders"))
    return out.withColumn("release_date", F.date_add("period_end", 18))


TARGETS = """targets AS (
  SELECT period_start, period_end, avg(o_totalprice) / 1000 AS actual, count(*) AS orders, (period_end + 18)::DATE AS release_date
  FROM (SELECT *, CASE WHEN month(o_orderdate) <= 2 THEN make_date(year(o_orderdate), 1, 1) ELSE date_trunc('month', o_orderdate)::DATE END AS period_start,
               CASE WHEN month(o_orderdate) <= 2 THEN last_day(make_date(year(o_orderdate), 2, 1)) ELSE last_day(o_orderdate::DATE) END AS period_end FROM orders)
  GROUP BY 1, 2)"""
