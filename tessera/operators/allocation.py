"""Monthly allocation between a risky and a defensive security: momentum, a volatility target, and confirmation by a forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Months of momentum, days of volatility, target and least weight factor without confirmation.
MOMENTUM_MONTHS, VOLATILITY_DAYS, TARGET, UNCONFIRMED = 12, 60, 0.10, 0.5


def month_signals(risk: DataFrame, defensive: DataFrame) -> DataFrame:
    """One row for each month: momentum, volatility and base weight at its last day, and both securities' returns from the next month's first open to the one after's.

    Bars of one security (trade_date, open, close); its months are few, so their ordered windows are small.
    """
    day, month = W.orderBy("trade_date"), W.orderBy("month")
    change = F.col("close") / F.lag("close").over(day) - 1
    moved = risk.withColumn("__r", change).withColumns({"__vol": F.stddev_pop("__r").over(day.rowsBetween(-VOLATILITY_DAYS + 1, 0)), "__n": F.count("__r").over(day.rowsBetween(-VOLATILITY_DAYS + 1, 0))})
    by_month = moved.groupBy(F.trunc("trade_date", "month").alias("month")).agg(F.max_by(F.struct("close", "__vol", "__n"), "trade_date").alias("last"), F.min_by("open", "trade_date").alias("risk_open"))
    other = defensive.groupBy(F.trunc("trade_date", "month").alias("month")).agg(F.min_by("open", "trade_date").alias("def_open"))
    both = by_month.join(other, "month")
    vol = F.when(F.col("last.__n") >= 2, F.col("last.__vol") * F.sqrt(F.lit(252.0))).otherwise(0.0)
    ahead = lambda c: F.lead(c, 2).over(month) / F.lead(c, 1).over(month) - 1
    out = both.select("month", (F.col("last.close") / F.lag("last.close", MOMENTUM_MONTHS).over(month) - 1).alias("momentum_12m"), vol.alias("volatility_60d"), ahead("risk_open").alias("risk_return"), ahead("def_open").alias("def_return"), F.lead("month", 1).over(month).alias("trade_month"))
    weight = F.when((F.col("momentum_12m") > 0) & (F.col("volatility_60d") > 0), F.least(TARGET / F.col("volatility_60d"), F.lit(1.0))).otherwise(0.0)
    return out.filter("momentum_12m IS NOT NULL AND risk_return IS NOT NULL").withColumn("base_weight", weight)


def allocate(signals: DataFrame, confirmations: dict[str, str], costs_bps: tuple[float, ...] = (5.0, 10.0, 20.0)) -> DataFrame:
    """Long rows of strategies: buy_hold, trend, and one for each column of accelerations, which halves the weight unless it is positive."""
    base = F.col("base_weight")
    weights = {"buy_hold": F.lit(1.0), "trend": base} | {name: F.when(F.col(c) > 0, base).otherwise(UNCONFIRMED * base) for name, c in confirmations.items()}
    long = signals.select("month", "trade_month", "risk_return", "def_return", F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), w.cast("double").alias("risk_weight")) for n, w in weights.items()])).alias("s")).select("*", "s.*").drop("s")
    w = W.partitionBy("strategy").orderBy("month")
    start = F.when(F.col("strategy") == "buy_hold", 1.0).otherwise(0.0)
    turned = long.withColumn("turnover", F.abs(F.col("risk_weight") - F.coalesce(F.lag("risk_weight").over(w), start))).withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs_bps])))
    net = F.col("risk_weight") * F.col("risk_return") + (1 - F.col("risk_weight")) * F.col("def_return") - F.col("turnover") * F.col("cost_bps") / 10000
    return turned.withColumn("net_return", net).withColumn("nav", F.product(1 + F.col("net_return")).over(W.partitionBy("strategy", "cost_bps").orderBy("month").rowsBetween(W.unboundedPreceding, 0)))


def monthly_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Annual return and volatility, Sharpe, Calmar, drawdown from the running peak of the NAV, share of winning months and annual turnover."""
    w = W.partitionBy(*keys).orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    n, total = F.count(F.lit(1)), F.product(1 + F.col("net_return"))
    out = rows.withColumn("__fall", F.col("nav") / F.max("nav").over(w) - 1).groupBy(*keys).agg(
        n.alias("months"), F.when(total > 0, F.pow(total, 12 / n) - 1).otherwise(-1.0).alias("annual_return"), F.when(n >= 2, F.stddev_pop("net_return") * F.sqrt(F.lit(12.0))).otherwise(0.0).alias("annual_volatility"),
        F.min("__fall").alias("max_drawdown"), F.avg((F.col("net_return") > 0).cast("double")).alias("monthly_win_rate"), (F.sum("turnover") * 12 / n).alias("annual_turnover"), F.min("net_return").alias("worst_month"),
    )
    ratio = lambda d: F.when(d != 0, F.col("annual_return") / d).otherwise(0.0)
    return out.withColumns({"sharpe": ratio(F.col("annual_volatility")), "calmar": ratio(F.abs("max_drawdown"))})
