"""Market series: the main continuous contract, its returns, momentum and forward labels.

Bars are keyed by (trade_date, contract).  Everything that steps in trading days
is an equi-join on the day's ordinal, so no operator walks through a series.  The
main series has one row for each trading day, so its ordered windows are small
whatever the size of the bars; the heavy steps group and join by day and contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _by_day():
    return W.orderBy("trade_date")


def main_continuous(bars: DataFrame) -> DataFrame:
    """The contract with the largest open interest each day, then volume, then name; by volume where no contract has open interest."""
    rank = F.struct(F.coalesce("open_interest", F.lit(-1.0)), "volume", "contract")
    best = bars.groupBy("trade_date").agg(
        F.max_by(F.struct("contract", "open", "high", "low", "close", "volume", "open_interest"), rank).alias("b"),
        F.when(F.max(F.col("open_interest").isNotNull()), "open_interest").otherwise("volume").alias("selection_basis"),
    )
    out = best.select("trade_date", "b.*", "selection_basis")
    return out.withColumns({"day_idx": F.row_number().over(_by_day()) - 1, "rolled": F.coalesce(F.col("contract") != F.lag("contract").over(_by_day()), F.lit(False))})


def next_open_returns(main: DataFrame, bars: DataFrame) -> DataFrame:
    """Signal at close i, in at open i + 1, out at open i + 2, of the contract that was selected at close i; days without both opens are left out."""
    plan = main.select("day_idx", F.col("trade_date").alias("signal_date"), "contract", F.lead("trade_date", 1).over(_by_day()).alias("entry_date"), F.lead("trade_date", 2).over(_by_day()).alias("exit_date"))
    entry = bars.select(F.col("trade_date").alias("entry_date"), "contract", F.col("open").alias("entry_open"))
    leave = bars.select(F.col("trade_date").alias("exit_date"), "contract", F.col("open").alias("exit_open"))
    met = plan.join(entry, ["entry_date", "contract"]).join(leave, ["exit_date", "contract"])
    return met.select("day_idx", "signal_date", F.col("entry_date").alias("trade_date"), "exit_date", "contract", (F.col("exit_open") / F.col("entry_open") - 1).alias("market_open_return"))


def same_contract_momentum(main: DataFrame, bars: DataFrame, horizons: list[int]) -> DataFrame:
    """momentum_{h}d: today's close over the close of the same contract h trading days ago; null where that contract had no bar."""
    out = main.select("day_idx", "trade_date", "contract", "close")
    days = main.select(F.col("day_idx").alias("__at"), F.col("trade_date").alias("__day"))
    closes = bars.select(F.col("trade_date").alias("__day"), "contract", F.col("close").alias("__close"))
    past = days.join(closes, "__day").select("__at", "contract", "__close")  # once for all horizons
    for h in horizons:
        lagged = past.select((F.col("__at") + h).alias("day_idx"), "contract", F.col("__close").alias(f"__close_{h}"))
        out = out.join(lagged, ["day_idx", "contract"], "left").withColumn(f"momentum_{h}d", F.col("close") / F.col(f"__close_{h}") - 1).drop(f"__close_{h}")
    return out


def continuous_momentum(main: DataFrame, horizons: list[int]) -> DataFrame:
    """momentum_{h}d over the continuous closes: for histories that come without bars of single contracts."""
    return main.select("day_idx", "trade_date", "contract", "close", *[(F.col("close") / F.lag("close", h).over(_by_day()) - 1).alias(f"momentum_{h}d") for h in horizons])


def forward_labels(documents: DataFrame, main: DataFrame, bars: DataFrame, horizon: int = 5, threshold: float = 0.01, day: str = "publish_time") -> DataFrame:
    """Open-to-open return of ``horizon`` trading days from the first day after publication, in the contract that was main the day before.

    Documents whose horizon isn't over, or whose contract lacks a bar, have no row.
    """
    from tessera.operators.asof import on_calendar

    entry = on_calendar(documents, main.select("day_idx", "trade_date"), day, strict=True).filter("day_idx IS NOT NULL")
    known = main.select((F.col("day_idx") + 1).alias("day_idx"), F.col("contract").alias("known"))
    first = main.select("day_idx", F.col("contract").alias("own"))
    ends = main.select((F.col("day_idx") - horizon).alias("day_idx"), F.col("trade_date").alias("exit_trade_date"))
    opens = bars.select("trade_date", "contract", "open")
    met = (
        entry.join(known, "day_idx", "left").join(first, "day_idx").withColumn("contract", F.coalesce("known", "own")).drop("known", "own")
        .join(ends, "day_idx")
        .join(opens.withColumnRenamed("open", "__in"), ["trade_date", "contract"])
        .join(opens.select(F.col("trade_date").alias("exit_trade_date"), "contract", F.col("open").alias("__out")), ["exit_trade_date", "contract"])
    )
    r = F.col("__out") / F.col("__in") - 1
    label = F.when(r >= threshold, "bullish").when(r <= -threshold, "bearish").otherwise("neutral")
    return met.select(*documents.columns, F.col("trade_date").alias("entry_trade_date"), "exit_trade_date", r.alias("forward_open_return"), label.alias("direction_label"), F.lit(horizon).alias("horizon_days"), (F.col("trade_date") > F.col(day)).alias("future_info_ok"))
