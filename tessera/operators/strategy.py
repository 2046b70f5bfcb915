"""Positions, overlays, ledgers of daily results, and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.numbers import clip

#: Horizons, lookbacks, targets and weights of the strategies.
HORIZONS, FEATURE_LOOKBACK, VOLATILITY_LOOKBACK = (20, 60, 120), 126, 40
TARGET_VOLATILITY, VOLATILITY_FLOOR, LEAST_HISTORY, LEAST_RETURNS = 0.25, 0.08, 30, 20
TEXT_WINDOW, YEAR = 5, 252


def _days():
    return W.orderBy("day_idx")


def trend_scores(momentum: DataFrame, start: str, end: str, column: str = "momentum_20d") -> DataFrame:
    """tanh of momentum over its population deviation in [start, end]; a missing momentum counts 0, no deviation gives 0."""
    inside = F.when(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.col(column))
    scale = momentum.agg(F.when(F.count(inside) >= 2, F.stddev_pop(inside)).alias("validation_std"))
    score = F.when(F.col("validation_std") > 0, F.tanh(F.coalesce(F.col(column), F.lit(0.0)) / F.col("validation_std"))).otherwise(0.0)
    return momentum.crossJoin(F.broadcast(scale)).withColumn("trend_score", score)  # one row of scale


def mature_baseline(momentum: DataFrame, returns: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Mean of tanh(momentum / its own trailing deviation) over horizons, scaled down to the target volatility.

    A signal at close i uses momenta before i and market returns that were settled by open i.
    """
    warm = max(horizons)
    scored = momentum.join(returns.select("day_idx", "market_open_return"), "day_idx", "left")
    parts = []
    for h in horizons:
        m = F.when(F.col("day_idx") >= h, F.col(f"momentum_{h}d"))
        frame = _days().rangeBetween(-FEATURE_LOOKBACK, -1)
        scale = F.when(F.count(m).over(frame) >= LEAST_HISTORY, F.stddev_pop(m).over(frame))
        scored = scored.withColumn(f"__part_{h}", F.when(scale > 0, F.tanh(m / scale)))
        parts.append(F.col(f"__part_{h}"))
    settled, frame = F.when(F.col("day_idx") >= warm, F.col("market_open_return")), _days().rangeBetween(-VOLATILITY_LOOKBACK - 1, -2)
    volatility = F.when(F.count(settled).over(frame) >= LEAST_RETURNS, F.stddev_pop(settled).over(frame) * F.sqrt(F.lit(float(YEAR)))).otherwise(TARGET_VOLATILITY)
    known = F.filter(F.array(*parts), lambda x: x.isNotNull())
    composite = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    out = scored.withColumn("realized_volatility", volatility).filter(F.col("day_idx") >= warm).filter(F.size(known) > 0).withColumn("composite_momentum", composite)
    multiplier = F.least(F.lit(1.0), TARGET_VOLATILITY / F.greatest(F.col("realized_volatility"), F.lit(VOLATILITY_FLOOR)))
    return out.select("day_idx", F.col("trade_date").alias("signal_date"), "composite_momentum", "realized_volatility", multiplier.alias("volatility_multiplier")).withColumn("position", clip(F.col("composite_momentum") * F.col("volatility_multiplier")))


def decayed_text_scores(events: DataFrame, days: DataFrame, score: str = "score", confidence: str = "confidence", window: int = TEXT_WINDOW) -> DataFrame:
    """For each day the mean of the scores of the last ``window`` days' events, weighted by confidence and a linear decay; 0 without events.

    ``events`` carry day_idx; each is spread over the days that it reaches before it is summed.
    """
    weight = F.col(confidence) * (window - F.col("__age")) / window
    spread = events.withColumn("__age", F.explode(F.sequence(F.lit(0), F.lit(window - 1)))).select((F.col("day_idx") + F.col("__age")).alias("day_idx"), (F.col(score) * weight).alias("__a"), weight.alias("__b"))
    sums = spread.groupBy("day_idx").agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    value = F.when(F.col("__b") > 0, F.col("__a") / F.col("__b")).otherwise(0.0)
    return days.select("day_idx").join(sums, "day_idx", "left").select("day_idx", F.coalesce(value, F.lit(0.0)).alias("active_text_score"))


def overlay(baseline: Column, text: Column, weight: float = 0.25) -> Column:
    """Text adds to a long baseline that it confirms; else the baseline stands."""
    return F.when((baseline > 0) & (text > 0), clip(baseline + weight * text)).otherwise(baseline)


def blend(trend: Column, text: Column, share: float = 0.3) -> Column:
    return clip((1 - share) * trend + share * text)


def additive(trend: Column, text: Column, weight: float = 4.0) -> Column:
    return clip(trend + weight * text)


def confirm_only(trend: Column, text: Column, weight: float = 0.25) -> Column:
    return F.when(trend * text > 0, clip(trend + weight * text)).otherwise(trend)


def strategy_rows(positions: DataFrame, returns: DataFrame, strategies: list[str], costs_bps: list[float], carried: list[str] = []) -> DataFrame:
    """Long rows (strategy, cost) with turnover, net return and NAV.

    ``positions`` has one column for each strategy.  Days without a market return are left out before turnover is taken, so the position held before them counts.
    """
    own = [c for c in carried if c not in ("market_open_return", "trade_date")]
    met = positions.select("day_idx", *strategies, *own).join(returns.select("day_idx", "signal_date", "trade_date", "market_open_return"), "day_idx")
    long = met.select("day_idx", "signal_date", "trade_date", "market_open_return", *own, F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("position")) for s in strategies])).alias("__s")).select("*", "__s.strategy", "__s.position").drop("__s")
    w = W.partitionBy("strategy").orderBy("day_idx")
    turned = long.withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))))
    priced = turned.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs_bps])))
    net = priced.withColumn("net_return", F.col("position") * F.col("market_open_return") - F.col("turnover") * F.col("cost_bps") / 10000)
    return net.withColumn("nav", F.product(1 + F.col("net_return")).over(W.partitionBy("strategy", "cost_bps").orderBy("day_idx").rowsBetween(W.unboundedPreceding, 0)))


def strategy_metrics(rows: DataFrame, keys: list[str], grid: DataFrame | None = None, order: str = "trade_date", per_year: int = YEAR) -> DataFrame:
    """Observations, annual return and volatility, Sharpe, largest drawdown (from 1.0) and annual turnover of each group; zeros for keys of ``grid`` without rows."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    run = rows.withColumn("__nav", F.product(1 + F.col("net_return")).over(w)).withColumn("__fall", F.col("__nav") / F.greatest(F.lit(1.0), F.max("__nav").over(w)) - 1)
    total, n = F.product(1 + F.col("net_return")), F.count(F.lit(1))
    out = run.groupBy(*keys).agg(
        n.alias("observations"), F.when(total > 0, F.pow(total, per_year / n) - 1).otherwise(-1.0).alias("annual_return"),
        F.when(n >= 2, F.stddev_pop("net_return") * F.sqrt(F.lit(float(per_year)))).otherwise(0.0).alias("annual_volatility"),
        F.least(F.lit(0.0), F.min("__fall")).alias("max_drawdown"), (F.sum("turnover") * per_year / n).alias("annual_turnover"),
    ).withColumn("sharpe", F.when(F.col("annual_volatility") != 0, F.col("annual_return") / F.col("annual_volatility")).otherwise(0.0))
    if grid is not None:
        out = grid.join(out, keys, "left").na.fill(0)
    return out


def paired_differences(rows: DataFrame, base: str, other: str, keys: list[str] = ["trade_date"]) -> DataFrame:
    """other - base of net returns on the days that both have."""
    both = rows.filter(F.col("strategy").isin(base, other)).groupBy(*keys).agg(F.max(F.when(F.col("strategy") == base, F.col("net_return"))).alias("__a"), F.max(F.when(F.col("strategy") == other, F.col("net_return"))).alias("__b"))
    return both.filter("__a IS NOT NULL AND __b IS NOT NULL").select(*keys, (F.col("__b") - F.col("__a")).alias("difference"))


def settle(decisions: DataFrame, main: DataFrame, bars: DataFrame) -> DataFrame:
    """Decisions (decision_id, recorded_at text, signal_date, selected_contract) with their settlement, or the reason why there is none."""
    days = main.select("day_idx", F.col("trade_date").alias("signal_date"), F.lead("trade_date", 1).over(_days()).alias("entry_date"), F.lead("trade_date", 2).over(_days()).alias("exit_date"))
    opens = lambda day, name: bars.select(F.col("trade_date").alias(day), F.col("contract").alias("selected_contract"), F.col("open").alias(name))
    met = decisions.join(days, "signal_date", "left").join(opens("entry_date", "entry_open"), ["entry_date", "selected_contract"], "left").join(opens("exit_date", "exit_open"), ["exit_date", "selected_contract"], "left")
    written = F.try_to_date(F.substring("recorded_at", 1, 10), "yyyy-MM-dd")
    reason = (
        F.when(F.col("day_idx").isNull(), "signal_date_not_trading_day").when(F.col("entry_date").isNull(), "entry_pending")
        .when(written.isNull(), "invalid_recorded_at").when(written >= F.col("entry_date"), "recorded_after_entry_open")
        .when(F.col("exit_date").isNull(), "exit_pending").when(F.col("entry_open").isNull() | F.col("exit_open").isNull(), "contract_bar_missing").otherwise("settled")
    )
    return met.withColumn("settlement", reason).withColumn("market_open_return", F.when(F.col("settlement") == "settled", F.col("exit_open") / F.col("entry_open") - 1))


def quarterly_increments(rows: DataFrame, base: str, other: str, per_year: int = YEAR) -> DataFrame:
    """(quarter, observations, annualized_difference) of the days that both strategies have."""
    days = paired_differences(rows, base, other)
    quarter = F.concat(F.year("trade_date").cast("string"), F.lit("Q"), F.quarter("trade_date").cast("string"))
    return days.groupBy(quarter.alias("quarter")).agg(F.count(F.lit(1)).alias("observations"), (F.avg("difference") * per_year).alias("annualized_difference"))


def weight_grid(trend: DataFrame, text: DataFrame, returns: DataFrame, weights: list[float], until: str, since: str, cost_bps: float = 5.0) -> DataFrame:
    """Metrics of the additive strategy for each weight on days after ``since`` up to ``until``, and which weight is chosen: the largest Sharpe ratio, then the smaller weight.

    ``trend``: day_idx, trend_score; ``text``: day_idx, active_text_score.  Positions and returns after ``until`` aren't read.
    """
    own = trend.join(text, "day_idx").select("day_idx", *[additive(F.col("trend_score"), F.col("active_text_score"), w).alias(f"w{i}") for i, w in enumerate(weights)])
    rows = strategy_rows(own, returns.filter(F.col("trade_date") <= F.lit(until).cast("date")), [f"w{i}" for i in range(len(weights))], [cost_bps])
    metrics = strategy_metrics(rows.filter(F.col("trade_date") > F.lit(since).cast("date")), ["strategy"])
    named = metrics.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.substring("strategy", 2, 10).cast("int"))).drop("strategy")
    return named.withColumn("chosen", F.row_number().over(W.orderBy(F.desc("sharpe"), "weight")) == 1)  # a row for each weight
