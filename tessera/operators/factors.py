"""Cross-sectional factors: forward and excess returns, ranks, quintiles, priors and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.dates import recency
from tessera.functions.numbers import beta_posterior, correlation


def forward_returns(bars: DataFrame, days: int = 5, entity: str = "entity") -> DataFrame:
    """From each day's open to the close ``days - 1`` bars later of the same entity."""
    w = W.partitionBy(entity).orderBy("trade_date")
    return bars.withColumn(f"forward_return_{days}d", F.lead("close", days - 1).over(w) / F.col("open") - 1)


def event_returns(events: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = (5, 10), entity: str = "entity") -> DataFrame:
    """Events with entry and exits on the first bars after them; an event needs as many bars as the longest horizon."""
    w = W.partitionBy(entity).orderBy("trade_date")
    ahead = bars.select(entity, "trade_date", F.col("open").alias("entry_open"), *[x for h in horizons for x in (F.lead("close", h - 1).over(w).alias(f"exit_close_{h}d"), F.lead("trade_date", h - 1).over(w).alias(f"exit_date_{h}d"))])
    from tessera.operators.asof import asof_forward

    values = [c for c in ahead.columns if c not in (entity, "trade_date")]
    met = asof_forward(events, ahead, [entity], "event_time", "trade_date", values, inclusive=False).filter(F.col(f"exit_close_{max(horizons)}d").isNotNull())
    return met.select(*events.columns, F.col("trade_date").alias("entry_trade_date"), *[x for h in horizons for x in (F.col(f"exit_date_{h}d"), (F.col(f"exit_close_{h}d") / F.col("entry_open") - 1).alias(f"forward_return_{h}d"))])


def excess_over(df: DataFrame, value: str, keys: list[str], name: str = "excess") -> DataFrame:
    """value less the mean of its group (sector and day)."""
    return df.withColumn(name, F.col(value) - F.avg(value).over(W.partitionBy(*keys)))


def tie_rank(value: str, keys: list[str]) -> Column:
    """Rank from 1 in the order of ``value``; ties share their mean rank."""
    return F.rank().over(W.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, value)) - 1) / 2


def rank_correlation(df: DataFrame, x: str, y: str, keys: list[str], least: int = 3) -> DataFrame:
    """Spearman's correlation of each group with at least ``least`` rows and two distinct values of both."""
    good = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = good.withColumns({"__x": tie_rank(x, keys), "__y": tie_rank(y, keys)})
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("__x"), F.col("__y")).alias("rank_ic"))
    return out.filter((F.col("n") >= least) & F.col("rank_ic").isNotNull())


def quantile_groups(df: DataFrame, factor: str, keys: list[str], groups: int = 5) -> DataFrame:
    """Add bucket 1..groups by tie-averaged rank within each group of ``keys``."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    bucket = F.least(F.lit(groups), F.floor((tie_rank(factor, keys) - 1) * groups / n) + 1).cast("int")
    return df.filter(F.col(factor).isNotNull()).withColumn("bucket", bucket)


def group_returns(df: DataFrame, factor: str, value: str, keys: list[str], groups: int = 5) -> DataFrame:
    return quantile_groups(df, factor, keys, groups).groupBy("bucket").agg(F.avg(value).alias("mean_return"), F.count(F.lit(1)).alias("n"))


def z_score(value: str, keys: list[str]) -> Column:
    """Population z-score within each group; 0 without deviation."""
    w = W.partitionBy(*keys)
    return F.when(F.stddev_pop(value).over(w) > 0, (F.col(value) - F.avg(value).over(w)) / F.stddev_pop(value).over(w)).otherwise(0.0)


def ic_summary(ic: DataFrame, keys: list[str] = []) -> DataFrame:
    """Mean rank correlation, its ratio to its population deviation, and the share of positive days."""
    sd = F.stddev_pop("rank_ic")
    return ic.groupBy(*keys).agg(F.count(F.lit(1)).alias("dates"), F.avg("rank_ic").alias("rank_ic_mean"), F.when(sd > 0, F.avg("rank_ic") / sd).otherwise(0.0).alias("ic_ir"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_share"))


def impact_priors(events: DataFrame, threshold: float = 0.02, kind: str = "event_type", value: str = "excess") -> DataFrame:
    """Posterior that a document of a type moves by ``threshold``: documents' mean excess first, then hits of all."""
    documents = events.groupBy(kind, "doc_id").agg(F.avg(value).alias("__r"))
    out = documents.groupBy(kind).agg(F.count(F.lit(1)).alias("document_count"), F.count_if(F.abs("__r") >= threshold).alias("hit_count"))
    return out.withColumn("posterior", beta_posterior(F.col("hit_count"), F.col("document_count")))


def event_factors(triggers: DataFrame, evidence: str = "evidence", prior: str = "prior") -> DataFrame:
    """Best trigger (score, then rule_id) of each event and label family, weighed by evidence and the type's prior."""
    best = triggers.groupBy("event_id", "label").agg(F.min_by(F.struct(*triggers.columns), F.struct(-F.col("score"), "rule_id")).alias("b")).select("b.*")
    return best.withColumn("factor_value", F.col("score") * (0.7 * F.col(evidence) + 0.3 * F.col(prior)))


def snapshot(factors: DataFrame, as_of: str | Column, entity: str = "entity", sector: str = "sector", half_life: float = 45.0) -> DataFrame:
    """Decayed sum of each entity's factors up to ``as_of``, and its z-score within the sector."""
    at = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    known = factors.filter(F.col("trade_date") <= at)
    sums = known.groupBy(entity, sector).agg(F.sum(F.col("factor_value") * recency(F.datediff(at, F.col("trade_date")), half_life)).alias("raw_score"), F.count(F.lit(1)).alias("events"))
    return sums.withColumn("score_z", z_score("raw_score", [sector]))


def burst(events: DataFrame, entity: str = "entity", day: str = "day") -> DataFrame:
    """Counts of each entity's last 7 days and of the 30 days before those."""
    n = F.datediff(F.col(day), F.lit("1970-01-01"))
    counts = events.groupBy(entity, day).agg(F.count(F.lit(1)).alias("n")).withColumn("__d", n)
    w = W.partitionBy(entity).orderBy("__d")
    both = {"last_7": F.sum("n").over(w.rangeBetween(-6, 0)), "before_30": F.coalesce(F.sum("n").over(w.rangeBetween(-36, -7)), F.lit(0))}
    return counts.withColumns(both).drop("__d")


def dense_panel(factors: DataFrame, returns: DataFrame, entity: str = "entity", day: str = "trade_date", factor: str = "factor_value", value: str = "excess") -> DataFrame:
    """(day, entity, factor, value) for every entity with a return on a day on which any entity has a factor; 0 where it has none, the sum where it has several."""
    days = factors.select(day).distinct()
    sums = factors.groupBy(day, entity).agg(F.sum(factor).alias(factor))
    return returns.select(day, entity, value).join(days, day, "left_semi").join(sums, [day, entity], "left").select(day, entity, F.coalesce(factor, F.lit(0.0)).alias(factor), value)


def cohort_rank(value: str, keys: list[str]) -> Column:
    """Place of a value between its cohort's least and largest, from 0 to 1; 0.5 in a cohort without spread."""
    w = W.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.5)


def dominant(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of several the one that comes first by ``order``."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__first"))
    return counts.groupBy(*keys).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("__first"))).alias("__b")).select(*keys, f"__b.{value}", "__b.n")
