"""Decisions that are frozen after a day's close: the position that follows from what was known by then, and digests that identify both.

Trading days are a small dimension, so their ordered windows are small; rows of the market and signals are hashed in place and summed by day before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.numbers import clip
from tessera.operators import asof, strategy
from tessera.operators.ledger import canonical, changed
from tessera.operators.market import continuous_momentum, same_contract_momentum

#: Days of history that a forecast's mapping needs, length of an id, and fields that a recorded decision never changes.
LEAST_DAYS, ID_LENGTH = 21, 24
IMMUTABLE = ["strategy_version", "signal_date", "selected_contract", "baseline_position", "active_text_score", "enhanced_position", "market_input_sha256", "signal_input_sha256"]


@dataclass(frozen=True)
class Policy:
    """A version's name and how it adds text to its baseline: ``confirm`` (where both have one sign), ``overlay`` (where both are positive) or ``additive``."""

    version: str
    combine: str
    weight: float
    cost_bps: float = 5.0
    execution_rule: str = "signal_close_then_next_available_open_to_following_open"

    def position(self, baseline: Column, text: Column) -> Column:
        how = {"confirm": strategy.confirm_only, "overlay": strategy.overlay, "additive": strategy.additive}
        return how[self.combine](baseline, text, self.weight)


def prefix_digests(rows: DataFrame, day: str, columns: list[str], days: DataFrame) -> DataFrame:
    """(day, rows, digest) of each of ``days`` (one column): how many rows came up to its end, and a digest of them whatever their order.

    A row's hash is taken in place, a day's hashes are summed in two lanes of 60 bits, and the sums of days run on; so every day's prefix
    takes one pass over the rows, and a later row changes no earlier digest.  It finds changes; it is no proof against someone who
    builds collisions.  Rows without a day belong to no prefix; repeated rows count as often as they stand.
    """
    lane = lambda at: F.sum(F.conv(F.substring("__h", at, 15), 16, 10).cast("decimal(38,0)"))
    hashed = rows.filter(F.col(day).isNotNull()).select(F.col(day).cast("date").alias("day"), F.sha2(canonical(columns), 256).alias("__h"))
    sums = hashed.groupBy("day").agg(F.count(F.lit(1)).alias("n"), lane(1).alias("a"), lane(16).alias("b"), F.lit(False).alias("asked"))
    none = F.lit(0).cast("decimal(38,0)")
    asked = days.toDF("day").filter("day IS NOT NULL").distinct().select(F.col("day").cast("date").alias("day"), F.lit(0).cast("long").alias("n"), none.alias("a"), none.alias("b"), F.lit(True).alias("asked"))
    by_day = sums.unionByName(asked).groupBy("day").agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in "nab"], F.max("asked").alias("asked"))
    w = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)  # a row for each day
    run = by_day.select("day", "asked", *[F.sum(c).over(w).alias(c) for c in "nab"]).filter("asked")
    return run.select("day", F.col("n").cast("long").alias("rows"), F.sha2(F.concat_ws(":", *[F.col(c).cast("decimal(38,0)").cast("string") for c in "nab"]), 256).alias("digest"))


def momentum_context(main: DataFrame, bars: DataFrame, horizons: list[int]) -> DataFrame:
    """momentum_{h}d of the selected contract's own closes.  Only if ``bars`` holds no row at all, of the continuous closes; a single missing bar gives null."""
    some = bars.limit(1).agg((F.count(F.lit(1)) > 0).alias("__some"))
    names = [f"momentum_{h}d" for h in horizons]
    smooth = continuous_momentum(main, horizons).select("day_idx", *[F.col(n).alias(f"__{n}") for n in names])
    met = same_contract_momentum(main, bars, horizons).join(smooth, "day_idx").crossJoin(F.broadcast(some))  # one row
    return met.select("day_idx", "trade_date", "contract", "close", *[F.when(F.col("__some"), F.col(n)).otherwise(F.col(f"__{n}")).alias(n) for n in names])


def spread_signals(events: DataFrame, window: int = strategy.TEXT_WINDOW) -> DataFrame:
    """(day_idx, doc_id): signals on each day on which they count; the long form of a decision's list of signals, so that no list grows with a day's signals."""
    return events.select(F.explode(F.sequence(F.col("day_idx"), F.col("day_idx") + (window - 1))).alias("day_idx"), "doc_id")


def decisions(policy: Policy, main: DataFrame, baseline: DataFrame, events: DataFrame, market_digests: DataFrame, signal_digests: DataFrame, inputs: dict[str, str] = {}, start: str | None = None) -> DataFrame:
    """A row for each trading day: the decision after its close, or the reason why there is none.

    ``main``: day_idx, trade_date, contract; ``baseline``: day_idx, position (null or no row: none known); ``events``: accepted signals with doc_id, day_idx,
    score, confidence.  The id digests the version, the day, ``inputs`` (names and digests of whatever else is frozen) and the digests of all market rows and
    signals up to the day, so a decision built again from the same inputs has the same id.  status: decided, before_start or no_baseline.
    """
    text = strategy.decayed_text_scores(events, main)
    counts = spread_signals(events).groupBy("day_idx").agg(F.count(F.lit(1)).alias("active_signals"))
    known = lambda df, name: df.select(F.col("day").alias("signal_date"), F.col("digest").alias(name))
    days = main.select("day_idx", F.col("trade_date").alias("signal_date"), F.col("contract").alias("selected_contract"))
    met = days.join(baseline.select("day_idx", F.col("position").alias("baseline_position")), "day_idx", "left").join(text, "day_idx").join(counts, "day_idx", "left")
    met = met.join(known(market_digests, "market_input_sha256"), "signal_date", "left").join(known(signal_digests, "signal_input_sha256"), "signal_date", "left")
    early = F.col("signal_date") < F.lit(start).cast("date") if start else F.lit(False)
    status = F.when(early, "before_start").when(F.col("baseline_position").isNull(), "no_baseline").otherwise("decided")
    decided = F.col("status") == "decided"
    met = met.withColumns({"strategy_version": F.lit(policy.version), "status": status, **{k: F.lit(x) for k, x in inputs.items()}})
    met = met.withColumn("enhanced_position", F.when(decided, policy.position(F.col("baseline_position"), F.col("active_text_score"))))
    identity = ["strategy_version", "signal_date", *sorted(inputs), "market_input_sha256", "signal_input_sha256"]
    return met.select(
        F.when(decided, F.substring(F.sha2(canonical(identity), 256), 1, ID_LENGTH)).alias("decision_id"), *identity, "day_idx", "status", "selected_contract",
        "baseline_position", "active_text_score", "enhanced_position", (F.col("enhanced_position") - F.col("baseline_position")).alias("position_delta"),
        F.coalesce("active_signals", F.lit(0)).cast("long").alias("active_signals"), F.lit(policy.cost_bps).alias("cost_bps"), F.lit(policy.execution_rule).alias("execution_rule"),
    )


def decision_signals(made: DataFrame, events: DataFrame) -> DataFrame:
    """(decision_id, doc_id): the signals that each decision counted."""
    return made.filter("status = 'decided'").select("decision_id", "day_idx").join(spread_signals(events), "day_idx").select("decision_id", "doc_id")


def recorded(ledger: DataFrame, incoming: DataFrame, fixed: list[str] = IMMUTABLE, key: str = "decision_id", one_per: list[str] = ["strategy_version", "signal_date"], order: str = "recorded_at") -> DataFrame:
    """Incoming rows with their outcome, as if they came one after the other by ``order`` and key, and the fixed fields that they would change.

    recorded: the row is new, and the only one that is to be appended.  already_recorded: a replay.  changed: its key is known with other fixed fields.
    second: another key holds its day.  Repeated rows count as replays.  As a key digests its day, only the day that it comes with first counts for it: rows
    that give it another are changed, and hold no day.
    """
    known = ledger.groupBy(key).agg(F.first(F.struct(*fixed)).alias("__old"))
    held = ledger.select(*one_per).distinct().withColumn("__held", F.lit(True))
    own = W.partitionBy(key).orderBy(order)
    met = incoming.join(known, key, "left").join(held, one_per, "left")
    met = met.withColumns({"__line": F.row_number().over(own), "__first": F.first(F.struct(*fixed)).over(own), "__day": F.first(F.struct(*one_per)).over(own), "__known": F.col("__old").isNotNull()})
    at_home = F.col("__day").eqNullSafe(F.struct(*one_per))
    met = met.withColumn("__holder", F.min(F.when(at_home & ~F.col("__known"), F.struct(order, key))).over(W.partitionBy(*one_per))[key])
    was = F.coalesce("__old", "__first")
    met = met.withColumn("changed_fields", F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(was[c]), F.lit(c)) for c in fixed])))
    replay = F.when(F.size("changed_fields") > 0, "changed").otherwise("already_recorded")
    other = F.coalesce("__held", F.lit(False)) | (F.col("__holder") != F.col(key))
    outcome = F.when(F.col("__known") | ~at_home, replay).when(other, "second").when(F.col("__line") == 1, "recorded").otherwise(replay)
    return met.withColumn("outcome", outcome).drop("__old", "__held", "__line", "__first", "__day", "__holder", "__known")


def mapped_forecasts(forecasts: DataFrame, main: DataFrame, trend: DataFrame, weight: float = 1.0, day: str = "publish_time", score: str = "score") -> DataFrame:
    """Each forecast at the first trading day on or after its publication: trend, position with the text where both have one sign, and the day of execution.

    ``trend``: day_idx, momentum_20d, validation_std.  status: insufficient_market_history, no_publish_time, awaiting_signal_day_market_data,
    insufficient_momentum_context, awaiting_next_trading_day or mapped; positions are null but for the last two.
    """
    size = main.agg(F.count(F.lit(1)).alias("__days"))
    nexts = main.select("day_idx", F.lead("trade_date").over(W.orderBy("day_idx")).alias("execution_trade_date"))  # a row for each day
    context = trend.select("day_idx", "momentum_20d", "validation_std").join(nexts, "day_idx")
    met = asof.on_calendar(forecasts, main.select("day_idx", "trade_date"), day).withColumnRenamed("trade_date", "signal_market_date")
    met = met.join(context, "day_idx", "left").crossJoin(F.broadcast(size))  # one row
    poor = F.col("momentum_20d").isNull() | ~F.coalesce(F.col("validation_std") > 0, F.lit(False))
    status = (
        F.when(F.col("__days") < LEAST_DAYS, "insufficient_market_history").when(F.col(day).isNull(), "no_publish_time").when(F.col("day_idx").isNull(), "awaiting_signal_day_market_data")
        .when(poor, "insufficient_momentum_context").when(F.col("execution_trade_date").isNull(), "awaiting_next_trading_day").otherwise("mapped")
    )
    base = F.when(F.col("status").isin("mapped", "awaiting_next_trading_day"), F.tanh(F.col("momentum_20d") / F.col("validation_std")))
    met = met.withColumn("status", status).withColumn("baseline_position", base)
    text = clip(F.coalesce(F.col(score), F.lit(0.0)))
    met = met.withColumn("enhanced_position", F.when(F.col("baseline_position").isNotNull(), strategy.confirm_only(F.col("baseline_position"), text, weight)))
    return met.withColumns({"position_delta": F.col("enhanced_position") - F.col("baseline_position"), "text_confirmed_trend": F.col("baseline_position") * text > 0, **{c: F.when(F.col("status") != "no_publish_time", F.col(c)) for c in ("signal_market_date", "execution_trade_date")}}).drop("__days", "day_idx")


def combined_digest(manifest: DataFrame) -> DataFrame:
    """(tables, rows, digest) over a manifest (name, rows, digest): a row for each frozen table, so one small group."""
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "digest"))), "\n")
    return manifest.agg(F.count(F.lit(1)).alias("tables"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sha2(F.coalesce(lines, F.lit("")), 256).alias("digest"))


def verification(manifest: DataFrame, now: DataFrame, settlements: DataFrame) -> DataFrame:
    """(item, ok, n): every frozen table against its state now (n: its rows now), the counts of a ledger's settlements, and whether all is well.

    A table on one side only isn't well; without any frozen table nothing was verified, which isn't well either.
    """
    bad = changed(manifest, now).select("name", F.lit(True).alias("bad"))
    names = manifest.select("name").union(now.select("name")).distinct()
    frozen = names.join(bad, "name", "left").join(now.select("name", "rows"), "name", "left").select(F.concat(F.lit("frozen:"), "name").alias("item"), F.col("bad").isNull().alias("ok"), F.coalesce("rows", F.lit(0)).alias("n"))
    ends = F.col("settlement")
    counts = {"recorded": F.count(F.lit(1)), "settled": F.count_if(ends == "settled"), "pending": F.count_if(ends.endswith("_pending"))}
    counted = settlements.agg(*[c.alias(n) for n, c in counts.items()])
    ledger = counted.select(F.explode(F.array(*[F.struct(F.lit(f"decisions:{n}").alias("item"), F.lit(True).alias("ok"), F.col(n).alias("n")) for n in counts])).alias("c")).select("c.*")
    whole = frozen.agg(F.coalesce(F.every("ok"), F.lit(False)).alias("ok"), F.count(F.lit(1)).alias("n")).select(F.lit("system").alias("item"), "ok", "n")
    return frozen.unionByName(ledger).unionByName(whole)
