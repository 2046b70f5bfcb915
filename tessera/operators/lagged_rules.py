"""Rules over grounded predicates that lead a released target by some months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.dates import advance_period
from tessera.functions.numbers import correlation_or_zero
from tessera.operators.rules import combinations


def rule_signals(predicates: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(signals, support) of every combination of predicates that are active together in a document.

    ``predicates``: doc_id, period_end, name, value, direction, intensity, confidence, lag.  A signal is the mean over a period's documents of the sign of their
    directions times their mean strength, moved ahead by the rule's median lag; periods that meet there add up.  Signals are
    rounded to 12 digits, so that equal ones don't differ by the order of their sums.
    """
    live = predicates.filter(F.col("value")).withColumn("strength", F.abs(F.col("direction") * F.col("intensity") * F.col("confidence")))
    docs = live.groupBy("doc_id", "period_end").agg(F.collect_list("name").alias("names"), F.map_from_entries(F.collect_list(F.struct("name", F.struct("strength", "direction", "lag", "confidence")))).alias("m"))  # a fixed schema of predicates
    each = docs.select("doc_id", "period_end", "m", F.explode(combinations(F.col("names"), most)).alias("conditions")).select("*", F.explode("conditions").alias("name"))
    parts = each.select("conditions", "doc_id", "period_end", F.element_at("m", F.col("name")).alias("p")).select("conditions", "doc_id", "period_end", "p.*")
    by_doc = parts.groupBy("conditions", "doc_id", "period_end").agg(F.avg("strength").alias("s"), F.sum("direction").alias("d"))
    lags = parts.groupBy("conditions").agg(F.bround(F.percentile("lag", 0.5)).cast("int").alias("rule_lag"), F.signum(F.sum("direction")).cast("int").alias("expected_direction"), F.avg("confidence").alias("evidence"), F.count_distinct("doc_id").alias("support_documents"), F.count_distinct("period_end").alias("support_periods"))
    source = by_doc.groupBy("conditions", "period_end").agg(F.avg(F.signum("d") * F.col("s")).alias("v"))
    moved = source.join(lags.select("conditions", "rule_lag"), "conditions").withColumn("target_end", advance_period(F.col("period_end"), F.col("rule_lag")))
    return moved.groupBy("conditions", "target_end").agg(F.round(F.sum("v"), 12).alias("signal")), lags


def rule_quality(signals: DataFrame, support: DataFrame, targets: DataFrame, least_documents: int = 12, least_periods: int = 6, least_history: int = 8) -> DataFrame:
    """Rules with enough support, their correlation with the target, gain in MAE over persistence by expanding lines, and share of years with the expected sign.

    ``targets``: period_end, release_date, actual, of the training split only.  A line for a period is fitted on earlier periods' signals whose targets were out by then.
    """
    good = support.filter((F.col("support_documents") >= least_documents) & (F.col("support_periods") >= least_periods))
    met = signals.join(good.select("conditions", "expected_direction"), "conditions").join(targets.select(F.col("period_end").alias("target_end"), "release_date", "actual"), "target_end")
    fits = met.groupBy("conditions").agg(correlation_or_zero(F.col("signal"), F.col("actual"), 3).alias("correlation"))
    # each rule has one signal a period, so a rule's history is short; its running sums take rows in the order of their release
    ends = met.select("conditions", F.col("target_end").alias("at"), F.lit(1).alias("side"), "signal", "actual", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    outs = met.select("conditions", F.col("release_date").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("double").alias("signal"), F.lit(None).cast("double").alias("actual"), F.col("signal").alias("x"), F.col("actual").alias("y"))
    w = W.partitionBy("conditions").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    run = ends.unionByName(outs).withColumns({"n": F.regr_count("y", "x").over(w), "b": F.coalesce(F.regr_slope("y", "x").over(w), F.lit(0.0)), "my": F.avg("y").over(w), "mx": F.avg("x").over(w), "last": F.last("y", ignorenulls=True).over(w)})
    told = run.filter((F.col("side") == 1) & (F.col("n") >= least_history))
    gains = told.groupBy("conditions").agg((F.avg(F.abs(F.col("last") - F.col("actual"))) - F.avg(F.abs(F.col("my") + F.col("b") * (F.col("signal") - F.col("mx")) - F.col("actual")))).alias("mae_gain"))
    years = met.groupBy("conditions", F.year("target_end").alias("year")).agg(F.count(F.lit(1)).alias("n"), (correlation_or_zero(F.col("signal"), F.col("actual"), 3) * F.max("expected_direction") > 0).alias("ok")).filter("n >= 3")
    steady = years.groupBy("conditions").agg(F.avg(F.col("ok").cast("double")).alias("year_stability"))
    return good.join(fits, "conditions", "left").join(gains, "conditions", "left").join(steady, "conditions", "left").na.fill(0.0, ["correlation", "mae_gain", "year_stability"])
