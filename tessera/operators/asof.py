"""As-of joins without a shuffle per event: both sides meet in one ordered window per key, or on the dates of a calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _tagged(events: DataFrame, facts: DataFrame, on: list[str], event_time: str, fact_time: str, values: list[str], facts_first: bool) -> DataFrame:
    payload = F.struct(*[F.col(v) for v in values], F.col(fact_time))
    order = 0 if facts_first else 1
    left = events.select(*on, F.col(event_time).alias("__t"), F.lit(1 - order).alias("__side"), F.struct(*events.columns).alias("__event"), F.lit(None).cast(facts.select(payload).schema[0].dataType).alias("__fact"))
    right = facts.select(*on, F.col(fact_time).alias("__t"), F.lit(order).alias("__side"), F.lit(None).cast(left.schema["__event"].dataType).alias("__event"), payload.alias("__fact"))
    return left.unionByName(right)


def asof_backward(events: DataFrame, facts: DataFrame, on: list[str], event_time: str, fact_time: str, values: list[str], inclusive: bool = True) -> DataFrame:
    """Each event with the latest fact of its key at or (``inclusive`` false) before its time; null values if there is none."""
    both = _tagged(events, facts, on, event_time, fact_time, values, inclusive)
    w = W.partitionBy(*on).orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, 0)
    met = both.withColumn("__fact", F.last("__fact", ignorenulls=True).over(w)).filter("__event IS NOT NULL")
    return met.select("__event.*", *[F.col(f"__fact.{v}").alias(v) for v in [*values, fact_time]])


def asof_forward(events: DataFrame, facts: DataFrame, on: list[str], event_time: str, fact_time: str, values: list[str], inclusive: bool = True) -> DataFrame:
    """Each event with the earliest fact of its key at or (``inclusive`` false) after its time."""
    both = _tagged(events, facts, on, event_time, fact_time, values, not inclusive)
    # backwards in time, as a frame that ends at the current row runs on, and one that begins there starts anew for each row
    w = W.partitionBy(*on).orderBy(F.desc("__t"), F.desc("__side")).rowsBetween(W.unboundedPreceding, 0)
    met = both.withColumn("__fact", F.last("__fact", ignorenulls=True).over(w)).filter("__event IS NOT NULL")
    return met.select("__event.*", *[F.col(f"__fact.{v}").alias(v) for v in [*values, fact_time]])


def on_calendar(events: DataFrame, calendar: DataFrame, day: str, strict: bool = False) -> DataFrame:
    """Add day_idx and trade_date of the first calendar day at or (``strict``) after ``day``; null where none is left.

    Each trading day is given the dates that lead to it (one row a date, so the dimension stays as small as a calendar), and events meet it by date.  Dates before
    the first trading day lead to it too.
    """
    back = F.lit(1 if strict else 0)
    own = calendar.select("day_idx", "trade_date", F.date_sub("trade_date", back).alias("__to"), F.lag("trade_date").over(W.orderBy("trade_date")).alias("__before"))
    after = F.coalesce(F.date_add("__before", F.lit(0 if strict else 1)), F.col("__to"))
    dates = own.withColumn("__d", F.explode(F.sequence(F.least(after, F.col("__to")), F.col("__to")))).select("__d", "day_idx", "trade_date")
    first = calendar.select(F.date_sub(F.min("trade_date"), back)).scalar()
    return events.withColumn("__d", F.greatest(F.col(day).cast("date"), first)).join(dates, "__d", "left").drop("__d")


def containing_period(documents: DataFrame, periods: DataFrame, day: str, start: str = "period_start", end: str = "period_end") -> DataFrame:
    """Each document with the first period (by end) that contains its day; documents outside all periods have nulls."""
    month = lambda c: F.trunc(c, "month")  # noqa: E731  equi-join on months instead of a range join
    months = periods.withColumn("__m", F.explode(F.expr(f"sequence(trunc({start}, 'month'), trunc({end}, 'month'), interval 1 month)"))).withColumn("__m", F.col("__m").cast("date"))
    keyed = documents.withColumn("__id", F.monotonically_increasing_id()) if "doc_id" not in documents.columns else documents.withColumn("__id", F.col("doc_id"))
    met = keyed.select("__id", day, month(F.col(day)).cast("date").alias("__m")).join(months, "__m").filter(F.col(day).between(F.col(start), F.col(end)))
    first = met.groupBy("__id").agg(F.min(F.struct(end, start)).alias("__p"))
    return keyed.join(first, "__id", "left").select(*documents.columns, F.col(f"__p.{start}").alias(start), F.col(f"__p.{end}").alias(end))


def latest_released(targets: DataFrame, as_of: DataFrame, value: str = "actual", day: str = "as_of") -> DataFrame:
    """Rows with a day, and the value, period_end and release_date of the latest target released by then (of several that day, the last period's).

    A release holds until the day before the next one, so releases become one row for each date, and rows meet them by date.
    """
    facts = targets.groupBy("release_date").agg(F.max_by(F.struct(value, "period_end"), "period_end").alias("__v"))
    until = F.coalesce(F.date_sub(F.lead("release_date").over(W.orderBy("release_date")), F.lit(1)), F.col("release_date"))
    dates = facts.withColumn("__until", until).withColumn("__d", F.explode(F.sequence("release_date", "__until"))).select("__d", f"__v.{value}", "__v.period_end", "release_date")
    last = targets.select(F.max("release_date")).scalar()
    return as_of.withColumn("__d", F.least(F.col(day).cast("date"), last)).join(dates, "__d", "left").drop("__d")
