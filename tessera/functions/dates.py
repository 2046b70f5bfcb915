"""Calendar expressions: observation periods, splits, trading-day spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse_day(x: Column) -> Column:
    """The written day of a date or timestamp with offset: its first ten characters, or null."""
    return F.try_to_date(F.substring(x.cast("string"), 1, 10), "yyyy-MM-dd")


def period_start(day: Column) -> Column:
    """Observation periods are months, but January and February are one."""
    return F.when(F.month(day) <= 2, F.trunc(day, "year")).otherwise(F.trunc(day, "month")).cast("date")


def period_end(day: Column) -> Column:
    return F.when(F.month(day) <= 2, F.last_day(F.make_date(F.year(day), F.lit(2), F.lit(1)))).otherwise(F.last_day(day))


def advance_period(end: Column, steps: Column) -> Column:
    """The end of the period ``steps`` periods later; a year has eleven."""
    number = F.year(end) * 11 + F.greatest(F.month(end) - 2, F.lit(0)) + steps
    year, within = F.floor(number / 11).cast("int"), F.pmod(number, F.lit(11))
    return F.last_day(F.make_date(year, F.when(within == 0, 2).otherwise(within + 2).cast("int"), F.lit(1)))


def split_of(day: Column, discovery_end: str, validation_end: str | None = None) -> Column:
    """discovery, validation (if it has an end) or oos; null days are unassigned."""
    out = F.when(day.isNull(), "unassigned").when(day <= F.lit(discovery_end).cast("date"), "discovery")
    if validation_end:
        out = out.when(day <= F.lit(validation_end).cast("date"), "validation")
    return out.otherwise("oos")


def half_year(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.when(F.month(day) <= 6, "H1").otherwise("H2"))


def weekdays(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row for each Monday to Friday of [start, end]."""
    days = F.filter(F.sequence(start, end), lambda d: F.dayofweek(d).between(2, 6))
    return df.withColumn("day", F.explode(days))


def epoch_day(x: Column, zone: str = "Asia/Shanghai") -> Column:
    """Exchange-local day of an epoch in seconds or, above 10**10, milliseconds."""
    value = x.cast("string").try_cast("double")
    millis = F.when(value > 1e10, value).otherwise(value * 1000).cast("long")
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(millis), zone))


def spine(days: DataFrame, day: str = "trade_date") -> DataFrame:
    """Distinct days with their ordinal.  A calendar has some thousand rows, so its one ordered window is small at any scale."""
    return days.select(day).distinct().withColumn("day_idx", F.row_number().over(W.orderBy(day)) - 1)


def recency(days: Column, half_life: float = 45.0) -> Column:
    return F.pow(F.lit(0.5), days / half_life)


def season(day: Column) -> tuple[Column, Column]:
    angle = F.month(day) * F.pi() / 6
    return F.sin(angle), F.cos(angle)
