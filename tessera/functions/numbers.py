"""Numeric column expressions that pass nulls on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """x within [low, high]; a null stays null (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def strict_double(x: Column) -> Column:
    """A finite number, or null: blanks, words, NaN and infinities aren't numbers."""
    value = F.trim(x.cast("string")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def lenient_double(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(strict_double(x), F.lit(default))


def bounded(x: Column, default: float = 0.0) -> Column:
    """A share in [0, 1]; what isn't a number is ``default``."""
    return clip(lenient_double(x, default), 0.0, 1.0)


def tri_state(x: Column) -> Column:
    """'true' is 1, 'false' is 0, a number is clamped to [0, 1]; else null."""
    word = F.lower(F.trim(x.cast("string")))
    return F.when(word == "true", 1.0).when(word == "false", 0.0).otherwise(clip(strict_double(x), 0.0, 1.0))


def rounded(x: Column, digits: int = 6) -> Column:
    """For results: rounded, and never a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def mean_or_zero(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def quantile_or_zero(x: Column, q: float) -> Column:
    """Linear interpolation between order statistics; 0 for no rows."""
    return F.coalesce(F.percentile(x, q), F.lit(0.0))


def logistic(value: Column, centre: Column, scale: Column, floor: float = 0.0025) -> Column:
    """Logistic percentile; its exponent is held within 40 and its scale above ``floor``."""
    z = (value - centre) / F.greatest(scale, F.lit(floor))
    return 1 / (1 + F.exp(-clip(z, -40.0, 40.0)))


def beta_posterior(hits: Column, n: Column) -> Column:
    """Mean of a Beta(2, 2) prior after ``hits`` of ``n``."""
    return (hits + 2) / (n + 4)


def soft_threshold(x: Column, t: float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of a group's pairs; null without variance, where ``corr`` fails under ANSI."""
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def correlation_or_zero(x: Column, y: Column, least: int = 2) -> Column:
    """Pearson correlation of a group; 0 with fewer than ``least`` pairs or without variance."""
    both = x.isNotNull() & y.isNotNull()
    return F.when(F.count_if(both) >= least, F.coalesce(correlation(x, y), F.lit(0.0))).otherwise(0.0)
