"""Linear models from aggregated normal equations, expanding refits and error metrics.

Spark sums the products of features (a matrix as wide as the features, whatever the
rows); numpy solves it.  Refits for every as-of date come from running sums of the
same products, so no date reads the history again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.numbers import clip


@dataclass(frozen=True)
class Linear:
    """y = intercept + sum of coefficient * (x - mean) / scale."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    intercept: float

    def predict(self, z_clip: float | None = None) -> Column:
        out = F.lit(self.intercept)
        for name, b, m, s in zip(self.features, self.coefficients, self.means, self.scales):
            z = (F.col(name) - m) / s
            out = out + b * (clip(z, -z_clip, z_clip) if z_clip else z)
        return out

    def values(self, x: np.ndarray) -> np.ndarray:
        """Predictions of the rows of a matrix of the features."""
        return self.intercept + (x - np.array(self.means)) / np.array(self.scales) @ np.array(self.coefficients)


def gram(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(i, j, value): sums of products of the features, the target and 1; one row of sums, unpivoted."""
    names = ["1", *features, target]
    value = lambda n: F.lit(1.0) if n == "1" else F.col(n).cast("double")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = df.select(*[F.sum(value(a) * value(b)).alias(f"__{k}") for k, (a, b) in enumerate(pairs)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"__{k}").alias("value")) for k, (a, b) in enumerate(pairs)])).alias("g")).select("g.*")


def moments(df: DataFrame, features: list[str], target: str) -> tuple[int, np.ndarray]:
    """Number of complete rows, and the sums of products of 1, the features and the target."""
    names = ["1", *features, target]
    m = np.zeros((len(names), len(names)))
    for r in gram(df.na.drop(subset=[*features, target]), features, target).collect():  # width squared rows
        i, j = names.index(r["i"]), names.index(r["j"])
        m[i, j] = m[j, i] = r["value"] or 0.0
    return int(m[0, 0]), m


def solve(a: np.ndarray, b: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """Least-squares solution that leaves out directions below ``least``."""
    return np.linalg.lstsq(a, b, rcond=least)[0]


def _scaled(n: int, m: np.ndarray, standardise: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales, and the covariances of scaled features with each other and with the target (population; a constant feature has scale 1)."""
    mean = m[0] / n
    cov = m / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[1:-1], 0))
    scale = np.where((scale > 1e-12) & standardise, scale, 1.0)
    return mean, scale, cov[1:-1, 1:-1] / np.outer(scale, scale), cov[1:-1, -1] / scale


def ridge_of(n: int, m: np.ndarray, features: list[str], alpha: float, standardise: bool = True) -> Linear:
    """Ridge from the moments of n rows, with a free intercept."""
    if not n:
        zero = (0.0,) * len(features)
        return Linear(tuple(features), zero, zero, (1.0,) * len(features), 0.0)
    mean, scale, a, b = _scaled(n, m, standardise)
    beta = solve(a * n + alpha * np.eye(len(features)), b * n)
    return Linear(tuple(features), tuple(beta), tuple(mean[1:-1]), tuple(scale), float(mean[-1]))


def elastic_net_of(n: int, m: np.ndarray, features: list[str], alpha: float, l1: float, rounds: int = 300, tolerance: float = 1e-8) -> Linear:
    """Coordinate descent on the moments of n rows, over standardised features."""
    if not n:
        return ridge_of(n, m, features, alpha)
    mean, scale, a, b = _scaled(n, m)
    beta = np.zeros(len(features))
    for _ in range(rounds):
        largest = 0.0
        for j in range(len(features)):
            rho = b[j] - a[j] @ beta + a[j, j] * beta[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1, 0.0) / (a[j, j] + alpha * (1 - l1)) if a[j, j] + alpha * (1 - l1) > 0 else 0.0
            largest, beta[j] = max(largest, abs(new - beta[j])), new
        if largest < tolerance:
            break
    return Linear(tuple(features), tuple(beta), tuple(mean[1:-1]), tuple(scale), float(mean[-1]))


def ridge(df: DataFrame, features: list[str], target: str, alpha: float, standardise: bool = True) -> Linear:
    return ridge_of(*moments(df, features, target), features, alpha, standardise)


def elastic_net(df: DataFrame, features: list[str], target: str, alpha: float, l1: float, rounds: int = 300, tolerance: float = 1e-8) -> Linear:
    return elastic_net_of(*moments(df, features, target), features, alpha, l1, rounds, tolerance)


def expanding_line(df: DataFrame, x: str, y: str, order: str, keys: list[str] = [], least: int = 3) -> DataFrame:
    """Add fit: each row's prediction by the least-squares line through the rows before it; null with fewer than ``least``."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    slope, intercept = F.regr_slope(y, x).over(w), F.regr_intercept(y, x).over(w)
    return df.withColumn("fit", F.when(F.regr_count(y, x).over(w) >= least, intercept + slope * F.col(x)))


def released_history(targets: DataFrame, day: str = "period_end", release: str = "release_date") -> DataFrame:
    """(period_end, n_known, known_mean, known_last): for each target what had been released by the end of its period.

    Releases and period ends are merged into one ordered series, so the theta join needs no pairs.
    """
    ends = targets.select(F.col(day).alias("at"), F.lit(1).alias("side"), F.col(day).alias("period_end"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("date").alias("of"))
    out = targets.select(F.col(release).alias("at"), F.lit(0).alias("side"), F.lit(None).cast("date").alias("period_end"), F.col("actual").alias("y"), F.col(day).alias("of"))
    w = W.orderBy("at", "side", "of").rowsBetween(W.unboundedPreceding, 0)
    run = ends.unionByName(out).withColumns({"n_known": F.count("y").over(w), "known_mean": F.avg("y").over(w), "known_last": F.last("y", ignorenulls=True).over(w)})
    return run.filter("side = 1").select("period_end", "n_known", "known_mean", "known_last")


def seasonal_mean(targets: DataFrame, last: int = 5, day: str = "period_end", value: str = "actual") -> DataFrame:
    """Mean of the ``last`` earlier values of the same month."""
    w = W.partitionBy(F.month(day)).orderBy(day).rowsBetween(-last, -1)
    return targets.withColumn("seasonal_mean", F.avg(value).over(w))


def forecast_errors(df: DataFrame, keys: list[str], actual: str = "actual", forecast: str = "forecast", base: str = "base") -> DataFrame:
    """MAE, RMSE, R squared against a base forecast, share of right directions, of each group."""
    e, b = F.col(actual) - F.col(forecast), F.col(actual) - F.col(base)
    good = df.filter(F.col(actual).isNotNull() & F.col(forecast).isNotNull() & F.col(base).isNotNull())
    return good.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(F.sum(b * b) > 0, 1 - F.sum(e * e) / F.sum(b * b)).otherwise(0.0).alias("r2_vs_base"),
        F.avg((((F.col(actual) - F.col(base)) >= 0) == ((F.col(forecast) - F.col(base)) >= 0)).cast("double")).alias("direction_accuracy"),
    )


def interval_width(errors: DataFrame, order: str = "period_end", value: str = "error", q: float = 0.9, default: float = 3.0) -> DataFrame:
    """Add width: the quantile of the absolute errors before each row, or ``default`` without any."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return errors.withColumn("width", F.coalesce(F.percentile(F.abs(value), q).over(w), F.lit(default)))


def choose(grid: DataFrame, by: list[str]) -> DataFrame:
    """The row of a grid with the least values of ``by``, in that order."""
    return grid.agg(F.min_by(F.struct(*grid.columns), F.struct(*by)).alias("b")).select("b.*")


def concentration(df: DataFrame, block: str, value: str, keys: list[str] = []) -> DataFrame:
    """Largest block's share of all positive improvement, of each group; 1 without any."""
    blocks = df.groupBy(*keys, block).agg(F.sum(value).alias("s")).select(*keys, F.greatest("s", F.lit(0.0)).alias("s"))
    return blocks.groupBy(*keys).agg(F.when(F.sum("s") > 0, F.max("s") / F.sum("s")).otherwise(1.0).alias("concentration"))


def contributions(df: DataFrame, model: Linear, keys: list[str], top: int = 8, z_clip: float | None = None) -> DataFrame:
    """(keys, feature, contribution, rank): the features that move each row's prediction most, by absolute contribution, then name."""
    parts = []
    for name, b, m, s in zip(model.features, model.coefficients, model.means, model.scales):
        z = (F.col(name) - m) / s
        parts.append(F.struct((b * (clip(z, -z_clip, z_clip) if z_clip else z)).alias("contribution"), F.lit(name.strip("`")).alias("feature")))
    ordered = F.array_sort(F.transform(F.array(*parts), lambda p: F.struct(-F.abs(p["contribution"]), p["feature"], p["contribution"].alias("contribution"))))
    return df.select(*keys, F.posexplode(F.slice(ordered, 1, top)).alias("rank", "p")).select(*keys, "p.feature", "p.contribution", (F.col("rank") + 1).alias("rank"))
