"""Walk-forward period forecasts, the text model on their residuals, single-text models and what one text changes.

A row of history counts from its release on.  Moments of every as-of date are
running sums over releases, so no date reads its history again; all dates are
solved in one batch of small systems.  Grids are explored as rows: a model for each
feature set and penalty from one aggregation, its errors from another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Penalties and weights of the two grids, and of the forecasts without choice.
RESIDUAL_ALPHAS, TEXT_WEIGHTS = (10.0, 20.0, 50.0, 100.0, 200.0), (0.25, 0.50, 0.75, 1.00)
SINGLE_ALPHAS, ANCHOR_WEIGHTS = (50.0, 100.0, 200.0, 500.0), (0.50, 0.75, 1.00)
LEAST_HISTORY, LEAST_PAIRS, SEASONS, Z_CLIP, NO_WIDTH = 12, 8, 5, 3.0, 3.0
BASELINES = ("persistence", "seasonal", "ar1", "no_text_ridge", "ridge_text", "elastic_net_text")


def _cells(columns: list[Column]) -> list[Column]:
    """Products of every two of ``columns``, upper triangle by rows."""
    return [a * b for i, a in enumerate(columns) for b in columns[i:]]


def _matrices(cells: pd.Series, size: int) -> np.ndarray:
    out = np.zeros((len(cells), size, size))
    flat = np.array([np.zeros(size * (size + 1) // 2) if c is None else np.asarray(c, float) for c in cells])
    i, j = np.triu_indices(size)
    if len(flat):
        out[:, i, j] = out[:, j, i] = np.nan_to_num(flat)
    return out


def _standardised(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means, scales (1 for constant features), and covariances of scaled features with each other and with the target, of each matrix of moments."""
    n = np.maximum(m[:, 0, 0], 1)
    mean = m[:, 0] / n[:, None]
    cov = m / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    spread = np.diagonal(cov, axis1=1, axis2=2)[:, 1:-1]
    floor = 1e-12 * np.maximum(np.diagonal(m, axis1=1, axis2=2)[:, 1:-1] / n[:, None], 1e-12)
    scale = np.where(spread > floor, np.sqrt(np.maximum(spread, 0)), 1.0)
    return n, mean, scale, cov[:, 1:-1, 1:-1] / (scale[:, :, None] * scale[:, None, :]), cov[:, 1:-1, -1] / scale


def ridge_rows(m: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (intercept first), means and scales of a ridge for each matrix of moments of (1, features, target)."""
    n, mean, scale, a, b = _standardised(m)
    beta = np.linalg.solve(a * n[:, None, None] + alpha * np.eye(a.shape[1]), (b * n[:, None])[:, :, None])[:, :, 0]
    return np.column_stack((mean[:, -1], beta)), mean[:, 1:-1], scale


def elastic_rows(m: np.ndarray, alpha: float = 0.08, l1: float = 0.5, rounds: int = 300, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``ridge_rows``, by coordinate descent on all matrices at once; each stops by itself."""
    _, mean, scale, a, b = _standardised(m)
    beta, live = np.zeros_like(b), np.ones(len(b), bool)
    for _ in range(rounds):
        largest = np.zeros(len(b))
        for j in range(b.shape[1]):
            own = a[:, j, j]
            rho = b[:, j] - (a[:, j] * beta).sum(axis=1) + own * beta[:, j]
            new = np.copysign(np.maximum(np.abs(rho) - alpha * l1, 0), rho) / (own + alpha * (1 - l1))
            new = np.where(live, new, beta[:, j])
            largest = np.maximum(largest, np.abs(new - beta[:, j]))
            beta[:, j] = new
        live &= largest >= tolerance
        if not live.any():
            break
    return np.column_stack((mean[:, -1], beta)), mean[:, 1:-1], scale


def predicted(cells: str | Column, x: Column, features: int, kind: str = "ridge", alpha: float = 1.0) -> Column:
    """Each row's prediction at ``x`` by the model of its moments; rows are solved a batch at once."""

    @F.pandas_udf("double")
    def run(moments: pd.Series, at: pd.Series) -> pd.Series:
        m = _matrices(moments, features + 2)
        model, mean, scale = ridge_rows(m, alpha) if kind == "ridge" else elastic_rows(m)
        z = (np.array([np.asarray(v, float) for v in at]).reshape(len(m), features) - mean) / scale
        return pd.Series(model[:, 0] + (model[:, 1:] * z).sum(axis=1))

    return run(cells, x)


def _season(month: Column) -> list[Column]:
    return [F.sin(month * math.pi / 6), F.cos(month * math.pi / 6)]


def baseline_forecasts(targets: DataFrame, features: DataFrame, fields: list[str], keys: list[str], least_text: int = 24) -> DataFrame:
    """Add the six BASELINES, n_known, latest and latest_covered to every period of each series that has LEAST_HISTORY released values by its end.

    targets: keys, period_end, actual (null: unknown yet), release_date; features: keys, period_end, document_count and
    ``fields``; a period without a row of features has zeros.  A value counts once it and all earlier ones are released.
    ridge_text and elastic_net_text equal no_text_ridge below ``least_text`` known periods with documents.
    """
    order = W.partitionBy(*keys).orderBy("period_end")
    month = F.month("period_end")
    on = [c for c in (*keys, "period_end") if c in features.columns]  # features can be common to all series
    told = list(dict.fromkeys(("document_count", *fields)))
    rows = targets.join(features.select(*on, *told), on, "left").fillna(0, told)
    known = rows.filter("actual IS NOT NULL AND release_date IS NOT NULL")
    before = F.lag("actual").over(order)
    lagged = [F.lag(c).over(order) for c in ("actual", "__sin", "__cos")]
    level = [F.lit(1.0), *[F.col(f).cast("double") for f in fields], F.col("actual")]
    # a pair (a value, the next one) is known when the next one is
    pair = [F.when(before.isNotNull(), F.lit(1.0)), *lagged, F.when(before.isNotNull(), F.col("actual"))]
    line = [pair[0], pair[1], pair[4]]
    known = known.withColumns(dict(zip(("__sin", "__cos"), _season(month)))).withColumn("at", F.max("release_date").over(order.rowsBetween(W.unboundedPreceding, 0)))
    known = known.withColumns({"__pair": F.array(*_cells(pair)), "__line": F.array(*_cells(line)), "__level": F.array(*_cells(level))})
    sizes = {"__pair": 15, "__line": 6, "__level": (len(fields) + 2) * (len(fields) + 3) // 2}
    released = known.select(*keys, "at", F.lit(0).alias("side"), "period_end", "actual", "document_count", *sizes)
    asked = rows.select(*keys, F.col("period_end").alias("at"), F.lit(1).alias("side"), "period_end", F.lit(None).cast("double").alias("actual"), F.lit(None).cast("double").alias("document_count"), *[F.lit(None).cast("array<double>").alias(c) for c in sizes])
    w = W.partitionBy(*keys).orderBy("at", "side", "period_end").rowsBetween(W.unboundedPreceding, 0)
    total = lambda c, n: F.array(*[F.coalesce(F.sum(F.get(c, F.lit(i))).over(w), F.lit(0.0)) for i in range(n)]).alias(c)
    same = W.partitionBy(*keys, F.month("period_end")).orderBy("at", "side", "period_end").rowsBetween(W.unboundedPreceding, 0)
    run = released.unionByName(asked).select(
        *keys, "side", "period_end", F.count("actual").over(w).alias("n_known"), F.last("actual", ignorenulls=True).over(w).alias("latest"),
        F.coalesce(F.sum((F.col("document_count") > 0).cast("long")).over(w), F.lit(0)).alias("n_covered"),
        F.collect_list("actual").over(same).alias("__same"),
        *[total(c, n) for c, n in sizes.items()],
    )
    run = run.filter((F.col("side") == 1) & (F.col("n_known") >= LEAST_HISTORY)).drop("side")
    out = rows.join(run, [*keys, "period_end"])
    five = F.when(F.size("__same") > SEASONS, F.slice("__same", -SEASONS, SEASONS)).otherwise(F.col("__same"))
    mean = F.when(F.size("__same") > 0, F.aggregate(five, F.lit(0.0), lambda a, x: a + x) / F.size(five))
    at_level = F.array(*[F.col(f).cast("double") for f in fields])
    out = out.withColumns({
        "persistence": F.col("latest"), "seasonal": F.coalesce(mean, F.col("latest")),
        "ar1": predicted("__line", F.array("latest"), 1, alpha=1.0), "__ridge": predicted("__pair", F.array(F.col("latest"), *_season(month)), 3, alpha=2.0),
        "__text": predicted("__level", at_level, len(fields), alpha=8.0), "__elastic": predicted("__level", at_level, len(fields), "elastic"),
    })
    no_text = F.when(F.col("n_known") - 1 >= LEAST_PAIRS, F.col("__ridge")).otherwise(F.col("ar1"))
    enough = F.col("n_covered") >= least_text
    out = out.withColumn("no_text_ridge", no_text).withColumns({"ridge_text": F.when(enough, F.col("__text")).otherwise(F.col("no_text_ridge")), "elastic_net_text": F.when(enough, F.col("__elastic")).otherwise(F.col("no_text_ridge"))})
    return out.drop("__same", "__ridge", "__text", "__elastic", *sizes)


def fitted(rows: DataFrame, sets: dict[str, list[str]], target: Column, keys: list[str], alphas: tuple[float, ...]) -> DataFrame:
    """(keys, feature_set, alpha, n, coefficients, means, scales): a ridge for each feature set and penalty, from one aggregation of all products."""
    every = list(dict.fromkeys(f for fields in sets.values() for f in fields))
    sums = rows.groupBy(*keys).agg(F.array(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in _cells([F.lit(1.0), *[F.col(f).cast("double") for f in every], target])]).alias("cells"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = _matrices(batch["cells"], len(every) + 2)
            for name, fields in sets.items():
                at = [0, *(every.index(f) + 1 for f in fields), len(every) + 1]
                own = m[:, at][:, :, at]
                for alpha in alphas:
                    model, mean, scale = ridge_rows(own, alpha)
                    yield batch[keys].assign(feature_set=name, alpha=alpha, n=m[:, 0, 0].astype("int64"), coefficients=list(model), means=list(mean), scales=list(scale))

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(solve, f"{kinds + ', ' if keys else ''}feature_set string, alpha double, n long, coefficients array<double>, means array<double>, scales array<double>")


def applied(sets: dict[str, list[str]], z_clip: float | None = None, values: str = "") -> Column:
    """The prediction of a row's own model (feature_set, coefficients, means, scales) from the row's features, or from those with the prefix ``values``."""
    z = lambda v, m, s: (v - m) / s
    one = F.lit(None).cast("double")
    for name, fields in sets.items():
        parts = []
        for i, f in enumerate(fields):
            at = z(F.col(values + f).cast("double"), F.col("means")[i], F.col("scales")[i])
            parts.append(F.col("coefficients")[i + 1] * (F.greatest(F.lit(-z_clip), F.least(F.lit(z_clip), at)) if z_clip else at))
        one = F.when(F.col("feature_set") == name, F.col("coefficients")[0] + sum(parts[1:], parts[0])).otherwise(one)
    return one


def chosen(errors: DataFrame, models: DataFrame, keys: list[str], sets: dict[str, list[str]], weight: str, weights: tuple[float, ...]) -> DataFrame:
    """The model and weight of least validation MAE, then RMSE, then fewest features, of each series, with validation_mae, validation_rmse, half_width.

    Without validation rows all errors are 0, so the first of the grid is taken; without training rows a series has no model.
    """
    fewest = F.create_map(*[F.lit(x) for n, f in sets.items() for x in (n, len(f))])
    grid = [*keys, "feature_set", "alpha", weight]
    scores = errors.groupBy(*grid).agg(F.avg(F.abs("error")).alias("validation_mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("validation_rmse"), F.percentile(F.abs("error"), 0.9).alias("half_width"), F.count(F.lit(1)).alias("n_validation"))
    every = models.select(*keys, "feature_set", "alpha", F.explode(F.array(*[F.lit(x) for x in weights])).alias(weight))
    scores = every.join(scores, grid, "left").fillna(0, ["validation_mae", "validation_rmse", "half_width", "n_validation"])
    rank = F.struct(F.round("validation_mae", 12), F.round("validation_rmse", 12), fewest[F.col("feature_set")], *[F.array_position(F.array(*[F.lit(n) for n in sets]), F.col("feature_set"))], "alpha", weight)
    best = scores.groupBy(*keys).agg(F.min_by(F.struct("feature_set", "alpha", weight, "validation_mae", "validation_rmse", "half_width", "n_validation"), rank).alias("b")).select(*keys, "b.*")
    return best.join(models, [*keys, "feature_set", "alpha"])


def _capped(weight: Column, residual: Column) -> Column:
    return F.greatest(-F.col("cap"), F.least(F.col("cap"), weight * residual))


def residual_model(rows: DataFrame, sets: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """One frozen model a series: text evidence fitted to what no_text_ridge leaves, chosen over the grid on validation rows.

    rows: keys, split, actual, no_text_ridge, document_count and all features; only rows with documents and a value take part.
    cap: mean absolute error of no_text_ridge on validation rows (3 where it is 0 or there are none), which bounds the text's part.
    """
    used = rows.filter("document_count > 0 AND actual IS NOT NULL")
    models = fitted(used.filter("split = 'train'"), sets, F.col("actual") - F.col("no_text_ridge"), keys, RESIDUAL_ALPHAS)
    held = used.filter("split = 'validation'")
    mean = held.groupBy(*keys).agg(F.avg(F.abs(F.col("no_text_ridge") - F.col("actual"))).alias("no_text_mae"))
    models = models.join(mean, keys, "left").withColumn("cap", F.when(F.col("no_text_mae") > 0, F.col("no_text_mae")).otherwise(NO_WIDTH))
    tried = held.join(models.drop("n"), keys).withColumn("residual", applied(sets, Z_CLIP)).withColumn("text_weight", F.explode(F.array(*[F.lit(x) for x in TEXT_WEIGHTS])))
    tried = tried.withColumn("error", F.col("no_text_ridge") + _capped(F.col("text_weight"), F.col("residual")) - F.col("actual"))
    return chosen(tried, models, keys, sets, "text_weight", TEXT_WEIGHTS)


def with_text(rows: DataFrame, model: DataFrame, sets: dict[str, list[str]], keys: list[str], values: str = "", name: str = "text_increment") -> DataFrame:
    """Add the text's part of the forecast: weighted, clipped residual within the cap; 0 without documents."""
    part = F.when(F.col(f"{values}document_count") > 0, _capped(F.col("text_weight"), applied(sets, Z_CLIP, values))).otherwise(0.0)
    columns = [c for c in model.columns if c not in (*keys, "n")]
    met = rows.join(model.drop("n"), keys)
    return met.withColumn(name, part).select(*rows.columns, name, *[c for c in columns if c not in rows.columns])


def walk_forward(rows: DataFrame, sets: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """Forecast, interval and change against the latest value for each period of ``rows`` (baseline_forecasts with split and features).

    The model is frozen after validation; the interval's half width is the 0.9 quantile of the absolute errors of the forecasts
    whose values were released by then, 3 without any.
    """
    out = with_text(rows, residual_model(rows, sets, keys), sets, keys).withColumn("forecast", F.col("no_text_ridge") + F.col("text_increment"))
    error = F.abs(F.col("actual") - F.col("forecast"))
    told = out.filter("actual IS NOT NULL AND release_date IS NOT NULL").select(*keys, F.col("release_date").alias("at"), F.lit(0).alias("side"), "period_end", error.alias("e"))
    asks = out.select(*keys, F.col("period_end").alias("at"), F.lit(1).alias("side"), "period_end", F.lit(None).cast("double").alias("e"))
    w = W.partitionBy(*keys).orderBy("at", "side", "period_end").rowsBetween(W.unboundedPreceding, 0)
    width = told.unionByName(asks).withColumn("width", F.coalesce(F.percentile("e", 0.9).over(w), F.lit(NO_WIDTH))).filter("side = 1").select(*keys, "period_end", "width")
    out = out.join(width, [*keys, "period_end"])
    return out.withColumns({"lower_90": F.col("forecast") - F.col("width"), "upper_90": F.col("forecast") + F.col("width"), "acceleration": F.col("forecast") - F.col("latest")})


def latest_by_day(targets: DataFrame, first: str, last: str, name: str = "latest") -> DataFrame:
    """(day, latest): for each day the value of the latest release up to it, the later period of two releases on a day; null before the first."""
    days = targets.sparkSession.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS day")
    told = targets.filter("actual IS NOT NULL AND release_date IS NOT NULL").groupBy(F.greatest("release_date", F.lit(first).cast("date")).alias("day")).agg(F.max_by("actual", F.struct("release_date", "period_end")).alias("told"))
    return days.join(told, "day", "left").select("day", F.last("told", ignorenulls=True).over(W.orderBy("day")).alias(name))


def single_text_model(docs: DataFrame, sets: dict[str, list[str]], anchor: str = "latest") -> DataFrame:
    """One row: the ridge over single documents, blended with the latest value, of least validation error over the grid.

    docs: split, actual, ``anchor`` and features of each document.  Documents are read once for all models and once for all grid points.
    """
    models = fitted(docs.filter("split = 'train'"), sets, F.col("actual").cast("double"), [], SINGLE_ALPHAS)
    held = docs.filter("split = 'validation'").crossJoin(F.broadcast(models.drop("n")))  # len(sets) * len(SINGLE_ALPHAS) models
    tried = held.withColumn("told", applied(sets)).withColumn("ridge_weight", F.explode(F.array(*[F.lit(x) for x in ANCHOR_WEIGHTS])))
    tried = tried.withColumn("error", F.col("ridge_weight") * F.col("told") + (1 - F.col("ridge_weight")) * F.col(anchor) - F.col("actual"))
    best = chosen(tried, models, [], sets, "ridge_weight", ANCHOR_WEIGHTS)
    base = docs.filter("split = 'validation'").agg(F.avg(F.abs(F.col(anchor) - F.col("actual"))).alias("persistence_mae"))
    out = best.crossJoin(base)  # one row each
    gain = F.col("persistence_mae") - F.col("validation_mae")
    share = F.when(F.col("persistence_mae") > 0, gain / F.col("persistence_mae")).otherwise(0.0)
    return out.withColumn("increment_status", F.when((gain >= 0.10) & (share >= 0.05), "validated_positive").otherwise("not_established"))


def marginal_effects(docs: DataFrame, periods: DataFrame, model: DataFrame, sets: dict[str, list[str]], keys: list[str], means: list[str], copy: str | None = None) -> DataFrame:
    """What each document changes in its period's forecast: before (without it), after, marginal_change.

    docs: period_end, doc_id and ``means`` (a document's values); periods: keys, period_end, no_text_ridge.  Sums and counts
    of a period are taken once; the means without a document are (sum - own) / (count - 1), so nothing is aggregated again.
    A document that ``copy`` marks counts for nothing, and changes nothing.
    """
    own = docs.withColumn("__new", F.lit(1) if copy is None else (~F.col(copy)).cast("int"))
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    sums = own.groupBy("period_end").agg(F.sum("__new").alias("__n"), *[F.sum(value(c) * F.col("__new")).alias(f"__s_{c}") for c in means])
    rows = periods.select(*keys, "period_end", "no_text_ridge").join(sums, "period_end")
    met = own.join(F.broadcast(rows), "period_end")  # a row for each period of each series
    less = F.col("__n") - F.col("__new")
    met = met.withColumns({"after_document_count": F.col("__n").cast("double"), "before_document_count": less.cast("double")})
    for c in means:
        met = met.withColumns({f"after_{c}": F.col(f"__s_{c}") / F.greatest(F.col("__n"), F.lit(1)), f"before_{c}": F.when(less > 0, (F.col(f"__s_{c}") - value(c) * F.col("__new")) / less).otherwise(0.0)})
    out = met.join(F.broadcast(model.drop("n")), keys)  # one model a series
    part = lambda p: F.when(F.col(f"{p}document_count") > 0, _capped(F.col("text_weight"), applied(sets, Z_CLIP, p))).otherwise(0.0)
    out = out.withColumns({"nowcast_before": F.col("no_text_ridge") + part("before_"), "nowcast_after": F.col("no_text_ridge") + part("after_")})
    return out.select(*keys, "period_end", "doc_id", "before_document_count", "after_document_count", "nowcast_before", "nowcast_after", (F.col("nowcast_after") - F.col("nowcast_before")).alias("marginal_change"))
