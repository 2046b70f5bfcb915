"""Forecasts of a released target from its own past and from text features, compared by route.

Rows are periods (a dimension of eleven a year), so ordered windows over all of them are small.  Features come from facts that were aggregated by period before.
Every value of a row was released by the end of its period.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.dates import season
from tessera.operators.iterate import saved
from tessera.operators.models import Linear, concentration, elastic_net_of, forecast_errors, moments, ridge_of

#: Penalties that are tried, the one without enough rows to try, fewest rows to try them and fewest that are fitted on, the elastic net's share of L1, and the width of a 90 % interval in deviations.
ALPHAS, PLAIN_ALPHA, LEAST_TO_TRY, LEAST_TO_FIT, L1, INTERVAL = (0.1, 1.0, 10.0, 100.0), 10.0, 24, 12, 0.5, 1.645
#: Gates of a comparison.
LEAST_TRAIN, LEAST_VALIDATION, LEAST_COVERAGE, LEAST_MONTHS, MOST_CONCENTRATION = 72, 18, 0.60, 0.80, 0.60
OWN_PAST = ["latest_released", "latest_change", "seasonal_value", "month_sin", "month_cos", "jan_feb"]


def model_rows(targets: DataFrame) -> DataFrame:
    """(period_end, release_date, target, latest_released, latest_change, seasonal_value, month_sin, month_cos, jan_feb) of each period with anything released by its end.

    ``targets``: period_start, period_end, release_date, actual.  The seasonal value is that of the last released same month of the same kind; without one, the latest.
    """
    kind = F.month("period_start") != F.month("period_end")
    none = F.lit(None)
    ends = targets.select(F.col("period_end").alias("at"), F.lit(1).alias("side"), F.month("period_end").alias("m"), kind.alias("merged"), "period_end", "release_date", F.col("actual").alias("target"), none.cast("struct<of:date,y:double>").alias("r"))
    outs = targets.select(F.col("release_date").alias("at"), F.lit(0).alias("side"), F.month("period_end").alias("m"), kind.alias("merged"), none.cast("date").alias("period_end"), none.cast("date").alias("release_date"), none.cast("double").alias("target"), F.struct(F.col("period_end").alias("of"), F.col("actual").cast("double").alias("y")).alias("r"))
    w = lambda *keys: W.partitionBy(*keys).orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    known = F.reverse(F.array_sort(F.collect_list("r").over(w())))  # as many as there are periods
    run = ends.unionByName(outs).select("*", F.get(known, F.lit(0))["y"].alias("latest_released"), F.get(known, F.lit(1))["y"].alias("before"), F.max("r").over(w("m", "merged"))["y"].alias("same"))
    rows = run.filter("side = 1 AND latest_released IS NOT NULL")
    sine, cosine = season(F.col("period_end"))
    return rows.select(
        "period_end", "release_date", "target", "latest_released", (F.col("latest_released") - F.coalesce("before", "latest_released")).alias("latest_change"),
        F.coalesce("same", "latest_released").alias("seasonal_value"), sine.alias("month_sin"), cosine.alias("month_cos"), F.col("merged").cast("double").alias("jan_feb"),
    )


def with_text(rows: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """Rows with one column for each text feature (0 where a period has none) and whether any is there.  ``features``: period_end, feature_name, feature_value."""
    wide = features.groupBy("period_end").pivot("feature_name", names).agg(F.first("feature_value"))
    out = rows.join(wide, "period_end", "left").select(*rows.columns, *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in names])
    some = F.lit(False)
    for n in names:
        some = some | (F.abs(F.col(f"`{n}`")) > 1e-12)
    return out.withColumn("text_available", some)


def _moments(x: np.ndarray, y: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of complete rows, and the sums of products of 1, the features and the target."""
    good = np.isfinite(y) & np.isfinite(x).all(axis=1)
    z = np.column_stack([np.ones(good.sum()), x[good], y[good]])
    return int(good.sum()), z.T @ z


def _fit(kind: str, x: np.ndarray, y: np.ndarray, alpha: float) -> Linear:
    n, m = _moments(x, y)
    names = [str(j) for j in range(x.shape[1])]
    return ridge_of(n, m, names, alpha) if kind == "ridge" else elastic_net_of(n, m, names, alpha, L1, 2000)


def _alpha_by_time(kind: str, x: np.ndarray, y: np.ndarray) -> float:
    """The penalty with the least absolute error on the last quarter of the rows, fitted on those before; ties go to the smaller."""
    if len(y) < LEAST_TO_TRY:
        return PLAIN_ALPHA
    cut = max(LEAST_TO_FIT, int(len(y) * 0.75))
    errors = []
    for alpha in ALPHAS:
        e = np.abs(y[cut:] - _fit(kind, x[:cut], y[:cut], alpha).values(x[cut:]))
        errors.append(e[np.isfinite(e)].mean() if np.isfinite(e).any() else np.inf)
    return min(zip(errors, ALPHAS))[1]


def _evaluate(kind: str, x: np.ndarray, y: np.ndarray, latest: np.ndarray, split: np.ndarray, at: str, alpha: float | None = None) -> tuple[np.ndarray, float, float]:
    """(forecasts, half width of their interval, penalty) of the rows of a split, by a model of the splits before it; with fewer than 3 rows to fit on, the latest value."""
    on = np.isin(split, ["train"] if at == "validation" else ["train", "validation"])
    here = split == at
    if _moments(x[on], y[on])[0] < 3:
        return latest[here], 0.0, 0.0
    alpha = _alpha_by_time(kind, x[on], y[on]) if alpha is None else alpha
    model = _fit(kind, x[on], y[on], alpha)
    rest = y[on] - model.values(x[on])
    return model.values(x[here]), INTERVAL * float(rest[np.isfinite(rest)].std()), alpha


_PREDICTIONS = "route string, split string, model string, alpha double, period_end date, actual double, forecast double, base double, lower double, upper double, text_available boolean"


def _predict(periods: pd.DataFrame) -> pd.DataFrame:
    """All predictions of one route: its periods (eleven a year) are a group."""
    periods = periods.sort_values("period_end")
    own, y, latest = periods[OWN_PAST].to_numpy(float), periods["target"].to_numpy(float), periods["latest_released"].to_numpy(float)
    x, split = np.column_stack([own, np.array([list(t) for t in periods["text"]], dtype=float).reshape(len(periods), -1)]), periods["split"].to_numpy()
    parts = []

    def add(model: str, at: str, features: np.ndarray, kind: str, alpha: float | None = None) -> float:
        forecast, width, alpha = _evaluate(kind, features, y, latest, split, at, alpha)
        part = periods.loc[split == at, ["route", "split", "period_end", "text_available"]].assign(model=model, alpha=float(alpha), actual=y[split == at], base=latest[split == at], forecast=forecast)
        parts.append(part.assign(lower=part["forecast"] - width, upper=part["forecast"] + width))
        return alpha

    for kind in ("ridge", "elastic_net"):
        add(kind, "oos", x, kind, add(kind, "validation", x, kind))
    add("no_text", "validation", own, "ridge")
    return pd.concat(parts)[["route", "split", "model", "alpha", "period_end", "actual", "forecast", "base", "lower", "upper", "text_available"]]


def route_predictions(rows: DataFrame, features: DataFrame, routes: list[str]) -> DataFrame:
    """Forecasts and intervals of every route's ridge and elastic net on validation and, with the penalty chosen there, out of sample, and of the ridge without text on validation.

    ``rows``: model_rows with a split (train, validation or oos); ``features``: route, period_end, feature_name, feature_value; 0 where a period has none.
    Every route is one group of periods, so all models are fitted in one pass and no result goes by the driver.
    """
    wide = features.groupBy("route", "period_end", "feature_name").agg(F.first("feature_value").cast("double").alias("v"))
    wide = wide.groupBy("route", "period_end").agg(F.map_from_entries(F.collect_list(F.struct("feature_name", "v"))).alias("__m"))
    named = features.groupBy("route").agg(F.array_sort(F.collect_set("feature_name")).alias("__names"))  # a schema of features
    each = rows.withColumn("route", F.explode(F.array(*[F.lit(r) for r in routes]))).join(named, "route", "left").join(wide, ["route", "period_end"], "left")
    text = F.coalesce(F.transform("__names", lambda n: F.coalesce(F.try_element_at(F.col("__m"), n), F.lit(0.0))), F.array().cast("array<double>"))
    each = each.withColumn("text", text).withColumn("text_available", F.exists("text", lambda x: F.abs(x) > 1e-12))
    numbers = dict.fromkeys(["target", *OWN_PAST])
    return each.select("route", "period_end", "split", *[F.col(c).cast("double").alias(c) for c in numbers], "text", "text_available").groupBy("route").applyInPandas(_predict, _PREDICTIONS)


def baselines(rows: DataFrame, split: str) -> DataFrame:
    """(model, period_end, actual, forecast, base): persistence, same month, and a line through the latest value, fitted on the splits before."""
    fitted_on = rows.filter(F.col("split").isin(*(["train"] if split == "validation" else ["train", "validation"])))
    n, m = moments(fitted_on, ["latest_released"], "target")
    line: Column = ridge_of(n, m, ["latest_released"], 0.1, standardise=False).predict() if n >= 3 else F.col("latest_released")
    forecasts = F.array(*[F.struct(F.lit(k).alias("model"), v.alias("forecast")) for k, v in {"persistence": F.col("latest_released"), "seasonal": F.col("seasonal_value"), "ar1": line}.items()])
    return rows.filter(F.col("split") == split).select("period_end", F.col("target").alias("actual"), F.col("latest_released").alias("base"), F.explode(forecasts).alias("f")).select("f.model", "period_end", "actual", "f.forecast", "base")


def interval_coverage(predictions: DataFrame, keys: list[str] = []) -> DataFrame:
    return predictions.groupBy(*keys).agg(F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("double")).alias("coverage_90"))


def compare_routes(rows: DataFrame, features: DataFrame, routes: list[str], rule_prefixes: dict[str, list[str]] = {}) -> DataFrame:
    """One row for each route: its better model on validation, errors of it and of the model without text, text coverage, concentration, and whether the gates are passed.

    ``rows``: model_rows with a split; ``features``: route, period_end, feature_name, feature_value.  ``rule_prefixes``: prefixes of feature names that a route needs
    to count as available; a route without validation rows has no row.  Out-of-sample errors are reported with the penalty that validation chose, and decide nothing.
    """
    made = saved(route_predictions(rows, features, routes))
    late, plain = F.col("split") == "oos", F.col("model") == "no_text"
    text = ~late & ~plain
    errors = forecast_errors(made, ["route", "split", "model", "alpha"])
    best = F.min_by(F.when(text, F.struct("model", "alpha", "n", "mae", "rmse", "r2_vs_base", "direction_accuracy")), F.when(text, F.struct("mae", "rmse", F.when(F.col("model") == "ridge", 0).otherwise(1))))
    base = [F.max(F.when(plain, F.col(c))).alias(f"base_{c}") for c in ("mae", "rmse", "direction_accuracy")]
    judged = errors.groupBy("route").agg(best.alias("b"), *base, F.collect_list(F.when(late, F.struct("model", "mae", "rmse"))).alias("__late"))  # two models
    own = F.get(F.filter("__late", lambda x: x["model"] == F.col("b.model")), F.lit(0))
    judged = judged.select("route", "b.*", *[f"base_{c}" for c in ("mae", "rmse", "direction_accuracy")], own["mae"].alias("oos_mae"), own["rmse"].alias("oos_rmse"))
    tried = made.filter(~late).join(judged.select("route", F.col("model").alias("__model")), "route")
    error, chosen = F.abs(F.col("forecast") - F.col("actual")), F.col("model") == F.col("__model")
    months = tried.groupBy("route", "period_end").agg(
        F.max(F.when(plain, error)).alias("e0"), F.max(F.when(chosen, error)).alias("e1"), F.max("text_available").alias("text"), F.max(F.when(chosen, F.col("actual").between(F.col("lower"), F.col("upper")))).alias("within"),
    )
    half = F.concat(F.year("period_end").cast("string"), F.when(F.month("period_end") <= 6, "H1").otherwise("H2"))
    share = concentration(months.select("route", half.alias("half"), F.greatest(F.col("e0") - F.col("e1"), F.lit(0.0)).alias("gain")), "half", "gain", ["route"])
    covered = months.groupBy("route").agg(F.avg(F.col("text").cast("double")).alias("text_coverage"), F.avg(F.col("within").cast("double")).alias("coverage_90"))
    named = features.groupBy("route").agg(F.collect_set("feature_name").alias("__names"))
    available = F.lit(True)
    for route, prefixes in rule_prefixes.items():
        for p in prefixes:
            available = available & ((F.col("route") != route) | F.coalesce(F.exists("__names", lambda n: F.startswith(n, F.lit(p))), F.lit(False)))
    out = judged.join(covered, "route").join(share, "route").join(named, "route", "left").withColumns({"features": F.coalesce(F.size("__names"), F.lit(0)), "available": available}).drop("__names")
    gates = F.col("available") & (F.col("n") >= LEAST_VALIDATION) & (F.col("mae") < F.col("base_mae")) & (F.col("rmse") < F.col("base_rmse")) & (F.col("direction_accuracy") >= F.col("base_direction_accuracy"))
    return out.withColumn("qualified", gates & (F.col("text_coverage") >= LEAST_COVERAGE) & (F.col("concentration") <= MOST_CONCENTRATION))


def choose_route(compared: DataFrame, rows: DataFrame, base_route: str) -> DataFrame:
    """(selected_route, data_sufficient): the qualified route beside the base with the least errors and features, if there are enough periods with text; else no text.

    ``rows``: with_text rows of the base route, with their split.
    """
    of = lambda s: F.col("split") == s
    covered = lambda s: F.coalesce(F.avg(F.when(of(s), F.col("text_available").cast("double"))), F.lit(0.0)) >= LEAST_MONTHS
    enough = (F.count_if(of("train")) >= LEAST_TRAIN) & (F.count_if(of("validation")) >= LEAST_VALIDATION) & covered("train") & covered("validation")
    best = compared.filter(F.col("qualified") & (F.col("route") != base_route)).agg(F.min_by("route", F.struct("mae", "rmse", "features")).alias("best"))
    chosen = F.when(F.col("data_sufficient") & F.col("best").isNotNull(), F.col("best")).otherwise("no_text_ridge")
    return rows.agg(enough.alias("data_sufficient")).join(best).select(chosen.alias("selected_route"), "data_sufficient")
