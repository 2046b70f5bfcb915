"""Walk-forward forecasts against refits from scratch for every date, and marginal effects against leaving each document out."""

import math

import numpy as np
import pandas as pd
import pytest
from tessera import catalogue
from tessera.operators import nowcast
from tessera.plans import nowcast_queries as q


def ridge(x, y, alpha):
    x, y = np.array(x, float).reshape(len(y), -1), np.array(y, float)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = np.column_stack((np.ones(len(y)), (x - mean) / scale))
    beta = np.linalg.solve(z.T @ z + alpha * np.diag([0.0] + [1.0] * x.shape[1]), z.T @ y)
    return beta, mean, scale


def told(model, row, clip=None):
    z = (np.asarray(row, float) - model[1]) / model[2]
    return model[0][0] + model[0][1:] @ (np.clip(z, -clip, clip) if clip else z)


def elastic(x, y, alpha=0.08, l1=0.5):
    x, y = np.array(x, float), np.array(y, float)
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-12, x.std(0), 1.0)
    z, b = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(300):
        before = b.copy()
        for j in range(len(b)):
            rho = z[:, j] @ (y - y.mean() - z @ b + z[:, j] * b[j]) / len(y)
            b[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (z[:, j] @ z[:, j] / len(y) + alpha * (1 - l1))
        if np.abs(b - before).max() < 1e-8:
            break
    return np.append(y.mean(), b), mean, scale


def refitted(rows: pd.DataFrame, fields, least_text):
    """The six forecasts of one series, each date from its own history."""
    out = []
    season = lambda e: [math.sin(e.month * math.pi / 6), math.cos(e.month * math.pi / 6)]
    for row in rows.itertuples():
        past = rows[rows.actual.notna() & (rows.release_date <= row.period_end)]
        if len(past) < 12:
            continue
        y, ends = past.actual.tolist(), past.period_end.tolist()
        same = [v for v, e in zip(y, ends) if e.month == row.period_end.month][-5:]
        ar1 = told(ridge([[v] for v in y[:-1]], y[1:], 1.0), [y[-1]])
        pairs = [[v, *season(e)] for v, e in zip(y[:-1], ends)]
        plain = told(ridge(pairs, y[1:], 2.0), [y[-1], *season(row.period_end)]) if len(pairs) >= 8 else ar1
        x, now = past[fields].to_numpy(float), [getattr(row, f) for f in fields]
        enough = (past.document_count > 0).sum() >= least_text
        out.append({"period_end": row.period_end, "persistence": y[-1], "seasonal": np.mean(same) if same else y[-1], "ar1": ar1, "no_text_ridge": plain, "ridge_text": told(ridge(x, y, 8.0), now) if enough else plain, "elastic_net_text": told(elastic(x, y), now) if enough else plain})
    return pd.DataFrame(out)


def best_model(rows: pd.DataFrame, sets):
    used = rows[(rows.document_count > 0) & rows.actual.notna()]
    train, held = used[used.split == "train"], used[used.split == "validation"]
    cap = (held.no_text_ridge - held.actual).abs().mean()
    best = None
    for name, fields in sets.items():
        for alpha in (10.0, 20.0, 50.0, 100.0, 200.0):
            model = ridge(train[fields], train.actual - train.no_text_ridge, alpha)
            left = np.array([told(model, x, 3.0) for x in held[fields].to_numpy(float)])
            for weight in (0.25, 0.5, 0.75, 1.0):
                e = held.no_text_ridge + np.clip(weight * left, -cap, cap) - held.actual
                score = (round(np.abs(e).mean(), 12), round(math.sqrt((e**2).mean()), 12), len(fields))
                if best is None or score < best[0]:
                    best = (score, name, alpha, weight, model, cap)
    return best[1:]


@pytest.fixture(scope="module")
def tables(spark, data):
    rows = q.series(spark, data).join(q.features(spark, data), "period_end", "left").fillna(0, q.FIELDS).toPandas()
    rows["period_end"], rows["release_date"] = pd.to_datetime(rows.period_end), pd.to_datetime(rows.release_date)
    rows["split"] = np.where(rows.period_end <= q.TRAIN_END, "train", np.where(rows.period_end <= q.VALIDATION_END, "validation", "oos"))
    return {k: g.sort_values("period_end").reset_index(drop=True) for k, g in rows.groupby("o_orderpriority")}


@pytest.fixture(scope="module")
def refits(tables):
    return {k: t.merge(refitted(t, q.FIELDS, 12), on="period_end") for k, t in tables.items()}


def test_every_date_equals_a_refit_from_scratch(spark, data, refits):
    got = catalogue.QUERIES["period_models"](spark, data).toPandas()
    assert len(got) == sum(map(len, refits.values())) > 100
    for key, want in refits.items():
        own = got[got.o_orderpriority == key].sort_values("period_end")
        assert own.period_end.tolist() == [str(e.date()) for e in want.period_end]
        for c in nowcast.BASELINES:
            np.testing.assert_allclose(own[c].to_numpy(float), want[c].to_numpy(float), atol=2e-4, err_msg=c)


def test_unreleased_values_change_nothing(spark):
    """A forecast depends on what was released by its period's end alone."""
    ends = pd.date_range("2000-01-31", periods=40, freq="ME")
    rows = [("s", e.date(), float((i * 7919) % 13), (e + pd.Timedelta(days=18)).date()) for i, e in enumerate(ends)]
    late = rows[:30] + [(k, e, y + 100, d) for k, e, y, d in rows[30:]]
    schema = "k string, period_end date, actual double, release_date date"
    features = spark.createDataFrame([(e.date(), 1.0, float(i % 5)) for i, e in enumerate(ends)], "period_end date, document_count double, f double")
    one, other = (nowcast.baseline_forecasts(spark.createDataFrame(x, schema), features, ["f"], ["k"]).select("period_end", *nowcast.BASELINES).orderBy("period_end").toPandas() for x in (rows, late))
    same = one.period_end <= rows[30][1]
    assert same.sum() >= 15 and one[same].equals(other[same]) and not one[~same].equals(other[~same])


def test_walk_forward_against_a_plain_grid(spark, data, refits):
    got = catalogue.QUERIES["walk_forward_forecasts"](spark, data).toPandas()
    assert len(got) == sum(map(len, refits.values()))
    for key, rows in refits.items():
        name, alpha, weight, model, cap = best_model(rows, q.SETS)
        own = got[got.o_orderpriority == key].sort_values("period_end").reset_index(drop=True)
        assert set(own.feature_set) == {name} and set(own.alpha) == {alpha} and set(own.text_weight) == {weight}
        more = [np.clip(weight * told(model, x, 3.0), -cap, cap) if n > 0 else 0.0 for x, n in zip(rows[q.SETS[name]].to_numpy(float), rows.document_count)]
        forecast = rows.no_text_ridge + more
        np.testing.assert_allclose(own.forecast, forecast, atol=2e-4)
        for i, end in enumerate(rows.period_end):
            past = (rows.actual - forecast).abs()[rows.release_date <= end]
            width = np.quantile(past, 0.9) if len(past) else 3.0
            assert (own.upper_90[i] - own.lower_90[i]) / 2 == pytest.approx(width, abs=2e-4)


def test_marginal_effect_equals_leaving_the_document_out(spark, data, refits):
    docs = q.documents(spark, data).toPandas()
    docs["period_end"], docs["copy"] = pd.to_datetime(docs.period_end), docs.doc_id % 10 == 3
    got = catalogue.QUERIES["marginal_text_effects"](spark, data).toPandas().set_index(["o_orderpriority", "doc_id"])
    seen = 0
    for key, rows in list(refits.items())[:2]:
        name, _, weight, model, cap = best_model(rows, q.SETS)
        base = rows.set_index("period_end").no_text_ridge

        def forecast(own, end):
            if not len(own):
                return base[end]
            means = own[q.MEANS].mean().to_dict() | {"document_count": len(own)}
            return base[end] + np.clip(weight * told(model, [means[f] for f in q.SETS[name]], 3.0), -cap, cap)

        for d in docs[docs.period_end.isin(base.index)].itertuples():
            own = docs[(docs.period_end == d.period_end) & ~docs["copy"]]
            after, before = forecast(own, d.period_end), forecast(own[own.doc_id != d.doc_id], d.period_end)
            r = got.loc[(key, d.doc_id)]
            assert (r.nowcast_before, r.nowcast_after, r.marginal_change) == pytest.approx((before, after, after - before), abs=2e-4)
            assert (r.after_document_count, r.before_document_count) == (len(own), len(own) - (not d.copy))
            seen += 1
    assert seen > 150 and (got.marginal_change != 0).any()


def test_single_text_model_against_a_plain_grid(spark, data):
    docs = q.single_texts(spark, data).toPandas()
    train, held = docs[docs.split == "train"], docs[docs.split == "validation"]
    best = None
    for name, fields in q.SINGLE.items():
        for alpha in (50.0, 100.0, 200.0, 500.0):
            model = ridge(train[fields], train.actual, alpha)
            raw = np.array([told(model, x) for x in held[fields].to_numpy(float)])
            for weight in (0.5, 0.75, 1.0):
                e = weight * raw + (1 - weight) * held.latest - held.actual
                score = (round(np.abs(e).mean(), 12), round(math.sqrt((e**2).mean()), 12), len(fields))
                if best is None or score < best[0]:
                    best = (score, name, alpha, weight, np.quantile(np.abs(e), 0.9))
    got = catalogue.QUERIES["single_text_model"](spark, data).first()
    assert (got["feature_set"], got["alpha"], got["ridge_weight"], got["n"], got["n_validation"]) == (*best[1:4], len(train), len(held))
    plain = (held.latest - held.actual).abs().mean()
    assert (got["validation_mae"], got["validation_rmse"], got["half_width"], got["persistence_mae"]) == pytest.approx((best[0][0], best[0][1], best[4], plain), abs=2e-4)
    gain = plain - best[0][0]
    assert got["increment_status"] == ("validated_positive" if gain >= 0.1 and gain / plain >= 0.05 else "not_established")
