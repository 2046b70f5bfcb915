"""Links, events, grounded predicates, second annotations and route forecasts on small fixtures."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.functions import lexicon
from tessera.operators import annotation, corpus, events, ledger, models, routes, rules

DOC = "doc_id string, source_type string, source_name string, title string, content string, publish_time date"
DAY = date(2026, 1, 5)


def docs(spark, *rows):
    return spark.createDataFrame([(i, k, n, t, c, d) for i, k, n, t, c, d in rows], DOC)


def test_research_predicates_and_sources(spark):
    d = docs(
        spark,
        ("a", "news", "某报", "停产检修", "库存下降12%，预计影响2万吨", DAY), ("b", "official_company_announcement", "某公司", "新能源汽车产销快报", "储能项目投产，销量1,200台", DAY),
        ("c", "news", None, None, None, DAY), ("d", "news", "", "广期所公告", "", DAY),
    )
    plain = {(r["doc_id"], r["name"]): r["evidence_text"] for r in events.research_predicates(d).filter("value").collect()}
    assert plain == {
        ("a", "supply_disruption"): "停产", ("a", "inventory_drawdown"): "库存下降", ("a", "quantitative_evidence"): "12%", ("a", "uncertainty_high"): "预计",
        ("b", "supply_expansion"): "投产", ("d", "authoritative_source"): "广期所",
    }
    told = {(r["doc_id"], r["name"]): r["evidence_text"] for r in events.research_predicates(d, by_source=True).filter("value").collect()}
    assert told == plain | {("b", "authoritative_source"): "某公司", ("b", "demand_ev_positive"): "产销快报", ("b", "demand_storage_positive"): "储能", ("b", "quantitative_evidence"): "1,200台"}
    every = events.research_predicates(d).collect()
    assert len(every) == 4 * len(lexicon.RESEARCH) and {round(r["confidence"], 2) for r in every if not r["value"]} == {0.65}


POOL = "entity string, name string, sector string, size double"


def test_link_cascade(spark):
    pool = spark.createDataFrame([("1", "宁德时代", "锂电", 9.0), ("2", "亿纬锂能", "锂电", 3.0), ("3", "国轩高科", "锂电", 5.0), ("4", "隆基绿能", "光伏", 7.0)], POOL)
    aliases = spark.createDataFrame([("1", "宁德"), ("1", "CATL"), ("2", "亿纬"), ("4", "隆基")], "entity string, alias string")
    d = docs(
        spark,
        ("a", "news", "x", "宁德时代扩产", "与亿纬合作", DAY), ("b", "news", "x", "CATL report", "宁德 and 隆基绿能", DAY), ("c", "policy", "x", "动力电池回收", "", DAY), ("d", "news", "x", "电动汽车", "", DAY),
        ("e", "ir_qa", "x", "动力电池", "", DAY), ("f", "news", "x", "其他", "正文项目关联：宁德时代", DAY),
    )
    got = sorted((r["doc_id"], r["entity"], r["confidence"], r["step"]) for r in events.link_cascade(d, pool, aliases).collect())
    assert got == [
        ("a", "1", 0.98, 0), ("a", "2", 0.84, 0), ("b", "1", 0.95, 0), ("b", "4", 0.91, 0), ("c", "1", 0.78, 1), ("c", "2", 0.78, 1), ("c", "3", 0.78, 1), ("d", "1", 0.58, 2), ("d", "3", 0.58, 2),
    ]


def test_events_keep_their_numbers(spark):
    d = docs(
        spark,
        ("a", "news", "证券时报", "标题", "一句。某公司扩产，投资20亿元。", DAY), ("b", "news", "x", "无事", "无", DAY), ("c", "policy", "国务院", "行动方案", "支持", DAY),
        *[(f"q{i}", "ir_qa", "x", "问", "答", date(2026, 1, 4 + i)) for i in range(3)],
    )
    links = spark.createDataFrame([("a", "1", "某公司", "锂电", 0, 1), ("b", "1", "某公司", "锂电", 0, 1), ("c", "1", "某公司", "锂电", 1, 1), ("c", "2", "别家", "光伏", 2, 2), *[(f"q{i}", "1", "某公司", "锂电", 0, 1) for i in range(3)]], "doc_id string, entity string, name string, sector string, step int, link_pos int")
    out = {r["event_id"]: r for r in events.build_events(d, links).collect()}
    assert {k: (r["doc_id"], r["event_type"]) for k, r in out.items()} == {"E001": ("a", "capacity_expansion"), "E003": ("c", "policy_support"), "E004": ("c", "policy_support"), "E007": ("q2", "investor_question_pressure")}
    a = out["E001"]
    assert a["evidence_text"] == "某公司扩产，投资20亿元。" and a["subject"] == "证券时报" and a["object"] == lexicon.SECTORS["锂电"][0]
    assert a["evidence_strength"] == pytest.approx(0.30 * 0.8 + 0.25 + 0.25 * 0.75 + 0.20, abs=0.006)  # no date or project
    assert out["E004"]["subject"] == "国务院" and out["E007"]["subject"] == "投资者与公司管理层"
    priors = spark.createDataFrame([("capacity_expansion", 0.625)], "event_type string, posterior double")
    p = {(r["event_id"], r["name"]): r["value"] for r in events.event_predicates(events.build_events(d, links), d, priors).collect()}
    assert len(p) == 4 * 19 and [p["E001", n] for n in ("capacity_policy_support", "event_has_quantitative_target", "source_major_media", "has_policy_support", "event_has_short_term_price_impact")] == ["true", "true", "true", "false", "0.63"]
    assert p["E007", "investor_questions_increase"] == "true" and p["E003", "event_has_short_term_price_impact"] == "0.50" and p["E001", "event_evidence_strength"] == f"{a['evidence_strength']:.2f}"


def test_rows_are_numbered_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = events.numbered(df, ["k"], "n").collect()
    assert sorted((r["k"], r["n"]) for r in got) == [(i, i + 1) for i in range(1000)]


def test_candidates_are_valid_or_replaced(spark):
    texts = spark.createDataFrame([("a", "alpha beta"), ("b", "gamma")], "doc_id string, text string")
    rows = [("a", 0, ["p", "q", "p"], 1, 0.5, 0.9, 3, " alpha "), ("a", 1, ["x"], 1, 0.5, 0.9, 3, "alpha"), ("a", 2, ["p"], 0, 0.5, 0.9, 3, "alpha"), ("a", 3, ["q"], 1, 0.5, 0.9, 3, "alpha"), ("b", 0, ["p"], 1, 0.5, 0.9, 13, "gamma")]
    candidates = spark.createDataFrame(rows, "doc_id string, position int, conditions array<string>, direction int, intensity double, confidence double, lag int, evidence_text string")
    predicates = spark.createDataFrame([("b", "p", True, -1, 0.4, 0.5, 0, "gamma"), ("b", "q", True, 1, 0.9, 0.9, 7, "gamma"), ("b", "r", False, 0, 0.0, 0.5, 0, "")], "doc_id string, name string, value boolean, direction int, intensity double, confidence double, lag int, evidence_text string")
    got = sorted((r["doc_id"], r["conditions"], r["direction"], r["lag_bucket"], r["proposed_by"]) for r in annotation.candidate_rules(candidates, predicates, texts, ["p", "q", "r"]).collect())
    assert got == [("a", ["p", "q"], 1, "1_3", "annotator"), ("b", ["p"], -1, "0", "predicate"), ("b", ["q"], 1, "7_12", "predicate")]


def test_nearest_frozen_rules(spark):
    rules_ = spark.createDataFrame([("R1", "policy AND export"), ("R2", "inventory AND cost"), ("R3", "policy AND exports")], "rule_id string, condition string")
    got = annotation.similar_rules(spark.createDataFrame([("policy AND export",)], "condition string"), rules_).orderBy("rank").collect()
    assert [(r["rule_id"], r["rank"]) for r in got] == [("R1", 1), ("R3", 2)] and got[0]["similarity"] == pytest.approx(1.0)


def test_no_rule_qualifies(spark):
    rows = [([f"p{i}", "q"], 1, 0, -0.1, 0.5, 1, 1, i, 1, float(i)) for i in range(20)]
    candidates = spark.createDataFrame(rows, "conditions array<string>, support_count long, positive_count long, avg_return double, avg_evidence double, entity_count long, date_count long, covered long, cover long, score double")
    got = rules.select_rules(candidates).orderBy("rule_id").collect()
    assert len(got) == 12 and [r["score"] for r in got] == [float(i) for i in range(19, 7, -1)] and {r["status"] for r in got} == {"candidate"}


def test_corpus_gates_and_keys(spark):
    columns = "doc_id string, source_type string, title string, content string, publish_time date, source_name string, url string"
    long = "储能 " + "字" * 900
    a = spark.createDataFrame([("1", "policy", "t", long, DAY, "s", "http://A.com/x#1"), ("2", "blog", "t", long + "b", DAY, "s", "http://a.com/x"), ("3", "news", "t", long, DAY, "s", ""), ("4", "news", "t", long + "c", DAY, "s", None), ("5", "news", "储能", "short", DAY, "s", "u://1"), ("6", "news", "t", "x" * 90, DAY, "s", "u://2"), ("7", "news", "储能", "y" * 13_000, DAY, "s", "u://3"), ("8", "news", "t", long, date(2020, 1, 1), "s", "u://4")], columns)
    got = {r["doc_id"]: (r["source_type"], len(r["content"])) for r in corpus.assemble([a.filter("doc_id < 4"), a.filter("doc_id >= 4")], ["储能"], "2026-01-01", "2026-12-31").collect()}
    assert got == {"1": ("policy", 903), "3": ("news", 903), "7": ("news", 12_000)}


def test_routes_against_numpy(spark):
    draw = np.random.default_rng(0)
    ends = [date(2010 + i // 12, i % 12 + 1, 28) for i in range(120)]
    value = np.cumsum(draw.normal(size=120)) * 0.2 + np.sin(np.arange(120) / 2)
    text = np.append(np.diff(value), 0.0) + draw.normal(size=120) * 0.1
    targets = spark.createDataFrame([(e.replace(day=1), e, date(e.year + e.month // 12, e.month % 12 + 1, 15), float(v)) for e, v in zip(ends, value)], "period_start date, period_end date, release_date date, actual double")
    rows = routes.model_rows(targets).withColumn("split", F.when(F.year("period_end") <= 2016, "train").when(F.year("period_end") <= 2018, "validation").otherwise("oos"))
    got = {r["period_end"]: r for r in rows.collect()}
    for i in range(13, 120):  # by the end of a period all before it but the last one's are out, and the last one's too
        r = got[ends[i]]
        assert (r["latest_released"], r["latest_change"]) == pytest.approx((value[i - 1], value[i - 1] - value[i - 2])) and r["seasonal_value"] == pytest.approx(value[i - 12])
    features = spark.createDataFrame([("base", e, "t.x", float(x)) for e, x in zip(ends, text)], "route string, period_end date, feature_name string, feature_value double")
    out = routes.compare_routes(rows, features, ["base"]).first()
    own = routes.with_text(rows, features, ["t.x"]).orderBy("period_end").toPandas()

    def fit(train, test, columns, alpha):
        x, y = train[columns].to_numpy(float), train["target"].to_numpy(float)
        mean, scale = x.mean(0), np.where(x.std(0) > 1e-12, x.std(0), 1.0)
        z = (x - mean) / scale
        beta = np.linalg.lstsq(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()), rcond=None)[0]
        return (test[columns].to_numpy(float) - mean) / scale @ beta + y.mean()

    train, check = own[own.split == "train"], own[own.split == "validation"]
    cut = max(12, int(len(train) * 0.75))
    errors = {}
    for name, columns in (("base", routes.OWN_PAST), ("ridge", [*routes.OWN_PAST, "t.x"])):
        alpha = min((float(np.abs(fit(train[:cut], train[cut:], columns, a) - train["target"][cut:]).mean()), a) for a in routes.ALPHAS)[1]
        e = fit(train, check, columns, alpha) - check["target"]
        errors[name] = (np.abs(e).mean(), np.sqrt((e**2).mean()), alpha)
    assert (out["base_mae"], out["base_rmse"]) == pytest.approx(errors["base"][:2])
    if out["model"] == "ridge":
        assert (out["mae"], out["rmse"], out["alpha"]) == pytest.approx(errors["ridge"])
    else:
        assert out["mae"] <= errors["ridge"][0] + 1e-9
    assert out["text_coverage"] == 1.0 and out["mae"] < out["base_mae"] and out["qualified"]
    made = routes.route_predictions(rows, features.unionByName(features.filter("period_end < '2000-01-01'").withColumn("route", F.lit("bare"))), ["base", "bare"]).toPandas().sort_values("period_end")
    alpha, columns, every = errors["ridge"][2], [*routes.OWN_PAST, "t.x"], own[own.split != "oos"]
    for at, on in (("validation", train), ("oos", every)):  # out of sample: the penalty of validation, fitted on both splits before
        one = made[(made.route == "base") & (made.model == "ridge") & (made.split == at)]
        width = routes.INTERVAL * (on["target"] - fit(on, on, columns, alpha)).std(ddof=0)
        want = fit(on, own[own.split == at], columns, alpha)
        assert one["forecast"].to_numpy() == pytest.approx(want) and one["upper"].to_numpy() == pytest.approx(want + width) and one["lower"].to_numpy() == pytest.approx(want - width)
    bare = made[(made.route == "bare") & (made.split == "validation")]  # without features, every route is the model without text
    assert bare[bare.model == "ridge"]["forecast"].to_numpy() == pytest.approx(bare[bare.model == "no_text"]["forecast"].to_numpy()) and not bare["text_available"].any()
    best = made[(made.route == "base") & (made.split == "validation") & (made.model == out["model"])].reset_index()
    plain = made[(made.route == "base") & (made.model == "no_text")].reset_index()
    gain = np.maximum((plain["forecast"] - plain["actual"]).abs() - (best["forecast"] - best["actual"]).abs(), 0)
    halves = gain.groupby(np.array([f"{d.year}{d.month <= 6}" for d in best["period_end"]])).sum()
    assert out["concentration"] == pytest.approx(halves.max() / halves.sum()) and out["coverage_90"] == pytest.approx(best["actual"].between(best["lower"], best["upper"]).mean())
    late = made[(made.route == "base") & (made.split == "oos") & (made.model == out["model"])]
    assert (out["oos_mae"], out["oos_rmse"]) == pytest.approx(((late["forecast"] - late["actual"]).abs().mean(), np.sqrt(((late["forecast"] - late["actual"]) ** 2).mean())))
    assert out["direction_accuracy"] == pytest.approx((((best["actual"] - best["base"]) >= 0) == ((best["forecast"] - best["base"]) >= 0)).mean())
    chosen = routes.choose_route(routes.compare_routes(rows, features.unionByName(features.withColumn("route", F.lit("rules"))), ["base", "rules"]), routes.with_text(rows, features, ["t.x"]), "base").first()
    assert chosen["selected_route"] == "rules" and chosen["data_sufficient"]


def test_reveal_is_guarded(spark):
    manifest, other = (spark.createDataFrame([("t", 1, d)], "name string, rows long, digest string") for d in ("a", "b"))
    none = spark.createDataFrame([], "x int")
    ledger.reveal(manifest, manifest, none)
    with pytest.raises(ValueError, match="changed: t"):
        ledger.reveal(manifest, other, none)
    with pytest.raises(ValueError, match="before"):
        ledger.reveal(manifest, manifest, spark.range(1))


def test_contributions_by_size(spark):
    model = models.Linear(("a", "b", "c"), (1.0, -5.0, 2.0), (0.0, 1.0, 0.0), (1.0, 1.0, 2.0), 0.5)
    got = models.contributions(spark.createDataFrame([(1, 3.0, 2.0, 6.0)], "k int, a double, b double, c double"), model, ["k"], 2).collect()
    assert [tuple(r) for r in got] == [(1, "c", 6.0, 1), (1, "b", -5.0, 2)]
