"""Operators on closed-form fixtures."""

import random
import time
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.functions import dates, numbers, scoring, text
from tessera.functions.html import visible
from tessera.operators import bootstrap, consensus, dedup, factors, iterate, ledger, market, models, quality, rules, strategy
from tessera.sources import tables


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def days(n, start=date(2026, 1, 5)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += timedelta(days=1)
    return out


BAR = "trade_date date, contract string, open double, high double, low double, close double, volume double, open_interest double"


def bars(spark, rows):
    return spark.createDataFrame([(d, c, p, p, p, p, v, oi) for d, c, p, v, oi in rows], BAR)


def test_label_holds_the_contract_that_was_known(spark):
    rows = [(d, c, p, 1.0, oi) for i, d in enumerate(days(9)) for c, p, oi in (("AA", 100 + 0.4 * i, 10.0 if i < 2 else 1.0), ("BB", 150.0 + i, 5.0))]
    b = bars(spark, rows)
    docs = spark.createDataFrame([("d", days(9)[0])], "doc_id string, publish_time date")
    label = market.forward_labels(docs, market.main_continuous(b), b).first()
    assert label["forward_open_return"] == pytest.approx((100 + 6 * 0.4) / (100 + 0.4) - 1) and label["future_info_ok"]


def test_open_interest_then_volume(spark):
    d = days(2)
    m = market.main_continuous(bars(spark, [(d[0], "A", 1.0, 1.0, 2000.0), (d[0], "B", 1.0, 9.0, 1500.0), (d[1], "A", 1.0, 1000.0, None), (d[1], "B", 1.0, 5000.0, None)])).orderBy("trade_date").collect()
    assert [(r["contract"], r["rolled"], r["selection_basis"]) for r in m] == [("A", False, "open_interest"), ("B", True, "volume")]


def test_baseline_is_causal(spark):
    ds = days(220, date(2025, 1, 2))
    price = [100000 + 80 * i + 120 * ((i % 11) - 5) for i in range(220)]

    def run(p):
        b = bars(spark, [(d, "A", float(x), 1.0, 1.0) for d, x in zip(ds, p)])
        m = market.main_continuous(b)
        out = strategy.mature_baseline(market.same_contract_momentum(m, b, [20, 60, 120]), market.next_open_returns(m, b))
        return {r["day_idx"]: r["position"] for r in out.collect()}

    a, b = run(price), run(price[:180] + [x * 2 for x in price[180:]])
    assert len(a) > 50 and {k: v for k, v in a.items() if k < 180} == {k: v for k, v in b.items() if k < 180}


def test_turnover_counts_the_last_tradable_position(spark):
    pos = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, -0.5)], "day_idx int, s double")
    ret = spark.createDataFrame([(0, None, None, 0.0), (2, None, None, 0.0)], "day_idx int, signal_date date, trade_date date, market_open_return double")
    assert [r["turnover"] for r in strategy.strategy_rows(pos, ret, ["s"], [5.0]).orderBy("day_idx").collect()] == [0.5, 1.0]


def test_settlement_needs_an_earlier_record(spark):
    ds = days(4)
    b = bars(spark, [(d, "A", 100.0 + i, 1.0, 1.0) for i, d in enumerate(ds)])
    rows = [("ok", f"{ds[0]}T16:00:00+08:00", ds[0], "A"), ("late", f"{ds[1]}T00:10:00+08:00", ds[0], "A"), ("wait", f"{ds[3]}T10:00:00+08:00", ds[3], "A"), ("gone", f"{ds[0]}T10:00:00", ds[0], "Z")]
    out = strategy.settle(spark.createDataFrame(rows, "decision_id string, recorded_at string, signal_date date, selected_contract string"), market.main_continuous(b), b)
    assert {r["decision_id"]: r["settlement"] for r in out.collect()} == {"ok": "settled", "late": "recorded_after_entry_open", "wait": "entry_pending", "gone": "contract_bar_missing"}


def test_ordered_dedup_frees_what_a_dropped_document_blocked(spark):
    rows = [("A", date(2020, 1, 1), "u1", "f1"), ("B", date(2020, 1, 2), "u1", "f2"), ("C", date(2020, 1, 3), "u2", "f2"), ("D", date(2020, 1, 4), None, ""), ("E", date(2020, 1, 5), None, "")]
    docs = spark.createDataFrame(rows, "doc_id string, publish_time date, url string, fp string")
    assert {r["doc_id"] for r in dedup.ordered_dedup(docs, ["url", "fp"], near=False).collect()} == {"A", "C", "D", "E"}


def test_near_pairs_of_several_blocks_write_less_than_their_texts(spark, tmp_path, monkeypatch):
    """Copies, contained and edited texts, one short text in many, and empty ones, over blocks of a few texts; the grams aren't written."""
    from tessera.functions import near
    from tessera.functions.text import gram_list

    monkeypatch.setattr(dedup, "BLOCK_BYTES", 4_000, raising=False)
    draw = random.Random(5)
    words = [f"{draw.choice('bcdfg')}{draw.choice('aeiou')}{draw.choice('klmn')}{i % 7}" for i in range(60)]
    rows = []
    for i in range(240):
        text = " ".join(draw.choice(words) for _ in range(draw.choice((3, 40, 60))))
        if i % 3 == 1 and rows[-1][2]:
            old = rows[draw.randrange(len(rows))][2] or "x"
            text = draw.choice((old, old + " " + text[:20], old[: len(old) * 9 // 10], old.replace(words[0], words[1])))
        rows.append((i, date(2020, 1 + i % 2, 1), None if i % 41 == 0 else "" if i % 43 == 0 else text))
    docs = spark.createDataFrame(rows, "doc_id long, period_end date, text string").withColumn("seq", F.col("doc_id") * 7 % 240)
    seq = {i: i * 7 % 240 for i in range(240)}
    sets = {}
    for i, p, t in rows:
        plain = "".join(gram_list(t, (1,)))
        sets[i] = (p, set(gram_list(t, (5,))) or ({plain} if plain else set()))
    similar = lambda a, b: bool(a and b) and len(a & b) / min(len(a), len(b)) >= 0.88
    want = {tuple(sorted((seq[a], seq[b]))) for a in sets for b in sets if a < b and sets[a][0] == sets[b][0] and similar(sets[a][1], sets[b][1])}
    monkeypatch.setattr(iterate, "_folder", lambda session: str(tmp_path))
    got = [tuple(r) for r in dedup.near_pairs(docs).collect()]
    assert len(got) == len(set(got)) > 60 and set(got) == want
    assert sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file()) < sum(len(t or "") for _, _, t in rows)
    # few counters and hits at once
    monkeypatch.setattr(near, "COUNTERS", 50)
    monkeypatch.setattr(near, "HITS", 200)
    block = near.Block(5)
    for i, p, t in rows:
        if p.month == 1:
            block.add(t, seq[i], i)
    block.close()
    assert set(block.pairs(block, 0.88)) == {w for w in want if w[0] in {seq[i] for i, p, _ in rows if p.month == 1}}


def test_near_pairs_count_few_hits(monkeypatch):
    """A text is only looked up among sets as large as its own: fewer steps of counting than grams."""
    from tessera.functions import near

    draw, counted, plain_count = random.Random(7), [], np.bincount
    words = ["".join(draw.choice("abcdefgh") for _ in range(3)) for _ in range(300)]
    block = near.Block(5)
    for i in range(300):
        block.add(" ".join(draw.choice(words) for _ in range(40 if i % 10 else 900)), i, i)
    block.close()
    monkeypatch.setattr(near.np, "bincount", lambda x, *args, **kwargs: counted.append(len(x)) or plain_count(x, *args, **kwargs))
    assert not set(block.pairs(block, 0.88)) and 0 < sum(counted) < sum(block.n)


def test_near_pairs_of_mixed_scripts():
    """Grams of letters and digits, of Chinese signs and of both, and texts shorter than a gram, against plain sets."""
    from tessera.functions import near
    from tessera.functions.text import gram_list

    draw = random.Random(6)
    words = ["anlage", "bericht", "Über", "中文", "价格上涨", "zwei", "x1", "oil"]
    rows = [(i, " ".join(draw.choice(words) for _ in range(2 + i % 60))) for i in range(400)] + [(400, "中"), (401, "a中b"), (402, "A中 b!"), (403, "ab"), (404, "ab"), (405, None), (406, "\U00020000 ...")]
    for size in (5, 7):
        sets = {}
        for i, t in rows:
            plain = "".join(gram_list(t, (1,)))
            sets[i] = set(gram_list(t, (size,))) or ({plain} if plain else set())
        want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) >= 0.88}
        block = near.Block(size)
        for i, t in rows:
            block.add(t, i, i)
        block.close()
        assert set(block.pairs(block, 0.88)) == want and len(want) > 100


def test_normal_text_takes_no_longer_than_a_plain_pattern(spark):
    """Every sign is kept or dropped as by ``gram_list``, and a text takes no three times as long as by a shorter pattern."""
    signs = [chr(i) for i in (*range(0xD800), *range(0xE000, 0x110000))]
    rows = ["x".join(signs[i : i + 1000]) for i in range(0, len(signs), 1000)] + ["", None]
    got = spark.createDataFrame([(t,) for t in rows], "text string").select(text.normal_text(F.col("text")).alias("n")).collect()
    assert [r["n"] for r in got] == [None if t is None else "".join(text.gram_list(t, (1,))) for t in rows]
    long = spark.range(0, 2_000, 1, 4).select(F.repeat(F.concat(F.lit("Über den Preis, 12 % more; "), "id"), 200).alias("text")).localCheckpoint()

    def seconds(column):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            long.select(F.sum(F.length(column))).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds(text.normal_text(F.col("text"))) < 3 * seconds(F.lower(F.regexp_replace("text", "[^0-9a-z]+", "")))


def test_ordered_dedup_against_a_loop(spark):
    draw = random.Random(4)
    rows = [(i, date(2020, 1, 1) + timedelta(days=draw.randrange(9)), f"u{draw.randrange(25)}", f"f{draw.randrange(25)}") for i in range(80)]
    kept, urls, prints = set(), set(), set()
    for i, d, u, f in sorted(rows, key=lambda r: (r[1], r[0])):
        if u not in urls and f not in prints:
            kept.add(i)
            urls.add(u)
            prints.add(f)
    got = dedup.ordered_dedup(spark.createDataFrame(rows, "doc_id long, publish_time date, url string, fp string"), ["url", "fp"], near=False)
    assert {r["doc_id"] for r in got.collect()} == kept


def test_scores(spark):
    assert one(spark, scoring.fused_value(F.lit("true"), F.lit("false"), F.lit("0.9"))) == 0.5
    assert one(spark, scoring.fused_value(F.lit("0.90"), F.lit("0.50"), F.lit("0.8"))) == pytest.approx(0.70)
    assert one(spark, scoring.consensus_status(F.lit("true"), F.lit("false"))) == "disputed"
    assert one(spark, scoring.consensus_status(F.lit("0.5"), F.lit("0.58"))) == "agreed_true"
    assert one(spark, scoring.consensus_status(F.lit("true"), F.lit(None).cast("string"))) == "invalid"
    assert one(spark, numbers.beta_posterior(F.lit(1), F.lit(17))) == pytest.approx(3 / 21)
    assert one(spark, numbers.clip(F.lit(None).cast("double"))) is None and one(spark, numbers.strict_double(F.lit("nan"))) is None
    assert one(spark, numbers.lenient_double(F.lit(""), 2.0)) == 2.0


def test_dates(spark):
    end = dates.period_end
    assert one(spark, end(F.lit("2020-01-08").cast("date"))) == one(spark, end(F.lit("2020-02-29").cast("date"))) == date(2020, 2, 29)
    assert one(spark, dates.advance_period(F.lit("2020-12-31").cast("date"), F.lit(1))) == date(2021, 2, 28)
    assert one(spark, dates.advance_period(F.lit("2021-02-28").cast("date"), F.lit(1))) == date(2021, 3, 31)
    assert one(spark, dates.parse_day(F.lit("2026-08-15T00:36:42+08:00"))) == date(2026, 8, 15) and one(spark, dates.parse_day(F.lit("2026/01/01"))) is None


def test_text(spark):
    assert one(spark, text.normal_url(F.lit("HTTPS://A.com//x//y/?utm_a=1&b=2&FROM=z#t"))) == "https://a.com/x/y?b=2"
    assert one(spark, text.recovered_evidence(F.lit("ab c\nd.e"), F.lit("cd.e"))) == "c\nd.e" and one(spark, text.recovered_evidence(F.lit("ab"), F.lit("x.y"))) is None
    assert one(spark, text.sentences(F.lit("一。二!三"))) == ["一。", "二!", "三"]
    assert one(spark, text.evidence(F.lit("甲乙。丙丁戊。"), [["丙"], ["戊"]])) == "丙丁戊。" and one(spark, text.evidence(F.lit("甲丙乙。丁戊。"), [["丙"], ["戊"]])).startswith("甲丙")
    assert one(spark, text.cut_at_boundary(F.lit("abcde，fgh ijk"), 8)) == "abcde，"
    assert visible("<p>a&amp;b<script>no</script><br>c</p>") == "a&b\nc" and visible(None) is None


def test_consensus_errors(spark):
    texts = spark.createDataFrame([(1, "fact here")], "doc_id int, text string")
    other = spark.createDataFrame([(1, "p", "true", "fact", 0.5), (1, "x", "maybe", "", 2.0), (1, "q", "true", "no such", 0.5)], "doc_id int, name string, value string, evidence string, confidence double")
    got = {(r["name"], r["error"]) for r in consensus.schema_errors(other, texts, ["p", "q", "r"]).collect()}
    assert got == {("x", "unknown_predicate"), ("x", "not_boolean"), ("x", "confidence_out_of_range"), ("q", "ungrounded_evidence"), ("r", "missing_predicate")}


def test_rules_find_a_planted_condition(spark):
    rows = [(i, date(2024, 1, 1) + timedelta(days=i), ["a", "b"] if i < 6 else ["c"], "bullish" if i < 6 else "bearish") for i in range(12)]
    book = rules.induce_rulebook(spark.createDataFrame(rows, "doc_id int, publish_time date, names array<string>, direction_label string"), ["bullish"])
    top = book.filter("rank = 1").first()
    assert (top["conditions"], top["coverage_positive"], top["coverage_negative"], top["support_documents"]) == (["a"], 1.0, 0.0, 6)


def test_violations(spark):
    df = spark.createDataFrame([(1, 1, -1.0, 1), (1, 1, 2.0, 2), (2, None, 1.0, 3)], "k int, c int, x double, line int")
    got = {(r["k"], r["violation"]) for r in quality.violations(df, ["k"], [quality.missing("c"), quality.not_positive("x")], ascending=(["k"], "line", "x")).collect()}
    assert got == {(1, "nonpositive_x"), (1, "duplicate_key"), (2, "missing_c")}


def test_linear_models_against_numpy(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(80, 3)) * [1, 5, 0.1]
    y = x @ [1.0, -2.0, 3.0] + 4 + draw.normal(size=80) * 0.1
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    m = models.ridge(df, ["a", "b", "c"], "y", 2.0)
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(m.coefficients, np.linalg.solve(z.T @ z + 2 * np.eye(3), z.T @ (y - y.mean()))) and m.intercept == pytest.approx(y.mean())
    net = models.elastic_net(df, ["a", "b", "c"], "y", 0.1, 0.5)
    g = z.T @ (y - y.mean() - z @ net.coefficients) / 80 - 0.05 * np.array(net.coefficients)
    assert np.allclose(g, 0.05 * np.sign(net.coefficients), atol=1e-6)
    assert models.ridge(df.limit(0), ["a"], "y", 1.0).intercept == 0.0


def test_bootstrap(spark):
    better = spark.createDataFrame([(d, 0.001 + 0.0001 * (i % 3)) for i, d in enumerate(days(130))], "trade_date date, difference double")
    out = [bootstrap.bootstrap(better, samples=200, circular=c, rule=r).first() for c in (False, True) for r in ("rank", "span", "linear")]
    assert all(o["conclusion"] == "positive_increment_established" and o["ci_lower_95"] > 0 for o in out)
    assert bootstrap.bootstrap(better, samples=200).first() == out[0] and bootstrap.bootstrap(better.limit(10)).first()["conclusion"] == "insufficient_history"
    assert bootstrap.draws(7, 3, 5, 4) == bootstrap.draws(7, 3, 5, 4)


def test_ledger(spark):
    held = spark.createDataFrame([("a", "d1", 1.0, "t1")], "id string, day string, p double, at string")
    new = spark.createDataFrame([("a", "d1", 1.0, "t2"), ("b", "d2", 2.0, "t"), ("b", "d2", 2.0, "t")], held.schema)
    assert ledger.conflicts(held, new, "id", ["day", "p"], "day").count() == 0 and ledger.append_new(held, new, "id").count() == 1
    bad = spark.createDataFrame([("a", "d1", 9.0, ""), ("c", "d1", 1.0, "")], held.schema)
    assert {(r[0], r[1]) for r in ledger.conflicts(held, bad, "id", ["day", "p"], "day").collect()} == {("a", "immutable_field_changed"), ("c", "second_id_for_day")}
    digest = lambda df: ledger.row_digest(df).first()["digest"]
    assert digest(new) == digest(new.orderBy(F.desc("id")).repartition(3)) != digest(bad) and ledger.row_digest(held.limit(0)).first()["rows"] == 0


def test_ledger_stream_is_idempotent(spark, tmp_path):
    from tessera.streaming.ledger import append_stream

    schema = "id string, day string, p double"
    source, path = str(tmp_path / "in"), str(tmp_path / "ledger")
    run = lambda n: append_stream(spark.readStream.schema(schema).json(source), path, str(tmp_path / f"cp{n}"), "id", ["p"]).awaitTermination()
    spark.createDataFrame([("a", "1", 1.0), ("b", "2", 2.0)], schema).write.json(source)
    run(1)
    run(2)  # all again, as after a lost checkpoint
    assert spark.read.parquet(path).count() == 2
    spark.createDataFrame([("a", "1", 5.0)], schema).write.mode("append").json(source)
    with pytest.raises(Exception, match="contradicts"):
        run(2)
    assert spark.read.parquet(path).count() == 2


def test_batch_and_stream_bursts_agree(spark, data, tmp_path):
    from tessera.streaming.ledger import event_bursts

    events = spark.read.parquet(f"{data}/events.parquet").select("ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "events"))
    query = event_bursts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), late="60 days").writeStream.outputMode("complete").format("memory").queryName("bursts").start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted((str(r["window_start"]), r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("bursts")) == key(event_bursts(events))


def test_csv_keeps_codes_and_blanks(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text('code,text,x\n000123,"two\nlines ""q""",\n,plain,1.5\n', encoding="utf-8")
    rows = tables.read_csv(spark, str(f), "code string, text string, x double").collect()
    assert [tuple(r) for r in rows] == [("000123", 'two\nlines "q"', None), (None, "plain", 1.5)]
    assert tables.read_csv(spark, str(tmp_path / "none.csv"), "a int").count() == 0
    tables.write_csv(spark.createDataFrame([(True, 0.5, 1)], "b boolean, f double, i int"), str(tmp_path / "out"), ["b", "f"], digits=6)
    assert spark.read.text(str(tmp_path / "out")).filter("value <> 'b,f'").first()[0] == "true,0.500000"


def test_correlations_of_constant_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("a", 1.0, 5.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("b", 3.0, 6.0), ("c", 1.0, None), ("c", 2.0, 1.0), ("c", 3.0, 1.0)], "k string, x double, y double")
    got = {r["k"]: r["c"] for r in df.groupBy("k").agg(numbers.correlation_or_zero(F.col("x"), F.col("y")).alias("c")).collect()}
    assert got == pytest.approx({"a": 0.0, "b": 1.0, "c": 0.0})
    assert [tuple(r) for r in factors.rank_correlation(df, "x", "y", ["k"]).collect()] == [("b", 3, pytest.approx(1.0))]


def test_nearest_vectors_by_blocks(spark, monkeypatch):
    """Several blocks of each side, equal vectors, vectors without length, nulls, and groups of fewer than k."""
    import numpy as np
    from tessera.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "ITEM_BLOCK", 25)
    draw = np.random.default_rng(3)
    pool = [[0.0] * 4, *draw.integers(-99, 99, (39, 4)).astype(float).tolist()]
    rows = [(i, [None, "a", "b"][i % 3] if i < 117 else "few", pool[int(draw.integers(0, 40))]) for i in range(119)] + [(500, "a", None), (None, "a", [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, _, v in rows[:119]}
    for per in ([], ["label"]):
        want = set()
        for q in range(0, 119, 4):
            groups = {}
            for i, label, _ in rows[:119]:
                if i != q:
                    groups.setdefault(label if per else None, []).append((-round(float(unit[q] @ unit[i]), 9), i))
            want |= {(q, i, n) for g in groups.values() for n, (_, i) in enumerate(sorted(g)[:3], 1)}
        got = retrieval.top_similar(df.filter("vec_id % 4 = 0 AND vec_id < 119"), df, 3, per)
        assert {(r["query_id"], r["vec_id"], r["rank"]) for r in got.collect()} == want
    assert retrieval.top_similar(df.limit(0), df, 3).collect() == []
