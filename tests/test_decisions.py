import hashlib
import json
import random
from datetime import date, timedelta

from tessera.operators import decisions, ledger
from tessera.operators.decisions import Policy

DAY = date(2020, 1, 1)


def _main(spark, closes):
    rows = [(i, DAY + timedelta(days=i), "A" if i < 30 else "B", float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "day_idx int, trade_date date, contract string, close double")


def test_prefix_digests_follow_rows_of_their_past_only(spark):
    rng = random.Random(5)
    rows = [(DAY + timedelta(days=rng.randrange(12)) if rng.random() < 0.9 else None, f"x{rng.randrange(4)}", rng.choice([None, "1"])) for _ in range(200)]
    days = spark.createDataFrame([(DAY + timedelta(days=d),) for d in (-1, 3, 7, 20)], "d date")
    of = lambda some: {r["day"]: (r["rows"], r["digest"]) for r in decisions.prefix_digests(spark.createDataFrame(some, "t date, a string, b string"), "t", ["t", "a", "b"], days).collect()}
    got = of(rows)
    for d in got:
        hashes = [hashlib.sha256(json.dumps({"t": str(t), "a": a or "", "b": b or ""}, separators=(",", ":")).encode()).hexdigest() for t, a, b in rows if t and t <= d]
        lanes = sum(int(h[:15], 16) for h in hashes), sum(int(h[15:30], 16) for h in hashes)
        assert got[d] == (len(hashes), hashlib.sha256(f"{len(hashes)}:{lanes[0]}:{lanes[1]}".encode()).hexdigest())
    assert of(rows[::-1]) == got and len(got) == 4
    later = of(rows + [(DAY + timedelta(days=5), "late", "1")])
    assert [later[d] == got[d] for d in sorted(got)] == [True, True, False, False]
    assert {n for n, _ in of([]).values()} == {0}


def test_momentum_falls_back_only_without_any_bar(spark):
    main = _main(spark, range(100, 150))
    bars = spark.createDataFrame([(DAY + timedelta(days=12), "B", 50.0), (DAY + timedelta(days=2), "A", 10.0)], "trade_date date, contract string, close double")
    own = {r["day_idx"]: r["momentum_20d"] for r in decisions.momentum_context(main, bars, [20]).collect()}
    assert {d for d, m in own.items() if m is not None} == {22, 32}  # one missing bar never falls back
    assert own[22] == 122 / 10.0 - 1 and own[32] == 132 / 50.0 - 1
    smooth = {r["day_idx"]: r["momentum_20d"] for r in decisions.momentum_context(main, bars.limit(0), [20]).collect()}
    assert all((smooth[d] is None) if d < 20 else abs(smooth[d] - ((100 + d) / (80 + d) - 1)) < 1e-12 for d in range(50))


def test_recorded_as_one_after_the_other(spark):
    rng = random.Random(11)
    schema = "decision_id string, strategy_version string, signal_date int, position double, recorded_at int"
    held = [(f"d{i}", "v", i, 0.5, 0) for i in range(0, 20, 3)]
    sent = [(f"d{rng.randrange(25)}", "v", 0, rng.choice([0.5, 0.5, 0.7]), t) for t in range(1, 90)]
    sent = [(k, v, int(k[1:]) if rng.random() < 0.8 else 1, p, t) for k, v, _, p, t in sent]
    book, first, want = {h[0]: h for h in held}, {}, {}
    for row in sent:
        k, old = row[0], book.get(row[0])
        first.setdefault(k, row)
        if not old and first[k][2] != row[2]:
            old = first[k]
        if old:
            bad = [n for n, i in (("signal_date", 2), ("position", 3)) if old[i] != row[i]]
            want[row[4]] = ("changed" if bad else "already_recorded", bad)
        elif any(b[2] == row[2] for b in book.values()):
            want[row[4]] = ("second", None)
        else:
            book[k], want[row[4]] = row, ("recorded", [])
    out = decisions.recorded(spark.createDataFrame(held, schema), spark.createDataFrame(sent, schema), ["signal_date", "position"])
    got = {r["recorded_at"]: (r["outcome"], r["changed_fields"] if r["outcome"] != "second" else None) for r in out.collect()}
    assert got == want
    assert {w[0] for w in want.values()} == {"changed", "already_recorded", "second", "recorded"} == {g[0] for g in got.values()}


def test_a_decision_built_again_has_its_id_and_any_input_changes_it(spark):
    main = _main(spark, range(100, 110))
    baseline = spark.createDataFrame([(i, 0.5) for i in range(4, 10)], "day_idx int, position double")
    events = spark.createDataFrame([("s1", 5, 0.8, 0.5), ("s2", 7, 0.4, 1.0)], "doc_id string, day_idx int, score double, confidence double")
    market = spark.createDataFrame([(DAY + timedelta(days=i), 1.0) for i in range(10)], "t date, p double")
    days = main.select("trade_date")
    dig = lambda df: decisions.prefix_digests(df, "t", ["t", "p"], days)
    made = lambda m=market, **k: {r["day_idx"]: r for r in decisions.decisions(Policy("v", "overlay", 0.25), main, baseline, events, dig(m), dig(market), start=str(DAY + timedelta(days=2)), **k).collect()}
    one, again, other = made(), made(), made(inputs={"source_sha256": "00"})
    assert [one[i]["status"] for i in range(10)] == ["before_start"] * 2 + ["no_baseline"] * 2 + ["decided"] * 6
    assert one == again and all(one[i]["decision_id"] != other[i]["decision_id"] for i in range(4, 10)) and len({one[i]["decision_id"] for i in range(4, 10)}) == 6
    moved = made(market.unionByName(spark.createDataFrame([(DAY + timedelta(days=7), 2.0)], "t date, p double")))
    assert [moved[i]["decision_id"] == one[i]["decision_id"] for i in range(4, 10)] == [True] * 3 + [False] * 3
    text = (0.8 * 0.5 * 3 / 5 + 0.4 * 1.0) / (0.5 * 3 / 5 + 1.0)
    assert abs(one[7]["active_text_score"] - text) < 1e-12 and abs(one[7]["enhanced_position"] - (0.5 + 0.25 * text)) < 1e-12 and one[7]["active_signals"] == 2
    frame = decisions.decisions(Policy("v", "overlay", 0.25), main, baseline, events, dig(market), dig(market))
    lists = {(r["decision_id"], r["doc_id"]) for r in decisions.decision_signals(frame, events).collect()}
    assert len(lists) == 5 + 3  # s1 on days 5 to 9, s2 on days 7 to 9


def test_single_forecasts_name_what_they_wait_for(spark):
    main = _main(spark, range(100, 150))
    trend = spark.createDataFrame([(i, 0.1 if i != 30 else None, 0.2) for i in range(20, 50)], "day_idx int, momentum_20d double, validation_std double")
    rows = [("a", DAY + timedelta(days=5), 0.5), ("b", DAY + timedelta(days=30), 0.5), ("c", DAY + timedelta(days=40), 3.0), ("d", DAY + timedelta(days=49), -0.5), ("e", DAY + timedelta(days=50), 0.5), ("f", None, 0.5), ("g", DAY + timedelta(days=40), None)]
    texts = spark.createDataFrame(rows, "doc_id string, publish_time date, score double")
    got = {r["doc_id"]: r for r in decisions.mapped_forecasts(texts, main, trend).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "insufficient_momentum_context", "b": "insufficient_momentum_context", "c": "mapped", "d": "awaiting_next_trading_day", "e": "awaiting_signal_day_market_data", "f": "no_publish_time", "g": "mapped"}
    assert got["c"]["enhanced_position"] == 1.0 and got["d"]["position_delta"] == 0.0 and got["f"]["signal_market_date"] is None and got["g"]["position_delta"] == 0.0
    assert {r["status"] for r in decisions.mapped_forecasts(texts.filter("publish_time IS NOT NULL"), main.filter("day_idx < 20"), trend).collect()} == {"insufficient_market_history"}


def test_verification_of_frozen_tables(spark):
    table = spark.createDataFrame([(DAY, 1), (DAY + timedelta(days=9), 2)], "t date, n int")
    frozen = lambda df: ledger.freeze({"one": (df, "t")}, str(DAY + timedelta(days=3)))
    settled = spark.createDataFrame([("settled",), ("exit_pending",), ("contract_bar_missing",)], "settlement string")
    state = lambda a, b: {r["item"]: (r["ok"], r["n"]) for r in decisions.verification(a, b, settled).collect()}
    same = state(frozen(table), frozen(table.unionByName(table.filter("n = 2"))))  # later rows don't count
    assert same == {"frozen:one": (True, 1), "decisions:recorded": (True, 3), "decisions:settled": (True, 1), "decisions:pending": (True, 1), "system": (True, 1)}
    assert state(frozen(table), frozen(table.unionByName(table)))["system"] == (False, 1)
    assert state(frozen(table).limit(0), frozen(table).limit(0))["system"] == (False, 0)
    one = decisions.combined_digest(frozen(table)).first()
    assert one == decisions.combined_digest(frozen(table)).first() and one["digest"] != decisions.combined_digest(frozen(table.filter("n = 2"))).first()["digest"]
