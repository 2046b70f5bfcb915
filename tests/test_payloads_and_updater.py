"""Payload validation and the daily updater: odd payloads, and a stream that stops, restarts and replays."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from tessera.operators import payloads
from tessera.streaming import updater

SCHEMA = payloads.Schema(("a", "b"), ("s",), ("x", "y"), {"k": ("one",), "other": ("two",)})
GOOD = {"event": {"event_type": "one", "subject": "s", "object": "o", "impact_path": "p", "evidence_text": "said"}, "analyses": [
    {"code": "E", "relationship_evidence": "said", "score_components": {"x": 1, "y": 0}, "predicates": [{"name": "a", "value": True, "confidence": 7}, {"name": "b", "value": "False"}, {"name": "s", "value": 0.5}]}]}


def with_(change) -> str:
    body = json.loads(json.dumps(GOOD))
    change(body)
    return json.dumps(body)


def predicates(*items):
    return with_(lambda b: b["analyses"][0].update(predicates=list(items)))


A, B, S = GOOD["analyses"][0]["predicates"]
CASES = [
    (json.dumps(GOOD), []), ("```json\n" + json.dumps(GOOD) + "\n``` and {", []), (None, ["unreadable"]), ("", ["unreadable"]), ("{", ["unreadable"]), ("[1]", ["unreadable"]), ("{bad}", ["unreadable"]),
    ("{}", ["unknown_event_type", "evidence_not_in_text", "missing_subject", "missing_object", "missing_impact_path", "no_analyses"]),
    (with_(lambda b: b.update(event=3)), ["unknown_event_type", "evidence_not_in_text", "missing_subject", "missing_object", "missing_impact_path"]),
    (with_(lambda b: b["event"].update(event_type="two", subject="}{\\\"")), ["event_type_of_other_source"]),
    (with_(lambda b: b.update(analyses={"code": "E"})), ["analyses_no_array"]), (with_(lambda b: b.update(analyses=[])), ["no_analyses"]), (with_(lambda b: b.pop("analyses")), ["no_analyses"]),
    (with_(lambda b: b["analyses"].append(b["analyses"][0])), ["repeated_entity"]), (with_(lambda b: b["analyses"][0].update(code=None)), ["unknown_entity"]),
    (with_(lambda b: b["analyses"][0].update(score_components={"x": 1, "z": 1})), ["incomplete_components"]), (with_(lambda b: b["analyses"][0].pop("score_components")), ["incomplete_components"]),
    (with_(lambda b: b["analyses"][0].update(relationship_evidence="unsaid")), ["relationship_not_in_text"]), (predicates(), ["missing_predicates"]), (predicates(A, B, S, A), ["repeated_predicate"]),
    (predicates({"name": "a", "value": "x"}, A, B, S), ["not_boolean"]), (predicates(A, B, {"name": "s", "value": "nan"}), ["missing_predicates", "not_a_score"]),
    (predicates(A, B, {"name": "s", "value": -0.1}, S, {"name": "t", "value": True}, 4), ["score_out_of_range", "unknown_predicate"]), (with_(lambda b: b["analyses"][0].update(predicates="none")), ["missing_predicates"]),
]


@pytest.fixture(scope="module")
def given(spark):
    return spark.createDataFrame([(i, "k", "it was said", p) for i, (p, _) in enumerate(CASES)] + [(900, None, None, json.dumps(GOOD))], "doc_id long, kind string, text string, payload string"), spark.createDataFrame([("E",)], "entity string")


def test_every_kind_of_error_is_a_row(given):
    found = {}
    for r in payloads.violations(*given, SCHEMA).collect():
        found.setdefault(r["doc_id"], []).append(r["error"])
    assert {i: sorted(found.get(i, [])) for i in range(len(CASES))} == {i: sorted(e) for i, (_, e) in enumerate(CASES)}
    assert sorted(found[900]) == ["evidence_not_in_text", "relationship_not_in_text"]  # no text, and a source of no kind


def test_accepted_predicates_and_their_map(given):
    rows = payloads.accepted_predicates(*given, SCHEMA)
    told = [tuple(r)[1:] for r in rows.filter("doc_id = 0").orderBy("name").collect()]
    assert told == [("E", "a", "true", 1.0), ("E", "b", "false", 0.0), ("E", "s", "0.50", 0.0)]
    assert {r["doc_id"] for r in rows.collect()} == {0, 1, 13, 17, 19, 20, 22}
    assert payloads.consensus_map(rows, ["doc_id", "entity"]).filter("doc_id = 0").first()["predicates"] == '{"a":true,"b":false,"s":0.5}'


def test_payloads_are_judged_by_row_and_read_once(spark, given, tmp_path):
    """Of payloads that share a key, or have none, those without errors stay; the table is read by a single scan and not joined with itself."""
    bad = with_(lambda b: b["event"].update(subject=""))
    rows = [(1, "k", "it was said", json.dumps(GOOD)), (1, "k", "it was said", bad), (None, "k", "it was said", bad), (2, "k", "it was said", bad)]
    spark.createDataFrame(rows, "doc_id long, kind string, text string, payload string").write.parquet(str(tmp_path / "p"))
    found = payloads.accepted_predicates(spark.read.parquet(str(tmp_path / "p")), given[1], SCHEMA)
    assert sorted((r["doc_id"], r["name"]) for r in found.collect()) == [(1, "a"), (1, "b"), (1, "s")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and plan.count("try_parse_json") + plan.count("parseJson") <= 1


def test_first_object_of_a_text(spark):
    texts = ['x {"a": "}{", "b": {"c": 1}} {"d": 2}', '{"a": "\\"}"}', "{ {", "none", "", None, '{"open": "', "{}" + "y" * 5000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", payloads.first_object(F.col("t")).alias("o")).orderBy("i").collect()
    assert [r["o"] for r in got] == ['{"a": "}{", "b": {"c": 1}}', '{"a": "\\"}"}', None, None, None, None, None, "{}"]


DAY = dt.date(2024, 5, 1)


def run(n, end, market, today, errors=0, ledger="v4"):
    day = lambda k: DAY + dt.timedelta(days=k)
    return (ledger, n, day(end), day(market), day(today), errors)


RUNS = [run(1, 0, 0, 0), run(2, 0, 0, 1), run(3, -1, -1, 1), run(4, 2, 1, 2, errors=3), run(5, 1, 1, 2), run(6, 1, 1, 2), run(7, 3, 1, 3), run(8, 5, 4, 9), run(9, 4, 4, 9), run(10, 9, 9, 9)]
STATUS = ["decision_recorded", "no_new_market_data", "refused_truncate", "refused_fetch_errors", "decision_recovered", "no_new_market_data", "no_new_trading_day", "refused_stale", "refused_stale", "decision_recorded"]
SCHEMA_RUNS = "ledger string, run long, end date, market_day date, today date, errors int"


def test_updater_passes_through_every_status(spark):
    rows = RUNS + [run(1, 7, 7, 7, ledger="v6")] + RUNS[:3]
    got = updater.updates(spark.createDataFrame(rows, SCHEMA_RUNS).repartition(3)).orderBy("ledger", "run").collect()
    assert [r["status"] for r in got] == [*STATUS, "decision_recorded"] and [r["run"] for r in got] == [*range(1, 11), 1]
    assert got[8]["market_day"] == DAY + dt.timedelta(days=4) and got[8]["decision_day"] == DAY + dt.timedelta(days=1)
    assert updater.updates(spark.createDataFrame([], SCHEMA_RUNS)).collect() == []


def test_updater_stream_goes_on_after_a_restart(spark, tmp_path):
    """State comes back from the checkpoint; replayed runs give no second row."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    try:
        for batch in (RUNS[:4], RUNS[2:8], RUNS[8:] + RUNS[:1]):
            spark.createDataFrame(batch, SCHEMA_RUNS).coalesce(1).write.mode("append").parquet(source)
            query = updater.update_stream(spark.readStream.schema(SCHEMA_RUNS).parquet(source), out, checkpoint)
            query.awaitTermination(120)
            assert query.exception() is None
        got = spark.read.parquet(out).orderBy("run").collect()
    finally:
        spark.conf.set(name, before)
    assert [(r["run"], r["status"]) for r in got] == list(enumerate(STATUS, 1))
