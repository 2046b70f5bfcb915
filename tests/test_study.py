"""The two-phase study against a plain one, and what may not change it."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F
from tessera import catalogue
from tessera.operators import study
from tessera.plans import study_queries as q
from tessera.plans import views as v


def test_study_against_a_plain_one(spark, data):
    records = v.records(spark, data)
    rows = [(r["doc_id"], r["publish_time"], r["names"], r["direction_label"]) for r in records.collect()]
    until = dt.date.fromisoformat(q.UNTIL)
    book = study.freeze_rulebook(records, q.UNTIL)
    rules = {(tuple(r["conditions"]), r["target_label"]) for r in book.rules.collect()}
    assert rules and rules <= plain_candidates(rows, until)
    score = {r["doc_id"]: r["score"] for r in q.directions(spark, data).collect()}
    label = {d: x for d, _, _, x in rows}
    got = {r["doc_id"]: r for r in catalogue.QUERIES["study_signals"](spark, data).collect()}
    assert set(got) == set(label) and {r["inference_mode"] for r in got.values()} == {"rules_active", "rulebook_inactive"}
    for doc, day, names, _ in rows:
        active = sum(set(c) <= set(names) for c, _ in rules) if day > until else 0
        s = score[doc] if active else 0.0
        want = "bullish" if s > 0.1 else "bearish" if s < -0.1 else "neutral"
        r = got[doc]
        assert (r["active_rules"], r["direction_score"], r["direction_label"], r["evidence_text"]) == (active, pytest.approx(s), want, f"evidence {doc}" if active else "")
        assert r["right"] == (want == label[doc])


def plain_candidates(rows, until):
    """Every combination that occurs in enough discovery documents, with either label."""
    found = {}
    for doc, day, names, _ in rows:
        if day <= until:
            for k in (1, 2):
                for c in itertools.combinations(sorted(set(names)), k):
                    found.setdefault(c, set()).add((doc, day))
    return {(c, t) for c, d in found.items() if len(d) >= 5 for t in ("bullish", "bearish")}


RECORDS = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=i % 9), ["a", "b"] if i % 2 else ["c"], "bullish" if i % 2 else "bearish") for i in range(40)]
SCHEMA = "doc_id long, publish_time date, names array<string>, direction_label string"


def test_later_rows_change_no_rule_and_the_guard_fails(spark):
    late = [(100 + i, dt.date(2024, 3, 1), ["a"], "bearish") for i in range(50)]
    one, other = (study.freeze_rulebook(spark.createDataFrame(rows, SCHEMA), "2024-01-31") for rows in (RECORDS, RECORDS + late))
    assert one.digest == other.digest and sorted(map(str, one.rules.collect())) == sorted(map(str, other.rules.collect())) != []
    with pytest.raises(Exception, match="later than 2024-01-31"):
        study.guarded(spark.createDataFrame(RECORDS + late, SCHEMA), "2024-01-31").agg(F.max("publish_time")).collect()
    changed = study.freeze_rulebook(spark.createDataFrame([(d, t, n[:1], x) for d, t, n, x in RECORDS], SCHEMA), "2024-01-31")
    assert changed.digest != one.digest


def test_inactive_rules_give_zero(spark):
    book = study.freeze_rulebook(spark.createDataFrame(RECORDS, SCHEMA), "2024-01-31")
    later = spark.createDataFrame([(1, dt.date(2024, 3, 1), ["c", "x"], None), (2, dt.date(2024, 3, 1), ["x"], None), (3, dt.date(2024, 3, 1), [], None), (4, dt.date(2024, 1, 2), ["c"], None)], SCHEMA)
    given = spark.createDataFrame([(i, -0.8, 0.9, 0.3, "said") for i in range(1, 5)], "doc_id long, score double, confidence double, zero_shot_score double, evidence string")
    got = {r["doc_id"]: (r["direction_label"], r["direction_score"], r["evidence_text"], len(r["activated_rules"]) > 0) for r in study.signals(later, given, book).collect()}
    off = ("neutral", 0.0, "", False)
    assert got == {1: ("bearish", -0.8, "said", True), 2: off, 3: off, 4: off}  # 4 lies in discovery


def test_overrides_decide_the_consensus_anew(spark):
    stored = spark.createDataFrame([(1, "a", "true", 0.9), (1, "b", "true", 0.8)], "doc_id long, name string, other_value string, confidence double")
    fixed = spark.createDataFrame([(1, "a", "true"), (1, "b", "false")], "doc_id long, name string, value string")
    assert {(r["name"], r["accepted"]) for r in study.overridden(fixed, stored).collect()} == {("a", True), ("b", False)}
