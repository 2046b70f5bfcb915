"""Staged swaps, incremental derived tables and repairs; the count of read and written files is looked at, not trusted."""

import os

import pytest
from pyspark.sql import functions as F
from tessera.operators import period_facts, staging
from tessera.plans import fact_queries

SCHEMA = "doc_id string, source_type string, title string, content string, publish_time string, url string"
LONG = "content " * 6


def doc(i, **other):
    return tuple(({"doc_id": f"d{i}", "source_type": "news", "title": "a title", "content": LONG, "publish_time": "2024-01-05", "url": f"https://x.org/{i}"} | other).values())


def rules():
    return staging.manifest_rules(["news", "policy"])


def test_every_broken_rule_is_reported_and_nothing_is_swapped(spark, tmp_path):
    rows = [doc(1), doc(2, doc_id="a b"), doc(3, doc_id=None), doc(4, source_type="rumour"), doc(5, source_type=None), doc(6, publish_time="2024-02-30"), doc(7, publish_time=None), doc(8, url="ftp://x/8"), doc(9, url=None), doc(10, url=None), doc(11, title=" abc  "), doc(12, content=None), doc(13), doc(13, url="https://x.org/other"), doc(14, url="https://x.org/1")]
    staged = staging.stage(spark.createDataFrame(rows, SCHEMA), str(tmp_path), rules(), "doc_id", ["doc_id", "url"])
    assert staged.broken == {"malformed_doc_id": 1, "missing_doc_id": 1, "invalid_source_type": 2, "malformed_publish_time": 2, "malformed_url": 3, "short_text": 2, "repeated_doc_id": 2, "repeated_url": 2, "repeated_url_after_merge": 2}
    with pytest.raises(ValueError, match="broken rules"):
        staging.commit(spark, str(tmp_path), staged)
    assert staging.versions(spark, str(tmp_path)) == [] and staging.read(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema).count() == 0


def test_a_concurrent_swap_loses(spark, tmp_path):
    root, schema = str(tmp_path), spark.createDataFrame([], SCHEMA).schema
    make = lambda *rows: staging.stage(spark.createDataFrame(rows, SCHEMA), root, rules(), "doc_id", ["doc_id", "url"])
    assert staging.commit(spark, root, make(doc(1), doc(2))) == 1
    one, other = make(doc(2, title="another title")), make(doc(3))
    assert staging.commit(spark, root, one) == 2
    with pytest.raises(staging.Moved):
        staging.commit(spark, root, other)
    with pytest.raises(staging.Moved):  # even if it looked before the other was done
        staging.create_once(spark, f"{root}/versions/{2:010d}", {})
    assert {r["doc_id"]: r["title"] for r in staging.read(spark, root, schema).collect()} == {"d1": "a title", "d2": "another title"}
    assert staging.read(spark, root, schema, 1).filter("title = 'another title'").count() == 0
    assert make(doc(9, url="https://x.org/1")).broken == {"repeated_url_after_merge": 2}
    assert staging.manifest(spark, root)["rows"] == 2


def test_target_rows(spark):
    good = ("yoy", "2024-01-01", "2024-02-29", "5.1", "2024-03-18", "https://x")
    rows = [good, good[:1] + ("2024-02-01",) + good[2:], good[:2] + ("2024-02-28",) + good[3:], good[:3] + ("high",) + good[4:], good[:4] + ("2024-02-29",) + good[5:], good[:5] + ("x",), ("mom",) + good[1:], good[:3] + (" ",) + good[4:]]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "id string, target_name string, period_start string, period_end string, target_value string, release_date string, source_url string")
    found = {(r["id"], r["violation"]) for r in staging.broken_rules(df, staging.target_rules("yoy"), "id", []).collect()}
    assert found == {("1", "wrong_period"), ("2", "wrong_period"), ("3", "not_a_number"), ("4", "released_too_early"), ("5", "malformed_source_url"), ("6", "invalid_target_name"), ("7", "missing_target_value"), ("7", "not_a_number")}


def test_only_changed_parts_are_built_again(spark, tmp_path):
    source, root, read = str(tmp_path / "in"), str(tmp_path / "out"), []
    rows = lambda part, n: spark.createDataFrame([(i, part) for i in range(n)], "x long, part string").coalesce(1).write.mode("append").partitionBy("part").parquet(source)

    def build(df):
        read.append(sorted({r[0].split("part=")[1][0] for r in df.select(F.col("_metadata.file_path")).distinct().collect()}))
        return df.groupBy("part").agg(F.sum("x").alias("total"), F.count(F.lit(1)).alias("n"))

    run = lambda engine="1": staging.derive(spark.read.parquet(source), "part", root, build, engine)
    table = lambda: {r["part"]: (r["total"], r["n"]) for r in staging.read(spark, root, "part string, total long, n long").collect()}
    for part, n in (("a", 3), ("b", 4), ("c", 5)):
        rows(part, n)
    assert run() == {"built": ["a", "b", "c"], "kept": [], "dropped": []}
    first = {p["part"]: p["path"] for p in staging.manifest(spark, root)["parts"]}
    assert run() == {"built": [], "kept": ["a", "b", "c"], "dropped": []} and len(read) == 1 and staging.versions(spark, root) == [1]
    rows("b", 2)
    rows("d", 1)
    assert run() == {"built": ["b", "d"], "kept": ["a", "c"], "dropped": []} and read[1] == ["b", "d"]
    second = {p["part"]: p["path"] for p in staging.manifest(spark, root)["parts"]}
    assert (second["a"], second["c"]) == (first["a"], first["c"]) and second["b"] != first["b"]
    assert table() == {"a": (3, 3), "b": (7, 6), "c": (10, 5), "d": (0, 1)}
    assert run("2")["built"] == ["a", "b", "c", "d"] and table()["b"] == (7, 6)
    schema = spark.createDataFrame([], "part string, total long, n long").schema
    before = {p["part"]: p["path"] for p in staging.manifest(spark, root)["parts"]}
    names = {p: sorted(os.listdir(f"{root}/{before[p]}")) for p in "acd"}
    fixes = spark.createDataFrame([("b", 1, 1, 1), ("b", 99, 9, 2), ("e", 5, 5, 1)], "part string, total long, n long, at int")
    audit = staging.repair(fixes, root, schema, "part", "part", "at")
    assert {tuple(r) for r in audit.select("part", "status").collect()} == {("b", "replaced"), ("e", "added")}
    assert table() == {"a": (3, 3), "b": (99, 9), "c": (10, 5), "d": (0, 1), "e": (5, 5)}
    after = {p["part"]: p["path"] for p in staging.manifest(spark, root)["parts"]}
    assert all(after[p] == before[p] and sorted(os.listdir(f"{root}/{after[p]}")) == names[p] for p in "acd")


def test_period_facts_take_one_wide_shuffle(spark, data):
    """All facts meet by document once; nothing is joined to them."""
    docs, facts = fact_queries.facts(spark, data)
    rows = period_facts.by_document(period_facts.union_of_facts(docs.limit(5), facts, fact_queries.TOPICS), fact_queries.NAMES, fact_queries.TOPICS)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [doc_id") == 1 and plan.split("Union")[0].count("Join") == 0
