"""The pipeline, stage by stage, and whole-table queries against brute force on the smallest tables."""

import hashlib
import sys

import corpus_pipeline
import numpy as np
import pyarrow as pa
from tessera.llm import decontamination, queries
from tessera.llm.common import materialise
from test_corpus import WORD, brute_components, brute_windows


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_registered_queries(spark, data):
    docs = rows_of(spark.read.parquet(f"{data}/documents.parquet"))
    assert sorted(map(tuple, queries.QUERIES["op2_ngram_join"](spark, data).select("doc_id", "n_shingles", "component_id").collect())) == brute_components(docs)
    assert sorted(map(tuple, queries.QUERIES["op3_substring_dedup"](spark, data).collect())) == brute_windows(docs)
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert [r["decoded_sha256"] for r in queries.QUERIES["op5_bpe"](spark, data).orderBy("doc_id").collect()] == [hashlib.sha256(t.encode()).hexdigest() for _, t in sorted(docs)]


def brute_leaks(spark, data, docs):
    """Every item aligned with every whole text, without seeds."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    i_words, i_ptr = decontamination._words(pa.array([t for _, t in items]))
    d_words, d_ptr = decontamination._words(pa.array([t for _, t in docs], pa.string()))
    out = set()
    for k, (d, _) in enumerate(docs):
        text = d_words[d_ptr[k] : d_ptr[k + 1]]
        for i in range(len(items)):
            item = i_words[i_ptr[i] : i_ptr[i + 1]]
            if np.isin(item, text).sum() * 2 >= len(item) and decontamination.align(item, text)[0] / (2 * len(item)) >= decontamination.LEAST:
                out.add((d, items[i][0]))
    return out


def test_leak_query(spark, data):
    docs = rows_of(spark.read.parquet(f"{data}/documents.parquet"))
    assert {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op1_decontamination"](spark, data).collect()} == brute_leaks(spark, data, docs)


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "substring_dedup", "decontamination", "bpe"]
    before = rows_of(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, data), "test")
        after = rows_of(docs)
        if name != "bpe":
            assert docs.columns == columns
        if name == "toxicity":
            assert set(after) <= set(before) and len(after) > 0.7 * len(before)
        if name == "ngram_join":
            assert {d for d, _ in after} == {c for _, _, c in brute_components(before)}
        if name == "substring_dedup":
            left = {(d, sha) for d, n, gone, sha in brute_windows(before) if gone < n or n == 0}
            assert {(d, hashlib.sha256(" ".join(WORD.findall(t or "")).encode()).hexdigest()) for d, t in after} == left
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        if name == "decontamination":
            assert {d for d, _ in after} == {d for d, _ in before} - {d for d, _ in brute_leaks(spark, data, before)}
        if name == "bpe":
            assert all(r["n_tokens"] == len(r["token_ids"]) for r in docs.collect()) and len(after) == len(before)
        before = after
    assert "corpus_pipeline" in sys.modules and corpus_pipeline.run(spark, data).count() == len(before)


def test_stages_on_odd_tables(spark, data):
    """Null and empty texts, null ids, repeated rows, columns with clashing names, and no rows at all."""
    columns = "doc_id long, text string, lang string, source string, n_chars int, score double, component_id string, u string, `__toxicity` int"
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, long + " tail"), (None, "some text of its own"), (None, None), (5, " \n\t"), (6, "few words")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "c", "u", 7) for i, t in rows], columns)
    for name, stage in corpus_pipeline.STAGES:
        before, empty = sorted(map(str, rows_of(docs))), stage(spark, docs.limit(0), data)
        assert empty.count() == 0
        docs = materialise(stage(spark, docs, data), "test")
        after = sorted(map(str, rows_of(docs)))
        if name == "ngram_join":  # of the two rows with id 3 and its near copy, the rows of the smallest id stay
            assert after == [r for r in before if r != str((4, long + " tail"))]
        elif name != "substring_dedup":
            assert after == before
        assert docs.columns[:9] == ["doc_id", "text", "lang", "source", "n_chars", "score", "component_id", "u", "__toxicity"]
    out = {r["doc_id"]: r for r in docs.filter("doc_id IS NOT NULL").collect()}
    assert out[6]["n_tokens"] == len(out[6]["token_ids"]) > 0 and out[1]["n_tokens"] == 0 and out[2]["n_tokens"] == 0
