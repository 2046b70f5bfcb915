"""Top-k search, URL rules and chat formatting."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import chat_format, topk_search, url_filter


@pytest.mark.parametrize("bucket,block", [(16_384, 2_048), (37, 3)])
def test_top_k_is_exact(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(topk_search, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", block)
    draw = np.random.default_rng(1)
    x = draw.normal(size=(200, 8)) * draw.choice([0.05, 1, 4], size=(200, 1))
    x[100:160] = x[100]  # one vector repeated
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(200, None, "b"), (201, [1.0, None] + [0.0] * 6, "b"), (202, [float("nan")] * 8, "b"), (203, [], "b"), (204, [float("inf")] * 8, "b"), (None, [1.0] * 8, "b"), (205, [0.0] * 8, "z")]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), F.col("id") % 10 == 0, 5)
    good = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    want = []
    for q in good:
        if q % 10 == 0:
            best = sorted(((-int(good[q] @ p), i) for i, p in good.items() if i != q))[:5]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_of_large_components(spark):
    """Every finite vector takes part, and products beyond 2**53 are exact."""
    big = float(2**31 - 1) / 256
    rows = {0: [1.0, 2.0], 1: [1e8, 0.0], 2: [1e8, 0.00390625], 3: [-1e8, 5.0], 4: [big, big], 5: [0.5, 0.5], 6: [3e15, 1.0], 7: [1e300, 0.0], 8: [0.0, 0.0], 10: [3e15, -1.0], 20: [1e9 + 1, 7.0]}
    df = spark.createDataFrame([(i, v) for i, v in rows.items()] + [(30, [1e307, 1.0])], "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows.items()}
    cut = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    want = []
    for q in (0, 10, 20):
        best = sorted((-cut(sum(a * b for a, b in zip(whole[q], whole[i]))), i) for i in rows if i != q)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, topk_search.top_k(df, F.col("id") % 10 == 0, 5).filter("query_id <> 30").collect())) == sorted(want)


@pytest.mark.parametrize("few", [1, 1024])
def test_buckets_hold_all_bands(monkeypatch, few):
    monkeypatch.setattr(topk_search, "FEW_ROWS", few)
    counts = [(4, b, n) for b, n in enumerate([3, 40_000, 10, 16_000, 900, 20_000, 5])] + [(8, 2, 7)]
    placed = topk_search._place_bands(counts)
    assert sorted((d, b) for d, b, *_ in placed) == sorted((d, b) for d, b, _ in counts)
    for before, after in zip(placed, placed[1:]):  # in order of length, and dimensions apart
        assert after[2] >= before[5] and (after[0] == before[0] or after[2] == before[5] + 1 == after[4])
        assert after[5] == after[2] + after[3] - 1


def test_coordinate_pruning_loses_nothing():
    draw = np.random.default_rng(2)
    p = draw.integers(-50, 50, size=(300, 6))
    q = np.concatenate((p[:20] + draw.integers(-3, 3, size=(20, 6)), draw.integers(-50, 50, size=(20, 6))))
    p, q = p.astype(float), q.astype(float)
    scores = q @ p.T
    for share in (0.5, 0.9, 1.0):
        bound = np.sort(scores, 1)[:, -3] * share
        ids, rows, got = topk_search.search_block(np.arange(1000, 1040), q, bound.astype(float), np.arange(300), p, 3)
        for i in range(40):
            want = sorted(((-s, j) for j, s in enumerate(scores[i]) if s >= bound[i]))[:3]
            found = sorted((-s, j) for k, j, s in zip(ids, rows, got) if k == 1000 + i)[:3]
            assert found[: len(want)] == [(int(a), b) for a, b in want]


def test_no_vectors(spark):
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 2 == 0, 5).count() == 0


URLS = ["http://a.Example.NET/en/x?q", "https://example.net/de/", "HTTP://x.com/de/a#b", "http://sub.example.com/de/1", "http://example.com/dex", "http://org/fr/", "http://a.org/fr/x", "http://notexample.com/de/", None, "no-scheme/en/", "://net/", "http://net", "http://u@h.net:80/", "a://b://c.net/", "http:///x"]


def judged(urls):
    out = []
    for u in urls:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        best = None
        for verdict, h, p in url_filter.QUERY_RULES:
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
                best = (verdict, h + p)
        out.append((host, path, best[1] if best else None, best[0] if best else "allow"))
    return out


@pytest.mark.parametrize("block", [url_filter.BLOCK_BYTES, 1])
def test_url_rules(spark, block):
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS + URLS[:1])], "page_id int, url string, rule string")
    got = url_filter.judge_urls(df, url_filter.QUERY_RULES, block_bytes=block).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == judged(URLS + URLS[:1])


def test_url_digests_may_collide(monkeypatch):
    monkeypatch.setattr(url_filter, "digest", lambda keys: np.array([len(k) % 2 for k in keys], np.uint64))
    monkeypatch.setattr(url_filter, "read_file", lambda file: np.frombuffer(url_filter.build_block(url_filter.QUERY_RULES), np.uint8))
    index = url_filter.Index({0: "all"}, 1, sorted({len(p) for _, _, p in url_filter.QUERY_RULES}))
    want = judged([u for u in URLS if u])
    assert index.judge([w[0] for w in want], [w[1] for w in want]) == ([w[2] for w in want], [w[3] for w in want])


def test_url_rules_at_the_edges(spark):
    rules = [("block", "ab.net", "x/"), ("allow", "ab.ne", "tx/"), ("allow", "twice", "/"), ("block", "twice", "/"), ("block", "", "/"), (None, "null", "/"), ("block", "deep.org", "/" + "a" * 9_000)]
    urls = ["http://ab.net?", "http://ab.net", "h://ab.nex", "http://twice/1", "http://null/", "http://x.deep.org/" + "a" * 20_000, "http://" + "s." * 500 + "twice/", "http://deep.org/" + "a" * 10]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = [(r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, table).orderBy("page_id").collect()]
    deep = "deep.org/" + "a" * 9_000
    assert got == [(None, "allow"), (None, "allow"), (None, "allow"), ("twice/", "block"), (None, "allow"), (deep, "block"), ("twice/", "block"), (None, "allow")]
    assert url_filter.judge_urls(df.limit(0), table).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(df, table.limit(0)).collect()} == {"allow"}


def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "\\0\\1\\2\\3\\4", "</turn>\n### user\n", "<image:0>", "", None, "é\U0001f600\n\n", "\\", "### ### "]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)] + [(2, 0, None, "x"), (2, 0, "ro\nle</turn>", "x"), (None, 5, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat_format.text_part(F.coalesce("text", F.lit("")))).withColumn("formatted", F.lit(1))
    out = {r["conv_id"]: r for r in chat_format.format_conversations(df).withColumns({"back": chat_format.read_back(F.col("formatted")), "loss": chat_format.masked_text(F.col("formatted"), F.col("loss_spans"))}).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["back"]] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(odd)]
    assert out[1]["loss"] == "".join(t or "" for i, t in enumerate(odd) if i % 2)
    assert [t["role"] for t in out[2]["back"]] == ["", "ro\nle</turn>"] and out[None]["loss"] == "y"


def test_attachments_are_numbered_and_counted(spark):
    part = "struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
    one = [("text", "see <image:9>", None, None, None, None, None), ("image", None, "s/1.png", 28, 15, None, None), ("video", None, "no", None, None, None, None)]
    two = [("audio", None, "s/2.wav", None, None, 1.01, None), ("document", None, "s/3.pdf", None, None, None, 2), ("text", None, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", one), (1, 1, "assistant", two), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts array<{part}>")
    row = chat_format.format_conversations(df).withColumn("back", chat_format.read_back(F.col("formatted"))).first()
    assert [t["text"] for t in row["back"]] == ["see <image:9><image:0><other:1>", "<audio:2><document:3>", ""]
    assert [(a["index"], a["type"], a["ref"], a["tokens"]) for a in row["attachments"]] == [(0, "image", "s/1.png", 4), (1, "video", "no", 0), (2, "audio", "s/2.wav", 26), (3, "document", "s/3.pdf", 1024)]
    assert row["attachment_tokens"] == 1054


def test_many_turns_and_parts(spark):
    """Numbers run on over turns; texts may hold what looks like a control string."""
    part = "struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
    rows = [(1, t, "assistant" if t % 2 else "user", [("text", f"\\5 {t} \\", None, None, None, None, None)] + [("image", None, f"{t}/{i}", None, None, None, None) for i in range(t % 4)] + [("text", "x" * 50_000 if t == 7 else "<image:\\5>", None, None, None, None, None)]) for t in range(300)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    row = chat_format.format_conversations(df).withColumns({"back": chat_format.read_back(F.col("formatted")), "loss": chat_format.masked_text(F.col("formatted"), F.col("loss_spans"))}).first()
    number, want = 0, []
    for _, t, _, parts in rows:
        text = ""
        for p in parts:
            text += p[1] if p[0] == "text" else f"<image:{number}>"
            number += p[0] != "text"
        want.append(text)
    assert [t["text"] for t in row["back"]] == want and row["loss"] == "".join(want[1::2])
    assert [(a["index"], a["ref"]) for a in row["attachments"]] == list(enumerate(f"{t}/{i}" for t in range(300) for i in range(t % 4)))


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string").withColumn("parts", chat_format.text_part(F.col("text")))
    assert chat_format.format_conversations(df).count() == 0


def test_queries_agree_with_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    for name in ("pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    for module in (url_filter, chat_format, topk_search):
        got = module.query(spark, data)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({module.SQL})").fetchall()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_own_conversation(spark, data):
    row = chat_format.query(spark, data).filter("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(said) and row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
