"""Operators over documents against brute force, on fixtures with nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tessera.llm import bpe, common, decontamination, licenses, ngram_join, quality, substring_dedup, toxicity
from tessera.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def corpus(seed: int, n: int = 120) -> list[tuple]:
    """Documents of few words, with copies, near copies, a passage that a third of them share, nulls, empty and odd texts."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "日本", "A", "a"]
    passage = " ".join(draw.choice(words) for _ in range(60))
    texts: list[str | None] = [None, "", " \t\n", "one", "two words", "One", "x " * 300, "é\u00a0b c d e f"]
    base = " ".join(draw.choice(words) for _ in range(80))
    for i in range(n):
        kind = draw.random()
        own = [draw.choice(words) for _ in range(draw.randint(1, 120))]
        if kind < 0.33:
            texts.append(" ".join(own[:30]) + "\n" + passage + "  " + " ".join(own[30:60]))
        elif kind < 0.5 and len(texts) > 9:
            texts.append(draw.choice(texts))
        elif kind < 0.7:
            near = base.split()
            near[draw.randrange(80)] = draw.choice(words)
            texts.append(" ".join(near).upper() if draw.random() < 0.2 else " ".join(near))
        else:
            texts.append("\t".join(own))
    rows = [(i * 3, t, None if i % 5 == 0 else "en", f"s{i % 3}", None, 0.5, 1) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9]]  # repeated rows
    draw.shuffle(rows)
    return rows


def brute_windows(rows, k=20):
    first, words = {}, [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words):
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            first[key] = min(first.get(key, (d, s)), (d, s))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {j for s in range(len(w) - k + 1) if first[tuple(w[s : s + k])] < (d, s) for j in range(s, s + k)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def brute_components(rows):
    low = {i: i + 32 for i in range(65, 91)}
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_id = {}
    for i, (d, _) in enumerate(rows):
        parent[root(i)] = root(by_id.setdefault(d, i))
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least[root(i)], d)
    return sorted((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_windows(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, substring_dedup.digests(docs).collect()))
    assert got == brute_windows([(r[0], r[1]) for r in rows])


def test_repeated_windows_in_hot_buckets(spark, monkeypatch):
    """Copies are a third of all rows: hot minimisers are dealt over buckets and settled by a second meeting."""
    rows = corpus(3, 60)
    rows += [(10_000 + i, rows[20][1], None, None, None, None, None) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(8)
    own = docs.filter("text IS NOT NULL").select("doc_id", "text")
    low, parts = substring_dedup.hot_minimisers(own, 16)
    assert len(low) and len(low) <= 128 and (parts >= 1).all()
    assert sorted(map(tuple, substring_dedup.digests(docs).collect())) == brute_windows([(r[0], r[1]) for r in rows])


def test_colliding_window_hashes_are_told_apart(spark, monkeypatch):
    real = substring_dedup.hash_windows
    monkeypatch.setattr(substring_dedup, "hash_windows", lambda w, f, n: real(w, f, n) % np.uint64(7))
    data = [substring_dedup._pack(np.array([i]), np.array([0]), np.array([0]), np.array([2]), np.array([0]), [" ".join(f"{'ab'[i % 2]}{j}" for j in range(21)).encode()]) for i in range(4)]
    import pyarrow as pa

    out = substring_dedup._settle(pa.table({"bucket": pa.array([0] * 4, pa.int32()), "blob": pa.array(data, pa.binary())}))
    assert sorted((r["doc_id"], r["start"], r["n"]) for r in out.to_pylist()) == [(2, 0, 2), (3, 0, 2)]


def test_removal_keeps_other_columns(spark):
    rows = corpus(4, 50)
    docs = spark.createDataFrame(rows, SCHEMA)
    out = substring_dedup.remove_repeats(docs)
    assert out.schema.names == docs.schema.names
    want = {(r[0], r[3]) for r in brute_windows([(r[0], r[1]) for r in rows]) if r[2] < r[1] or r[1] == 0}
    got = {(r["doc_id"], hashlib.sha256(" ".join(WORD.findall(r["text"] or "")).encode()).hexdigest()) for r in out.collect()}
    assert got == want


@pytest.mark.parametrize("seed", [1, 5])
def test_components(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, ngram_join.components(docs).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute_components([(r[0], r[1]) for r in rows])


def test_components_with_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (None, None)], "doc_id long, text string")
    got = {(r[0], r[1], r[2]) for r in ngram_join.components(docs).collect()}
    assert got == {(None, 2, None), (1, 2, 1), (2, 2, 1), (None, 0, None)}
    assert ngram_join.one_of_each(docs).count() == 3


@pytest.mark.parametrize("share", [70, 84, 88, 92])
def test_pages_of_one_template(spark, share):
    """Pages whose text is a template but for some words: none, or all, link; sizes differ."""
    rows = [(i, " ".join([f"t{k}" for k in range(share * 2)] + [f"own{i}x{k}" for k in range(2 * (100 - share) + i % 7)])) for i in range(40)]
    assert sorted(map(tuple, ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())) == brute_components(rows)


def test_size_bands_lose_no_pair(spark):
    draw = random.Random(5)
    rows = []
    for i in range(150):
        n = draw.randint(1, 60)
        shared = draw.randint(-(-80 * n // 100), n)
        part = draw.randint(0, 3)
        rows.append((draw.randrange(3), i, n, shared, draw.randint(0, shared - -(-80 * n // 100)), part, draw.randrange(2)))
    columns = spark.createDataFrame(rows, "shingle long, id long, n long, shared long, place int, component long, main long")
    main = {r[0]: r[6] for r in rows}
    columns = columns.drop("main").join(spark.createDataFrame(list(main.items()), "shingle long, main long"), "shingle").select(*columns.columns)

    def can(x, y):
        left = min(x[3] - x[4], y[3] - y[4])
        return 100 * min(x[2], y[2]) >= 80 * max(x[2], y[2]) and 180 * left >= 80 * (x[2] + y[2])

    want = {frozenset((x[1], y[1])) for x in rows for y in rows if x[1] < y[1] and x[0] == y[0] and x[5] != y[5] and (x[5] != main[x[0]] or y[5] != main[y[0]]) and can(x, y)}
    got = [frozenset((r["u"], r["v"])) for r in ngram_join.unsettled(columns).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    pages = spark.createDataFrame([(7, i, 100, 85, 0, i, 0) for i in range(5000)], columns.schema)
    assert ngram_join.unsettled(pages).count() == 0  # no pair of them is walked


@pytest.mark.parametrize("least", [common.LEAST_SENT, 2])
def test_components_with_often_shared_columns_sent(spark, monkeypatch, least):
    monkeypatch.setattr(common, "LEAST_SENT", least)
    rows = corpus(9, 90)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(map(tuple, ngram_join.components(docs).collect())) == brute_components([(r[0], r[1]) for r in rows])


def test_text_beyond_one_slice(spark):
    draw = random.Random(8)
    long = " ".join(f"w{draw.randrange(10**6)}" for _ in range(400_000))  # above 2 MB
    rows = [(1, long), (2, long + " end"), (3, "short text of a few words"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r[0], r[2]) for r in ngram_join.components(docs).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.digests(docs).collect()}
    assert got == {1: (400_000, 0), 2: (400_001, 400_000), 3: (6, 0), 4: (0, 0)}


def test_connected_components(spark):
    draw = random.Random(0)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(draw.randrange(200, 260), draw.randrange(200, 260)) for _ in range(40)]
    parent = {x: x for p in links for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for a, b in links if a != b for x in (a, b)}
    assert {r[0]: r[1] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()} == want


def brute_align(item, text):
    rows = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if a == b else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
    return max(map(max, rows))


def test_alignment_scores():
    draw = random.Random(2)
    for _ in range(50):
        a, b = (np.array([draw.randrange(4) for _ in range(draw.randint(1, 15))]) for _ in range(2))
        assert decontamination.align(a, b)[0] == brute_align(a.tolist(), b.tolist())


def test_leaks_against_brute_force(spark):
    draw = random.Random(7)
    words = [f"t{i}" for i in range(500)]
    items = [(i, " ".join(draw.choice(words) for _ in range(20))) for i in range(6)] + [(6, None), (7, "")]
    docs = []
    for i in range(60):
        own = [draw.choice(words) for _ in range(100)]
        if i % 3 == 0:  # a third hold item 0, some edited
            leak = items[0][1].split()
            for _ in range(draw.randint(0, 3)):
                leak[draw.randrange(20)] = "edited"
            own[40:40] = leak
        if i % 10 == 1:
            own[10:10] = [w.upper() + "," for w in items[3][1].split()]
        docs.append((i, " ".join(own), "x"))
    docs += [(60, None, "x"), (61, "", "x"), docs[0]]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    norm = lambda t: [w.strip(",").lower() for w in (t or "").split()]
    want = {(d, i): s for d, t, _ in docs for i, x in items if x and (s := brute_align(norm(x), norm(t)) / (2 * len(norm(x)))) >= decontamination.LEAST}
    assert got == pytest.approx(want)
    left = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in left.collect()} == {d for d, _, _ in docs} - {d for d, _ in want}


@pytest.mark.parametrize("others", [False, True])
@pytest.mark.parametrize(("copies", "step"), [(5, 4), (5, 5), (1000, 4), (1000, 5)])
def test_one_edited_form_however_often_copied(spark, copies, step, others):
    words = [f"q{i}" for i in range(40)]
    edited = " ".join("edited" if i % step == step - 1 else w for i, w in enumerate(words))
    texts = [f"a b c {edited} d e f"] * copies + [" ".join(words[:6]) + " and more"]
    if others:  # a whole copy, and one edited elsewhere: their 3-grams are rarer than those of the copies
        texts += [" ".join(words), " ".join("changed" if i % step == 0 else w for i, w in enumerate(words))]
    docs, items = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    score = {t: brute_align(words, t.split()) / 80 for t in set(texts)}
    want = {d: score[t] for d, t in enumerate(texts) if score[t] >= decontamination.LEAST}
    assert {r["doc_id"]: r["score"] for r in decontamination.find_leaks(docs, items).collect()} == pytest.approx(want)
    assert len(want) == len(texts) - 1 and [r["doc_id"] for r in decontamination.decontaminate(docs, items).collect()] == [copies]


def test_leaks_with_one_seed(spark):
    sizes = {1: (15, (4, 7, 10, 13)), 2: (9, (4, 7)), 3: (8, (4, 7)), 4: (7, (4,))}  # of words, and which of them change
    items = {i: [f"i{i}w{k}" for k in range(1, n + 1)] for i, (n, _) in sizes.items()}
    texts = [f"a b {' '.join('edited' if k in changed else w for k, w in enumerate(items[i], 1))} c d" for i, (_, changed) in sizes.items()]
    items[6] = [f"v{k}" for k in range(20)]
    texts.append(" ".join(items[6][:3]) + " " + " ".join(f"gap {w}" for w in items[6][3:]))  # one seed, far from the item's end
    texts.append(" ".join(f"{w} gap" for w in items[6][:17]) + " " + " ".join(items[6][17:]))
    texts.append(" ".join(items[6][5:8]) + " and more")
    docs, table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    want = {(d, i): s for d, t in enumerate(texts) for i, x in items.items() if (s := brute_align(x, t.split()) / (2 * len(x))) >= decontamination.LEAST}
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.find_leaks(docs, table).collect()} == pytest.approx(want)
    assert {d for d, _ in want} == {0, 1, 2, 3, 4, 5}
    assert {r["doc_id"] for r in decontamination.decontaminate(docs, table).collect()} == {6}


@pytest.mark.parametrize("size", [decontamination.BLOCK_BYTES, 40])
def test_items_of_any_id_and_length(spark, monkeypatch, size):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
    monkeypatch.setattr(decontamination, "KEPT_BLOCKS", 1)
    items = spark.createDataFrame([("a", "one"), ("b", "two words"), (None, "an item without any id at all"), ("c", "repeated item of some words"), ("c", "repeated item of some words"), ("d", None), ("e", " .,")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "there is one here"), (2, "these are Two, words"), (None, "x an item without any id at all y"), (3, "the repeated item of some words"), (4, "nothing"), (None, "else"), (5, None)], "doc_id long, text string")
    got = sorted(map(str, [(r["doc_id"], r["item_id"], r["score"]) for r in decontamination.find_leaks(docs, items).collect()]))
    assert got == sorted(map(str, [(1, "a", 1.0), (2, "b", 1.0), (None, None, 1.0), (3, "c", 1.0), (3, "c", 1.0)]))
    assert sorted((r["text"] or "" for r in decontamination.decontaminate(docs, items).collect())) == ["", "else", "nothing"]


def test_bpe_agrees_with_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    texts = ["", "a<|endoftext|>b  \n", "x" * 3000, "it's  we'll\t\n  日本 é\u0301", "###" * 900, "ab" * 50, " lead", None, "😀👍🏽"]
    rows = [(i, t, "kept") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False) == (t or "")
    sums = bpe.round_trip_digests(docs, VOCABULARY).orderBy("doc_id").collect()
    ids = library.encode(texts[1], add_special_tokens=False).ids
    assert sums[1]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and sums[1]["n_tokens"] == len(ids)


def test_bpe_ids_of_a_whole_table(spark, data):
    from tokenizers import Tokenizer

    library, rows = Tokenizer.from_file(VOCABULARY), {}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        rows[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = bpe.round_trip_digests(spark.read.parquet(f"{data}/documents.parquet"), VOCABULARY).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == rows and len(got) == len(rows)


def test_bpe_decodes_odd_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, 10_000_000, -1])], "doc_id long, token_ids array<int>")
    assert [r["decoded"] for r in bpe.decode(df, VOCABULARY).orderBy("doc_id").collect()] == ["", "", ""]


def test_bpe_with_ids_of_more_than_16_bits(tmp_path):
    import json

    spec = json.load(open(VOCABULARY))
    top = max(spec["model"]["vocab"].values())
    spec["model"]["vocab"] = {k: (i + 100_000 if i > 300 else i) for k, i in spec["model"]["vocab"].items()}
    small, large, draw = bpe.ByteBPE(open(VOCABULARY).read()), bpe.ByteBPE(json.dumps(spec)), random.Random(4)
    assert top < 1 << 16
    for _ in range(100):
        word = bytes(draw.choice(b"abcdethrs ") for _ in range(draw.randint(1, 40)))
        want = tuple(i + 100_000 if i > 300 else i for i in small.word(word))
        assert large.word(word) == want and large._long(word) == want


def test_bpe_merges_long_and_short_words_alike():
    coder = bpe.ByteBPE(open(VOCABULARY).read())
    draw = random.Random(1)
    for _ in range(200):
        word = bytes(draw.choice(b"abcdethrs ") for _ in range(draw.randint(1, 70)))
        assert coder.word(word) == coder._long(word)


@pytest.mark.parametrize("least", [common.LEAST_SENT, 0])
def test_licences_and_inheritance(spark, monkeypatch, least):
    monkeypatch.setattr(common, "LEAST_SENT", least)
    rows = [
        ("a/LICENSE", "Released under the MIT License.\nsome text"), ("a/b/c/x.py", "print"), ("a/b/y.py", None), ("z.py", "hi"), (None, "Licensed under CC BY-NC 4.0."),
        ("a/d/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/d/q/r.py", ""), ("a/d/own.py", "# Licensed under the Apache License, Version 2.0.\ncode"), ("z.py", "hi"),
    ]
    out = licenses.scan(spark.createDataFrame([(*r, "old") for r in rows], "path string, text string, license string"))
    got = sorted(((r["path"], r["license"], r["license_from"]) for r in out.collect()), key=str)
    want = [("a/LICENSE", "MIT", "own"), ("a/b/c/x.py", "MIT", "a"), ("a/b/y.py", "MIT", "a"), ("z.py", None, None), (None, "CC-BY-NC-4.0", "own"), ("a/d/COPYING", "GPL-3.0", "own"), ("a/d/q/r.py", "GPL-3.0", "a/d"), ("a/d/own.py", "Apache-2.0", "own"), ("z.py", None, None)]
    assert got == sorted(want, key=str)


def test_licence_wording(spark):
    acme = "All rights reserved by ACME, do not pass on to anybody"
    header = "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\nint main() {}\n\nvoid other() {}"
    texts = {"a.c": "// SPDX-License-Identifier: MIT\ncode", "b.c": "# SPDX-License-Identifier: GPL-3.0-or-later", "c.c": "// SPDX-License-Identifier: Unknown-1.0", "d.c": header, "e.c": acme.upper() + "\nint x;",
             "f.c": "Version 2.0", "g.c": "the license", "h.c": "License", "i.c": "word " * 500_000 + "\n# SPDX-License-Identifier: Apache-2.0", "j.c": "...\n---\n.-.", "k.c": "any of the work under version 3"}
    rows = list(texts.items()) + [(f"p{i}.c", "any words of the common kind under which this is to be read") for i in range(20)]
    out = licenses.scan(spark.createDataFrame(rows, "path string, text string"), licenses.TEMPLATES | {"ACME": [acme]})
    got = {r["path"]: r["license"] for r in out.collect() if r["license"]}
    assert got == {"a.c": "MIT", "b.c": "GPL-3.0", "d.c": "GPL-3.0", "e.c": "ACME", "i.c": "Apache-2.0"}


def test_equal_scores_and_repeated_files(spark):
    rows = [("d/x", "one same wording here"), ("d/x", "one same wording here"), ("d/LICENSE", "one same wording here"), ("d/COPYING", "one same wording here"), ("d/y", "nothing")]
    out = licenses.scan(spark.createDataFrame(rows, "path string, text string"), {"B": ["one same wording here"], "A": ["one same wording here"]})
    assert sorted((r["path"], r["license"], r["license_from"]) for r in out.collect()) == [("d/COPYING", "A", "own"), ("d/LICENSE", "A", "own"), ("d/x", "A", "own"), ("d/x", "A", "own"), ("d/y", "A", "d")]


def brute_licences(rows, templates):
    """Licence and score of each (path, text) by plain dictionaries."""
    find = lambda t: re.findall(r"\w+(?:[.-]\w+)*", t.lower())
    lines = [line for _, t in rows for line in (t or "").split("\n") if find(line)]
    df = defaultdict(int)
    for line in lines:
        for t in set(find(line)):
            df[t] += 1

    def vector(text):
        tf = defaultdict(int)
        for t in find(text):
            tf[t] += 1
        w = {t: c * (np.log((1 + len(lines)) / (1 + max(df[t], 1))) + 1) for t, c in tf.items()}
        norm = sum(x * x for x in w.values()) ** 0.5
        return {t: x / norm for t, x in w.items()}

    known = [(name, vector(t)) for name, some in sorted(templates.items()) for t in some]
    holders = defaultdict(set)
    for name, v in known:
        for t in v:
            holders[t].add(name)
    out = []
    for path, text in rows:
        found, paragraph = [], []
        for line in [*(text or "").split("\n"), ""]:
            if find(line):
                paragraph.append(line)
                found.append(line)
            else:
                found += ["\n".join(paragraph)] if len(paragraph) > 1 else []
                paragraph = []
        if path and re.search(licenses.FILE_NAME, path) and find(text or ""):
            found.append(text)
        best = (0.0, None)
        for p in found:
            v = vector(p)
            for name, t in known:
                s = round(sum(x * v.get(k, 0) for k, x in t.items()), 9)
                own = {k for k in t if holders[k] == {name}}
                good = own & set(v) if own else sum(x * x for k, x in t.items() if k in v) >= 0.5
                if s >= licenses.LEAST and good and s > best[0]:
                    best = (s, name)
        out.append((path, best[1], best[0]))
    return out


def test_licence_scan_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(F.concat_ws("/", "source", "lang", F.when(F.col("doc_id") % 9 == 0, "LICENSE").otherwise(F.col("doc_id").cast("string"))).alias("path"), "text")
    rows = [tuple(r) for r in docs.collect()]
    if any(ord(c) > 127 for _, t in rows for c in t or ""):  # bytes beyond ASCII are letters here
        rows = [(p, "".join(c if ord(c) < 128 or c.isalnum() else "x" for c in t or "")) for p, t in rows]
    got = licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()
    own = sorted(((r["path"], r["license"], round(r["license_score"], 6)) for r in got if r["license_from"] == "own"), key=str)
    assert own == sorted(((p, n, round(s, 6)) for p, n, s in brute_licences(rows, licenses.TEMPLATES) if n), key=str) and own


@pytest.mark.parametrize("most", [licenses.MOST_COUNTED, 3])
def test_licence_scores_depend_on_shares(spark, monkeypatch, most):
    monkeypatch.setattr(licenses, "MOST_COUNTED", most)
    header, mit = "Copyright The Authors, licensed under the Apache License, Version 2.0.", "Copyright The Owners. Released under the MIT License."
    scores = []
    for n in (20, 4000):
        texts = [header if i % 2 else mit if i % 4 else f"Copyright the someone{i}" for i in range(n)]
        out = licenses.scan(spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, text string")).collect()
        met = [set(re.findall(r"\w+(?:[.-]\w+)*", t.lower())) for t in texts]
        df = defaultdict(int)
        for t in (t for x in met for t in x):
            df[t] += 1

        def vector(text):
            tf = defaultdict(int)
            for t in re.findall(r"\w+(?:[.-]\w+)*", text.lower()):
                tf[t] += 1
            w = {t: c * (np.log((1 + n) / (1 + df.get(t, 1))) + 1) for t, c in tf.items()}
            norm = sum(x * x for x in w.values()) ** 0.5
            return {t: x / norm for t, x in w.items()}

        best = {t: max((sum(x * vector(u).get(k, 0) for k, x in vector(t).items()), name) for name, some in licenses.TEMPLATES.items() for u in some) for t in (header, mit)}
        for r in out:
            want = best.get(texts[int(r["path"][1:])], (0, None))
            assert (r["license"], r["license_score"]) == ((want[1], pytest.approx(want[0], abs=1e-8)) if want[0] >= licenses.LEAST else (None, pytest.approx(r["license_score"])))
        scores.append(best[header][0])
        assert all(r["license"] == "Apache-2.0" for r in out if texts[int(r["path"][1:])] == header)
    assert scores[0] == pytest.approx(scores[1], abs=0.1)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    outs = [substring_dedup.digests(docs), substring_dedup.remove_repeats(docs), ngram_join.components(docs), decontamination.find_leaks(docs, items), decontamination.decontaminate(docs, items), bpe.encode(docs, VOCABULARY),
            quality.score(docs, quality.train(docs, labels)), toxicity.score(docs, toxicity.train(docs, labels)), licenses.scan(docs.withColumnRenamed("lang", "path"))]
    assert [o.count() for o in outs] == [0] * len(outs)


def test_classifiers_on_held_out_rows(spark):
    draw = random.Random(3)
    words = [f"k{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad, rude = draw.random() < 0.3, draw.random() < 0.3
        own = [draw.choice(words) + ("###" if bad else "") for _ in range(draw.randint(20, 80))]
        if rude:
            own[3] = draw.choice(["fool", "Fool!"])
        rows.append((i, " ".join(own), 9.0))
        labels.append((i, int(not bad), int(rude)))
    rows += [(600, None, 9.0), (601, "", 9.0), rows[0], (None, "text", 9.0)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels + [(5, 7, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for module, column in ((quality, 1), (toxicity, 2)):
        out = module.score(docs, module.train(docs, marks)).collect()
        assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
        held = [(r["predicted"], labels[r["doc_id"]][column]) for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
        assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95
    left = toxicity.reject(docs, toxicity.train(docs, marks))
    assert left.schema == docs.schema and left.count() < len(rows)


def test_flat_trees_agree_with_a_walk():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    forest = quality.fit(x, y, trees=10)

    def walk(row):
        b, total = forest.binned(row[None])[0], forest.prior
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if b[forest.feature[node]] <= forest.bin[node] else forest.right[node]
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    assert forest.score(x[:50]) == pytest.approx([walk(r) for r in x[:50]])


@pytest.mark.parametrize("kind", ["agree", "meet"])
def test_terms_that_tell_only_in_pairs(kind):
    """Labels by the agreement of two terms, or by two frequent terms that meet in few documents: neither tells anything, or much, alone."""
    draw = np.random.default_rng(5)

    def data(n):
        x, y = [], []
        for _ in range(n):
            own = set(draw.choice(np.arange(10, 400), 20, replace=False).tolist())
            a, b = draw.random(2) < (0.5 if kind == "agree" else 0.05)
            if kind == "meet" and draw.random() < 0.035:
                a = b = True
            y.append(float(a == b) if kind == "agree" else float((a and b) or draw.random() < 0.08))
            x.append(np.array(sorted(own | ({1} if a else set()) | ({2} if b else set()))))
        return x, np.array(y)

    machine = toxicity.fit(*data(4000 if kind == "agree" else 12_000))
    x, _ = data(1000)
    scores = machine.score(np.concatenate(x), np.cumsum([0, *map(len, x)]))
    both, one = (scores[[f(1 in d, 2 in d) for d in x]] for f in (lambda a, b: a and b, lambda a, b: a != b))
    assert (both > 0.9).all() and (one < 0.5).mean() > 0.99


def naive_terms(text):
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
    out = set()
    for w in words:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        one = np.frombuffer(w, np.uint8)
        out.add(int(toxicity.hash_words(one, np.array([0]), np.array([len(w)]))[0] >> np.uint64(64 - toxicity.BITS)))
        if len(w) > toxicity.STEM:
            out.add(int((toxicity.hash_words(one, np.array([0]), np.array([toxicity.STEM]))[0] ^ np.uint64(1 << 63)) >> np.uint64(64 - toxicity.BITS)))
    return out


ODD_TEXTS = ["", None, "You IDIOT, you!", "idiot", "a b c d e f g " * 20, "É日本 Ünïcode-wörds", "x" * 5000, "one\ntwo two two. Three!\n\nthree\nthree\n", "|#$%&*| !! 123 ABC def.", "\n\n \t", "Ends here?\nEnds here?\nshort"]


def test_toxicity_scores_against_plain_sums():
    import pyarrow as pa

    column = pa.array(ODD_TEXTS, pa.string())
    place, ptr = toxicity.terms(*common.text_buffer(column))
    assert [set(place[a:b].tolist()) for a, b in zip(ptr, ptr[1:])] == [naive_terms(t) for t in ODD_TEXTS]
    assert all(len(set(place[a:b].tolist())) == b - a for a, b in zip(ptr, ptr[1:]))
    draw = np.random.default_rng(1)
    known = np.unique(place)[::2]
    machine = toxicity.Machine(-0.3, known, draw.normal(size=len(known)), draw.normal(size=(len(known), toxicity.FACTORS)))
    row = {int(p): i for i, p in enumerate(known)}
    want = []
    for t in ODD_TEXTS:
        own = [row[p] for p in naive_terms(t) if p in row]
        total = machine.w0 + sum(machine.w[i] for i in own) + sum(float(machine.v[i] @ machine.v[j]) for n, i in enumerate(own) for j in own[:n])
        want.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
    assert machine.score(place, ptr) == pytest.approx(want)


def naive_statistics(text):
    """quality.FEATURES of one text by plain Python over its bytes."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lines = [x for x in raw.split(b"\n") if x]
    size, n, m = len(raw), len(words), len(lines)
    per = lambda a, b: a / max(b, 1)
    count = lambda chars: sum(raw.count(c) for c in chars)
    one = [bytes([c]) for c in range(256)]
    upper, stops = one[65:91], raw.count(b".")
    most = max((words.count(w) for w in set(words)), default=0)
    return [
        np.log1p(size), np.log1p(n), np.log1p(m), per(size, n), per(n, m), per(n, stops), per(sum(len(w) > 12 for w in words), n), per(sum(len(w) < 3 for w in words), n),
        per(len(set(words)), n), per(sum(a == b for a, b in zip(words, words[1:])), n), per(most, n), per(count(upper), size), per(count(one[48:58]), size), per(count([bytes([c]) for c in b".,;:!?'\"()-"]), size), per(count([bytes([c]) for c in b"#$%&*@^~_=+<>{}[]\\/`"]), size),
        per(raw.count(b"|"), n), per(raw.count(b"!"), n), per(count(one[128:]), size), per(sum(w[:1] in upper for w in words), n), per(sum(x[-1:] in (b".", b"?") for x in lines), m),
        per(sum(len(x) < 30 for x in lines), m), per(m - len(set(lines)), m), per(count([b" ", b"\t", b"\n", b"\v", b"\f", b"\r"]), size), per(stops, n),
    ]


def test_statistics_against_plain_counts():
    import pyarrow as pa

    got = quality.statistics(*common.text_buffer(pa.array(ODD_TEXTS, pa.string())))
    assert got == pytest.approx(np.array([naive_statistics(t) for t in ODD_TEXTS]))


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_queries_score_every_row(spark, data, module, label):
    """The registered query's rows against the model applied to naive features of each text."""
    import zlib

    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = module.train(docs, labels)
    out = {r["doc_id"]: r for r in module.query(spark, data).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(out) == len(rows) == docs.count()
    cut = 0.3 if module is quality else 0.5
    for r in rows:
        if module is quality:
            want = model.score(np.array([naive_statistics(r["text"])]))[0]
        else:
            own = np.array(sorted(naive_terms(r["text"])), np.int64)
            want = model.score(own, np.array([0, len(own)]))[0]
        got = out[r["doc_id"]]
        assert got["score"] == pytest.approx(want, abs=1e-6) and got["predicted"] == int(got["score"] >= cut) and got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
