"""SimHash trie, phrase mining and token alignment against brute force, on fixtures with nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tessera.llm import alignment, chat_format, licenses, phrases, simhash_trie, substring_dedup, toxicity
from tessera.llm import words as kernels
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, print long, least int, k string"


def duckdb_rows(sql: str, data: str) -> list[tuple]:
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    return sorted(db.execute(sql).fetchall())


def rows_of(seed: int, n: int = 90) -> list[tuple]:
    """Texts with exact copies, a large group of near copies, nulls, empty and one-word texts, repeated rows, and columns named as inner ones."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "A", "a", "the", "of"]
    base = [draw.choice(words) for _ in range(400)]
    texts: list[str | None] = [None, "", " \t\n", "one", "two words", "ONE", "x " * 300, "é b c d e f"]
    for _ in range(n):
        kind = draw.random()
        if kind < 0.4:
            near = list(base)
            near[draw.randrange(400)] = draw.choice(words)
            texts.append(" ".join(near).upper() if draw.random() < 0.2 else " ".join(near))
        elif kind < 0.5:
            texts.append(draw.choice(texts))
        else:
            texts.append("\t ".join(draw.choice(words) for _ in range(draw.randint(1, 80))))
    rows = [(i * 7, t, None if i % 5 == 0 else "en", 1, 2, "k") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, rows[12][1], "en", 1, 2, "k"), (None, "nobody else says this", "en", 1, 2, "k")]
    draw.shuffle(rows)
    return rows


def slow_print(text: str | None) -> int:
    w = WORD.findall((text or "").translate(LOW))
    grams = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(rows, budget=2):
    prints = [slow_print(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in set(label)}
    return sorted(((rows[i][0], f"{prints[i]:016x}", least[label[i]]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_simhash_classes_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(simhash_trie, "LEAST", 3)  # several leaves, some of them deep
    rows = rows_of(seed)
    found = simhash_trie.classes(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == slow_classes([(r[0], r[1]) for r in rows])


def test_simhash_of_an_empty_table(spark):
    assert simhash_trie.classes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_simhash_on_the_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash_trie.query(spark, data).collect()), key=str) == slow_classes(rows)


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie_join_finds_every_near_pair(budget, monkeypatch):
    monkeypatch.setattr(simhash_trie, "FRONT", 50)
    draw = np.random.default_rng(budget)
    centre = draw.integers(0, 2**64, 5, dtype=np.uint64)
    near = np.concatenate([centre] + [c ^ (np.uint64(1) << draw.integers(0, 64, 60, dtype=np.uint64)) for c in centre] + [draw.integers(0, 2**64, 200, dtype=np.uint64)])
    a = np.unique(near)
    b = np.unique(np.concatenate((near[::3], near[::5] ^ np.uint64(3))))
    distance = lambda x, y: np.bitwise_count(x[:, None] ^ y[None, :])
    pairs = {(int(i), int(j)) for u, v in simhash_trie.meet(simhash_trie.Trie(a), simhash_trie.Trie(b), budget, False) for i, j in zip(u, v)}
    assert pairs == set(zip(*map(np.ndarray.tolist, np.nonzero(distance(a, b) <= budget))))
    met = [(int(i), int(j)) for u, v in simhash_trie.meet(simhash_trie.Trie(a), simhash_trie.Trie(a), budget, True) for i, j in zip(u, v)]
    assert len(met) == len(set(met)) and set(met) == {(i, j) for i, j in zip(*np.nonzero(distance(a, a) <= budget)) if i <= j}


def test_upper_trie_deals_every_print_to_one_leaf(spark, monkeypatch):
    monkeypatch.setattr(simhash_trie, "LEAST", 20)
    draw = np.random.default_rng(5)
    hot = np.uint64(0xABCDEF0123456789) ^ draw.integers(0, 1 << 18, 400, dtype=np.uint64)  # far down one path
    prints = np.unique(np.concatenate((hot, draw.integers(0, 2**64, 300, dtype=np.uint64))))
    table = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    upper = simhash_trie.upper_trie(table, len(prints))
    leaf = np.searchsorted(upper.path, prints, side="right") - 1
    shift = (64 - upper.depth[leaf]).astype(np.uint64)
    assert (prints >> shift == upper.path[leaf] >> shift).all()
    assert np.bincount(leaf, minlength=len(upper.path)).max() <= 20 and np.bincount(leaf, minlength=len(upper.path)).min() > 0


def test_forest_names_the_smallest_node():
    assert simhash_trie.forest(7, np.array([5, 3, 6]), np.array([3, 1, 2])).tolist() == [0, 1, 2, 1, 4, 1, 2]


def slow_collocations(rows, support, best=2000):
    """Straight counting of all runs of up to four words; scores as the contract has them."""
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            count.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    often = {k: n for k, n in count.items() if n >= support}
    out = defaultdict(list)
    for (lang, p), a in often.items():
        if len(p) == 1:
            continue
        cuts = [(2_000_000 * a // (often[lang, p[:k]] + often[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        longer = [n for (x, q), n in often.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if not any(100 * n >= 80 * a for n in longer):
            out[lang].append((-score, -a, " ".join(p).encode(), often[lang, p[:k]], often[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, x, y, total[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:best], 1))


def phrase_rows(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    words = ["the", "of", "new", "york", "city", "É", "日本", "A", "a", "x", *(f"r{i}" for i in range(40))]
    texts: list[str | None] = [None, "", " .,;", "the", "new york city " * 40, "a b " * 35]
    for _ in range(60):
        own = [draw.choice(words[:10]) if draw.random() < 0.7 else draw.choice(words) for _ in range(draw.randint(1, 60))]
        own[len(own) // 2 : len(own) // 2] = ["New", "York"] + (["City"] if draw.random() < 0.9 else [])
        texts.append("".join(w + draw.choice([" ", " ", " ", "\t", "  ", ". ", "\n"]) for w in own))
    return [(i, t, [None, "en", "en", "de"][i % 4], 1, 2, "k") for i, t in enumerate(texts + texts[8:20])]


@pytest.mark.parametrize("shard", [120, 1500, 1 << 23])
def test_collocations_equal_brute_force(spark, shard):
    """Local supports of 1, of some, and of the whole."""
    rows = phrase_rows(shard)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = slow_collocations([(r[1], r[2]) for r in rows], 12)
    assert len(expected) > 8
    assert sorted(map(tuple, phrases.collocations(df, support=12, shard_bytes=shard).collect())) == expected
    few = [e for e in expected if e[1] <= 3]
    assert sorted(map(tuple, phrases.collocations(df, support=12, best=3, shard_bytes=shard).collect())) == few


def test_collocations_of_an_empty_table_and_of_no_words(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, "en", 1, 2, "k"), (2, " . ", None, 1, 2, "k")], SCHEMA)).collect() == []


def test_local_mining_sifts_phrases(spark):
    """With shards of a part of the words, phrases that lie scattered below the local support aren't counted again."""
    rows = phrase_rows(5)
    texts = phrases._texts(spark.createDataFrame(rows, SCHEMA).coalesce(1), "text", "lang")
    words = phrases.count_words(texts)
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    bits = phrases.candidate_bitmap(texts, np.full(1 << 21, 255, np.uint8), totals, sum(totals.values()), 12, shard_bytes=4000)
    every = phrases.candidate_bitmap(texts, np.full(1 << 21, 255, np.uint8), {}, sum(totals.values()), 1, shard_bytes=4000)
    assert 0 < np.bitwise_count(bits).sum() < np.bitwise_count(every).sum() / 4


def test_collocations_equal_sql(spark, data):
    expected = duckdb_rows(phrases.SQL, data)
    assert len(expected) > 0 and sorted(map(tuple, phrases.query(spark, data).collect())) == expected


A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def slow_alignment(rows):
    """Groups by a scan over both streams, links one by one."""
    a_model, b_model = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    a_model.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    found, held, out = [], Counter(), []
    for doc, text in rows:
        a = [(t, bytes(letter[c] for c in a_model.id_to_token(t))) for t in a_model.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(t, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := b_model.id_to_piece(t)) else p.replace("\u2581", " ").encode()) for t in b_model.encode(text or "")]
        whole = (" " + (text or "")).encode()
        groups = []
        if text and b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
            i = j = at_a = at_b = 0
            while i < len(a):
                one, other = [], []
                while not one or at_a != at_b:
                    if at_a <= at_b:
                        one.append(a[i][0])
                        at_a, i = at_a + len(a[i][1]), i + 1
                    else:
                        other.append(b[j][0])
                        at_b, j = at_b + len(b[j][1]), j + 1
                groups.append((one, other))
        found.append((doc, groups))
        held.update({(x, y) for one, other in groups for x in one for y in other})
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    for doc, groups in found:
        links = [(x, y) for one, other in groups for x in one for y in other]
        shown = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, other)) for one, other in groups)
        out.append((doc, sum(len(o) for o, _ in groups), sum(len(o) for _, o in groups), len(groups), len(links), sum(held[k] == most[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def aligned_rows(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    some = ["the", "word", "Straße", "日本語", "🙂🙃", "don't", "1234567", "<|endoftext|>", "<s>", "<unk>", "naïve", "\n\n", "   ", "\t", "x" * 50, "…", "é", "==>", "\u00a0"]
    texts: list[str | None] = [None, "", " ", "\n", "▁", "a▁b", "  two  spaces ", "<0x41>", "\x00", "ﬁ", "e\u0301", "日" * 300, "y" * 2000, "?!" * 400]
    texts += [draw.choice([" ", "", "  "]).join(draw.choice(some) for _ in range(draw.randint(1, 60))) for _ in range(40)]
    texts += [" ".join(draw.choice(some) for _ in range(1500)), texts[20], texts[20]]
    return [(i, t, "en", 1, 2, "k") for i, t in enumerate(texts)] + [(20, texts[20], "en", 1, 2, "k")]


@pytest.mark.parametrize("chunk", [7, 60, 1 << 16])
def test_alignment_equals_brute_force(spark, chunk):
    """Chunks shorter than tokens and groups, and chunks that hold whole documents."""
    rows = aligned_rows(chunk)
    found = alignment.aligned(spark.createDataFrame(rows, SCHEMA).repartition(3), A_FILE, B_FILE, chunk_bytes=chunk)
    assert sorted(map(tuple, found.collect()), key=str) == slow_alignment([(r[0], r[1]) for r in rows])


def test_alignment_of_an_empty_table(spark):
    assert alignment.aligned(spark.createDataFrame([], SCHEMA), A_FILE, B_FILE).collect() == []


def test_alignment_on_the_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, alignment.query(spark, data).collect()), key=str) == slow_alignment(rows)


def test_wide_groups_are_linked_by_their_different_ids(monkeypatch):
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 9, 60), draw.integers(0, 9, 50)
    groups = lambda: alignment.Groups((a, b), (np.repeat([0, 1, 2], 20), np.repeat([0, 1, 2], [30, 10, 10])), np.array([0, 0, 1]))
    plain = [x.tolist() for x in groups().pairs()]
    monkeypatch.setattr(alignment, "WIDE", 250)
    assert [x.tolist() for x in groups().pairs()] == plain and sum(plain[2]) == 20 * 50


def _fragment(cuts, tokens):
    """A fragment of a run of tokens, some of which end at common ends, with the groups that it closes."""
    whole, closed = None, []
    for cut, token in zip(cuts, tokens):
        one = (cut, ([token], []), ([], []))
        if whole is None:
            whole = one
        else:
            whole, group = alignment.compose(whole, one)
            closed += [group] if group else []
    return whole, closed


@settings(max_examples=100, deadline=None)
@given(st.lists(st.booleans(), min_size=3, max_size=12), st.data())
def test_composition_of_fragments_is_associative(cuts, draw):
    i = draw.draw(st.integers(1, len(cuts) - 2))
    j = draw.draw(st.integers(i + 1, len(cuts) - 1))
    tokens = list(range(len(cuts)))
    (x, cx), (y, cy), (z, cz) = (_fragment(cuts[p:q], tokens[p:q]) for p, q in ((0, i), (i, j), (j, len(cuts))))
    xy, g1 = alignment.compose(x, y)
    left, g2 = alignment.compose(xy, z)
    yz, h1 = alignment.compose(y, z)
    right, h2 = alignment.compose(x, yz)
    groups = lambda *found: sorted(g for part in found for g in part if g)
    assert left == right == _fragment(cuts, tokens)[0]
    assert groups(cx, cy, cz, [g1, g2]) == groups(cx, cy, cz, [h1, h2]) == groups(_fragment(cuts, tokens)[1])


def test_parts_of_other_types_keep_their_text_and_reference(spark):
    part = "struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
    parts = [("video", "caption <other:7> ", "v.mp4", None, None, None, None), (None, "kept", None, None, None, None, None), ("image", None, "i", None, None, None, None)]
    row = chat_format.format_conversations(spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{part}>")).first()
    assert row["formatted"] == "### user\n<other:0>caption \\4other:7> kept<image:1></turn>\n"
    assert [(a["index"], a["type"], a["ref"], a["tokens"]) for a in row["attachments"]] == [(0, "video", "v.mp4", 0), (1, "image", "i", 1)]


def test_licence_scan_keeps_columns_named_as_its_own(spark):
    mit = licenses.TEMPLATES["MIT"][0] if "MIT" in licenses.TEMPLATES else next(iter(licenses.TEMPLATES.values()))[0]
    rows = [("a/LICENSE", mit, 5, 6, "n", "f", "k"), ("a/b/x.py", "print(1)", 7, None, "n", "f", "k"), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "path string, text string, __dir int, __named int, __file string, __near string, __key string")
    found = {r["path"]: r for r in licenses.scan(df).collect()}
    assert licenses.scan(df).columns == [*df.columns, "license", "license_score", "license_from"]
    assert found["a/b/x.py"]["license"] == found["a/LICENSE"]["license"] and found["a/b/x.py"]["license_from"] == "a"
    assert [tuple(found[r[0]])[:7] for r in rows] == rows


def test_words_are_merged_and_described_once(monkeypatch):
    """A text is composed of its words as whole texts are aligned, and words that came before aren't tokenized again."""
    content = open(A_FILE, encoding="utf-8").read(), open(B_FILE, "rb").read()
    tokens = alignment.Tokenizers(*content)
    draw = random.Random(4)
    some = list("ab .,'sS1\t\n▁é日🙂\x1c\x00 　́") + ["  ", "   ", "the", " the", "<s>", "<unk>", "'re", "\r\n", "ing", "z" * 70]
    texts = ["".join(draw.choice(some) for _ in range(draw.randint(0, 40))) for _ in range(1500)] + ["", None, "a ", " ", "a b"]
    words = alignment.Words(tokens)
    whole = tokens.both(texts)
    assert [a for a, _ in whole if a] == [tokens.a.encode(" " + t) for t, (a, _) in zip(texts, whole) if a]
    for limit in (1 << 20, 50):
        monkeypatch.setattr(alignment, "MEMO_CHARACTERS", limit)
        for at in range(0, len(texts), 100):
            out, same = words.describe(texts[at : at + 100])
            for i, (a, b) in enumerate(whole[at : at + 100]):
                if same[i]:
                    assert (out["n_a"][i], out["n_b"][i]) == (len(a), len(b)) and " ".join(alignment.words_of(texts[at + i])) == (texts[at + i] or "")
    monkeypatch.setattr(alignment, "MEMO_CHARACTERS", 1 << 20)
    words.clear()
    words.describe(["so it was said"])
    monkeypatch.setattr(tokens, "both", None)
    out, _ = words.describe(["it was so", "said it"])
    assert out["shown"] == [words.shown[1] + ";" + words.shown[2] + ";" + words.shown[0], words.shown[3] + ";" + words.shown[1]]


def test_fit_holds_few_bytes_of_each_entry(monkeypatch):
    """The driver holds the entries of 12,000 texts while it fits: once numbered, and once in batches, those of one phase at a time."""
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "FREE_EPOCHS", 1)
    draw = np.random.default_rng(1)
    x = [np.unique(draw.integers(0, 1 << 18, 500)).astype(np.int32) for _ in range(6000)]
    y = (np.arange(len(x)) % 2).astype(float)
    tracemalloc.start()
    try:
        machine = toxicity.fit(x, y)
        assert tracemalloc.get_traced_memory()[1] < 40 * sum(map(len, x))
    finally:
        tracemalloc.stop()
    assert set(machine.places) <= set(np.concatenate(x))


def peak_of(run) -> float:
    """MB that ``run`` holds at once, beyond what was there."""
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_kernels_of_a_slice_hold_little():
    """A slice of 1 MB of text takes a few MB, not 8 bytes a character several times over; hashes don't depend on the block."""
    draw = random.Random(3)
    texts = ["", " ".join(draw.choice("abcdefgh") * draw.randint(1, 9) for _ in range(190_000)), "", " \n", "x  y\tz", ""]
    parts = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    start, end, _ = kernels.find_words(data, offsets)
    assert len(data) > 1_000_000
    fresh = kernels.Powers(kernels._BYTES.base)
    kernels._BYTES.up, kernels._BYTES.down = fresh.up, fresh.down
    assert peak_of(lambda: kernels.hash_words(data, start, end)) < 12  # 35 with blocks of 1 MB
    assert peak_of(lambda: substring_dedup.normalised(data, offsets)) < 12
    assert (kernels.hash_words(data, start, end) == kernels.hash_words(data, start, end, 1 << 20)).all()
    out, where = substring_dedup.normalised(data, offsets)
    spaced = ["".join(f"{w} " for w in WORD.findall(t)) for t in texts]
    assert [out[a:b].tobytes().decode().strip() for a, b in zip(where[:-1], where[1:])] == [s.strip() for s in spaced]
    for none in (np.zeros(1, np.int64), np.zeros(4, np.int64)):
        assert substring_dedup.normalised(data[:0], none)[1].tolist() == none.tolist()
