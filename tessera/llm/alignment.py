"""Alignment of the tokens that two tokenizers make of the same bytes.

Where a token of A and one of B end at the same byte, both streams can be cut;
the tokens between two such places are a group, and all its A-B pairs are linked.

A byte range of a document is a fragment: an open prefix (tokens before its first
common end), closed groups, and an open suffix (tokens after its last).  Joining
two neighbours closes at most one group, the left one's suffix with the right
one's prefix; the join is associative, and a fragment without a common end is
all prefix.  A document of one chunk is a fragment that is closed at both ends,
made where the text is tokenized.  Chunks of longer documents are dealt over
tasks and their open ends composed by a tree, FAN neighbours a step; closed groups
stay where they are and come together, in order, only to be digested.

How many documents hold a pair of ids linked is counted over all documents.  The
counts are written sorted, in blocks of bounded size, that tasks map and probe for
the pairs of their documents, so no document's links are shuffled.

A blank after a character that is neither white space nor U+2581 begins a token of both
kinds, whatever surrounds it, so the words between such blanks are fragments closed at both
ends: each different one is tokenized and grouped once for many documents, and a document
is composed of those it holds.

Defined results: null and empty texts, and texts whose joined A or B bytes differ
from space + text, have no tokens; repeated rows count as documents of their own;
an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import materialise, pieces, read_file, scan, shared_folder, write_file

#: Bytes of a chunk, chunks that a step of the tree composes, text tokenized at once, and pair counts in a block.
CHUNK, FAN, SLICE_BYTES, BLOCK_PAIRS = 1 << 16, 16, 256 << 10, 1 << 22
#: Where a text is cut in words (see above), what a text has that isn't cut at every blank, and characters of the words that a worker remembers before it begins anew.
CUT, UNCUT, MEMO_CHARACTERS = re.compile(r"(?<=[^\s\u2581]) "), re.compile(r"[\s\u2581] "), 2 << 20
#: Groups with more links than this are linked by their different ids.
WIDE = 1 << 12
#: Bits of an id of B in the number of a pair.
B_BITS = 31
_ENDS = "cut boolean, pre_a array<int>, pre_b array<int>, post_a array<int>, post_b array<int>"
_DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


class Tokenizers:
    """A: byte-level BPE; B: pieces.  For each the bytes of every id, and their number."""

    def __init__(self, a: str, b: bytes):
        self.a = bpe.ByteBPE(a)
        self.a.cut = None  # strings of special tokens are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.bytes_a = self.a.bytes_of
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        for i, x in self.bytes_a.items():
            self.size_a[i] = len(x)
        self.size_b = np.array([len(x) for x in self.bytes_b])
        numeral = [str(i) for i in range(max(len(self.size_a), len(self.size_b)))]
        #: What an id adds to the digest: 4 * id, + 1 if it is the group's last of its kind, + 2 for B.
        self.shown = [n + end for n in numeral for end in (",", "|", ",", ";")]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def both(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and B of each text; none where their bytes aren't those of space + text."""
        texts = [t or "" for t in texts]
        found = [(a, b) if t else ([], []) for t, a, b in zip(texts, self.a.encode_all([" " + t if t else "" for t in texts]), self.b.encode(texts, num_threads=1))]
        if self._alike(texts, found):
            return found
        return [x if self._alike([t], [x]) else ([], []) for t, x in zip(texts, found)]

    def _alike(self, texts: list[str | None], found: list[tuple[list[int], list[int]]]) -> bool:
        """Whether the tokens of each text have its bytes: as many for each, and the same in all."""
        wholes = [(" " + t).encode() if t else b"" for t in texts]
        size = np.fromiter(map(len, wholes), np.int64, len(wholes))
        for k, bytes_of, size_of in ((0, self.bytes_a, self.size_a), (1, self.bytes_b, self.size_b)):
            ids, owner = _flat([x[k] for x in found])
            if (np.bincount(owner, weights=size_of[ids], minlength=len(texts)) != size).any() or b"".join([bytes_of[i] for i in ids.tolist()]) != b"".join(wholes):
                return False
        return True


@lru_cache(maxsize=2)
def load(a: str, b: bytes) -> Tokenizers:
    return Tokenizers(a, b)


class Groups:
    """Groups of many units (documents, or chunks of one) at once: tokens of both kinds in order, each with its group's number."""

    def __init__(self, ids: tuple[np.ndarray, np.ndarray], group: tuple[np.ndarray, np.ndarray], unit: np.ndarray):
        self.ids, self.group, self.unit = ids, group, unit  # unit: of each group
        n = len(unit)
        self.n = tuple(np.bincount(g, minlength=n) for g in group)

    def texts(self, shown: list[str], units: int) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each unit."""
        a, b = self.group
        to_a = np.arange(len(a)) + np.append(0, np.cumsum(self.n[1]))[a]
        to_b = np.arange(len(b)) + np.cumsum(self.n[0])[b] if len(b) else np.zeros(0, np.int64)
        code, owner = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        for to, ids, g, kind in ((to_a, self.ids[0], a, 0), (to_b, self.ids[1], b, 2)):
            code[to] = 4 * ids + kind + np.append(g[1:] != g[:-1], True)[: len(g)]
            owner[to] = self.unit[g]
        edge = np.searchsorted(owner, np.arange(units + 1))
        parts = [shown[c] for c in code.tolist()]
        return ["".join(parts[x:y])[:-1] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """unit, number of the pair of ids and how often it is linked, in order; each unit and pair once."""
        (a, b), (na, nb) = self.ids, self.n
        product = na * nb
        plain = product <= WIDE
        first_b = np.cumsum(nb) - nb
        some = plain[self.group[0]]
        one, g = a[some], self.group[0][some]
        times = nb[g]
        at = np.repeat(first_b[g] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        unit, pair, n = [np.repeat(self.unit[g], times)], [np.repeat(one.astype(np.int64), times) << B_BITS | b[at]], [np.ones(len(at), np.int64)]
        first_a = np.cumsum(na) - na
        for k in np.flatnonzero(~plain).tolist():
            (ua, ca), (ub, cb) = (np.unique(x[f[k] : f[k] + m[k]], return_counts=True) for x, f, m in ((a, first_a, na), (b, first_b, nb)))
            pair.append((ua.astype(np.int64)[:, None] << B_BITS | ub[None, :]).ravel())
            n.append((ca[:, None] * cb[None, :]).ravel())
            unit.append(np.full(len(pair[-1]), self.unit[k]))
        unit, pair, n = (np.concatenate(x) for x in (unit, pair, n))
        return _once(unit, pair, n)


def _once(unit: np.ndarray, pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each unit and pair once, in order, with the sum of its n."""
    order = np.lexsort((pair, unit))
    unit, pair, n = unit[order], pair[order], n[order]
    head = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (unit[1:] != unit[:-1]))) if len(pair) else np.zeros(0, np.int64)
    return unit[head], pair[head], np.add.reduceat(n, head) if len(head) else n


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Entries of all lists, and the list of each."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), np.repeat(np.arange(len(lists)), n)


def _common(ends: list[np.ndarray], owner: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Common ends of A and B within each unit, as numbers in order, their units, and the group of every A and B token."""
    reach = int(max([x.max(initial=0) for x in ends])) + 1
    a, b = (o * reach + e for o, e in zip(owner, ends))
    common = np.intersect1d(a, b, assume_unique=True)
    return common // reach, np.searchsorted(common, a), np.searchsorted(common, b), common


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _described(groups: Groups, units: int, shown: list[str]) -> dict[str, np.ndarray | list]:
    """Counts, text and pairs of the groups of each unit."""
    unit, pair, times = groups.pairs()
    per = lambda weights: np.bincount(groups.unit, weights=weights, minlength=units).astype(np.int64)
    return {
        "n_a": per(groups.n[0]), "n_b": per(groups.n[1]), "n_groups": per(None), "n_links": per(groups.n[0] * groups.n[1]),
        "shown": groups.texts(shown, units), "pairs": _lists(pair, unit, units, pa.int64()), "times": _lists(times, unit, units, pa.int64()),
    }


def words_of(text: str | None) -> list[str]:
    """The words of a text, which one blank each joins to the text again."""
    if not text:
        return []
    return CUT.split(text) if text[0] == " " or UNCUT.search(text) else text.split(" ")


class Words:
    """What the words of texts hold, by number: counts (tokens of A and B, groups, links), text of the groups, and linked pairs."""

    def __init__(self, tokens: Tokenizers):
        self.tokens, self.blank = tokens, [tokens.b.piece_to_id("▁")]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.shown: list[str] = []
        self.counts, self.same = np.zeros((0, 4), np.int64), np.zeros(0, bool)
        self.pairs, self.times, self.edge, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), 0

    def add(self, words: list[str]) -> None:
        """Number new words and describe them; their tokens are those of a blank and the word."""
        found = self.tokens.both(words)
        found = [(self.tokens.a.encode(" "), self.blank) if w == "" else x for w, x in zip(words, found)]
        (a, of_a), (b, of_b) = (_flat([x[k] for x in found]) for k in (0, 1))
        ends = []
        for ids, owner, size in ((a, of_a, self.tokens.size_a), (b, of_b, self.tokens.size_b)):
            total = np.cumsum(size[ids])
            ends.append(total - np.append(0, total)[np.searchsorted(owner, np.arange(len(words)))][owner])
        unit, ga, gb, _ = _common(ends, [of_a, of_b])
        out = _described(Groups((a, b), (ga, gb), unit), len(words), self.tokens.shown)
        self.number.update(zip(words, range(len(self.shown), len(self.shown) + len(words))))
        self.shown += out["shown"]
        self.counts = np.concatenate((self.counts, np.stack([out[c] for c in ("n_a", "n_b", "n_groups", "n_links")], 1)))
        self.same = np.append(self.same, out["n_a"] > 0)
        self.edge = np.append(self.edge, len(self.pairs) + np.asarray(out["pairs"].offsets)[1:].astype(np.int64))
        self.pairs, self.times = (np.append(x, np.asarray(out[c].values)) for x, c in ((self.pairs, "pairs"), (self.times, "times")))
        self.size += sum(map(len, words))

    def describe(self, texts: list[str | None]) -> tuple[dict[str, np.ndarray | list], np.ndarray]:
        """As ``_described``, of whole texts, and whether each has only words whose bytes are those of both tokenizers."""
        cut = [words_of(t) for t in texts]
        flat = list(chain.from_iterable(cut))
        new = dict.fromkeys(flat)
        if self.size > MEMO_CHARACTERS:
            self.clear()
        if new := [w for w in new if w not in self.number]:
            self.add(new)
        ids = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        owner, n = np.repeat(np.arange(len(cut)), [len(c) for c in cut]), len(texts)
        edge = np.searchsorted(owner, np.arange(n + 1)).tolist()
        shown = [self.shown[i] for i in ids.tolist()]
        # words of a text, each once and how often, with their pairs
        held, often = np.unique(owner * max(len(self.shown), 1) + ids, return_counts=True)
        unit, word = np.divmod(held, max(len(self.shown), 1))
        first, m = self.edge[word], self.edge[word + 1] - self.edge[word]
        at = np.repeat(first - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        unit, pair, times = _once(np.repeat(unit, m), self.pairs[at], self.times[at] * np.repeat(often, m))
        sums = [_sums(owner, self.counts[ids, k], n) for k in range(4)]
        out = dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums)) | {
            "shown": [";".join(shown[x:y]) for x, y in zip(edge, edge[1:])], "pairs": _lists(pair, unit, n, pa.int64()), "times": _lists(times, unit, n, pa.int64()),
        }
        return out, np.bincount(owner, weights=~self.same[ids], minlength=n) == 0


@lru_cache(maxsize=2)
def load_words(a: str, b: bytes) -> Words:
    return Words(load(a, b))


def _vocabularies(spark: SparkSession, a: str, b: str):
    """Both files, of some megabytes however large the corpus is."""
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        return spark.sparkContext.broadcast((f.read(), g.read()))


def tokenized(docs: DataFrame, vocabulary_a: str, vocabulary_b: str, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """A row for each document: described, if it is a single chunk; for others its number and, a row for each chunk, tokens and their ends."""
    content = _vocabularies(docs.sparkSession, vocabulary_a, vocabulary_b)
    schema = f"doc_id long, uid string, chunk long, {_DOC}, a array<int>, a_end array<long>, b array<int>, b_end array<long>"

    ids_type, long_type = pa.list_(pa.int32()), pa.list_(pa.int64())
    names = ["doc_id", "uid", "chunk", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "a", "a_end", "b", "b_end"]

    def described(keys: pa.Array, out: dict[str, np.ndarray | list]) -> pa.RecordBatch:
        sha = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in out["shown"]]
        none = lambda kind: pa.nulls(len(keys), kind)
        return pa.RecordBatch.from_arrays([keys, none(pa.string()), none(pa.int64()), *(pa.array(out[c]) for c in names[3:7]), pa.array(sha, pa.string()), out["pairs"], out["times"], none(ids_type), none(long_type), none(ids_type), none(long_type)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, words = load(*content.value), load_words(*content.value)
        for batch in pieces(batches, "text", SLICE_BYTES):
            # texts that may be longer than a chunk, or hold words of other bytes, are tokenized as a whole
            short = pc.less(pc.fill_null(pc.binary_length(batch.column(1)), 0), chunk_bytes)
            few = batch.filter(short)
            out, same = words.describe(few.column(1).to_pylist())
            yield described(few.column(0), out).filter(pa.array(same))
            for rest in (batch.filter(pc.invert(short)), few.filter(pa.array(~same))):
                if rest.num_rows:
                    yield from whole(rest, tokens)

    def whole(batch: pa.RecordBatch, tokens: Tokenizers) -> Iterator[pa.RecordBatch]:
        keys, found = batch.column(0).to_pylist(), tokens.both(batch.column(1).to_pylist())
        a, of_a = _flat([x for x, _ in found])
        b, of_b = _flat([x for _, x in found])
        ends = []
        for ids, owner, size in ((a, of_a, tokens.size_a), (b, of_b, tokens.size_b)):
            total = np.cumsum(size[ids])
            begin = np.searchsorted(owner, np.arange(len(found) + 1))
            ends.append(total - np.append(0, total)[begin[:-1]][owner])
        long = np.bincount(of_a, weights=ends[0] > chunk_bytes, minlength=len(found)) > 0
        keep = tuple(~long[o] for o in (of_a, of_b))
        unit, ga, gb, _ = _common([e[k] for e, k in zip(ends, keep)], [o[k] for o, k in zip((of_a, of_b), keep)])
        out = _described(Groups((a[keep[0]], b[keep[1]]), (ga, gb), unit), len(found), tokens.shown)
        yield described(pa.array(keys, pa.int64()), out).filter(pa.array(~long))
        for i in np.flatnonzero(long).tolist():
            uid, stream = uuid.uuid4().hex, []
            for ids, owner, end in ((a, of_a, ends[0]), (b, of_b, ends[1])):
                own = slice(*np.searchsorted(owner, [i, i + 1]))
                stream += [ids[own], end[own]]
            chunks = [(stream[k] - 1) // chunk_bytes for k in (1, 3)]
            for chunk in np.unique(np.concatenate(chunks)).tolist():
                cut = [slice(*np.searchsorted(c, [chunk, chunk + 1])) for c in chunks]
                parts = [stream[k][cut[k // 2]] for k in range(4)]
                lists = [pa.array([x], t) for x, t in zip(parts, (ids_type, long_type, ids_type, long_type))]
                yield pa.RecordBatch.from_arrays([pa.array([keys[i]], pa.int64()), pa.array([uid]), pa.array([chunk], pa.int64()), *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.string()), pa.nulls(1, long_type), pa.nulls(1, long_type), *lists], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


Fragment = tuple[bool, tuple[list, list], tuple[list, list]]


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, tuple[list, list] | None]:
    """The fragment of two neighbours, and the group that closes between them: (has a common end, open prefix, open suffix), each of A and B tokens."""
    add = lambda x, y: (x[0] + y[0], x[1] + y[1])
    if not left[0]:
        return (right[0], add(left[1], right[1]), right[2]), None
    if not right[0]:
        return (True, left[1], add(left[2], right[1])), None
    return (True, left[1], right[2]), add(left[2], right[1])


_GROUP = "doc_id long, uid string, chunk long, inner boolean, n_a long, n_b long, n_groups long, n_links long, shown string, pairs array<long>, times array<long>"


def _fragments(chunks: DataFrame, content) -> DataFrame:
    """Rows of closed groups (node null) and, for every chunk, of its open ends (node: the chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load(*content.value)
        for batch in batches:
            for i in range(batch.num_rows):
                doc, uid, chunk = (batch.column(k)[i].as_py() for k in range(3))
                a, a_end, b, b_end = (np.asarray(batch.column(k)[i].values).astype(np.int64) for k in range(3, 7))
                unit, ga, gb, common = _common([a_end, b_end], [np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)])
                last = len(common)
                side = lambda k: (a[ga == k].tolist(), b[gb == k].tolist())
                ends = (last > 0, side(0), side(last) if last else ([], []))
                yield _open_row(doc, uid, chunk, chunk, ends)
                keep = [(g > 0) & (g < last) for g in (ga, gb)]
                if last > 1:
                    groups = Groups((a[keep[0]], b[keep[1]]), (ga[keep[0]] - 1, gb[keep[1]] - 1), unit[1:])
                    yield _closed_row(doc, uid, chunk, True, groups, tokens.shown)

    return chunks.select("doc_id", "uid", "chunk", "a", "a_end", "b", "b_end").repartition("uid", "chunk").mapInArrow(run, f"{_GROUP}, node long, {_ENDS}")


_TYPES = pa.schema([
    ("doc_id", pa.int64()), ("uid", pa.string()), ("chunk", pa.int64()), ("inner", pa.bool_()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("shown", pa.string()),
    ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("node", pa.int64()), ("cut", pa.bool_()), *((c, pa.list_(pa.int32())) for c in ("pre_a", "pre_b", "post_a", "post_b")),
])


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([values[f.name].cast(f.type) if isinstance(values.get(f.name), pa.Array) else pa.array([values.get(f.name)], f.type) for f in _TYPES], schema=_TYPES)


def _open_row(doc: int, uid: str, chunk: int, node: int, ends: Fragment) -> pa.RecordBatch:
    """Open ends; ``chunk`` is where the first common end lies, at which a group of the left neighbour closes."""
    return _row(doc_id=doc, uid=uid, chunk=chunk, node=node, cut=ends[0], pre_a=ends[1][0], pre_b=ends[1][1], post_a=ends[2][0], post_b=ends[2][1])


def _closed_row(doc: int, uid: str, chunk: int, inner: bool, groups: Groups, shown: list[str]) -> pa.RecordBatch:
    out = _described(groups, 1, shown)
    counts = {c: int(out[c][0]) for c in ("n_a", "n_b", "n_groups", "n_links")}
    return _row(doc_id=doc, uid=uid, chunk=chunk, inner=inner, shown=out["shown"][0], pairs=out["pairs"], times=out["times"], **counts)


def _one_group(doc: int, uid: str, chunk: int, tokens: tuple[list, list], shown: list[str]) -> pa.RecordBatch:
    a, b = (np.asarray(x, np.int64) for x in tokens)
    return _closed_row(doc, uid, chunk, False, Groups((a, b), (np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)), np.zeros(1, np.int64)), shown)


def _composer(content, root: bool):
    def run(rows: pa.Table) -> pa.Table:
        return _compose_all(rows.sort_by("node"), load(*content.value).shown, root)

    return run


def _compose_all(rows: pa.Table, shown: list[str], root: bool) -> pa.Table:
    """Compose neighbours of one parent, in order; a group that closes lies before those inside the chunk in which it closes."""
    doc, uid, node = (rows.column(c)[0].as_py() for c in ("doc_id", "uid", "node"))
    out, whole, first = [], None, None
    for r in rows.select(["chunk", "cut", "pre_a", "pre_b", "post_a", "post_b"]).to_pylist():
        piece: Fragment = (r["cut"], (r["pre_a"], r["pre_b"]), (r["post_a"], r["post_b"]))
        closed = None
        if whole is None:
            whole = piece
        else:
            whole, closed = compose(whole, piece)
        if closed is not None:
            out.append(_one_group(doc, uid, r["chunk"], closed, shown))
        if first is None and piece[0]:
            first = r["chunk"]
    if root:  # a document begins and ends at common ends
        out.append(_one_group(doc, uid, first, whole[1], shown))
    else:
        out.append(_open_row(doc, uid, -1 if first is None else first, node // FAN, whole))
    return pa.Table.from_batches(out, _TYPES)


def _long_documents(chunks: DataFrame, content) -> DataFrame:
    """Documents of several chunks, described: fragments, composed by a tree, then digested in order."""
    top = chunks.agg(F.max("chunk")).first()[0]
    rows = materialise(_fragments(chunks, content), "fragments")
    closed, nodes, schema = [rows.filter("node IS NULL")], rows.filter("node IS NOT NULL"), rows.schema
    while True:
        root = top < FAN
        parents = nodes.withColumn("parent", F.floor(F.col("node") / FAN)).groupBy("uid", "parent")
        rows = materialise(parents.applyInArrow(_composer(content, root), schema), "composed")
        closed.append(rows.filter("node IS NULL"))
        if root:
            break
        nodes, top = rows.filter("node IS NOT NULL"), top // FAN

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document's rows follow each other, in order; of its texts only the digest's state is held."""
        names = ["doc_id", *(c.split()[0] for c in _DOC.split(", "))]
        now, doc, counts, sha, pairs = None, None, None, None, {}

        def done() -> pa.RecordBatch:
            numbers = sorted(pairs)
            return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), *(pa.array([c], pa.int64()) for c in counts), pa.array([sha.hexdigest()]), pa.array([numbers], pa.list_(pa.int64())), pa.array([[pairs[p] for p in numbers]], pa.list_(pa.int64()))], names=names)

        for batch in batches:
            for r in batch.select(["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "shown", "pairs", "times"]).to_pylist():
                if r["uid"] != now:
                    if now is not None:
                        yield done()
                    now, doc, counts, sha, pairs = r["uid"], r["doc_id"], [0, 0, 0, 0], hashlib.sha256(), {}
                sha.update((";" * (counts[2] > 0) + r["shown"]).encode())
                counts = [n + r[c] for n, c in zip(counts, ("n_a", "n_b", "n_groups", "n_links"))]
                for p, n in zip(r["pairs"], r["times"]):
                    pairs[p] = pairs.get(p, 0) + n
        if now is not None:
            yield done()

    ordered = reduce(DataFrame.unionByName, closed).repartition("uid").sortWithinPartitions("uid", "chunk", "inner")
    return ordered.mapInArrow(digest, f"doc_id long, {_DOC}")


def pair_counts(described: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents a pair of ids is linked, and whether none of its A id is in more."""
    counts = described.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    # rows of an A id: at most the vocabulary of B
    most = F.max("n").over(W.partitionBy(F.shiftright("pair", B_BITS)))
    return counts.withColumn("best", F.col("n") == most)


def count_blocks(counts: DataFrame) -> list[tuple[int, str]]:
    """Write the counts sorted by pair in blocks of about BLOCK_PAIRS; the first pair and the file of each block that isn't empty."""
    counts = materialise(counts, "counts")
    folder = f"{shared_folder(counts.sparkSession)}/blocks-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is not None and len(rows):
            pair, n = np.asarray(rows.column("pair")), np.asarray(rows.column("n")) << 1 | np.asarray(rows.column("best"))
            path = write_file(folder, pair.astype("<i8").tobytes() + n.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([int(pair[0])], pa.int64()), pa.array([path])], names=["first", "path"])

    blocks = counts.count() // BLOCK_PAIRS + 1
    made = counts.repartitionByRange(blocks, "pair").sortWithinPartitions("pair").mapInArrow(write, "first long, path string")
    return sorted(tuple(r) for r in made.collect())


def _known(pairs: np.ndarray, blocks: list[tuple[int, str]]) -> np.ndarray:
    """For each pair, in order, its count twice, and one more if it is the best of its A id."""
    out = np.zeros(len(pairs), np.int64)
    edge = np.append(np.searchsorted(pairs, [b[0] for b in blocks]), len(pairs))
    for k, (_, path) in enumerate(blocks):
        if edge[k] < edge[k + 1]:
            stored = read_file(path).view("<i8").reshape(2, -1)
            out[edge[k] : edge[k + 1]] = stored[1][np.searchsorted(stored[0], pairs[edge[k] : edge[k + 1]])]
    return out


def aligned(docs: DataFrame, vocabulary_a: str, vocabulary_b: str, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """Counts and digest of each document's groups, links that are the best of their A id, and the sum of all links' counts."""
    spark = docs.sparkSession
    made = materialise(tokenized(docs, vocabulary_a, vocabulary_b, key, text, chunk_bytes), "tokens")
    columns = ["doc_id", *(c.split()[0] for c in _DOC.split(", "))]
    described, chunks = made.filter("uid IS NULL").select(columns), made.filter("uid IS NOT NULL")
    if chunks.head(1):
        described = described.unionByName(materialise(_long_documents(chunks, _vocabularies(spark, vocabulary_a, vocabulary_b)), "long"))
    blocks = spark.sparkContext.broadcast(count_blocks(pair_counts(described)))  # a name for each BLOCK_PAIRS pairs

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = (batch.column(c) for c in ("pairs", "times"))
            owner, n = np.asarray(pairs.value_parent_indices()), np.asarray(times.flatten())
            pair, place = np.unique(np.asarray(pairs.flatten()), return_inverse=True)
            known = _known(pair, blocks.value)[place]
            total = lambda weights: np.array([int(x) for x in _sums(owner, weights, batch.num_rows)], np.int64)
            plain = [batch.column(c) for c in columns[:5]]
            yield pa.RecordBatch.from_arrays([*plain, pa.array(total(n * (known & 1))), pa.array(total(n * (known >> 1))), batch.column("groups_sha256")], names=[*columns[:5], "n_best", "count_sum", "groups_sha256"])

    return described.select(columns).mapInArrow(look_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of the values of each owner, which are in order."""
    total = np.append(0, np.cumsum(values))
    edge = np.searchsorted(owner, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(scan(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
