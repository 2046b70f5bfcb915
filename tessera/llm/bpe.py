"""Byte-level BPE encoding and decoding with a given vocabulary.

Each pre-token is a short word of bytes.  Its merge works on one contiguous
array: its parts (so their boundaries) and, beside each, the rank of the pair
that starts there.  The smallest rank is searched, the boundary inside that pair
is deleted, and only the two neighbouring ranks are looked up anew.  Words that a
worker has met before come from a bounded memo.

Defined results: a null or empty text has no tokens; repeated rows are encoded
alike; the text of a special token becomes that token's id; other columns stay.
A text that isn't null decodes to itself.  The operator only maps rows, so
partitions of any size, and lost executors, need no care.
"""

from __future__ import annotations

import hashlib
import json
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.llm.common import pieces

#: Words that a worker remembers; then a new memo starts, and the one before is kept for what it still serves.
MEMO_WORDS = 400_000
#: Longer pre-tokens (runs of one kind of character) aren't remembered, and are merged by a heap.
MEMO_CHARACTERS = 64
#: Fixed value: the pre-token pattern of byte-level BPE (the vocabulary's published pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = 1 << 60
#: Text whose tokens are held at once.
SLICE_BYTES = 256 << 10


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder of one vocabulary file (JSON with merges and added tokens)."""

    def __init__(self, content: str):
        spec = json.loads(content)
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        vocabulary = {raw(k): v for k, v in spec["model"]["vocab"].items() if all(c in letter for c in k)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.ids = vocabulary
        #: Bits of an id; rank of the pair of adjacent parts a, b, under a << bits | b; the part that a rank makes.
        self.bits = max(vocabulary.values()).bit_length()
        self.rank = {vocabulary[x] << self.bits | vocabulary[y]: i for i, (x, y) in enumerate((raw(x), raw(y)) for x, y in pairs)}
        self.made = [vocabulary[raw(x) + raw(y)] for x, y in pairs]
        self.byte = [vocabulary[bytes([i])] for i in range(256)]
        self.bytes_of = {v: k for k, v in vocabulary.items()} | {v: k.encode() for k, v in self.special.items()}
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.sorted: tuple[np.ndarray, ...] | None = None

    def word(self, word: bytes) -> tuple[int, ...]:
        """Token ids of one pre-token."""
        rank, made, bits = self.rank.get, self.made, self.bits
        parts = [self.byte[c] for c in word]
        ranks = [rank(a << bits | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = made[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] << bits | parts[i + 1], _NONE)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << bits | parts[i], _NONE)
        return tuple(parts)

    def merged(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """As ``word``, of many words at once: a step deletes one boundary in each word that still has a pair."""
        if self.sorted is None:
            pair, rank = (np.fromiter(x, np.int64, len(self.rank)) for x in (self.rank.keys(), self.rank.values()))
            order = np.argsort(pair)
            self.sorted = np.append(pair[order], np.iinfo(np.int64).max), np.append(rank[order], _NONE), np.array(self.made), np.array(self.byte)
        pairs, ranks_of, made, byte = self.sorted

        def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """A pair with a place behind the last part has no rank."""
            key = a << self.bits | b
            at = np.searchsorted(pairs, key)
            return np.where((a >= 0) & (b >= 0) & (pairs[at] == key), ranks_of[at], _NONE)

        out: list[tuple[int, ...]] = [()] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in zip((0, 8, 16, 32, 64), (8, 16, 32, 64, 1 << 60)):
            row = np.flatnonzero((size > low) & (size <= high))
            if not len(row):
                continue
            column = np.arange(size[row].max() + 1)
            data = np.frombuffer(b"".join([words[i] for i in row.tolist()]), np.uint8)
            inside = column < size[row][:, None]
            parts = np.full(inside.shape, -1)
            parts[inside] = byte[data]
            ranks = np.full(inside.shape, _NONE)
            ranks[:, :-1] = rank(parts[:, :-1], parts[:, 1:])
            while len(row):
                at = ranks.argmin(1)
                least = ranks[np.arange(len(row)), at]
                done = least == _NONE
                for i, ids in zip(row[done].tolist(), parts[done].tolist()):
                    out[i] = tuple(ids[: ids.index(-1)])
                row, parts, ranks, at, least = (x[~done] for x in (row, parts, ranks, at, least))
                every = np.arange(len(row))
                parts[every, at] = made[least]
                after = np.minimum(column + (column > at[:, None]), len(column) - 1)
                parts = np.take_along_axis(parts, after, 1)
                ranks = np.take_along_axis(ranks, np.minimum(column + (column >= at[:, None]), len(column) - 1), 1)
                ranks[every, at] = rank(parts[every, at], parts[every, at + 1])
                before = np.flatnonzero(at)
                ranks[before, at[before] - 1] = rank(parts[before, at[before] - 1], parts[before, at[before]])
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Token ids of texts in which special tokens are plain text; words that weren't met before are merged together."""
        cut = [self.words.findall(t) for t in texts]
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        new = [w for w in dict.fromkeys(chain.from_iterable(cut)) if w not in self.memo]
        made = {w: self._long(w.encode()) for w in new if len(w) > MEMO_CHARACTERS}
        new = [w for w in new if w not in made]
        self.memo.update(zip(new, self.merged([w.encode() for w in new])))
        memo = ChainMap(made, self.memo) if made else self.memo
        return [list(chain.from_iterable(map(memo.__getitem__, words))) for words in cut]

    def _plain(self, text: str, out: list[tuple[int, ...]]) -> None:
        memo = self.memo
        for word in self.words.findall(text):
            ids = memo.get(word)
            if ids is None:
                ids = self._met(word)
            out.append(ids)

    def _met(self, word: str) -> tuple[int, ...]:
        if len(word) > MEMO_CHARACTERS:
            return self._long(word.encode())
        if len(self.memo) >= MEMO_WORDS:
            self.older = dict(self.memo)
            self.memo.clear()
        ids = self.older.get(word)
        self.memo[word] = ids = self.word(word.encode()) if ids is None else ids
        return ids

    def _long(self, word: bytes) -> tuple[int, ...]:
        """As ``word``, with a heap of pairs: a run of thousands of bytes without a boundary costs n log n, not n * n."""
        from heapq import heapify, heappop, heappush

        n, rank, bits = len(word), self.rank, self.bits
        part, end, before = [self.byte[c] for c in word], list(range(1, n + 1)), list(range(-1, n - 1))
        pair = lambda i: rank.get(part[i] << bits | part[end[i]]) if end[i] < n else None
        heap = [(r, i) for i in range(n) if (r := pair(i)) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            if part[i] < 0 or pair(i) != r:  # one of its parts has gone meanwhile
                continue
            part[i], part[end[i]], end[i] = self.made[r], -1, end[end[i]]
            if end[i] < n:
                before[end[i]] = i
            for k in (before[i], i):
                if k >= 0 and (q := pair(k)) is not None:
                    heappush(heap, (q, k))
        return tuple(p for p in part if p >= 0)

    def encode_parts(self, text: str) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = []
        if self.cut is None or not self.cut.search(text):
            self._plain(text, out)
            return out
        at = 0
        for m in self.cut.finditer(text):
            self._plain(text[at : m.start()], out)
            out.append((self.special[m[0]],))
            at = m.end()
        self._plain(text[at:], out)
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_parts(text)))

    def decode(self, ids: list[int]) -> str:
        """Text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        table = self.bytes_of
        return b"".join([table.get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(content: str) -> ByteBPE:
    return ByteBPE(content)


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary's text, of about 2 MB however large the corpus is, once on each executor."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add the array column ``ids``; a column of that name is replaced."""
    content, kept = _vocabulary(df.sparkSession, vocabulary_path), df.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(content.value)
        for batch in batches:
            for part in pieces(iter([batch]), text, SLICE_BYTES):
                rows = [bpe.encode(t or "") for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(pa.int32()))], names=[*part.schema.names, ids])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, vocabulary_path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Add the string column ``text``, the text of the ids in ``ids``; null ids give an empty text."""
    content, kept = _vocabulary(df.sparkSession, vocabulary_path), df.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(content.value)
        for batch in batches:
            rows = [bpe.decode([i for i in x or [] if i is not None]) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.string())], names=[*batch.schema.names, text])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())]))


def round_trip_digests(df: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text; keep the count of its tokens and the digests of its ids and of the decoded text."""
    content = _vocabulary(df.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(content.value)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        numeral = {i: str(i) for i in bpe.bytes_of}
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for value in batch.column(1):
                ids = bpe.encode(value.as_py() or "")
                counts.append(len(ids))
                of_ids.append(digest(",".join([numeral[i] for i in ids]).encode()))
                of_text.append(digest(bpe.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
