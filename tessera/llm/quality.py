"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics of a text are counts over its bytes, words and lines, made for a whole
batch at once by numpy.  Each statistic is cut into at most BINS bins; a tree
chooses its splits from sums of gradients and Hessians of the bins.  The trees are
flattened into arrays (statistic, bin, left child, value), and a batch goes down
all of them level by level by array lookups.

Labels are learnt from at most TRAIN_ROWS labelled rows (those with the smallest
hash of their id), so what reaches the driver is bounded; every row is scored.
Statistics don't depend on other rows.

Defined results: a null or empty text has all counts 0 and is scored like any
other; repeated rows get the same score; rows without label, or with a label other
than 0 or 1, aren't learnt from; without any row to learn from, or with one class
only, every score is the (smoothed) share of label 1, 0.5 if nothing is known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import pieces, text_buffer
from tessera.llm.words import SPACE, find_words, hash_words, table

#: Bound on the labelled rows that are learnt from.
TRAIN_ROWS = 12_000
BINS, TREES, LEAVES_DEPTH, RATE, LEAST_ROWS = 64, 120, 4, 0.12, 20
FEATURES = (
    "bytes", "words", "lines", "bytes_per_word", "words_per_line", "words_per_sentence", "long_words", "short_words", "distinct_words",
    "repeated_next", "top_word", "upper", "digits", "punctuation", "symbols", "pipes", "exclamations", "not_ascii", "capital_words",
    "full_lines", "short_lines", "repeated_lines", "white", "stops",
)
_UPPER, _DIGIT = table(bytes(range(65, 91))), table(b"0123456789")
_PUNCT, _SYMBOL = table(b".,;:!?'\"()-"), table(b"#$%&*@^~_=+<>{}[]\\/`")
_HIGH = np.arange(256) >= 128
_LINE = table(b"\n")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The FEATURES of each text of a buffer."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    def per(ptr: np.ndarray, values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return (total[ptr[1:]] - total[ptr[:-1]]).astype(float)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return part / np.maximum(whole, 1)

    start, end, ptr = find_words(data, offsets, SPACE)
    words, length = np.diff(ptr).astype(float), end - start
    hashed = hash_words(data, start, end) & np.uint64((1 << 40) - 1)
    of = np.repeat(np.arange(n), np.diff(ptr))
    same = np.zeros(len(hashed), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1])
    key = np.sort((of.astype(np.uint64) << np.uint64(40)) | hashed)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(key)))
    owner = (key[at] >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(owner, minlength=n).astype(float)
    top = np.zeros(n)
    np.maximum.at(top, owner, run)
    # a line ends at a line feed or with its text
    l_start, l_end, l_ptr = find_words(data, offsets, _LINE)
    lines = np.diff(l_ptr).astype(float)
    l_hash = hash_words(data, l_start, l_end)
    l_of = np.repeat(np.arange(n), np.diff(l_ptr))
    order = np.lexsort((l_hash, l_of))
    again = np.zeros(len(order), bool)
    again[1:] = (l_hash[order][1:] == l_hash[order][:-1]) & (l_of[order][1:] == l_of[order][:-1])
    repeated = np.bincount(l_of[order][again], minlength=n).astype(float) if len(order) else np.zeros(n)
    last = data[l_end - 1] if len(l_end) else np.zeros(0, np.uint8)
    stops = count(data == 46)
    capital = per(ptr, _UPPER[data[start]]) if len(start) else np.zeros(n)
    out = np.column_stack((
        np.log1p(size), np.log1p(words), np.log1p(lines), share(size, words), share(words, lines), share(words, stops), share(per(ptr, length > 12), words), share(per(ptr, length < 3), words),
        share(distinct, words), share(per(ptr, same), words), share(top, words), share(count(_UPPER[data]), size), share(count(_DIGIT[data]), size), share(count(_PUNCT[data]), size), share(count(_SYMBOL[data]), size),
        share(count(data == 124), words), share(count(data == 33), words), share(count(_HIGH[data]), size), share(capital, words), share(per(l_ptr, (last == 46) | (last == 63)), lines),
        share(per(l_ptr, l_end - l_start < 30), lines), share(repeated, lines), share(count(SPACE[data]), size), share(stops, words),
    ))
    return np.where(np.isfinite(out), out, 0.0)


@dataclass
class Forest:
    """Trees in flat arrays; a leaf is its own child."""

    edges: list[np.ndarray]
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    prior: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]).astype(np.int32)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        if len(self.roots) and len(x):
            b, rows = self.binned(x), np.arange(len(x))[:, None]
            node = np.tile(self.roots, (len(x), 1))
            for _ in range(self.depth):
                node = np.where(b[rows, self.feature[node]] <= self.bin[node], self.left[node], self.right[node])
            total = total + self.value[node].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = LEAVES_DEPTH, rate: float = RATE) -> Forest:
    """Boosted trees for the logistic loss, grown level by level from histograms."""
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
    empty = Forest([np.zeros(0)] * len(FEATURES), *(np.zeros(0, int) for _ in range(4)), np.zeros(0), np.zeros(0, int), depth, prior)
    if not len(y) or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    forest = Forest(edges, *(np.zeros(0, int) for _ in range(4)), np.zeros(0), np.zeros(0, int), depth, prior)
    b, m = forest.binned(x), x.shape[1]
    flat = b + np.arange(m) * BINS
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a in (feature, cut, value):
            a.append(0)
        left.append(len(left))
        right.append(len(right))
        return len(feature) - 1

    total = np.full(len(y), prior)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        root = node()
        roots.append(root)
        level = [(root, np.arange(len(y)))]
        for d in range(depth + 1):
            deeper = []
            for at, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[at] = -rate * gs / (hs + 1.0)
                split = None
                if d < depth and len(rows) >= 2 * LEAST_ROWS:
                    index = flat[rows].ravel()
                    gb, hb, nb = (np.bincount(index, np.repeat(w, m), minlength=m * BINS).reshape(m, BINS).cumsum(1)[:, :-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                    gain = gb**2 / (hb + 1) + (gs - gb) ** 2 / (hs - hb + 1) - gs**2 / (hs + 1)
                    gain[(nb < LEAST_ROWS) | (len(rows) - nb < LEAST_ROWS)] = -1
                    j, k = np.unravel_index(int(gain.argmax()), gain.shape)
                    split = (j, k) if gain[j, k] > 1e-3 else None
                if split is None:
                    total[rows] += value[at]
                    continue
                feature[at], cut[at] = split
                goes = b[rows, split[0]] <= split[1]
                left[at], right[at] = node(), node()
                deeper += [(left[at], rows[goes]), (right[at], rows[~goes])]
            level = deeper
    forest.feature, forest.bin, forest.left, forest.right = (np.array(a) for a in (feature, cut, left, right))
    forest.value, forest.roots = np.array(value, float), np.array(roots)
    return forest


def training_features(docs: DataFrame, labels: DataFrame, label: str, most: int, features: Callable[[pa.Array], pa.Array], kind: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(label, x) of at most ``most`` labelled documents outside the held-out fold: those with the smallest hash of their id, then of their text.

    ``features`` turns texts into the column x in the tasks that read them, so texts don't travel.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(most)  # at most ``most`` rows of 12 bytes
    rows = docs.select(F.col(key).alias("train_id"), F.col(text).alias("text")).join(F.broadcast(chosen.withColumnRenamed(key, "train_id")), "train_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], features(batch.column(0))], names=["h1", "h2", "label", "x"])

    made = rows.select("text", F.xxhash64("train_id").alias("h1"), F.xxhash64("text").alias("h2"), "label").mapInArrow(run, f"h1 long, h2 long, label int, x {kind}")
    return made.orderBy("h1", "h2").limit(most).select("label", "x")


def held_out(key: str = "doc_id"):
    """The fold that is never learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> Forest:
    def features(column: pa.Array) -> pa.Array:
        x = statistics(*text_buffer(column))
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))

    rows = training_features(docs, labels, label, most, features, "array<double>").collect()
    return fit(np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, forest: Forest, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(forest)  # some thousand nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            s = model.value.score(statistics(*text_buffer(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    return docs.select(key, text, held_out(key).alias("held_out")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))
