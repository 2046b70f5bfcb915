"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms: lower-cased words without punctuation, and
the first STEM bytes of longer words, which languages that join words need.  They
are hashed to 2**BITS places.  Its score is the logistic of

    w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)

over its terms i, so that pairs of terms (an insult and the mention of a group)
weigh together more than they do alone.  Each document's sums are taken for a
whole batch at once.

Weights are learnt by AdaGrad from at most TRAIN_ROWS labelled rows (those with
the smallest hash of their id), whole texts.  Every place that occurs there has a
weight and factors while the machine is fitted, as a term that tells nothing alone may
tell much beside another; a penalty keeps those at 0 whose documents' errors don't
outweigh it.  Places that don't occur there weigh nothing.  Every row is scored.

Defined results: a null or empty text scores the logistic of w0; repeated rows get
the same score; labels other than 0 and 1 aren't learnt from; without rows to
learn from, or with one class only, every score is the smoothed share of label 1,
0.5 if nothing is known.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import free_name, pieces, text_buffer
from tessera.llm.quality import held_out, training_features
from tessera.llm.words import LOOSE, LOWER, find_words, gather, hash_words

TRAIN_ROWS = 12_000
BITS, FACTORS, STEM = 22, 4, 6
EPOCHS, FREE_EPOCHS, BATCH, RATE, FACTOR_RATE, SPREAD = 20, 20, 64, 0.2, 0.1, 0.05
#: Errors, summed over a term's documents, that its weight and its factors must outweigh to leave 0; the part of these penalties that later epochs keep.
LASSO, FACTOR_LASSO, LATER = 4.0, 20.0, 0.25


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct terms of each text, and n + 1 pointers into them."""
    start, end, ptr = find_words(data, offsets, LOOSE)
    low = LOWER[data]
    place = hash_words(low, start, end) >> np.uint64(64 - BITS)
    of = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(ptr))
    long = np.flatnonzero(end - start > STEM)
    stem = (hash_words(low, start[long], start[long] + STEM) ^ np.uint64(1 << 63)) >> np.uint64(64 - BITS)
    key = np.sort(np.concatenate(((of << np.uint64(BITS)) | place, (of[long] << np.uint64(BITS)) | stem)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), np.searchsorted(key >> np.uint64(BITS), np.arange(len(offsets), dtype=np.uint64))


@dataclass
class Machine:
    """Weights of the places that were learnt, in order; all other places weigh nothing."""

    w0: float
    places: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def raw(self, place: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        if not len(self.places):
            return np.full(len(ptr) - 1, self.w0)
        at = np.minimum(np.searchsorted(self.places, place), len(self.places) - 1)
        known = self.places[at] == place
        ptr, at = np.concatenate(([0], np.cumsum(known)))[ptr], at[known]
        v = self.v[at]
        total = np.cumsum(np.column_stack((self.w[at], (v**2).sum(1), v)), 0)
        sums = np.diff(np.concatenate((np.zeros((1, total.shape[1])), total))[ptr], axis=0)
        return self.w0 + sums[:, 0] + 0.5 * ((sums[:, 2:] ** 2).sum(1) - sums[:, 1])

    def score(self, place: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(place, ptr), -30, 30)))


@dataclass
class _Batch:
    """Entries of some documents: distinct places, which of them each entry is, its document, and how often each place occurs; a byte holds the last two."""

    at: np.ndarray
    back: np.ndarray
    times: np.ndarray
    of: np.ndarray
    y: np.ndarray


def _numbered(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct places, which of them each entry is, and how often each occurs; by a count of all places, as sorting the entries takes five times their bytes."""
    seen = np.zeros(1 << BITS, np.int32)
    for d in documents:
        seen[d] += 1
    places = np.flatnonzero(seen)
    number = np.zeros(1 << BITS, np.int32)
    number[places] = np.arange(len(places), dtype=np.int32)
    flat = np.empty(sum(map(len, documents)), np.int32)
    at = 0
    for d in documents:
        flat[at : at + len(d)] = number[d]
        at += len(d)
    return places, flat, seen[places].astype(np.int64)


def _batches(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, y: np.ndarray, order: np.ndarray) -> list[_Batch]:
    """Batches of BATCH documents; all are views of four arrays, which go back to the system as a whole."""
    kinds = (np.int32, np.uint8, np.int32 if int(size.max(initial=0)) * BATCH >= 1 << 16 else np.uint16, np.uint8)
    ats, timess, backs, ofs = (np.empty(len(flat), kind) for kind in kinds)
    out, place, entry = [], 0, 0
    for start in range(0, len(order), BATCH):
        own = order[start : start + BATCH]
        at, back, times = np.unique(gather(flat, begin[own], size[own]), return_inverse=True, return_counts=True)
        distinct, entries = slice(place, place := place + len(at)), slice(entry, entry := entry + len(back))
        ats[distinct], timess[distinct], backs[entries], ofs[entries] = at, times, back, np.repeat(np.arange(len(own)), size[own])
        out.append(_Batch(ats[distinct], backs[entries], timess[distinct], ofs[entries], y[own]))
    return out


def fit(documents: list[np.ndarray], y: np.ndarray, seed: int = 0) -> Machine:
    """Weights from documents (distinct places each) and their labels.

    Penalised epochs come first: a weight, or a term's factors together, leave 0 only if the errors of the term's documents outweigh the penalty, of which each
    document carries its part.  Terms that left 0 are then fitted on under a share LATER of the penalty.
    """
    positive = y.sum() if len(y) else 0
    w0 = float(np.log((positive + 0.5) / (len(y) - positive + 0.5)))
    if not len(y) or y.min() == y.max():
        return Machine(w0, np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    size = np.array([len(d) for d in documents])
    places, flat, seen = _numbered(documents)
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(y))
    w, v = np.zeros(len(places)), draw.normal(0, SPREAD, (len(places), FACTORS))
    for epochs, weight, factor_weight in ((EPOCHS, LASSO, FACTOR_LASSO), (FREE_EPOCHS, LATER * LASSO, LATER * FACTOR_LASSO)):
        batches = b = None  # those of the epochs before go first
        if weight < LASSO:
            alive = (w != 0) | (v != 0).any(1)
            kept = alive[flat]
            ends = np.concatenate(([0], np.cumsum(kept)))
            size = np.diff(ends[np.concatenate(([0], np.cumsum(size)))])
            places, flat, seen, w, v = places[alive], (np.cumsum(alive, dtype=np.int32) - 1)[flat[kept]], seen[alive], w[alive], v[alive]
        batches = _batches(flat, np.cumsum(size) - size, size, y, order)
        w_squares, v_squares, w0_squares = np.full(len(places), 1e-3), np.full(len(places), 1e-3), 1e-3
        for _ in range(epochs):
            for k in draw.permutation(len(batches)):
                b = batches[k]
                n, (wi, vi) = len(b.y), (w[b.at], v[b.at])
                factors = vi[b.back]
                sums = np.column_stack([np.bincount(b.of, c, minlength=n) for c in (wi[b.back], *factors.T, (vi**2).sum(1)[b.back])])
                raw = w0 + sums[:, 0] + 0.5 * ((sums[:, 1:-1] ** 2).sum(1) - sums[:, -1])
                error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - b.y
                w0_squares += error.mean() ** 2
                w0 -= RATE * error.mean() / np.sqrt(w0_squares)
                share, own = b.times / (seen[b.at] * n), error[b.of]  # share: of a term's penalty
                slope = np.bincount(b.back, own, minlength=len(b.at)) / n
                w_squares[b.at] += slope**2
                step = RATE / np.sqrt(w_squares[b.at])
                moved = wi - step * slope
                w[b.at] = np.sign(moved) * np.maximum(np.abs(moved) - step * share * weight, 0)
                pull = own[:, None] * (sums[b.of, 1:-1] - factors)
                slopes = np.column_stack([np.bincount(b.back, c, minlength=len(b.at)) for c in pull.T]) / n
                v_squares[b.at] += (slopes**2).sum(1)
                step = FACTOR_RATE / np.sqrt(v_squares[b.at])
                moved = vi - step[:, None] * slopes
                norm = np.sqrt((moved**2).sum(1))
                v[b.at] = moved * (np.maximum(norm - step * share * factor_weight, 0) / np.maximum(norm, 1e-300))[:, None]
    return Machine(w0, places.astype(np.int64), w.astype(np.float32), v.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_ROWS) -> Machine:
    def features(column: pa.Array) -> pa.Array:
        place, ptr = terms(*text_buffer(column))
        return pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(place, pa.int32()))

    rows = training_features(docs, labels, label, most, features, "array<int>").toArrow()
    return fit([np.asarray(x.values) for x in rows.column("x")], np.asarray(rows.column("label"), dtype=float))


def scored(docs: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``score`` (replaced, if there is one)."""
    model, kept = docs.sparkSession.sparkContext.broadcast(machine), docs.drop(name)  # at most 2**BITS places, and the terms of TRAIN_ROWS texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            s = model.value.score(*terms(*text_buffer(batch.column(batch.schema.get_field_index(text)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, name])

    from pyspark.sql import types as T

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, machine: Machine, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    out = scored(docs.select(key, text), machine, text)
    return out.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, machine: Machine, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with their own columns."""
    name = free_name(docs, "__toxicity")
    return scored(docs, machine, text, name).filter(F.col(name) < threshold).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))
