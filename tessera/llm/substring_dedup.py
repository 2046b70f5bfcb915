"""Removal of repeated word windows by super-k-mer partitioning.

A window is WINDOW consecutive words of one document.  Its minimiser is the
smallest hash of the MINIMISER-word sequences in it; consecutive windows that
share it (a super-k-mer) travel as one packed string to the minimiser's bucket.
There the windows are sorted, counted exactly (equal hashes are confirmed on the
words), and all but the earliest start of each are marked.  Marks go back to their
documents as runs, and words under a marked window are removed.

Hot minimisers (a passage, or copies, in a third of all rows) are found first, by
counts over all documents.  Their super-k-mers are dealt over several buckets by
document, and each bucket's earliest windows of that kind meet once more, one row
for each bucket, under the digest of their words.  Super-k-mers that repeat inside
one task are settled there and don't travel.

Defined results: a null or empty text has no words; a text shorter than a window
loses nothing; windows are judged on the input, not on what is left; rows with a
null id take no part and stay whole; of rows that share an id, windows at the same
place of both aren't earlier than each other; extra columns stay.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import free_name, materialise, pieces, text_buffer
from tessera.llm.words import SPACE, find_words, gather, hash_windows, hash_words, windows

WINDOW, MINIMISER = 20, 4
#: Packed text in a bucket, about, and in what a task collects before it sends.
BUCKET_BYTES, SEND_BYTES = 10 << 20, 8 << 20
#: Pairs of windows whose bytes are compared at once.
SAME_ROWS = 4096
#: At most so many hot minimisers are told to the tasks (16 bytes each).
MOST_HOT = 1 << 20
_MARKS = "doc_id long, print long, start int, n int, digest binary"


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with their words joined by one space (and one after the last)."""
    inside = ~SPACE[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    if len(data):
        edges = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
        keep[edges] = inside[edges]
    some = np.diff(offsets) > 0  # texts with bytes; the sums of the others are empty
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.add.reduceat(keep, offsets[:-1][some], dtype=np.int64))))
    return np.where(inside, data, np.uint8(32))[keep], total[np.concatenate(([0], np.cumsum(some)))]


def super_kmers(hashed: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of windows, minimiser) of each super-k-mer; first word counts over the buffer."""
    none = np.zeros(0, np.int64)
    first, text = windows(ptr, WINDOW)
    if not len(first):
        return none, none, none, np.zeros(0, np.uint64)
    low = hash_windows(hashed, np.arange(len(hashed) - MINIMISER + 1), MINIMISER)
    width, reach = 1, WINDOW - MINIMISER + 1
    while 2 * width <= reach:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < reach:
        low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
    least = low[first]
    new = np.ones(len(first), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], first[at], np.diff(np.append(at, len(first))), least[at]


def hot_minimisers(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimisers with more than an eighth of a bucket's share of all super-k-mers, in order, and for each the number of parts that it is dealt into.

    Each task names those that are frequent in its own rows; a frequent one overall is frequent in some task, and what the others
    leave out of its count is less than the threshold.
    """
    share = min(8 * buckets, MOST_HOT // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, offsets = text_buffer(batch.column(0))
            start, end, ptr = find_words(data, offsets)
            low, n = np.unique(super_kmers(hash_words(data, start, end), ptr)[3], return_counts=True)
            often = (n >= max(2, n.sum() / share)) if len(n) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(low[often], 0).view(np.int64)), pa.array(np.append(n[often], 0)), pa.array([0] * int(often.sum()) + [int(n.sum())], pa.int64())], names=["low", "n", "of"])

    counts = docs.select("text").mapInArrow(run, "low long, n long, of long").groupBy("low").agg(F.sum("n").alias("n"), F.sum("of").alias("of"))
    counts = materialise(counts, "minimisers")
    total = counts.agg(F.sum("of")).first()[0] or 0
    rows = counts.filter((F.col("n") > total / share) & (F.col("n") > 1)).collect()  # at most ``share`` of them
    rows = sorted((np.uint64(r["low"] % (1 << 64)), r["n"]) for r in rows)
    return np.array([r[0] for r in rows], np.uint64), np.array([-(-r[1] * share // max(total, 1)) for r in rows], np.int64)


def _pack(doc: np.ndarray, prints: np.ndarray, start: np.ndarray, count: np.ndarray, hot: np.ndarray, texts: list[bytes]) -> bytes:
    """Super-k-mers of one bucket as one string."""
    body = b"".join((doc.astype(np.int64).tobytes(), prints.astype(np.int64).tobytes(), start.astype(np.int32).tobytes(), count.astype(np.int32).tobytes(), hot.astype(np.uint8).tobytes(), np.array([len(t) for t in texts], np.int32).tobytes(), *texts))
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<q", len(texts)) + body)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<q", raw)[0]
    at, out = 8, []
    for kind in (np.int64, np.int64, np.int32, np.int32, np.uint8, np.int32):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return *out, np.frombuffer(raw, np.uint8, -1, at)


def _send(docs: DataFrame, buckets: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (bucket, blob); with bucket -1 the marks that a task could already set."""
    known = docs.sparkSession.sparkContext.broadcast(hot)  # at most MOST_HOT entries

    def flush(held: list[tuple], parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        bucket, doc, prints, start, count, is_hot, content, text = (np.concatenate(x) for x in zip(*held))
        # equal super-k-mers of this task: the earliest travels, the others' windows are all marked
        order = np.lexsort((start, doc, content))
        head = np.ones(len(order), bool)
        head[1:] = content[order][1:] != content[order][:-1]
        first = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
        later = np.flatnonzero(~head & ((doc[order] != doc[first]) | (start[order] != start[first])))
        same = np.array([parts[text[order[i]]] == parts[text[first[i]]] for i in later], bool)
        marked = order[later[same]] if len(later) else later
        travels = np.ones(len(order), bool)
        travels[marked] = False
        rows = np.flatnonzero(travels)
        rows = rows[np.argsort(bucket[rows], kind="stable")]
        cut = np.append(np.flatnonzero(np.diff(bucket[rows], prepend=-1)), len(rows))
        none = np.zeros(len(marked), np.uint8)
        ids, blobs = [], []
        if len(marked):
            ids.append(-1)
            blobs.append(_pack(doc[marked], prints[marked], start[marked], count[marked], none, [b""] * len(marked)))
        for a, b in zip(cut[:-1], cut[1:]):
            own = rows[a:b]
            ids.append(int(bucket[own[0]]))
            blobs.append(_pack(doc[own], prints[own], start[own], count[own], is_hot[own], [parts[i] for i in text[own]]))
        for i in range(0, len(ids), 64):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 64], pa.int32()), pa.array(blobs[i : i + 64], pa.binary())], names=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, size = [], [], 0
        low_hot, dealt = known.value
        for batch in pieces(batches, "text"):
            data, offsets = normalised(*text_buffer(batch.column(2)))
            start, end, ptr = find_words(data, offsets)
            hashed = hash_words(data, start, end)
            text, first, count, low = super_kmers(hashed, ptr)
            if not len(text):
                continue
            ids, prints = np.asarray(batch.column(0))[text], np.asarray(batch.column(1))[text]
            at = np.minimum(np.searchsorted(low_hot, low), max(len(low_hot) - 1, 0))
            is_hot = (low_hot[at] == low) if len(low_hot) else np.zeros(len(low), bool)
            salt = np.zeros(len(low), np.uint64)
            if is_hot.any():
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                salt[is_hot] = mixed[is_hot] % dealt[at[is_hot]].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
            bucket = (((low ^ salt) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)) % np.uint64(buckets)
            raw = data.tobytes()
            words = count + WINDOW - 1
            a, b = start[first], end[first + words - 1]
            held.append((bucket.astype(np.int64), ids, prints, first - ptr[text], count, is_hot, hash_windows(hashed, first, words), np.arange(len(text)) + len(parts)))
            parts += [raw[i:j] for i, j in zip(a.tolist(), b.tolist())]
            size += int((b - a).sum())
            if size >= SEND_BYTES:
                yield from flush(held, parts)
                held, parts, size = [], [], 0
        if held:
            yield from flush(held, parts)

    return docs.select("doc_id", "print", "text").mapInArrow(run, "bucket int, blob binary")


def _settle(table: pa.Table) -> pa.Table:
    """Marks of one bucket, as runs; and, with a digest, its earliest windows of hot minimisers."""
    if len(table) and table.column("bucket")[0].as_py() < 0:
        got = [_unpack(b.as_py())[:4] for b in table.column("blob")]
        doc, prints, start, count = (np.concatenate(x) for x in zip(*got))
        return _marks(doc, prints, start, count, [None] * len(doc))
    got, hashes, lengths, begins, ends, base = [], [], [], [], [], 0
    for blob in table.column("blob"):
        *own, size, data = _unpack(blob.as_py())
        offsets = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        start, end, ptr = find_words(data, offsets)
        first, _ = windows(ptr, WINDOW)
        hashes.append(hash_windows(hash_words(data, start, end), first, WINDOW))
        begins.append((start[first] + base).astype(np.int64))
        ends.append((end[first + WINDOW - 1] + base).astype(np.int64))
        lengths.append(data)
        got.append(own)
        base += len(data)
    data = np.concatenate(lengths)
    doc, prints, start, count, hot = (np.concatenate(x) for x in zip(*got))
    count = count.astype(np.int64)
    place = np.cumsum(count) - count
    order = np.lexsort((start, doc))  # then windows lie in the order of document and start
    spread = lambda x: np.repeat(x[order], count[order])
    moved = gather(np.arange(int(count.sum())), place[order], count[order])
    hashed, begin, end = (np.concatenate(x)[moved] for x in (hashes, begins, ends))
    w_doc, w_print, w_hot = spread(doc), spread(prints), spread(hot)
    w_start = gather(np.arange(int(count.sum())), place[order], count[order]) - spread(place) + spread(start)
    by = np.argsort(hashed, kind="stable")
    head = np.ones(len(by), bool)
    head[1:] = hashed[by][1:] != hashed[by][:-1]
    first = np.empty(len(by), np.int64)
    first[by] = by[np.flatnonzero(head)[np.cumsum(head) - 1]]
    repeat = np.flatnonzero(first != np.arange(len(by)))
    wrong = repeat[~_same_words(data, begin, end, repeat, first[repeat])]
    if len(wrong):  # hashes collide: words decide
        for h in np.unique(hashed[wrong]):
            seen: dict[bytes, int] = {}
            for i in np.sort(by[hashed[by] == h]).tolist():
                first[i] = seen.setdefault(data[begin[i] : end[i]].tobytes(), i)
    marked = np.flatnonzero((w_doc != w_doc[first]) | (w_start != w_start[first]))
    new = np.ones(len(marked), bool)
    new[1:] = (np.diff(marked) != 1) | (np.diff(w_start[marked]) != 1) | (w_doc[marked][1:] != w_doc[marked][:-1]) | (w_print[marked][1:] != w_print[marked][:-1])
    at = np.flatnonzero(new)
    run = marked[at]
    again = np.flatnonzero((w_hot > 0) & (first == np.arange(len(first))))
    digests = [hashlib.blake2b(data[a:b].tobytes(), digest_size=16).digest() for a, b in zip(begin[again].tolist(), end[again].tolist())]
    return pa.concat_tables((
        _marks(w_doc[run], w_print[run], w_start[run], np.diff(np.append(at, len(marked))), [None] * len(run)),
        _marks(w_doc[again], w_print[again], w_start[again], np.ones(len(again)), digests),
    ))


def _marks(doc: np.ndarray, prints: np.ndarray, start: np.ndarray, n: np.ndarray, digest: list[bytes | None]) -> pa.Table:
    return pa.table({"doc_id": pa.array(doc, pa.int64()), "print": pa.array(prints, pa.int64()), "start": pa.array(start.astype(np.int32)), "n": pa.array(n.astype(np.int32)), "digest": pa.array(digest, pa.binary())})


def _same_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    size = end - begin
    same = size[left] == size[right]
    for at in range(0, len(left), SAME_ROWS):
        own = np.flatnonzero(same[at : at + SAME_ROWS]) + at
        if len(own):
            n = size[left[own]]
            differ = gather(data, begin[left[own]], n) != gather(data, begin[right[own]], n)
            same[own] = np.add.reduceat(differ, np.cumsum(n) - n, dtype=np.int64) == 0
    return same


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print, runs): for each document that loses words, the runs (start, n) of its marked windows."""
    spark = docs.sparkSession
    own = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * size // BUCKET_BYTES + 1)
    sent = _send(own, buckets, hot_minimisers(own, buckets))
    # what was settled in its task goes by its own number, so no group holds all of it
    sent = sent.withColumn("group", F.when(F.col("bucket") >= 0, F.col("bucket").cast("long")).otherwise(-1 - F.pmod(F.xxhash64("blob"), F.lit(buckets).cast("long"))))
    marks = materialise(sent.groupBy("group").applyInArrow(lambda t: _settle(t), _MARKS), "marks")
    again = marks.filter(F.col("digest").isNotNull())
    earliest = F.min(F.struct("doc_id", "start")).over(W.partitionBy("digest"))
    later = again.withColumn("earliest", earliest).filter(F.struct("doc_id", "start") > F.col("earliest"))
    every = marks.filter(F.col("digest").isNull()).unionByName(later.drop("earliest"))
    return every.groupBy("doc_id", "print").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def kept_words(text: str | None, runs: list[dict] | None) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = (text or "").encode().split()
    if not runs:
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        edge[r["start"]] += 1
        edge[min(r["start"] + r["n"] + WINDOW - 1, len(words))] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()], len(words)


def _with_runs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with a last column of runs."""
    own, prints, runs = (free_name(docs, n) for n in ("__id", "__print", "__runs"))
    found = removals(docs, key, text).select(F.col("doc_id").alias(own), F.col("print").alias(prints), F.col("runs").alias(runs))
    return docs.join(found, (docs[key].cast("long") == F.col(own)) & (F.xxhash64(docs[text]) == F.col(prints)), "left").drop(own, prints)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            n, gone, sha = [], [], []
            for value, runs in zip(batch.column(1), batch.column(2)):
                kept, words = kept_words(value.as_py(), runs.as_py())
                n.append(words)
                gone.append(words - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=[key, "n_words", "n_removed", "kept_sha256"])

    own = docs.select(key, text)
    return _with_runs(own, key, text).mapInArrow(run, f"`{key}` {own.schema[key].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated windows removed: a text that loses words is its kept words joined by one space; one that loses all goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            t = batch.schema.get_field_index(text)
            out, stays = [], []
            for value, runs in zip(batch.column(t).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if not runs:
                    out.append(value)
                    stays.append(True)
                    continue
                kept, _ = kept_words(value, runs)
                out.append(b" ".join(kept).decode())
                stays.append(bool(kept))
            columns = [pa.array(out, c.type) if i == t else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(pa.array(stays, pa.bool_()))

    return _with_runs(docs, key, text).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
