"""Jaccard join of documents over word shingles, and its components, by a blocked sparse product.

A document is the set of its distinct shingles (WORDS consecutive words; a shorter
text is one shingle), each a 64-bit hash.  Documents with equal sets (128 bits) are
one class, and only classes are compared.  The product of the incidence matrix
(classes by shingles) with its transpose is taken in blocks, and only where it can
reach the size bounds.  With t the least similarity, two sets x and y that link
share at least t * max(|x|, |y|) shingles, so

1. among the first p shingles of each in one global order (by hash) they share at
   least c * t * |x|, with p = (1 - t + c) * |x|.  A block counts, for each of its
   shingles, the classes that have it, and adds up for each class the entries that
   another class shares.  A class below its bound is dropped: it links with none;
2. for the classes that are left the same is done over whole sets with the bound
   t * |x|; a class keeps its n' shared shingles in the order of their frequency,
   and pairs need only meet in the rarest n' - t * |x| + 1 of them;
3. the product itself: for pairs that meet and whose sizes and places don't rule
   them out, a cell (group of rows, range of shingles) counts the shingles that both
   have in its range, and drops the pair if the sum over all ranges can't reach
   t / (1 + t) * (|x| + |y|) any more.  The cells' partial counts are added up by
   pair, and the sum decides.

Step 3 is taken twice.  First each class meets the most central class (whose
shingles are most shared) of each of its rare columns, which settles groups of
copies without their pairs.  Then only pairs of one column are taken that are still
in different components, one of them outside the column's main component, and whose
sizes allow a link (they meet by size band, so columns in which nobody can link
cost nothing).

Shingles in a large share of all documents are found beforehand; they are counted
without being sent to their block.  Columns with many classes, and classes with many
copies, are sent to the rows instead of being gathered: fewer than MOST_SENT of them
exist, as each has a larger part of all rows.

Defined results: a null or empty text, or one without words, has the empty set and
links with nothing; rows with a null id get their set's size, no component, and
link with nothing; rows that share an id are one document for links, each with its
own set; repeated rows are copies; ids must be integers or cast to them; extra
columns are ignored or kept as stated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import free_name, materialise, often_and_seldom, pieces, text_buffer
from tessera.llm.components import connected_components
from tessera.llm.words import LOWER, SPACE, find_words, hash_windows, hash_words, mix, windows

WORDS = 5
#: Least similarity in percent, and c of the first step in percent.
PERCENT, EXTRA = 80, 10
#: Entries of a block, about; entries that a task collects before it sends; most hot shingles (16 bytes each).
BLOCK_ENTRIES, SEND_ENTRIES, MOST_HOT = 1 << 20, 1 << 19, 1 << 20
#: Ranges of shingles in the product, width of a band of sizes, and groups over which one set's pairs of the second product are dealt.
RANGES, BAND, SPREAD = 4, 1.05, 64


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, and n + 1 pointers."""
    data, offsets = text_buffer(column)
    data = LOWER[data]
    start, end, ptr = find_words(data, offsets, SPACE)
    hashed = hash_words(data, start, end)
    first, text = windows(ptr, WORDS)
    shingles = hash_windows(hashed, first, WORDS)
    words = np.diff(ptr)
    few = np.flatnonzero((words > 0) & (words < WORDS))
    if len(few):
        shingles, text = np.append(shingles, hash_windows(hashed, ptr[few], words[few])), np.append(text, few)
    order = np.lexsort((shingles, text))
    shingles, text = shingles[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (text[1:] != text[:-1])
    shingles, text = shingles[new], text[new]
    return shingles, np.searchsorted(text, np.arange(len(column) + 1))


def set_hashes(shingles: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    return hash_windows(shingles, ptr[:-1], np.diff(ptr)).view(np.int64), (total[ptr[1:]] - total[ptr[:-1]]).view(np.int64)


def bound(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n shares with every partner, at least."""
    return -(-PERCENT * n // 100)


def first_part(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of a set's first part, and how many of it every partner shares at least."""
    extra = EXTRA * n // 100 + 1
    return np.minimum(n - bound(n) + extra, n), EXTRA * bound(n) // 100 + 1


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join((sizes.tobytes(), *(a.tobytes() for a in arrays))))


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds), 8)
    at = 8 + 8 * len(kinds) + np.concatenate(([0], np.cumsum(sizes)))
    return [np.frombuffer(raw, k, int(s) // np.dtype(k).itemsize, int(a)) for k, s, a in zip(kinds, sizes, at)]


def _blocks(shingle: np.ndarray, owner: np.ndarray, ids: np.ndarray, sizes: np.ndarray, blocks: int) -> Iterator[tuple[int, bytes]]:
    """Entries (shingle, owner's place in ids) as one string for each block."""
    block = (shingle % np.uint64(blocks)).astype(np.int64)
    order = np.lexsort((shingle, block))
    cut = np.searchsorted(block[order], np.arange(blocks + 1))
    for b in np.flatnonzero(np.diff(cut)):
        own = order[cut[b] : cut[b + 1]]
        used, back = np.unique(owner[own], return_inverse=True)
        yield int(b), _pack(np.diff(shingle[own], prepend=np.uint64(0)), back.astype(np.int32), ids[used], sizes[used])


def _read_block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries of a block, by shingle: (shingle, index of its class, ids of classes, their sizes)."""
    got = [_unpack(b.as_py(), np.uint64, np.int32, np.int64, np.int64) for b in table.column("blob")]
    shingle = np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got])
    every = np.concatenate([g[2] for g in got])
    base = np.cumsum([0, *(len(g[2]) for g in got)])
    ids, first, back = np.unique(every, return_index=True, return_inverse=True)
    sizes = np.concatenate([g[3] for g in got])[first]
    owner = back[np.concatenate([g[1] + b for g, b in zip(got, base)])]
    order = np.lexsort((owner, shingle))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    return shingle[new], owner[new], ids, sizes


def _columns(shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and number of entries of each shingle's column."""
    new = np.ones(len(shingle), bool)
    new[1:] = shingle[1:] != shingle[:-1]
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(shingle)))


class Sender:
    """Collects entries of a task and sends them block by block; a class that a task met before isn't sent again."""

    def __init__(self, blocks: int, hot: tuple[np.ndarray, np.ndarray]):
        self.blocks, self.hot, self.counts, self.seen = blocks, *hot, set()
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def new_rows(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        rows = [i for i, (c, k) in enumerate(zip(ids.tolist(), n.tolist())) if k and not (c in self.seen or self.seen.add(c))]
        return np.array(rows, np.int64)

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if self.held:
            base = np.cumsum([0, *(len(h[2]) for h in self.held)])
            shingle, ids, sizes = (np.concatenate([h[k] for h in self.held]) for k in (0, 2, 3))
            owner = np.concatenate([h[1] + b for h, b in zip(self.held, base)])
            yield from _blocks(shingle, owner, ids, sizes, self.blocks)
        self.held, self.size = [], 0

    def add(self, shingle: np.ndarray, owner: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, bytes]]:
        self.held.append((shingle, owner, ids, sizes))
        self.size += len(shingle)
        if self.size >= SEND_ENTRIES:
            yield from self.flush()

    def is_hot(self, shingle: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(shingle), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, shingle), len(self.hot) - 1)] == shingle


def _taken(shingles: np.ndarray, ptr: np.ndarray, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``length`` shingles of ``rows``, and for each the row's place in ``rows``."""
    owner = np.repeat(np.arange(len(rows)), length)
    before = np.cumsum(length) - length
    return shingles[np.arange(len(owner)) - before[owner] + ptr[rows][owner]], owner


def describe(docs: DataFrame, blocks: int) -> DataFrame:
    """For every row its set's size and hash; and, with ``doc_row`` false, the shingles that are frequent in some piece."""
    share = min(8 * blocks, MOST_HOT // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            shingles, ptr = shingle_sets(batch.column(1))
            n = np.diff(ptr)
            a, b = set_hashes(shingles, ptr)
            rows = np.flatnonzero(n)
            rows = rows[np.unique(a[rows], return_index=True)[1]]
            taken, _ = _taken(shingles, ptr, rows, n[rows])
            hot, count = np.unique(taken, return_counts=True)
            often = count >= max(2, len(taken) / share)
            hot, count = hot[often], count[often]
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array([True] * m + [False] * (len(hot) + 1)), pa.concat_arrays([batch.column(0), pa.nulls(len(hot) + 1, pa.int64())]),
                pa.array(np.concatenate((n, count, [len(taken)])), pa.int64()), pa.array(np.concatenate((a, hot.view(np.int64), [0]))), pa.array(np.concatenate((b, np.zeros(len(hot), np.int64), [1]))),
            ], names=["doc_row", "doc_id", "n", "h1", "h2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_row boolean, doc_id long, n long, h1 long, h2 long")


def hot_shingles(described: DataFrame, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles with more than an eighth of a block's share of all entries, in order, with their counts: at most 8 * blocks of them."""
    share = min(8 * blocks, MOST_HOT // 2)
    counts = described.filter("NOT doc_row").groupBy("h2", "h1").agg(F.sum("n").alias("n"))
    total = described.filter("NOT doc_row AND h2 = 1").agg(F.sum("n")).first()[0] or 0
    rows = sorted((r["h1"] % (1 << 64), r["n"]) for r in counts.filter((F.col("h2") == 0) & (F.col("n") > total / share)).collect())
    return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)


def first_survivors(docs: DataFrame, blocks: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Step 1: (class, n) of the classes that share enough of their first part.  A class is named by the hash of its set."""
    known = docs.sparkSession.sparkContext.broadcast(hot)  # at most MOST_HOT entries

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(blocks, known.value)
        out = lambda rows, hot: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([hot] * len(rows))], names=["block", "blob", "hot"])
        for batch in pieces(batches, "text"):
            shingles, ptr = shingle_sets(batch.column(0))
            n, ids = np.diff(ptr), set_hashes(shingles, ptr)[0]
            rows = sender.new_rows(ids, n)
            if not len(rows):
                continue
            taken, owner = _taken(shingles, ptr, rows, first_part(n[rows])[0])
            is_hot = sender.is_hot(taken)
            counted = np.bincount(owner[is_hot], minlength=len(rows))
            some = np.flatnonzero(counted)
            to = ids[rows[some]] % blocks
            parts = [(int(b), some[to == b]) for b in np.unique(to)]
            if parts:
                yield out([(b, _pack(ids[rows[o]], n[rows[o]], counted[o])) for b, o in parts], True)
            for b, blob in sender.add(taken[~is_hot], owner[~is_hot], ids[rows], n[rows]):
                yield out([(b, blob)], False)
        for b, blob in sender.flush():
            yield out([(b, blob)], False)

    def count(table: pa.Table) -> pa.Table:
        hot = [_unpack(b.as_py(), np.int64, np.int64, np.int64) for b in table.filter(table.column("hot")).column("blob")]
        cold = table.filter(pa.compute.invert(table.column("hot")))
        ids, sizes, shared = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(cold):
            shingle, owner, ids, sizes = _read_block(cold)
            _, number = _columns(shingle)
            shared = np.bincount(owner[np.repeat(number > 1, number)], minlength=len(ids))
            some = np.flatnonzero(shared)
            ids, sizes, shared = ids[some], sizes[some], shared[some]
        h_ids, h_sizes, h_shared = (np.concatenate([h[k] for h in hot] + [np.zeros(0, np.int64)]) for k in range(3))
        return pa.table({"class": np.concatenate((ids, h_ids)), "n": np.concatenate((sizes, h_sizes)), "shared": np.concatenate((shared, np.zeros_like(h_shared))), "hot": np.concatenate((np.zeros_like(shared), h_shared))})

    counted = docs.select("text").mapInArrow(send, "block long, blob binary, hot boolean").groupBy("block").applyInArrow(count, "class long, n long, shared long, hot long")
    bounds = EXTRA * F.ceil(PERCENT * F.col("n") / 100) / 100
    # a class may come from several tasks, each with its hot shingles: these count once
    return counted.groupBy("class", "n").agg((F.sum("shared") + F.max("hot")).alias("shared")).filter(F.col("shared") >= F.floor(bounds) + 1).select("class", "n")


def rare_columns(texts: DataFrame, blocks: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Step 2 over (id, h1, h2, text): (id, n, shared, central, shingles, entries), for each class that shares enough.  Of rows that share an id, those count whose set is the class's.

    ``shingles``: the rarest of its shared shingles; ``entries``: all of them in order, as one string for each range.
    """
    known = texts.sparkSession.sparkContext.broadcast(hot)  # at most MOST_HOT entries

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(blocks, known.value)
        out = lambda rows, hot: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([hot] * len(rows))], names=["block", "blob", "hot"])
        for batch in pieces(batches, "text"):
            shingles, ptr = shingle_sets(batch.column(3))
            n, ids = np.diff(ptr), np.asarray(batch.column(0))
            a, b = set_hashes(shingles, ptr)
            rows = sender.new_rows(ids, n * ((a == np.asarray(batch.column(1))) & (b == np.asarray(batch.column(2)))))
            if not len(rows):
                continue
            taken, owner = _taken(shingles, ptr, rows, n[rows])
            is_hot = sender.is_hot(taken)
            if is_hot.any():
                number = sender.counts[np.searchsorted(sender.hot, taken[is_hot])]
                yield out(_by_class(taken[is_hot], number, ids[rows][owner[is_hot]], n[rows][owner[is_hot]]), True)
            for b, blob in sender.add(taken[~is_hot], owner[~is_hot], ids[rows], n[rows]):
                yield out([(b, blob)], False)
        for b, blob in sender.flush():
            yield out([(b, blob)], False)

    def _by_class(shingle: np.ndarray, number: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> list[tuple[int, bytes]]:
        """Shared entries with their frequency, for blocks of classes."""
        to = ids % blocks
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(blocks + 1))
        parts = [(int(b), order[cut[b] : cut[b + 1]]) for b in np.flatnonzero(np.diff(cut))]
        return [(b, _pack(shingle[o], number[o], ids[o], sizes[o])) for b, o in parts]

    def count(table: pa.Table) -> pa.Table:
        direct = table.filter(table.column("hot"))
        cold = table.filter(pa.compute.invert(table.column("hot")))
        rows = list(zip(direct.column("block").to_pylist(), direct.column("blob").to_pylist()))
        if len(cold):
            shingle, owner, ids, sizes = _read_block(cold)
            _, number = _columns(shingle)
            number = np.repeat(number, number)
            good = number > 1
            rows += _by_class(shingle[good], number[good], ids[owner[good]], sizes[owner[good]])
        return pa.table({"to": pa.array([b for b, _ in rows], pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})

    def choose(table: pa.Table) -> pa.Table:
        got = [_unpack(b.as_py(), np.uint64, np.int64, np.int64, np.int64) for b in table.column("blob")]
        shingle, number, ids, sizes = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((shingle, number, ids))
        shingle, number, ids, sizes = shingle[order], number[order], ids[order], sizes[order]
        new = np.ones(len(ids), bool)  # rows that share an id and a set send their hot entries twice
        new[1:] = (ids[1:] != ids[:-1]) | (shingle[1:] != shingle[:-1])
        shingle, number, ids, sizes = shingle[new], number[new], ids[new], sizes[new]
        begin, shared = _columns(ids)
        n = sizes[begin]
        good = np.flatnonzero(shared >= bound(n))
        length = shared[good] - bound(n[good]) + 1
        central = np.add.reduceat(number.astype(np.float64), begin)[good] / n[good] if len(begin) else np.zeros(0)
        rare, _ = _taken(shingle, begin, good, length)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(rare.view(np.int64)))
        edges = np.arange(1, RANGES, dtype=np.uint64) * np.uint64((1 << 64) // RANGES)
        entries = []
        for g in good:
            own = np.sort(shingle[begin[g] : begin[g] + shared[g]])
            entries.append([x.tobytes() for x in np.split(own, np.searchsorted(own, edges))])
        return pa.table({"id": ids[begin][good], "n": n[good], "shared": shared[good], "central": central, "shingles": lists, "entries": pa.array(entries, pa.list_(pa.binary()))})

    sent = texts.select("id", "h1", "h2", "text").mapInArrow(send, "block long, blob binary, hot boolean").groupBy("block").applyInArrow(count, "to long, blob binary")
    return sent.groupBy("to").applyInArrow(choose, "id long, n long, shared long, central double, shingles array<long>, entries array<binary>")


def can_link(left: str, right: str, tail: str = ""):
    """Whether two classes that meet in a column can still reach their sizes' bound, if this is the first shingle that they share.

    To link, x and y share at least t / (1 + t) * (|x| + |y|) shingles.  Both list their shared shingles in the same order, so from the first common one on
    there are at most shared - place left in either.  A pair that links passes in its first common column.
    """
    x, y = (lambda c: F.col(left + c)), (lambda c: F.col(right + c + tail))
    left_over = F.least(x("shared") - x("place"), y("shared") - y("place"))
    return (100 * F.least(x("n"), y("n")) >= PERCENT * F.greatest(x("n"), y("n"))) & ((100 + PERCENT) * left_over >= PERCENT * (x("n") + y("n")))


def partial_counts(table: pa.Table) -> pa.Table:
    """One cell of the product: (u, v, need, both) of its pairs that can still link; ``both`` counts the shingles of this range only.

    Rows with ``v`` are pairs; the others are sets (id u, size n, shared, entries of this range).
    """
    is_pair = pa.compute.is_valid(table.column("v"))
    pairs, sets = table.filter(is_pair), table.filter(pa.compute.invert(is_pair))
    ids, first = np.unique(sets.column("u").to_numpy(), return_index=True)
    blobs = sets.column("data").to_pylist()
    own = [np.frombuffer(blobs[i], np.uint64) for i in first]
    n, shared = sets.column("n").to_numpy()[first], sets.column("shared").to_numpy()[first]
    u, v = pairs.column("u").to_numpy(), pairs.column("v").to_numpy()
    at_u, at_v = (np.minimum(np.searchsorted(ids, x), max(len(ids) - 1, 0)) for x in (u, v))
    known = (ids[at_u] == u) & (ids[at_v] == v) if len(ids) else np.zeros(len(u), bool)
    u, v, at_u, at_v = u[known], v[known], at_u[known], at_v[known]
    size = np.array([len(x) for x in own], np.int64)
    begin = np.cumsum(size) - size
    values, rank = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]), return_inverse=True)
    keys = np.repeat(np.arange(len(ids)), size) * len(values) + rank  # ascending, as ids and each set's entries are
    small, large = np.where(size[at_u] <= size[at_v], at_u, at_v), np.where(size[at_u] <= size[at_v], at_v, at_u)
    both = np.zeros(len(u), np.int64)
    parts = np.cumsum(size[small]) // BLOCK_ENTRIES
    for part in np.unique(parts):
        a, b = np.searchsorted(parts, (part, part + 1))
        taken, pair = _taken(rank, begin, small[a:b], size[small[a:b]])
        sought = large[a:b][pair] * len(values) + taken
        if len(sought):
            both[a:b] = np.bincount(pair[keys[np.minimum(np.searchsorted(keys, sought), len(keys) - 1)] == sought], minlength=b - a)
    need = -(-PERCENT * (n[at_u] + n[at_v]) // (100 + PERCENT))
    most = both + np.minimum((shared - size)[at_u], (shared - size)[at_v])
    good = (most >= need) & (both > 0)
    return pa.table({"u": u[good], "v": v[good], "need": need[good], "both": both[good]})


def product(pairs: DataFrame, sets: DataFrame, groups: int, spread: int = 1) -> DataFrame:
    """The pairs (u, v) of ``pairs`` (distinct) whose sets (id, n, shared, entries) link, by summed partial counts of the cells.

    A cell has the pairs of some u, and a copy of each set that these need; so v may be in any number of pairs, and u too, if they are spread over groups.
    """
    group = F.pmod(F.xxhash64("u", F.pmod("v", F.lit(spread))), F.lit(groups))
    ranges = F.posexplode(F.sequence(F.lit(0), F.lit(RANGES - 1)))
    none = F.lit(None)
    asked = pairs.select(group.alias("g"), "u", "v", ranges.alias("r", "__r")).select("g", "r", "u", "v", none.cast("long").alias("n"), none.cast("long").alias("shared"), none.cast("binary").alias("data"))
    needed = pairs.select(group.alias("g"), F.explode(F.array("u", "v")).alias("id")).distinct()
    sent = needed.join(sets.select("id", "n", "shared", "entries"), "id").select("g", "id", "n", "shared", F.posexplode("entries").alias("r", "data"))
    sent = sent.select("g", "r", F.col("id").alias("u"), none.cast("long").alias("v"), "n", "shared", "data")
    parts = asked.unionByName(sent).groupBy("g", "r").applyInArrow(partial_counts, "u long, v long, need long, both long")
    return parts.groupBy("u", "v").agg(F.sum("both").alias("both"), F.max("need").alias("need")).filter("both >= need").select("u", "v")


def meet(rows: DataFrame, totals: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` (n of them) joined with the row of ``totals`` (key, k: its rows, and others) of their key; keys with many rows are sent to these."""
    often, seldom = often_and_seldom(totals, n)
    met = rows.join(F.broadcast(often), key, "left")  # fewer than MOST_SENT keys
    there = F.col("k").isNotNull()
    return met.filter(there).unionByName(met.filter(~there).select(*rows.columns).join(seldom, key))


def unsettled(columns: DataFrame) -> DataFrame:
    """Pairs (u, v) of rows (shingle, id, n, shared, place, component, main) of one shingle that may link and aren't in one component yet, nor both in the main one.

    The smaller set is x.  Its partner's size is at most (1 + t) / t * (shared - place) - |x|, and it is no smaller than x itself; y's partner is as large as
    t * |y|.  So both are met by bands of sizes, and rows that can't have any partner meet none.
    """
    most = F.floor((100 + PERCENT) * (F.col("shared") - F.col("place")) / PERCENT) - F.col("n")
    band = lambda n: F.floor(F.log(n) / float(np.log(BAND))).cast("int")
    low, high = F.ceil(PERCENT * F.col("n") / 100), F.least(F.col("n"), most)
    small = columns.filter(most >= F.col("n")).withColumn("band", band(F.col("n")))
    large = columns.filter(high >= low).withColumn("band", F.explode(F.sequence(band(low), band(high))))
    large = large.select("shingle", "band", *[F.col(c).alias(f"{c}_") for c in ("id", "n", "shared", "place", "component", "main")])
    ordered = (F.col("n") < F.col("n_")) | ((F.col("n") == F.col("n_")) & (F.col("id") < F.col("id_")))
    found = [
        small.join(large.filter("component_ <> main_"), ["shingle", "band"]),
        small.filter("component <> main").join(large.filter("component_ = main_"), ["shingle", "band"]),
    ]
    pairs = [f.filter((F.col("component") != F.col("component_")) & ordered & can_link("", "", "_")).select(F.col("id").alias("u"), F.col("id_").alias("v")) for f in found]
    return pairs[0].unionByName(pairs[1]).distinct()


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = own.filter("doc_id IS NOT NULL")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(2 * partitions, size // 6 // 3 // BLOCK_ENTRIES + 1)
    described = materialise(describe(own, blocks), "sets")
    sets = described.filter("doc_row").drop("doc_row")
    in_class = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    classes = sets.filter(in_class).groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("k"))
    hot = hot_shingles(described, blocks)
    alive = first_survivors(named, blocks, hot).select(F.col("class").alias("h1"))
    chosen = classes.join(alive, "h1", "left_semi").select("id", "h1", "h2")
    texts = named.join(chosen, F.col("doc_id") == F.col("id"))
    rare = materialise(rare_columns(texts, blocks, hot), "columns")
    entries, all_shared = (int(x or 0) for x in rare.agg(F.sum(F.size("shingles")), F.sum("shared")).first())
    groups = max(partitions, all_shared // BLOCK_ENTRIES + 1)
    column = rare.select("id", "n", "shared", "central", F.posexplode("shingles").alias("place", "shingle"))
    centre = column.groupBy("shingle").agg(F.max_by(F.struct("id", "n", "shared", "place"), F.struct("central", -F.col("id"))).alias("c"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    stars = meet(column, materialise(centre, "centres"), "shingle", entries).filter(F.col("id") != F.col("c.id")).filter(can_link("", "c."))
    stars = materialise(stars.select(F.col("id").alias("u"), F.col("c.id").alias("v")).distinct(), "pairs")  # u isn't the centre: many may share one
    links = materialise(product(stars, rare, groups), "links")
    found = materialise(connected_components(links), "components")
    placed = rare.join(found, rare.id == found.node, "left").select("id", "n", "shared", F.coalesce("component", "id").alias("component"), F.posexplode("shingles").alias("place", "shingle"))
    counted = placed.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = counted.groupBy("shingle").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("k")).filter("parts > 1").drop("parts")
    rest = unsettled(materialise(meet(placed, materialise(mixed, "mixed"), "shingle", entries).drop("k"), "open"))
    done = stars.unionAll(stars.select("v", "u"))
    rest = rest.join(done, ["u", "v"], "left_anti")
    more = materialise(product(materialise(rest, "pairs"), rare, groups, SPREAD), "links")
    last = connected_components(links.unionByName(more)).select(F.col("node"), F.col("component").alias("found"))
    members = materialise(classes.join(last, F.col("id") == F.col("node"), "left").select(F.struct("h1", "h2").alias("class"), "k", F.coalesce("found", "id").alias("component_id")), "classes")
    rows = sets.filter(in_class).select("doc_id", "n", F.struct("h1", "h2").alias("class"))
    placed_rows = meet(rows, members, "class", described.count()).select("doc_id", "n", "component_id")
    alone = sets.filter(~in_class).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return placed_rows.unionByName(alone).withColumnRenamed("n", "n_shingles")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row for each component: that of its smallest id; rows with a null id and texts without words stay."""
    name = free_name(docs, "__gone")
    gone = components(docs, key, text).filter(F.col("component_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[key].cast("long") == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
