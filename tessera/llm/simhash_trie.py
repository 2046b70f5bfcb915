"""Near copies by SimHash fingerprints: a binary trie of all fingerprints joined with itself.

Each document gets a fingerprint of 64 bits.  The different fingerprints form a
binary trie.  Its upper part, cut where few enough fingerprints hang below a
node, deals them to leaves; pairs of nodes are walked down together, the bits in
which their paths differ add up, and a pair beyond the error budget is left.
First tasks walk the upper part to find the pairs of leaves that may hold links,
then each such pair walks its two subtrees.  A task answers with a forest of its
links, never with all pairs of a group, and components follow from the forests.

Defined results: null and empty texts, and texts without words, have fingerprint
zero and link like any other; equal fingerprints link, so rows that repeat do;
rows are linked by their texts alone, so rows that share an id can lie in
different components; a row with a null id links others but names no component,
which is null only where no row of it has an id; ids must be integers; an empty
table gives an empty one; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, often_and_seldom, pieces, scan, text_buffer
from tessera.llm.components import connected_components
from tessera.llm.words import LOWER, find_words, gather

SHINGLE, BITS, BUDGET, SEED = 3, 64, 2, 42
#: Fingerprints that may hang below a leaf of the upper trie: LEAST, and with more than LEAVES * LEAST of them a LEAVES-th of all.
LEAST, LEAVES = 2048, 4096
#: Levels that one pass of counts adds to the upper trie.
STEP = 8
#: Shingles whose bits are counted at once, node pairs that are walked at once, and links that are held before they become a forest.
BLOCK, FRONT, HELD = 1 << 17, 1 << 17, 1 << 20
#: Node pairs with at most so many pairs of fingerprints below are compared directly.
DIRECT = 16
_U = np.uint64


def _shingle_hashes(body: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(body[s:e], SEED) for s, e in zip(first.tolist(), last.tolist())], np.uint64)


def simhash(texts: pa.Array, width: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text: bit b is 1 if over half of its shingles' hashes have bit b."""
    data, offsets = text_buffer(texts)
    start, end, ptr = find_words(LOWER[data], offsets)
    size = end - start
    # words joined by one space each
    joined = gather(np.append(LOWER[data], np.uint8(32)), start, size + 1)
    stop = np.cumsum(size + 1) - 1
    joined[stop] = 32
    body, begin = joined.tobytes(), stop - size
    words = np.diff(ptr)
    count = np.where(words, np.maximum(words - width + 1, 1), 0)
    doc = np.repeat(np.arange(len(words)), count)
    first = np.arange(len(doc)) - (np.cumsum(count) - count)[doc] + ptr[:-1][doc]
    last = np.minimum(first + width, ptr[1:][doc]) - 1
    ones = np.zeros((len(words), BITS), np.int64)
    for at in range(0, len(doc), BLOCK):
        part = slice(at, at + BLOCK)
        h = _shingle_hashes(body, begin[first[part]], stop[last[part]])
        bit = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edge = np.flatnonzero(np.append(True, doc[part][1:] != doc[part][:-1]))
        ones[doc[part][edge]] += np.add.reduceat(bit, edge, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(simhash(batch.column(1)).view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, print long")


class Trie:
    """Paths in order (uint64, left aligned) with their depths, none the beginning of another; a node is a range of them and a depth."""

    def __init__(self, path: np.ndarray, depth: np.ndarray | None = None):
        self.path, self.depth = path, np.full(len(path), BITS) if depth is None else depth

    def split(self, low: np.ndarray, high: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the right child of each node begins, and whether the node is a path that ends at this level (it goes along both ways)."""
        bit = _U(1 << (BITS - 1 - level))
        above = _U((1 << 64) - (1 << (BITS - level)))
        ends = self.depth[low] <= level
        middle = np.searchsorted(self.path, (self.path[low] & above) | bit)
        return np.where(ends, high, np.clip(middle, low, high)), ends


def meet(a: Trie, b: Trie, budget: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) whose paths differ in at most ``budget`` bits of their common depth; with ``same`` a is b, and i < j or i = j.

    Both tries are walked together, a level a step; the front of node pairs is cut into parts that are walked depth first.
    """
    if not len(a.path) or not len(b.path):
        return
    root = [np.array([x], np.int64) for x in (0, len(a.path), 0, len(b.path), 0)]
    stack = [(0, root)]
    while stack:
        level, (alow, ahigh, blow, bhigh, off) = stack.pop()
        many = (ahigh - alow) * (bhigh - blow) > DIRECT
        if level >= BITS:
            many[:] = False
        few = ~many
        if few.any():
            rows, columns = (ahigh - alow)[few], (bhigh - blow)[few]
            pair = np.repeat(np.arange(len(rows)), rows * columns)
            rank = np.arange(len(pair)) - (np.cumsum(rows * columns) - rows * columns)[pair]
            i, j = alow[few][pair] + rank // columns[pair], blow[few][pair] + rank % columns[pair]
            common = np.minimum(a.depth[i], b.depth[j])
            apart = np.where(common, (a.path[i] ^ b.path[j]) >> (BITS - np.maximum(common, 1)).astype(np.uint64), _U(0))
            near = np.bitwise_count(apart) <= budget
            if same:
                near &= i <= j
            if near.any():
                yield i[near], j[near]
        if not many.any():
            continue
        alow, ahigh, blow, bhigh, off = (x[many] for x in (alow, ahigh, blow, bhigh, off))
        amid, aends = a.split(alow, ahigh, level)
        bmid, bends = b.split(blow, bhigh, level)
        cost = (~(aends | bends)).astype(np.int64)
        kinds = [(alow, amid, blow, bmid, off), (amid, ahigh, bmid, bhigh, off), (alow, amid, bmid, bhigh, off + cost), (amid, ahigh, blow, bmid, off + cost)]
        front = [np.concatenate(x) for x in zip(*kinds)]
        stays = (front[0] < front[1]) & (front[2] < front[3]) & (front[4] <= budget)
        if same:
            stays &= front[0] < front[3]
        front = [x[stays] for x in front]
        for at in range(0, len(front[0]), FRONT):
            stack.append((level + 1, [x[at : at + FRONT] for x in front]))


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links u, v lead to."""
    label = np.arange(n)
    while True:
        lu, lv = label[u], label[v]
        apart = lu != lv
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(lu, lv)[apart], np.minimum(lu, lv)[apart])
        while (label[label] != label).any():
            label = label[label]
        u, v = u[apart], v[apart]


def _links(a: np.ndarray, b: np.ndarray, same: bool, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between two sorted arrays of fingerprints, or within one."""
    every = a if same else np.concatenate((a, b))
    shift, u, v, held = 0 if same else len(a), [], [], 0
    for i, j in meet(Trie(a), Trie(b), budget, same):
        u.append(i)
        v.append(j + shift)
        held += len(i)
        if held >= HELD:
            label = forest(len(every), np.concatenate(u), np.concatenate(v))
            u, v = [np.flatnonzero(label != np.arange(len(label)))], [label[label != np.arange(len(label))]]
            held = len(u[0])
    if not u:
        return every[:0], every[:0]
    label = forest(len(every), np.concatenate(u), np.concatenate(v))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return every[moved], every[label[moved]]


def upper_trie(texts: DataFrame, n: int) -> Trie:
    """Nodes that have at most max(LEAST, n / LEAVES) of the n fingerprints below and whose parent has more: at most 64 * LEAVES of them.

    Counts by prefix come from Spark, STEP levels a pass, and only below the at most LEAVES nodes that are still too large.
    """
    most = max(LEAST, n // LEAVES)
    paths, depths = [], []
    large, level = np.zeros(1, np.uint64), 0
    if n <= most:
        return Trie(large, np.zeros(1, np.int64))
    while len(large):
        prefix = F.shiftrightunsigned("print", BITS - level - STEP)
        own = texts
        if level:
            nodes = texts.sparkSession.createDataFrame(pa.table({"node": (large >> _U(BITS - level)).view(np.int64)}))
            own = texts.join(F.broadcast(nodes), F.shiftrightunsigned("print", BITS - level) == F.col("node"), "left_semi")
        counts = own.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).toArrow()
        where, number = (np.asarray(counts.column(c)) for c in ("prefix", "n"))
        below = np.zeros((len(large), 1 << STEP), np.int64)
        where = where.view(np.uint64)
        below[np.searchsorted(large, (where >> _U(STEP)) << _U(BITS - level) if level else np.zeros(len(where), np.uint64)), (where & _U((1 << STEP) - 1)).astype(np.int64)] = number
        open_, after = np.ones((len(large), 1), bool), []
        for step in range(1, STEP + 1):
            total = below.reshape(len(large), 1 << step, -1).sum(axis=2)
            parent = np.repeat(open_, 2, axis=1)
            node, child = np.nonzero(parent & (total > 0) & (total <= most))
            paths.append(large[node] | (child.astype(np.uint64) << _U(BITS - level - step)))
            depths.append(np.full(len(node), level + step))
            open_ = parent & (total > most)
        node, child = np.nonzero(open_)
        level += STEP
        large = np.sort(large[node] | (child.astype(np.uint64) << _U(BITS - level)))
    path, depth = np.concatenate(paths), np.concatenate(depths)
    order = np.argsort(path)
    return Trie(path[order], depth[order])


def links(texts: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(u, v): links between the different fingerprints in column ``print`` that connect all that lie within the budget of each other."""
    spark = texts.sparkSession
    upper = upper_trie(texts, texts.count())
    sent = spark.sparkContext.broadcast((upper.path, upper.depth))  # at most 64 * LEAVES nodes

    def leaf_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.asarray(batch.column(0)).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(sent.value[0], prints, side="right") - 1), batch.column(0)], names=["leaf", "print"])

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, depth = sent.value
        for batch in batches:
            own = np.sort(np.asarray(batch.column(0)))
            for i, j in meet(Trie(path[own], depth[own]), Trie(path, depth), budget, False):
                once = own[i] <= j
                yield pa.RecordBatch.from_arrays([pa.array(own[i][once]), pa.array(j[once])], names=["a", "b"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, one, other in zip(*batch.columns):
                a, b = (np.sort(np.asarray(x.values).view(np.uint64)) for x in (one, other))
                u, v = _links(a, b, same.as_py(), budget)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    leaves = materialise(texts.select("print").mapInArrow(leaf_of, "leaf long, print long").groupBy("leaf").agg(F.collect_list("print").alias("prints")), "leaves")
    pairs = leaves.select("leaf").mapInArrow(partners, "a long, b long")
    met = pairs.join(leaves.toDF("a", "one"), "a").join(leaves.toDF("b", "other"), "b")
    return met.select((F.col("a") == F.col("b")).alias("same"), "one", "other").mapInArrow(settle, "u long, v long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id that links reach, for every row."""
    prints = materialise(fingerprints(docs, key, text), "fingerprints")
    texts = materialise(prints.groupBy("print").agg(F.count(F.lit(1)).alias("k"), F.min("doc_id").alias("least")), "prints")
    found = links(texts, budget).distinct()
    # a node is ordered by its smallest id, so the smallest node of a component names it
    node = lambda p: texts.select(F.col("print").alias(p), F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), F.col("print").alias("print")).alias(f"{p}_node"))
    edges = found.join(node("u"), "u").join(node("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    named = connected_components(edges).select(F.col("node.print").alias("print"), F.col("component.id").alias("component_id"), F.lit(True).alias("linked"))
    own = texts.join(named, "print", "left").select("print", "k", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    own = materialise(own, "classes")
    often, seldom = (x.drop("k") for x in often_and_seldom(own, prints.count()))
    out = prints.join(F.broadcast(often), "print").unionByName(prints.join(F.broadcast(often.select("print")), "print", "left_anti").join(seldom, "print"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(scan(spark, sf_dir, "documents"))
