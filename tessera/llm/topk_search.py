"""Exact inner-product search over norm buckets.

Vectors become integers, floor(256 * x), kept as doubles, which hold them exactly.
They are grouped by length into bands of about 1 %, and these, longest first, into
buckets (about BUCKET_ROWS rows; a band of more rows is split by a hash of the id, so
one vector repeated in a third of all rows is many buckets).  Queries come in blocks
of BLOCK_ROWS.

First every query meets the bucket of the longest vectors; its k-th score there is a
lower bound.  As buckets are in the order of length, it is then sent to a run of them,
down to the last band whose upper edge can still reach the bound.  In a bucket the
local cosine threshold, bound / (|q| * longest), chooses the pruning: a low one cuts
the bucket, sorted by length, where |q| * |p| falls below the bound; a high one keeps
the rows whose value at the query's largest coordinate lies in the range that the
threshold allows.  What is left is verified by its product.  All comparisons of
pruning leave a margin, and products are exact (in floats while every partial sum is
below 2**53, else in integers of any size), so the result is exact.

Defined results: vectors that are null, empty, or hold a null or non-finite component
(or one whose integer isn't a finite double) take no part, nor rows with a null id.
A score beyond a long is given as the largest or smallest long, and ranked as that.
Vectors of different dimension don't meet.  A row is never its own candidate; rows
that repeat an id aren't candidates of that id either and query once.  Ties go to the
smaller id.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_ROWS, BLOCK_ROWS = 16_384, 2_048
#: Bands of lengths for each doubling, and rows that a bucket needs before the next one begins.
BANDS, FEW_ROWS = 64, 1_024
#: Local cosine threshold from which coordinate pruning is chosen.
BY_COORDINATE = 0.6
_MARGIN = 1e-9


def integer_vectors(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """Rows that take part, with their integer vector ``v`` (as doubles), its length, dimension and band of lengths."""
    infinite = float("inf")
    good = F.forall(F.col(vector), lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * scale) < infinite), F.lit(False)))
    kept = df.filter(F.col("id").isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & good)
    x = F.transform(vector, lambda c: c.cast("double") * scale)
    # a double of 2**53 or more is whole; below, floor is a long
    whole = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**53, F.floor(F.when(F.abs(c) < 2.0**53, c)).cast("double")).otherwise(c))
    most = F.array_max(F.transform("v", F.abs))  # squares of shares of it can't overflow
    length = F.when(F.col("most") > 0, F.col("most") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + (c / F.col("most")) * (c / F.col("most"))))).otherwise(F.lit(0.0))
    measured = kept.select("id", whole.alias("v")).withColumn("most", most).withColumn("length", length).drop("most").withColumn("dims", F.size("v"))
    return measured.withColumn("band", F.floor(F.log2(F.least(F.greatest("length", F.lit(0.5)), F.lit(1e308))) * BANDS).cast("int"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dims)


def _lengths(x: np.ndarray) -> np.ndarray:
    most = np.maximum(np.abs(x).max(1, initial=0.0), 1e-300)
    with np.errstate(over="ignore"):
        return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products, within a long's limits."""
    out = np.zeros((len(q), len(p)), np.int64)
    if not len(q) or not len(p):
        return out
    q_most, p_most = np.abs(q).max(1), np.abs(p).max(1)
    plain_q, plain_p = q_most * p_most.min() * q.shape[1] < 2**53, None
    if plain_q.any():
        plain_p = p_most * q_most[plain_q].max() * q.shape[1] < 2**53
        out[np.ix_(plain_q, plain_p)] = (q[plain_q] @ p[plain_p].T).astype(np.int64)
    limits = np.iinfo(np.int64)
    rows = [[int(c) for c in row] for row in p[~plain_p]] if plain_p is not None else []
    every = [[int(c) for c in row] for row in p] if not plain_q.all() else []
    for i in range(len(q)):
        others = rows if plain_q[i] else every
        if others:
            own = [int(c) for c in q[i]]
            exact = [min(max(sum(a * b for a, b in zip(own, row)), limits.min), limits.max) for row in others]
            out[i, ~plain_p if plain_q[i] else slice(None)] = exact
    return out


def search_block(q_id: np.ndarray, q: np.ndarray, bound: np.ndarray, p_id: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best rows of one bucket: (query ids, row ids, scores).  ``bound``: scores below it don't count; -inf for none."""
    q_length, p_length = _lengths(q), _lengths(p)
    order = np.argsort(-p_length, kind="stable")
    p, p_id, p_length = p[order], p_id[order], p_length[order]
    longest = p_length[0] if len(p) else 0.0
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        threshold = np.where(q_length * longest > 0, bound / (q_length * longest), np.where(bound > 0, np.inf, -np.inf))
    threshold = np.where(np.isnan(threshold), -np.inf, threshold)  # a product beyond a double's limit prunes nothing
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        """scores: queries by rows (ids of rows)."""
        for i, one in enumerate(ids):
            good = np.flatnonzero(rows != one)
            s = scores[i, good]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                good, s = good[s >= least], s[s >= least]
            best = np.lexsort((rows[good], -s))[:k]
            found.append((np.full(len(best), one), rows[good][best], s[best]))

    possible = threshold <= 1 + _MARGIN
    by_coordinate = np.flatnonzero(possible & (threshold >= BY_COORDINATE))
    by_length = np.flatnonzero(possible & (threshold < BY_COORDINATE))
    for start in range(0, len(by_length), 256):
        own = by_length[start : start + 256]
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where((bound[own] > 0) & (q_length[own] > 0), bound[own] / q_length[own], 0.0).min() * (1 - _MARGIN)
        n = int(np.searchsorted(-p_length, -least, side="right")) if least > 0 else len(p)
        keep(q_id[own], p_id[:n], _products(q[own], p[:n]))
    unit = p / np.maximum(p_length, 1e-300)[:, None] if len(by_coordinate) else p
    for i in by_coordinate:
        t = min(threshold[i], 1.0)
        at = int(np.abs(q[i]).argmax())
        c = q[i, at] / q_length[i]
        reach = np.sqrt(max(0.0, (1 - t * t) * (1 - c * c))) + 1e-6
        low, high = (-1.0 - reach if c <= -t else t * c - reach), (1.0 + reach if c >= t else t * c + reach)
        near = np.flatnonzero((unit[:, at] >= low) & (unit[:, at] <= high))
        keep(q_id[i : i + 1], p_id[near], _products(q[i : i + 1], p[near]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


_PAIR = "query_id long, vec_id long, score long"


def _meet(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Each bucket with the query blocks that were sent to it."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = (np.zeros(0, np.int64),) * 3
        if len(left) and len(right):
            dims = len(left.column("v")[0])
            out = search_block(
                np.asarray(right.column("q_id")), _matrix(right.column("q"), dims), np.asarray(right.column("bound")),
                np.asarray(left.column("id")), _matrix(left.column("v"), dims), k,
            )
        return pa.table({"query_id": out[0].astype(np.int64), "vec_id": out[1].astype(np.int64), "score": out[2].astype(np.int64)})

    queries = queries.select(F.col("id").alias("q_id"), F.col("v").alias("q"), "bound", F.col("bucket").alias("to_bucket"), F.col("block").alias("own_block"))
    return candidates.groupBy("bucket", "block").cogroup(queries.groupBy("to_bucket", "own_block")).applyInArrow(run, _PAIR)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _place_bands(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(dims, band, first bucket, parts, first bucket of the dimension, last bucket up to here) for counts of (dims, band), longest bands first."""
    out: list[tuple[int, int, int, int, int, int]] = []
    bucket, filled, dims_before, begin = -1, 0, None, 0
    for dims, band, n in sorted(counts, key=lambda x: (x[0], -x[1])):
        if dims != dims_before:
            bucket, filled, dims_before = bucket + 1, 0, dims
            begin = bucket
        elif filled + n > BUCKET_ROWS and filled >= min(FEW_ROWS, BUCKET_ROWS):
            bucket, filled = bucket + 1, 0
        parts = max(1, -(-n // BUCKET_ROWS))
        out.append((dims, band, bucket, parts, begin, bucket + parts - 1))
        bucket, filled = (bucket + parts - 1, BUCKET_ROWS) if parts > 1 else (bucket, filled + n)
    return out


def top_k(df: DataFrame, is_query: Column, k: int, id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row for which ``is_query`` (over column id) holds."""
    from tessera.llm.common import materialise

    spark = df.sparkSession
    vectors = materialise(integer_vectors(df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("x")), "x", scale), "vectors")
    counts = [tuple(r) for r in vectors.groupBy("dims", "band").count().collect()]  # at most BANDS for each doubling that a double has
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = _place_bands(counts)
    edges = [(*r, float(2 ** min((r[1] + 1) / BANDS, 1023.9))) for r in rows]
    bands = spark.createDataFrame(edges, "dims int, band int, first int, parts int, begin int, last int, edge double")
    placed = (
        vectors.join(F.broadcast(bands.select("dims", "band", "first", "parts")), ["dims", "band"])
        .select("id", "v", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int")).alias("bucket"))
    )
    chosen = vectors.filter(is_query).dropDuplicates(["id"]).drop("band")
    blocks = max(1, -(-chosen.count() // BLOCK_ROWS))
    chosen = chosen.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))

    def send(queries: DataFrame) -> DataFrame:
        """Meet the buckets named in ``queries``; a bucket is copied once for each block that comes, and for no other."""
        sent = queries.select("bucket", "block").distinct()
        return _meet(placed.join(sent, "bucket"), queries, k)

    begins = bands.select("dims", F.col("begin").alias("bucket")).distinct()
    start = chosen.join(F.broadcast(begins), "dims").withColumn("bound", F.lit(float("-inf")))
    begun = materialise(_best(send(start.select("id", "v", "bucket", "block", "bound")), k).drop("rank"), "topk-first")
    bounds = begun.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("least")).alias("bound"))
    bounded = chosen.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    # the bands of a dimension by length: a query needs those from the longest down to the last that can reach its bound
    known = F.broadcast(bands.groupBy("dims").agg(F.collect_list(F.struct("edge", "last")).alias("ends"), F.min("begin").alias("begin")))
    reach = F.aggregate("ends", F.col("begin"), lambda a, e: F.when(F.col("length") * e["edge"] * (1 + _MARGIN) >= F.col("bound"), F.greatest(a, e["last"])).otherwise(a))
    later = bounded.join(known, "dims").withColumn("reach", reach).filter(F.col("reach") > F.col("begin")).withColumn("bucket", F.explode(F.sequence(F.col("begin") + 1, F.col("reach"))))
    rest = send(later.select("id", "v", "bucket", "block", "bound"))
    return _best(begun.unionByName(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("id") % 50 == 0, 5)


SQL = """
WITH parts AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id IS NOT NULL),
good AS (SELECT vec_id FROM parts GROUP BY vec_id HAVING count(*) = count(x) AND bool_and(isfinite(x))),
vectors AS (SELECT vec_id, i, floor(256 * x)::BIGINT AS x FROM parts SEMI JOIN good USING (vec_id)),
scores AS (
  SELECT q.vec_id AS query_id, p.vec_id, sum(q.x * p.x)::BIGINT AS score
  FROM vectors q JOIN vectors p ON q.i = p.i AND q.vec_id <> p.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
