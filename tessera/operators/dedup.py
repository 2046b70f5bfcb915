"""Deduplication of dated documents: by keys, and by order with near copies.

The ordered rule keeps the first of each group of conflicting documents, where a
dropped document's keys don't count against later ones.  Two documents conflict if
they share an id, a link or a fingerprint, or lie in one period and are similar.
Conflicts are found by keys and, for near copies, by pairs of blocks of a period, and
the rule is then settled in rounds: in each, a document with no undecided earlier
conflict is decided.  A round only joins the conflicts that are still open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.near import BLOCK_BYTES, block_pairs
from tessera.operators.iterate import settled

#: Tasks for each core that a period's blocks are dealt to: some blocks take much longer than others, and few should share a task.
CELL_TASKS = 16


def keep_earliest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first by ``order``.  Aggregates before it shuffles, so a hot key costs one row per task."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__r")
    return df.groupBy(*key).agg(first).select("__r.*")


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: latest record wins."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__r")).select("__r.*")


def near_pairs(docs: DataFrame, threshold: float = 0.88, size: int = 5, period: str = "period_end") -> DataFrame:
    """(earlier, later): similar documents of one period.  ``docs`` has doc_id, seq, text and the period.

    Texts travel, not their grams: a period is cut into blocks of BLOCK_BYTES, and each of its texts meets every block once (``block_pairs``).
    """
    slim = docs.select("seq", F.xxhash64("doc_id").alias("id"), "text", F.col(period).alias("__p")).filter(F.col("doc_id").isNotNull() & F.col("__p").isNotNull())
    blocks = slim.groupBy("__p").agg(F.greatest(F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES), F.lit(1)).alias("__n"))
    dealt = slim.join(F.broadcast(blocks), "__p").withColumn("__own", F.pmod(F.xxhash64("seq"), "__n"))
    cells = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__block")).withColumn("cell", F.xxhash64("__p", "__block")).withColumn("visits", F.col("__own") != F.col("__block"))
    tasks = CELL_TASKS * docs.sparkSession.sparkContext.defaultParallelism
    met = cells.select("cell", "visits", "seq", "id", "text").repartition(tasks, "cell").sortWithinPartitions("cell", "visits")
    return met.mapInArrow(lambda batches: block_pairs(batches, threshold, size), "earlier long, later long").distinct()


def ordered_dedup(docs: DataFrame, keys: list[str], threshold: float = 0.88, order: list[str] = ["publish_time", "doc_id"], near: bool = True) -> DataFrame:
    """Documents that the ordered rule keeps.  ``keys``: columns that must not repeat (null or empty ones never conflict)."""
    numbered = docs.withColumn("seq", F.xxhash64(*order)).withColumn("__at", F.struct(*order))
    held = F.array_compact(F.array(F.concat(F.lit("seq="), F.col("seq").cast("string")), *[F.when(F.coalesce(F.col(k).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}="), F.col(k).cast("string"))) for k in keys]))
    nodes = numbered.select("seq", F.col("__at").alias("at"), F.explode(held).alias("key"))
    if near:
        orders = numbered.select("seq", "__at")
        met = near_pairs(numbered, threshold).join(orders.select(F.col("seq").alias("earlier"), F.col("__at").alias("oa")), "earlier").join(orders.select(F.col("seq").alias("later"), F.col("__at").alias("ob")), "later")
        first = F.expr("oa < ob")
        pairs = met.select(F.when(first, F.col("earlier")).otherwise(F.col("later")).alias("earlier"), F.when(first, F.col("later")).otherwise(F.col("earlier")).alias("later"))
    else:
        pairs = nodes.select(F.col("seq").alias("earlier"), F.col("seq").alias("later")).limit(0)
    return numbered.join(settled(nodes, pairs), "seq", "left_semi").drop("seq", "__at")
