"""Loops over DataFrames that end when nothing is open, with their lineage cut in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to spark.checkpoint.dir and read again."""
    path = f"{_folder(df.sparkSession)}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seq) of the nodes that stay when nodes are taken in order, and one that conflicts with an earlier kept one is dropped.

    ``keys`` (seq, at, key): nodes with their order and each key that they may not share; ``pairs`` (earlier, later): other conflicts.
    A node that comes first among the undecided in all its keys, and waits for no pair, stays; what conflicts with it goes.  Each round
    groups keys (no pairs of a group are made) and decides at least the first node of every chain.
    """
    waiting, pairs = saved(keys), saved(pairs)
    kept = waiting.select("seq").limit(0)
    while waiting.limit(1).count():
        heads = waiting.groupBy("key").agg(F.min_by("seq", "at").alias("seq"))
        ready = waiting.join(heads.withColumn("head", F.lit(1)), ["key", "seq"], "left").groupBy("seq").agg(F.count("head").alias("h"), F.count(F.lit(1)).alias("n")).filter("h = n").select("seq")
        stays = saved(ready.join(pairs.select(F.col("later").alias("seq")).distinct(), "seq", "left_anti"))
        taken = waiting.join(stays, "seq", "left_semi").select("key").distinct()
        goes = waiting.join(taken, "key", "left_semi").select("seq").unionByName(pairs.join(stays.withColumnRenamed("seq", "earlier"), "earlier", "left_semi").select(F.col("later").alias("seq")))
        decided = saved(goes.unionByName(stays).distinct())
        kept = saved(kept.unionByName(stays))
        waiting = saved(waiting.join(decided, "seq", "left_anti"))
        pairs = saved(pairs.join(decided.withColumnRenamed("seq", "earlier"), "earlier", "left_anti").join(decided.withColumnRenamed("seq", "later"), "later", "left_anti"))
    return kept
