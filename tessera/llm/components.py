"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges lead from the larger node u to the smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
    moved = edges.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v): the smallest node that it reaches.  Nodes without links aren't listed."""
    edges = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        after = materialise(_small_star(_large_star(edges)), "edges")
        # stars are left as they are: done once no edge changes
        mark = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark(edges) == mark(after):
            break
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select("v", "v").distinct())
