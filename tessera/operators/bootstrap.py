"""Moving-block bootstrap of a paired mean difference.

Draws are block starts from a seeded generator, one small array for each sample;
Spark spreads the samples over tasks.  A block's sum is the difference of two
running sums, so a sample costs as many look-ups as it has blocks, not days.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def block_means(differences: DataFrame, size: int, order: str = "trade_date", value: str = "difference") -> DataFrame:
    """Mean of each run of ``size`` days, by its first day."""
    w = W.orderBy(order).rowsBetween(0, size - 1)
    return differences.select(order, F.avg(value).over(w).alias("block_mean"), F.count(value).over(w).alias("n")).filter(F.col("n") == size).drop("n")


def draws(seed: int, samples: int, blocks: int, each: int) -> list[list[int]]:
    """Block starts of every sample, in the order in which one generator gives them."""
    rng = random.Random(seed)
    return [[rng.choice(range(blocks)) for _ in range(each)] for _ in range(samples)]


def bootstrap(differences: DataFrame, size: int = 63, samples: int = 5000, seed: int = 20260815, per_year: int = 252, circular: bool = False, rule: str = "rank", order: str = "trade_date", value: str = "difference") -> DataFrame:
    """One row: observations, annualised difference, its 95 % interval and the conclusion.

    ``differences`` is one series of days.  ``rule``: 'rank' takes the sorted estimates at int(n * q), 'span' at int((n - 1) * q), 'linear' interpolates.
    """
    spark = differences.sparkSession
    series = np.array([r[0] for r in differences.orderBy(order).select(F.col(value).cast("double")).collect()], float)  # one value per trading day
    n = len(series)
    observed = float(series.mean() * per_year) if n else 0.0
    schema = "observations int, samples int, annualized_difference double, ci_lower_95 double, ci_upper_95 double, conclusion string"
    if n < size or not n:
        return spark.createDataFrame([(n, 0, observed, 0.0, 0.0, "insufficient_history")], schema)
    blocks, each = (n if circular else n - size + 1), -(-n // size)
    table = spark.createDataFrame(enumerate(draws(seed, samples, blocks, each)), "sample int, starts array<int>")
    total = np.concatenate(([0.0], np.cumsum(np.concatenate((series, series[:size])))))
    known = spark.sparkContext.broadcast(total)

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, width = known.value, np.full(each, size)
        width[-1] = n - size * (each - 1)
        for batch in batches:
            starts = np.array(batch["starts"].tolist())
            yield pd.DataFrame({"sample": batch["sample"], "estimate": (sums[starts + width] - sums[starts]).sum(1) / n * per_year})

    estimates = table.repartition(8, "sample").mapInPandas(estimate, "sample int, estimate double")
    ranked = F.sort_array(F.collect_list("estimate"))  # ``samples`` numbers
    at = lambda q: {"rank": min(samples - 1, int(samples * q)), "span": int((samples - 1) * q)}.get(rule, 0)
    ends = [F.percentile("estimate", q) if rule == "linear" else F.get(ranked, F.lit(at(q))) for q in (0.025, 0.975)]
    out = estimates.agg(ends[0].alias("ci_lower_95"), ends[1].alias("ci_upper_95"))
    verdict = F.when((F.lit(observed) > 0) & (F.col("ci_lower_95") > 0), "positive_increment_established").otherwise("increment_not_established")
    return out.select(F.lit(n).alias("observations"), F.lit(samples).alias("samples"), F.lit(observed).alias("annualized_difference"), "ci_lower_95", "ci_upper_95", verdict.alias("conclusion"))
