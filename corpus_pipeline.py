"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents.

Defined results: documents with a null or empty text are not toxic, no copies, without windows and leaks, and have no tokens, so they stay; rows with a null
id stay too, but for toxic texts and leaks; of equal texts, and of rows that repeat, the smallest id stays (rows that share an id are one document for near
copies); an empty table gives an empty one; other columns are kept, and n_chars follows the text where there is such a column.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontamination, ngram_join, substring_dedup, toxicity
from tessera.llm.common import materialise, scan

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Rows that Spark hands to a Python worker at once: with texts of some kilobytes, a few megabytes.
BATCH_ROWS = 1_000


def small_batches(stage: Stage) -> Stage:
    """Run a stage with small batches; the session keeps them, as Spark reads the setting when the stage's rows are made."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    return toxicity.reject(docs, toxicity.train(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "labels")))


@small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return ngram_join.one_of_each(docs)


@small_batches
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of words that an earlier place has go; n_chars follows the text."""
    out = substring_dedup.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


@small_batches
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item, exact or edited, go."""
    return decontamination.decontaminate(docs, scan(spark, sf_dir, "benchmark"))


@small_batches
def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and how many there are."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe", to_tokens),
]
#: A trained model takes part, so SQL can't express it; tests/llm holds it against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
