"""Structured Streaming twins: idempotent ledger appends, and bursts of events."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.ledger import append_new, conflicts


def append_stream(decisions: DataFrame, path: str, checkpoint: str, key: str, fixed: list[str], one_per: str | None = None, once: bool = True) -> StreamingQuery:
    """Append new decisions to the Parquet ledger at ``path``; a batch that contradicts it fails and adds nothing.

    Replayed batches find their keys in the ledger, so a retry after a lost executor or driver adds nothing twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        try:
            ledger = spark.read.schema(df.schema).parquet(path)
        except AnalysisException:
            ledger = spark.createDataFrame([], df.schema)
        if bad := conflicts(ledger, df, key, fixed, one_per).limit(5).collect():
            raise ValueError(f"the ledger contradicts: {[(r[0], r[1]) for r in bad]}")
        append_new(ledger, df, key).write.mode("append").parquet(path)

    writer = decisions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_bursts(events: DataFrame, stamp: str = "ts", key: str = "event_type", late: str = "1 day", size: str = "7 days", step: str = "1 day") -> DataFrame:
    """Counts and sums of sliding windows; rows later than ``late`` are dropped.  Works on streams and on batches alike."""
    own = events.withColumn("__ts", F.col(stamp).cast("timestamp"))
    if events.isStreaming:
        own = own.withWatermark("__ts", late)
    return own.groupBy(F.window("__ts", size, step).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), key, "n", "value")
