"""Candidates from paged listings whose filters aren't trusted: what comes back is checked again, and every rejection is counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import tags_stripped

#: Fixed value: seconds by which the source's calendar is ahead of UTC.
AHEAD = 8 * 3600
REASONS = ("other_stock", "duplicate_question", "out_of_window", "detail_rejected", "duplicate_content")


def local_day(stamp: Column) -> Column:
    """The source's calendar day of an epoch in seconds or milliseconds; null for what isn't a positive number."""
    n = F.trim(stamp.cast("string")).try_cast("long")
    seconds = F.when(n > 10_000_000_000, F.floor(n / 1000)).when(n > 0, n)
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((seconds + AHEAD) / 86400).cast("int"))


def judged(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Add day, content_sha256 and reason: the first of REASONS that rejects a row, null for candidates.

    rows: stock_code (asked for), page, place, found_code, question_id, published, detail_code, detail_date, question, reply.  Rows count in
    the order of stock, page and place: of equal questions the first in the window, of equal contents the first candidate stays.
    """
    inside = lambda day: F.coalesce(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(False))
    at = F.struct("stock_code", "page", "place")
    id_ = F.coalesce(F.col("question_id").cast("string"), F.lit(""))
    out = rows.withColumns({"__at": at, "__id": id_, "question": tags_stripped(F.col("question")), "reply": tags_stripped(F.col("reply")), "day": local_day(F.col("detail_date"))})
    other = ~F.col("found_code").eqNullSafe(F.col("stock_code"))
    listed = inside(local_day(F.col("published")))
    first = F.min(F.when(~other & listed, F.col("__at"))).over(W.partitionBy("__id"))
    bad = ~F.col("detail_code").eqNullSafe(F.col("stock_code")) | ~inside(F.col("day")) | (F.col("question") == "") | (F.col("reply") == "")
    out = out.withColumn("reason", F.when(other, "other_stock").when((F.col("__id") == "") | F.coalesce(F.col("__at") > first, F.lit(False)), "duplicate_question").when(~listed, "out_of_window").when(bad, "detail_rejected"))
    out = out.withColumn("content_sha256", F.sha2(F.concat_ws("\n", "question", "reply"), 256))
    # rejected rows are spread, as only candidates share a content
    key = F.when(F.col("reason").isNull(), F.col("content_sha256")).otherwise(F.concat(F.lit("-"), F.xxhash64("__at").cast("string")))
    kept = F.min(F.when(F.col("reason").isNull(), F.col("__at"))).over(W.partitionBy(key))
    return out.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("__at") > kept), "duplicate_content").otherwise(F.col("reason"))).drop("__at", "__id")


def rejections(rows: DataFrame) -> DataFrame:
    """(reason, n) of judged rows; candidates are ``candidate``."""
    return rows.groupBy(F.coalesce("reason", F.lit("candidate")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def mismatched_stocks(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Stocks whose listing returned rows, but none of the asked window: their remote filter doesn't work."""
    listed = local_day(F.col("published")).between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("found_code").eqNullSafe(F.col("stock_code"))
    return rows.groupBy("stock_code").agg(F.count_if(F.coalesce(listed, F.lit(False))).alias("n")).filter("n = 0").select("stock_code")
