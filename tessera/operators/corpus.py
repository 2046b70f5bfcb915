"""A dated corpus from several sources, and documents that state large changes of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import has_any, normal_text, normal_url
from tessera.operators.dedup import keep_earliest

#: Longest text, shortest text, characters that stand for a text without link, and the quantile of large changes.
MOST_CHARACTERS, LEAST_CHARACTERS, KEY_CHARACTERS, LARGE = 12_000, 40, 800, 0.75
KINDS = ("policy", "announcement", "news", "ir_qa")


def source_kind(kind: Column) -> Column:
    """A known kind of source; anything else counts as news."""
    return F.when(kind.isin(*KINDS), kind).otherwise("news")


def document_key(url: Column, text: Column) -> Column:
    """The link without its fragment, else the first characters of the normalised text."""
    link = normal_url(F.coalesce(url, F.lit("")))
    return F.when(link != "", F.concat(F.lit("u:"), link)).otherwise(F.concat(F.lit("t:"), F.substring(normal_text(F.coalesce(text, F.lit(""))), 1, KEY_CHARACTERS)))


def assemble(sources: list[DataFrame], terms: list[str], start: str, end: str) -> DataFrame:
    """Documents (doc_id, source_type, title, content, publish_time, source_name, url) of all sources that lie in a range of days, hold one of ``terms`` in title or content
    and have LEAST_CHARACTERS; of those with one link (or one text, without link) the first by day and id; contents are cut to MOST_CHARACTERS."""
    whole = sources[0]
    for more in sources[1:]:
        whole = whole.unionByName(more)
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    good = F.col("publish_time").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & has_any(text, terms) & (F.length(F.trim(F.coalesce("content", F.lit("")))) >= LEAST_CHARACTERS)
    own = whole.filter(F.coalesce(good, F.lit(False))).withColumns({"source_type": source_kind(F.col("source_type")), "content": F.substring("content", 1, MOST_CHARACTERS)})
    return keep_earliest(own.withColumn("__key", document_key(F.col("url"), F.col("content"))), ["__key"], ["publish_time", "doc_id"]).drop("__key")


def large_changes(series: DataFrame, until: str, q: float = LARGE) -> DataFrame:
    """Rows (day, quantity, change) whose change is at least the nearest-rank quantile of all absolute changes but 0 up to ``until``; none without such changes."""
    early = (F.col("day") <= F.lit(until).cast("date")) & (F.col("change") != 0)
    least = series.filter(early).agg(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY abs(change))").alias("least"))
    return series.join(F.broadcast(least)).filter(F.abs("change") >= F.col("least")).drop("least")  # one row of it


def fact_documents(series: DataFrame, until: str, subject: str) -> DataFrame:
    """A document for each large change, in words."""
    number = lambda c: F.regexp_replace(F.format_string("%.6f", c.cast("double")), r"\.?0+$", "")
    moved = F.when(F.col("change") > 0, F.concat(F.lit("rose by "), number(F.col("change")))).when(F.col("change") < 0, F.concat(F.lit("fell by "), number(-F.col("change")))).otherwise("is unchanged")
    title = F.concat(F.lit(f"{subject} "), moved)
    return large_changes(series, until).select(
        F.concat(F.lit("FACT-"), F.date_format("day", "yyyyMMdd")).alias("doc_id"), F.lit("announcement").alias("source_type"), title.alias("title"),
        F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(f": {subject} is "), number(F.col("quantity")), F.lit(" and "), moved, F.lit(".")).alias("content"), F.col("day").alias("publish_time"),
    )
