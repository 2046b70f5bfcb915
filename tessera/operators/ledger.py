"""Append-only ledgers, row-set digests and frozen manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(columns: list[str]):
    """A row's canonical text: its columns as JSON, nulls kept as empty strings."""
    return F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]))


def decision_id(columns: list[str], length: int = 24):
    return F.substring(F.sha2(canonical(columns), 256), 1, length)


def row_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """rows and digest of a set of rows whatever their order.

    Rows are digested in place and summed in 1,024 groups by their own digest; the groups' digests, sorted, make the whole's.  No task sees all rows.
    """
    lines = df.select(F.sha2(canonical(columns or df.columns), 256).alias("h"))
    groups = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).groupBy(F.substring("h", 1, 2).alias("g"), F.substring("h", 3, 1).alias("k"))
    sums = groups.agg(F.sum("n").alias("n"), F.sum(F.xxhash64("h", "n").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64("n", "h").cast("decimal(38,0)")).alias("b"))
    parts = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "g", "k", "n", "a", "b"))), ",")  # 4,096 strings at most
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.coalesce(parts, F.lit("")), 256).alias("digest"))


def freeze(tables: dict[str, tuple[DataFrame, str]], until: str) -> DataFrame:
    """(name, rows, digest) of each table's rows up to a day; tables are (DataFrame, date column)."""
    out = None
    for name, (df, day) in sorted(tables.items()):
        one = row_digest(df.filter(F.col(day).cast("date") <= F.lit(until).cast("date"))).select(F.lit(name).alias("name"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def changed(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """Names whose frozen rows differ from the manifest, or are missing on one side."""
    both = manifest.alias("m").join(now.alias("n"), "name", "full_outer")
    return both.filter("NOT (m.digest <=> n.digest)").select("name", F.col("m.rows").alias("frozen_rows"), F.col("n.rows").alias("rows_now"))


def conflicts(ledger: DataFrame, incoming: DataFrame, key: str, fixed: list[str], one_per: str | None = None) -> DataFrame:
    """(key, conflict): incoming rows that change a fixed field of a known key, or bring a second key for the same ``one_per``."""
    known = ledger.select(F.col(key), F.struct(*fixed).alias("__old"))
    met = incoming.join(known, key)
    out = met.filter(~F.struct(*fixed).eqNullSafe(F.col("__old"))).select(key, F.lit("immutable_field_changed").alias("conflict"))
    if one_per:
        held = ledger.select(F.col(one_per), F.col(key).alias("__key"))
        second = incoming.join(held, one_per).filter(F.col(key) != F.col("__key")).select(key, F.lit(f"second_{key}_for_{one_per}").alias("conflict"))
        out = out.unionByName(second.distinct())
    return out


def append_new(ledger: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key the ledger doesn't hold, once each: replays add nothing."""
    return incoming.join(ledger.select(key), key, "left_anti").dropDuplicates([key])


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "doc_id") -> DataFrame:
    """Existing rows, replaced by incoming ones of the same key, and new ones."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def reveal(manifest: DataFrame, now: DataFrame, revealed: DataFrame) -> None:
    """Allow one reveal of held-back results: fails if any frozen input has changed, or if a result was revealed before (``revealed`` has rows)."""
    if revealed.limit(1).count():
        raise ValueError("the result was revealed before")
    if names := [r["name"] for r in changed(manifest, now).select("name").orderBy("name").collect()]:  # a row for each frozen table
        raise ValueError("frozen inputs have changed: " + ", ".join(names))
