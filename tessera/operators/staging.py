"""Rows checked and staged apart from a table, then swapped in by one step; and tables derived from it part by part.

A table is a folder: ``data`` holds Parquet that is never changed, ``versions`` one
small file for each version, that names the data it is made of.  A version's file
is created once, by a call that fails if it exists, so of two writers that start
from one version one wins and the other is told; readers see whole versions only.
(HDFS creates atomically; object stores need one that does.)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.dates import parse_day, period_end, period_start
from tessera.operators.ledger import row_digest, upsert
from tessera.operators.quality import Rule, missing, not_in, not_like, violations


class Moved(Exception):
    """The table has a newer version than the one that was built upon."""


def manifest_rules(source_types: list[str]) -> list[Rule]:
    """What a document to be taken in must satisfy; repeated ids and links are checked over all rows."""
    text = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit(""))))
    day = F.coalesce(F.col("publish_time"), F.lit(""))
    return [
        not_like("doc_id", "^[A-Za-z0-9_-]+$"), missing("doc_id"), Rule("invalid_source_type", ~F.coalesce(F.col("source_type").isin(*source_types), F.lit(False))),
        Rule("malformed_publish_time", ~day.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") | F.try_to_date(day, "yyyy-M-d").isNull()),
        Rule("malformed_url", ~F.coalesce(F.col("url"), F.lit("")).rlike(r"^https?://[^/?#]+")), Rule("short_text", (text("title") < 6) | (text("content") < 40)),
    ]


def target_rules(name: str) -> list[Rule]:
    """What a row of a released target must satisfy: whole, of its period, a number, and released after the period ends."""
    end, release = parse_day(F.col("period_end")), parse_day(F.col("release_date"))
    fields = ("target_name", "period_start", "period_end", "target_value", "release_date", "source_url")
    return [
        *[missing(c) for c in fields], Rule("wrong_period", end.isNull() | (parse_day(F.col("period_start")) != period_start(end)) | (end != period_end(end))), not_in("target_name", [name]),
        Rule("not_a_number", F.col("target_value").isNotNull() & F.col("target_value").try_cast("double").isNull()), Rule("released_too_early", release <= end), not_like("source_url", "^https?://"),
    ]


def repeated(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, violation) of all rows that share a value of ``column`` with another row."""
    many = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(column)
    return df.join(many, column, "left_semi").select(key, F.lit(f"repeated_{column}").alias("violation"))


def broken_rules(df: DataFrame, rules: list[Rule], key: str, unique: list[str]) -> DataFrame:
    """(key, violation): a row for each rule that a row breaks, and for each value that must be unique and isn't."""
    out = violations(df, [key], rules, unique=False)
    for column in unique:
        out = out.unionByName(repeated(df, column, key) if column != key else df.join(df.groupBy(key).count().filter("count > 1").select(key), key, "left_semi").select(key, F.lit(f"repeated_{key}").alias("violation")))
    return out


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def versions(spark: SparkSession, root: str) -> list[int]:
    files, folder = _files(spark, f"{root}/versions")
    return sorted(int(s.getPath().getName()) for s in files.listStatus(folder)) if files.exists(folder) else []


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """What a version is made of; the newest unless one is given, version 0 before the first."""
    known = versions(spark, root)
    version = (known[-1] if known else 0) if version is None else version
    if not version:
        return {"version": 0, "parts": []}
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{root}/versions/{version:010d}").collect()))


def create_once(spark: SparkSession, path: str, content: dict) -> None:
    """Write a small file that must not exist yet."""
    files, name = _files(spark, path)
    try:
        out = files.create(name, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()) or files.exists(name):
            raise Moved(path) from e
        raise
    out.write(bytearray((json.dumps(content, ensure_ascii=False) + "\n").encode()))
    out.close()


def read(spark: SparkSession, root: str, schema, version: int | None = None) -> DataFrame:
    """The rows of a version; none before the first."""
    paths = [p["path"] for p in manifest(spark, root, version)["parts"]]
    return spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in paths]) if paths else spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Staged:
    """Rows that wait to be swapped in: where they are, on which version they build, and what is wrong with them."""

    path: str
    base: int
    rows: int
    digest: str
    broken: dict[str, int]


def stage(incoming: DataFrame, root: str, rules: list[Rule], key: str, unique: list[str], by_key: bool = True) -> Staged:
    """Merge ``incoming`` into the newest version by ``key``, write the result and a report of every broken rule, and change nothing.

    Rules are checked on incoming rows; what must be unique is checked on incoming rows, then on the merged ones.
    """
    spark, name = incoming.sparkSession, f"data/{uuid.uuid4().hex}"
    now = manifest(spark, root)
    existing = read(spark, root, incoming.schema, now["version"])
    faults = broken_rules(incoming, rules, key, unique)
    merged = upsert(existing, incoming, key) if by_key else existing.unionByName(incoming)
    for column in unique:
        if column != key:
            faults = faults.unionByName(repeated(merged, column, key).select(key, F.lit(f"repeated_{column}_after_merge").alias("violation")))
    faults.write.parquet(f"{root}/reports/{name}")
    broken = {r["violation"]: r["count"] for r in spark.read.schema(faults.schema).parquet(f"{root}/reports/{name}").groupBy("violation").count().collect()}  # a row for each rule
    merged.write.parquet(f"{root}/{name}")
    sums = row_digest(spark.read.schema(incoming.schema).parquet(f"{root}/{name}")).first()
    return Staged(name, now["version"], sums["rows"], sums["digest"], broken)


def commit(spark: SparkSession, root: str, staged: Staged) -> int:
    """Make staged rows the next version, in one step; fails if a rule is broken, or with Moved if the base isn't the newest any more."""
    if staged.broken:
        raise ValueError(f"broken rules: {dict(sorted(staged.broken.items()))}")
    version = staged.base + 1
    if manifest(spark, root)["version"] != staged.base:
        raise Moved(root)
    create_once(spark, f"{root}/versions/{version:010d}", {"version": version, "rows": staged.rows, "digest": staged.digest, "parts": [{"part": None, "path": staged.path}]})
    return version


def fingerprints(source: DataFrame, by: str) -> DataFrame:
    """(part, fingerprint) of each partition of a file source, from its files' names, sizes and times: no row is read."""
    files = source.select(F.col(by).cast("string").alias("part"), F.concat_ws("|", "_metadata.file_name", F.col("_metadata.file_size"), F.col("_metadata.file_modification_time").cast("string")).alias("file")).distinct()
    return files.groupBy("part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("file")), "\n"), 256).alias("fingerprint"))


def derive(source: DataFrame, by: str, root: str, build: Callable[[DataFrame], DataFrame], engine: str = "1") -> dict[str, list[str]]:
    """Bring a derived table up to date: only partitions whose files changed, or all after a change of ``engine``, are built; others are named again.

    source: a file source partitioned by ``by``; build: rows of some partitions to derived rows that keep ``by``.  Gives the parts that
    were built, kept and dropped; nothing is written where nothing changed.
    """
    spark = source.sparkSession
    now = {r["part"]: r["fingerprint"] for r in fingerprints(source, by).collect()}  # a row for each partition
    before = manifest(spark, root)
    old = {p["part"]: p for p in before["parts"]} if before.get("engine") == engine else {}
    build_ = sorted(p for p, f in now.items() if old.get(p, {}).get("fingerprint") != f)
    kept = sorted(set(now) - set(build_))
    done = {"built": build_, "kept": kept, "dropped": sorted({p["part"] for p in before["parts"]} - set(now))}
    if not build_ and not done["dropped"] and old:
        return done
    name = f"data/{uuid.uuid4().hex}"
    if build_:
        rows = build(source.filter(F.col(by).cast("string").isin(*build_)))
        rows.withColumn("__part", F.col(by).cast("string")).write.partitionBy("__part").parquet(f"{root}/{name}")
    files, _ = _files(spark, root)
    path = lambda p: f"{name}/__part={p}"
    some = [p for p in build_ if files.exists(_files(spark, f"{root}/{path(p)}")[1])]  # a part can derive to nothing
    parts = [old[p] for p in kept] + [{"part": p, "fingerprint": now[p], "path": path(p)} for p in some]
    version = before["version"] + 1
    create_once(spark, f"{root}/versions/{version:010d}", {"version": version, "engine": engine, "parts": sorted(parts, key=lambda p: p["part"])})
    return done


def repair(corrections: DataFrame, root: str, schema, key: str, by: str, at: str) -> DataFrame:
    """Replace rows of a derived table by their latest correction (largest ``at``) in a new version; only parts with a corrected key are written.

    corrections: the table's columns and ``at``.  Gives the audit: table_part, key, status (replaced, or added where the key was unknown).
    """
    spark = corrections.sparkSession
    now = manifest(spark, root)
    last = corrections.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(at)))).filter("__n = 1").drop("__n", at)
    touched = {r[0] for r in last.select(F.col(by).cast("string")).distinct().collect()}  # a row for each partition
    held = [p for p in now["parts"] if p["part"] in touched]
    rows = spark.read.schema(schema).parquet(*[f"{root}/{p['path']}" for p in held]) if held else spark.createDataFrame([], schema)
    names = [f.name for f in schema.fields]
    audit = last.join(rows.select(key, F.lit(True).alias("__known")), key, "left").select(F.col(by).cast("string").alias("table_part"), key, F.when(F.col("__known"), "replaced").otherwise("added").alias("status"))
    name = f"data/{uuid.uuid4().hex}"
    audit.write.parquet(f"{root}/audits/{name}")
    upsert(rows.select(*names), last.select(*names), key).withColumn("__part", F.col(by).cast("string")).write.partitionBy("__part").parquet(f"{root}/{name}")
    parts = [p for p in now["parts"] if p["part"] not in touched] + [{"part": p, "fingerprint": None, "path": f"{name}/__part={p}"} for p in sorted(touched)]
    create_once(spark, f"{root}/versions/{now['version'] + 1:010d}", {"version": now["version"] + 1, "engine": now.get("engine"), "parts": sorted(parts, key=lambda p: p["part"])})
    return spark.read.schema(audit.schema).parquet(f"{root}/audits/{name}")
