"""URL rules found through a sorted array of digests.

The index of a rule list is blocks of bytes, each with the sorted 64-bit xxhash
digests of the rules (host, NUL, path) that fall into it by their remainder, and the rules'
strings in the same order.  Tasks write the blocks, of about BLOCK_BYTES each, to the
shared folder; the workers map those that they touch.  A batch of urls makes its keys
(each enclosing domain of the host, with each prefix of the path whose length some
rule has), finds all of them at once by binary search in the block of their remainder, and
every digest that is found is confirmed against the stored string.

A rule fits its host and all subdomains if the url's path starts with the rule's
path.  The longest fitting rule wins (host + path; then the longer host); without
one the verdict is the method's: a url that no listed digest confirms is allowed.

Defined results: a null url, or one without ``://``, has empty host and path and
is allowed; an empty host fits no rule; repeated rows are judged alike; a rule
given twice counts once, and ``block`` wins over ``allow``; rules with a null or an
empty host, or another null, are left out; without rules all is allowed; other
columns stay, except that host, path, rule and verdict are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read_file, shared_folder, write_file

#: Bytes of rules in a block of the index, about.
BLOCK_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(keys: list[str]) -> np.ndarray:
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(k) for k in keys), np.uint64, len(keys))


def key_of(host: str, path: str) -> str:
    return f"{host}\0{path}"


def build_block(rules: list[Rule]) -> bytes:
    """Number of rules (distinct by host and path), digests, ends of the strings, and the strings ``verdict host path``; sorted by digest and key."""
    keys = [key_of(host, path) for _, host, path in rules]
    digests = digest(keys)
    order = sorted(range(len(rules)), key=lambda i: (int(digests[i]), keys[i]))
    strings = [f"{rules[i][0]}\0{keys[i]}".encode() for i in order]
    return np.int64(len(rules)).tobytes() + digests[order].tobytes() + np.cumsum([len(x) for x in strings], dtype=np.int64).tobytes() + b"".join(strings)


class Block:
    """A mapped block."""

    def __init__(self, raw: np.ndarray):
        n = int(raw[:8].view(np.int64)[0])
        self.keys, self.ends = raw[8 : 8 + 8 * n].view(np.uint64), raw[8 + 8 * n : 8 + 16 * n].view(np.int64)
        self.strings = raw[8 + 16 * n :]

    def rule(self, i: int) -> Rule:
        return tuple(bytes(self.strings[self.ends[i - 1] if i else 0 : self.ends[i]]).decode().split("\0", 2))  # type: ignore[return-value]


class Index:
    """The blocks of all rules, mapped as they are touched."""

    def __init__(self, files: dict[int, str], blocks: int, lengths: list[int]):
        self.files, self.blocks, self.lengths = files, blocks, lengths
        self.open: dict[int, Block] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": {}}

    def block(self, k: int) -> Block:
        if k not in self.open:
            self.open[k] = Block(read_file(self.files[k]))
        return self.open[k]

    def confirmed(self, sought: np.ndarray, keys: list[str]) -> Iterator[tuple[int, Rule]]:
        """(index, rule) of each key that a rule has."""
        own = (sought % np.uint64(self.blocks)).astype(np.int64)
        for k in np.unique(own):
            if int(k) not in self.files:
                continue
            block, some = self.block(int(k)), np.flatnonzero(own == k)
            at = np.searchsorted(block.keys, sought[some])
            for j in np.flatnonzero(block.keys[np.minimum(at, len(block.keys) - 1)] == sought[some]):
                i = int(at[j])
                while i < len(block.keys) and block.keys[i] == sought[some[j]]:  # digests may collide: the string decides
                    rule = block.rule(i)
                    if key_of(*rule[1:]) == keys[some[j]]:
                        yield int(some[j]), rule
                    i += 1

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        keys, of = [], []
        for row, (host, path) in enumerate(zip(hosts, paths)):
            starts = [path[:n] for n in self.lengths if n <= len(path)]
            at = 0
            while host and starts:
                keys += [key_of(host[at:], start) for start in starts]
                of += [row] * len(starts)
                at = host.find(".", at) + 1
                if not at:
                    break
        rule: list[str | None] = [None] * len(hosts)
        verdict = ["allow"] * len(hosts)
        best = [(0, 0)] * len(hosts)
        for k, (what, host, path) in self.confirmed(digest(keys), keys):
            if (size := (len(host) + len(path), len(host))) > best[of[k]]:
                rule[of[k]], verdict[of[k]], best[of[k]] = host + path, what, size
        return rule, verdict


def write_index(rules: DataFrame, block_bytes: int = BLOCK_BYTES) -> Index:
    """Index a DataFrame with columns verdict, host, path."""
    folder = f"{shared_folder(rules.sparkSession)}/rules-{uuid.uuid4().hex}"
    distinct = rules.select("verdict", "host", "path").na.drop().filter("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
    size = distinct.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 32)).first()[0] or 0
    blocks = size // block_bytes + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [key_of(h, p) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((digest(keys) % np.uint64(blocks)).astype(np.int64))], names=[*batch.schema.names, "block"])

    def write(table: pa.Table) -> pa.Table:
        file = write_file(folder, build_block(list(zip(*(table.column(c).to_pylist() for c in ("verdict", "host", "path"))))))
        lengths = sorted({len(x) for x in table.column("path").to_pylist()})
        return pa.table({"block": table.column("block")[:1], "file": [file], "lengths": pa.array([lengths], pa.list_(pa.int64()))})

    placed = distinct.mapInArrow(place, "host string, path string, verdict string, block long")
    written = placed.groupBy("block").applyInArrow(write, "block long, file string, lengths array<long>").collect()  # a row for each block of rules
    return Index({r["block"]: r["file"] for r in written}, blocks, sorted({n for r in written for n in r["lengths"]}))


def judge_urls(df: DataFrame, rules: list[Rule] | DataFrame, url: str = "url", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add host, path, rule and verdict.  ``rules``: a list, or a DataFrame with columns verdict, host, path."""
    spark = df.sparkSession
    parts = df.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    index = write_index(rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "verdict string, host string, path string"), block_bytes)
    known = spark.sparkContext.broadcast(index)  # names of the blocks' files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rule, verdict = known.value.judge(batch.column(batch.schema.get_field_index("host")).to_pylist(), batch.column(batch.schema.get_field_index("path")).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict)], names=[*batch.schema.names, "rule", "verdict"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return parts.mapInArrow(run, f"{schema}, rule string, verdict string")


#: The rules of query op4.
QUERY_RULES: list[Rule] = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, QUERY_RULES).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
found AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN found f USING (page_id)
"""
