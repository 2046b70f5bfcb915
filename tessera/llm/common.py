"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once by a kernel; keeps a task's temporary arrays near 25 MB.
CHUNK_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where that is unset and all runs on one machine, a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a key, at least, for what belongs to the key to be sent to them, and bound on the number of such keys.
LEAST_SENT, MOST_SENT = 500, 100_000


def often_and_seldom(totals: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """``totals`` (k: rows of a key, n in all) in two: keys with so many rows that fewer than MOST_SENT such keys exist, and the others."""
    least = max(LEAST_SENT, n // MOST_SENT)
    return totals.filter(F.col("k") > least), totals.filter(F.col("k") <= least)


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    path = path.split(":", 1)[1] if path.startswith("file:") else path
    return (pa.fs.LocalFileSystem(), path) if "://" not in path else pa.fs.FileSystem.from_uri(path)


def write_file(folder: str, content: bytes) -> str:
    """Write a new file of the shared folder and name it; a task that runs twice writes two, and its result names one."""
    files, name = _place(folder)
    own = uuid.uuid4().hex
    files.create_dir(name, recursive=True)
    with files.open_output_stream(f"{name}/{own}") as out:
        out.write(content)
    return f"{folder}/{own}"


def read_file(path: str) -> np.ndarray:
    """The bytes of a file that write_file wrote: mapped, where the folder is mounted, else read."""
    files, name = _place(path)
    if not files.get_file_info(name).size:
        return np.zeros(0, np.uint8)
    if isinstance(files, pa.fs.LocalFileSystem):
        return np.memmap(name, np.uint8, "r")
    with files.open_input_stream(name) as stream:
        return np.frombuffer(stream.read(), np.uint8)


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it needs not to be a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[where[0] : where[-1]], where - where[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``most`` bytes of column ``text``; a longer text is a slice of its own."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64))
        first = 0
        while first < len(size):
            before = size[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(size, before + most, side="right")))
            yield batch.slice(first, last - first)
            first = last


def sizes_in(df: DataFrame, text: str) -> tuple[int, int]:
    """Rows and bytes of text in all of ``df``."""
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return int(rows), int(size)
