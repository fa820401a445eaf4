"""What the corpus operators share: the cluster's shared folder, words, and word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LETTERS_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS_LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallyweave-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/") if "://" in folder or folder.startswith("file:/") else "file://" + os.path.abspath(folder)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more, so a long job holds few at a time."""
    discard_folders(*[df.written_to for df in tables])


def discard_folders(*paths: str) -> None:
    for path in paths:
        with contextlib.suppress(OSError, pa.ArrowException):  # the folder's store may not let us; files then stay
            fs, place = pa.fs.FileSystem.from_uri(path)
            fs.delete_dir(place)


def prepare(spark: SparkSession, rows: int = 2000) -> None:
    """Settings for jobs over long texts: fewer rows in an Arrow batch keep Python workers and their buffers small, and
    shuffle files go when the query that made them ends, as every step is written before the next."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator reads, so that other columns can have any name."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def ascii_lower(text: Column) -> Column:
    return F.translate(text, LETTERS_UPPER, LETTERS_LOWER)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column of a batch."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


class WordHashes(dict):
    """64-bit hashes of words; a bounded cache, as words repeat."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of ``width`` word hashes; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    width_here = min(width, len(words))
    total = np.full(len(words) - width_here + 1, width_here, np.uint64)
    for i in range(width_here):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - width_here + 1 + i]
    return mixed(total)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables that hold only whole groups, of batches that are sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if held:
                change[0] |= v[0] != held[-1].column(k)[-1].as_py()
        at = np.flatnonzero(change)
        if held and len(at):
            head = batch.slice(0, int(at[0]))
            yield pa.Table.from_batches([*held, head])
            held, batch, at = [], batch.slice(int(at[0])), at - at[0]
        if len(at) and at[-1] > 0:
            yield pa.Table.from_batches([batch.slice(0, int(at[-1]))])
            batch = batch.slice(int(at[-1]))
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def starts_of(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """First rows of the groups of a sorted table, and its length at the end."""
    change = np.ones(table.num_rows, bool)
    change[1:] = False
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def tidy(run):
    """A task's generator that gives its freed memory back to the system at its end, as Spark keeps Python workers."""

    @functools.wraps(run)
    def with_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return with_release


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``place``, from 0 and without gaps in each group by ``order``, and ``of``, the group's rows.

    Rows are dealt by ranges of (group, order) and counted within their range; a group of any size is spread over as
    many ranges as it needs, and only a row for each range and group is summed up. Columns of ``group`` hold no nulls.
    """
    keys = [*group, *order]
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    sorted_rows = materialize(sorted_rows.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), name)
    parts = sorted_rows.groupBy("_range", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    over = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"_shift": before - F.col("_first"), "of": F.sum("_n").over(over)}).drop("_first", "_n")
    out = sorted_rows.join(parts, ["_range", *group]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")
    out.written_to = sorted_rows.written_to
    return out
