"""Tables between the rounds of iterative jobs: written to the folder that all executors share, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder where it is unset in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallyweave-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once: the plan behind it is cut, and a lost executor costs its tasks only."""
    place = new_place(df.sparkSession, name)
    df.write.parquet(place)
    out = df.sparkSession.read.schema(df.schema).parquet(place)
    out.place = place
    return out


def written_with(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """The same, and what is counted of its rows while they are written."""
    seen = Observation()
    out = written(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), name)
    return out, {n: seen.get.get(n) or 0 for n in counts}


def delete(spark: SparkSession, *places: str) -> None:
    for place in places:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.place)


def in_ranges(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` written in ranges of (group, order), sorted, with ``range_no`` and ``range_at``, the place in it: a group of
    any size lies in as many neighbouring ranges as it needs."""
    keys = [*[F.col(c) for c in group], *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(rows.withColumns({"range_no": F.spark_partition_id(), "range_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), name)


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with ``place``, from 0 and without gaps in each group: counted within ranges, and only a row for each range
    and group is summed up. Columns of ``group`` hold no nulls."""
    rows = in_ranges(df, group, order, name)
    parts = rows.groupBy("range_no", *group).agg(F.min("range_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("range_no", *group, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(parts, ["range_no", *group]).withColumn("place", F.col("range_at") + F.col("_shift")).drop("range_no", "range_at", "_shift")
