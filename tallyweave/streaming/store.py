"""The stored feed: what a stream of batches leaves in a folder, and how it is read, compacted and replayed.

``delta/batch=N`` holds the on-time rows of a batch, ``late/batch=N`` the late ones, ``polls/batch=N`` its metrics.
``base/upto=N`` holds all announcements up to a batch, one row each, and ``manifest/upto=N`` says that it is whole: it is
written last. A reader takes the newest base that has a manifest and the batches after it, so its work is bounded by the
state and the batches since; a batch that comes again writes the same folders again, or nothing if a base covers it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..storage import delete
from .feed import LATENESS, feed_watermark, folded_log, linked_status


def _numbers(spark: SparkSession, place: str, key: str) -> list[int]:
    """The N of the folders key=N of a place that were written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    whole = [p.getName() for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in whole if n.startswith(f"{key}="))


def _read(spark: SparkSession, folder: str, kind: str, numbers: list[int]) -> DataFrame | None:
    return spark.read.parquet(*[f"{folder}/{kind}/batch={n}" for n in numbers]) if numbers else None


def polls(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """Metrics of the batches of a folder, or of those before one."""
    return _read(spark, folder, "polls", [n for n in _numbers(spark, f"{folder}/polls", "batch") if before is None or n < before])


def append_batch(batch: DataFrame, batch_id: int, folder: str, failed: bool = False, backfill: bool = False, at: str | None = None) -> None:
    """Sink of ``foreachBatch`` for announcements (source, external_id, announced, status, ...).

    Rows older than the watermark of the batches before, less the lateness, go to the late rows, all others to the log.
    The watermark is made of stored metrics, so a batch that runs again parts its rows alike. ``at`` is the time of the
    poll, now by default. A batch that a base covers changes nothing.
    """
    spark = batch.sparkSession
    if any(n >= batch_id for n in _numbers(spark, f"{folder}/manifest", "upto")):
        return
    now = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    earlier = polls(spark, folder, batch_id)
    rows = batch.withColumns({"batch_id": F.lit(batch_id).cast("long"), "row_no": F.monotonically_increasing_id()})
    if earlier is None:
        rows = rows.withColumn("late", F.lit(False))
    else:  # a row a source
        marks = feed_watermark(earlier).select("source", "watermark")
        rows = rows.join(marks, "source", "left").withColumn("late", F.coalesce(F.col("announced") < F.col("watermark") - F.expr(f"INTERVAL {LATENESS}"), F.lit(False))).drop("watermark")
    seen = Observation()
    rows = rows.observe(seen, F.count("*").alias("rows"), F.count_if("late").alias("late"))
    place = f"{folder}/staged/batch={batch_id}"
    rows.write.mode("overwrite").parquet(place)  # read twice below
    staged = spark.read.schema(rows.schema).parquet(place)
    staged.filter("late").drop("late").write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
    staged.filter("NOT late").drop("late").write.mode("overwrite").parquet(f"{folder}/delta/batch={batch_id}")
    dates = staged.groupBy("source").agg(F.max("announced").alias("max_date"), F.count("*").alias("rows"), F.count_if("late").alias("late"))
    known = earlier.select("source").distinct() if earlier is not None else None
    if known is not None:  # a source without rows in this batch was polled as well
        dates = dates.join(known, "source", "full")
    counted = seen.get
    dates.select("source", F.lit(batch_id).cast("long").alias("batch_id"), "max_date", F.lit(failed).alias("failed"), F.lit(backfill).alias("backfill"), now.alias("at"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("late", F.lit(0)).alias("late"), F.lit(counted["rows"]).alias("batch_rows")).write.mode("overwrite").parquet(f"{folder}/polls/batch={batch_id}")
    delete(spark, place)


def _folded(spark: SparkSession, folder: str) -> tuple[DataFrame | None, int | None]:
    bases = _numbers(spark, f"{folder}/manifest", "upto")
    upto = bases[-1] if bases else None
    deltas = [n for n in _numbers(spark, f"{folder}/delta", "batch") if upto is None or n > upto]
    rows = _read(spark, folder, "delta", deltas)
    if upto is not None:
        base = spark.read.parquet(f"{folder}/base/upto={upto}")
        rows = base if rows is None else base.unionByName(rows, allowMissingColumns=True)
    return (None if rows is None else folded_log(rows)), (deltas[-1] if deltas else upto)


def stored_announcements(spark: SparkSession, folder: str) -> DataFrame | None:
    """The state of each announcement, or None if the folder has none."""
    rows, _ = _folded(spark, folder)
    return None if rows is None else linked_status(rows)


def stored_late_rows(spark: SparkSession, folder: str) -> DataFrame | None:
    return _read(spark, folder, "late", _numbers(spark, f"{folder}/late", "batch"))


def compact(spark: SparkSession, folder: str) -> int | None:
    """Fold the log up to its last batch into a new base, then its manifest; older bases and the batches in it go. Returns
    the last batch in the base. A compaction that breaks off leaves the older base in force and is done again."""
    rows, upto = _folded(spark, folder)
    bases = _numbers(spark, f"{folder}/manifest", "upto")
    if rows is None or upto in bases:
        return upto
    rows.write.mode("overwrite").parquet(f"{folder}/base/upto={upto}")
    count = spark.read.parquet(f"{folder}/base/upto={upto}").count()
    spark.range(1).select(F.lit(upto).cast("long").alias("upto"), F.lit(count).alias("rows")).write.mode("overwrite").parquet(f"{folder}/manifest/upto={upto}")
    for n in bases:
        delete(spark, f"{folder}/manifest/upto={n}", f"{folder}/base/upto={n}")
    for n in _numbers(spark, f"{folder}/delta", "batch"):
        if n <= upto:
            delete(spark, f"{folder}/delta/batch={n}")
    return upto
