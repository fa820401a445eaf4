"""Snapshots of ledger tables: written as JSON in the order of their references, restored only whole and into empty targets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMAT = "ledger-snapshot-2"
#: Tables of the ledger, each after those that it refers to.
LEDGER_TABLES = ["users", "companies", "documents", "entities", "aliases", "merges", "claims", "rejections"]
MANIFEST = "format string, place int, table_name string, table_schema string, rows long, fingerprint string"


def _fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows, and a sum of row hashes that no order changes; one pass with partial sums."""
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(20,0)")
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(whole), F.lit(0)).cast("decimal(38,0)").cast("string")).first()
    return n, total


def _read(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(StructType.fromJson(json.loads(schema))).json(f"{folder}/{name}")


def ledger_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """Write each table as JSON lines in its own folder, in the order of references, and last a manifest with schemas, row
    counts and fingerprints of what was written, so a half-written snapshot has none."""
    rank = {name: k for k, name in enumerate(LEDGER_TABLES)}
    spark, rows = next(iter(tables.values())).sparkSession, []
    for k, name in enumerate(sorted(tables, key=lambda n: rank.get(n, len(rank)))):
        tables[name].write.mode("errorifexists").json(f"{folder}/{name}")
        schema = tables[name].schema.json()
        rows.append((FORMAT, k, name, schema, *_fingerprint(_read(spark, folder, name, schema))))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(f"{folder}/_manifest")


def ledger_restore(spark: SparkSession, folder: str, targets: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Tables of a snapshot in the order in which they can be inserted; every target must be empty, the format known, and
    each table as the manifest has it."""
    rows = spark.read.schema(MANIFEST).json(f"{folder}/_manifest").orderBy("place").collect()  # a row a table
    if not rows or any(r.format != FORMAT for r in rows):
        raise ValueError("not a snapshot of this format")
    full = [name for name, df in (targets or {}).items() if df.limit(1).count()]
    if full:
        raise ValueError(f"not empty: {', '.join(full)}")
    tables = {r.table_name: _read(spark, folder, r.table_name, r.table_schema) for r in rows}
    changed = [r.table_name for r in rows if _fingerprint(tables[r.table_name]) != (r.rows, r.fingerprint)]
    if changed:
        raise ValueError(f"not as written: {', '.join(changed)}")
    return tables


def scan_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Parquet tables of a folder by name; only the columns that a job selects are read."""
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def key_of(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumn("row_key", F.sha2(F.concat_ws("\u001f", *columns), 256))
