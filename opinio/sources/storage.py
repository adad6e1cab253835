"""Stored review tables: scan, write, append, upsert, delete, export.

A table is a folder of numbered snapshots, each an ordinary Spark output folder. A
rewrite goes to the next number and counts only once Spark has marked it complete, so
readers never see half a write and a rewrite never overwrites what it reads.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinio.columns import REVIEW_SCHEMA

_PREFIX = "snapshot-"


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _path(spark, path)
    return fs.exists(target)


def current_snapshot(spark: SparkSession, table: str) -> str | None:
    """Path of the newest complete snapshot."""
    fs, target = _path(spark, table)
    if not fs.exists(target):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    numbers = sorted((int(n[len(_PREFIX) :]) for n in names if n.startswith(_PREFIX)), reverse=True)
    for number in numbers:
        snapshot = f"{table}/{_PREFIX}{number:08d}"
        if exists(spark, f"{snapshot}/_SUCCESS"):
            return snapshot
    return None


def _next_snapshot(spark: SparkSession, table: str) -> str:
    fs, target = _path(spark, table)
    names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
    used = [int(n[len(_PREFIX) :]) for n in names if n.startswith(_PREFIX)]
    return f"{table}/{_PREFIX}{max(used, default=0) + 1:08d}"


def read_any(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """Read CSV or Parquet; a missing path gives an empty frame of the schema."""
    schema = schema or (REVIEW_SCHEMA if fmt == "csv" else None)
    if not exists(spark, path):
        return spark.createDataFrame([], schema or REVIEW_SCHEMA)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        return reader.options(header=True, multiLine=True, escape='"').csv(path)
    return reader.option("mergeSchema", schema is None).parquet(path)


def equals_all(df: DataFrame, filters: Mapping[str, object] | None) -> Column:
    """AND of the equality filters over columns the frame has; others are ignored."""
    out = F.lit(True)
    for name, value in (filters or {}).items():
        if name in df.columns:
            out = out & (F.col(name) == F.lit(value))
    return out


def retrieve(
    spark: SparkSession,
    table: str,
    filters: Mapping[str, object] | None = None,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    """Current rows of a stored table, filtered; the filters reach the scan."""
    snapshot = current_snapshot(spark, table)
    df = read_any(spark, snapshot or table + "/none", fmt, schema)
    return df.filter(equals_all(df, filters)) if filters else df


def _write(df: DataFrame, path: str, fmt: str, mode: str, by_year: bool) -> None:
    writer = df.write.mode(mode)
    if by_year:
        writer = df.withColumn("date_year", F.year("date")).write.mode(mode).partitionBy("date_year")
    if fmt == "csv":
        writer.options(header=True, escape='"').csv(path)
    else:
        writer.parquet(path)


def store(
    df: DataFrame, table: str, append: bool = False, fmt: str = "parquet", by_year: bool = False
) -> str:
    """Write a table, replacing it or adding to it; returns the snapshot's path.

    Appending adds files and rewrites nothing; columns are united by name on read.
    """
    spark = df.sparkSession
    snapshot = current_snapshot(spark, table) if append else None
    if append and fmt == "csv" and snapshot:
        # CSV files have no column names to unite by, so the table is rewritten.
        old = read_any(spark, snapshot, fmt, df.schema)
        return replace_table(old.unionByName(df, allowMissingColumns=True), table, fmt)
    target = snapshot or _next_snapshot(spark, table)
    _write(df, target, fmt, "append" if append else "overwrite", by_year)
    return target


def replace_table(df: DataFrame, table: str, fmt: str = "parquet", by_year: bool = False) -> str:
    """Write the next snapshot; ``df`` may read the current one."""
    target = _next_snapshot(df.sparkSession, table)
    _write(df, target, fmt, "overwrite", by_year)
    return target


def upsert(stored: DataFrame, update: DataFrame, key: str = "review_id") -> DataFrame:
    """Stored rows whose key is not in the update, followed by every update row.

    Null keys match null keys. Keys are deduplicated before the anti join, so a key that
    fills a third of the update weighs no more than any other.
    """
    for df in (stored, update):
        if key not in df.columns:
            raise ValueError(f"key column {key!r} not found")
    keys = update.select(F.col(key).alias("_key")).distinct()
    kept = stored.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    return kept.unionByName(update, allowMissingColumns=True)


def update_table(update: DataFrame, table: str, key: str = "review_id", fmt: str = "parquet") -> str:
    spark = update.sparkSession
    if current_snapshot(spark, table) is None:
        return store(update, table, fmt=fmt)
    schema = update.schema if fmt == "csv" else None
    return replace_table(upsert(retrieve(spark, table, fmt=fmt, schema=schema), update, key), table, fmt)


def delete_matching(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Drop rows that match ANY filter; nulls survive, unknown columns are ignored."""
    hit = F.lit(False)
    for name, value in filters.items():
        if name in df.columns:
            hit = hit | F.col(name).eqNullSafe(F.lit(value))
    return df.filter(~hit)


def delete_rows(
    spark: SparkSession,
    table: str,
    filters: Mapping[str, object] | None = None,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
) -> str | None:
    """Delete matching rows, or every row when there is no filter."""
    if current_snapshot(spark, table) is None:
        return None
    stored = retrieve(spark, table, fmt=fmt, schema=schema)
    kept = delete_matching(stored, filters) if filters else spark.createDataFrame([], stored.schema)
    return replace_table(kept, table, fmt)


def load_reviews(
    spark: SparkSession,
    folder: str,
    prepare,
    raw: str = "reviews",
    processed: str = "processed_reviews",
    fmt: str = "parquet",
) -> DataFrame:
    """The processed table if stored, else the raw one prepared and stored for next time."""
    if current_snapshot(spark, f"{folder}/{processed}") is None:
        rows = retrieve(spark, f"{folder}/{raw}", fmt=fmt)
        store(prepare(rows), f"{folder}/{processed}")
    return retrieve(spark, f"{folder}/{processed}")


def newest_first(df: DataFrame, date: str = "date", key: str = "review_id") -> DataFrame:
    """Global order by date, the key splitting days too large for one task."""
    return df.orderBy(F.desc(date), F.asc(key))


def export_csv(df: DataFrame, path: str) -> str:
    """Newest first, as CSV part files whose names follow the order."""
    newest_first(df).write.mode("overwrite").options(header=True, escape='"').csv(path)
    return path


def export_charts(tables: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Every chart table as JSON lines under its name."""
    out = {}
    for name, table in tables.items():
        out[name] = f"{folder}/{name}"
        table.write.mode("overwrite").json(out[name])
    return out
