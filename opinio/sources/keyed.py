"""Tables laid out by key, of which a change rewrites only the parts it touches.

Rows are partitioned into a fixed number of folders by a hash of their key. An update or
a deletion reads and overwrites the folders of its keys, with Spark's dynamic partition
overwrite; all others keep their files. What is written is staged until the whole job has
ended. Should the final renames be cut short, repeating the change completes it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinio.operators.ranking import first_per_key
from opinio.sources import storage

PART = "key_part"

#: Rows a part is meant to hold where the number of parts is not given.
PART_ROWS = 500_000

#: Parts of a table that begins without rows.
NEW_PARTS = 64


def exists(spark: SparkSession, table: str) -> bool:
    return storage.exists(spark, f"{table}/layout/_SUCCESS")


def _layout(spark: SparkSession, table: str) -> tuple[str, int, T.StructType]:
    row = spark.read.parquet(f"{table}/layout").first()
    return row["key"], row["parts"], T.StructType.fromJson(json.loads(row["schema"]))


def _note(spark: SparkSession, table: str, key: str, parts: int, schema: T.StructType) -> None:
    row = [(key, parts, schema.json())]
    spark.createDataFrame(row, "key string, parts int, schema string").coalesce(1).write.mode("overwrite").parquet(f"{table}/layout")


def _part(key: str, parts: int) -> Column:
    """The part of a key; all null keys share one."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")


def _write(rows: DataFrame, table: str, mode: str) -> None:
    # By range, so that a part with most of the rows is written by many tasks.
    columns = [c for c in rows.columns if c != PART]
    spread = rows.repartitionByRange(PART, F.xxhash64(*columns))
    spread.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{table}/rows")


def create(df: DataFrame, table: str, key: str = "review_id", parts: int | None = None) -> str:
    """Store ``df`` by ``key``. Keys may repeat and may be null."""
    spark = df.sparkSession
    if key not in df.columns:
        raise ValueError(f"key column {key!r} not found")
    parts = parts or max(1, math.ceil(df.count() / PART_ROWS))
    _write(df.withColumn(PART, _part(key, parts)), table, "overwrite")
    _note(spark, table, key, parts, df.schema)
    return table


def retrieve(spark: SparkSession, table: str, parts: Sequence[int] | None = None) -> DataFrame:
    """Rows of a table, or of some of its parts; other parts are not read."""
    _, _, schema = _layout(spark, table)
    rows = _read(spark, table, schema)
    return (rows if parts is None else rows.filter(F.col(PART).isin(list(parts)))).drop(PART)


def _read(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    if not storage.exists(spark, f"{table}/rows"):
        return spark.createDataFrame([], T.StructType([*schema, T.StructField(PART, T.IntegerType())]))
    whole = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema], T.StructField(PART, T.IntegerType())])
    return spark.read.schema(whole).option("basePath", f"{table}/rows").parquet(f"{table}/rows")


def _parts_of(rows: DataFrame) -> list[int]:
    return [r[PART] for r in rows.select(PART).distinct().collect()]  # at most as many as parts


def _placed(rows: DataFrame, key: str, parts: int, schema: T.StructType) -> DataFrame:
    """Rows with the stored type of the key, by which they are placed."""
    if key not in rows.columns:
        raise ValueError(f"key column {key!r} not found")
    return rows.withColumn(key, F.col(key).cast(schema[key].dataType)).withColumn(PART, _part(key, parts))


def upsert(update: DataFrame, table: str) -> list[int]:
    """Replace all stored rows of the update's keys by the update's rows; the parts rewritten.

    As :func:`storage.upsert`: all rows of the update stay, null is a key like any other,
    and columns are united by name.
    """
    spark = update.sparkSession
    key, parts, schema = _layout(spark, table)
    update = _placed(update, key, parts, schema)
    touched = _parts_of(update)
    if not touched:
        return []
    stored = _read(spark, table, schema).filter(F.col(PART).isin(touched))
    rows = storage.upsert(stored, update, key)
    _write(rows, table, "overwrite")
    fields = {f.name for f in schema}
    added = [f for f in rows.schema if f.name not in fields and f.name != PART]
    if added:
        _note(spark, table, key, parts, T.StructType([*schema, *added]))
    return sorted(touched)


def upsert_first(update: DataFrame, table: str, *order: Column) -> list[int]:
    """Upsert where of all rows of a key, stored ones included, the first in order stays."""
    spark = update.sparkSession
    key, parts, schema = _layout(spark, table)
    update = _placed(update, key, parts, schema)
    touched = _parts_of(update)
    keys = update.select(F.col(key).alias("_key")).distinct()
    stored = _read(spark, table, schema).filter(F.col(PART).isin(touched))
    met = stored.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return upsert(first_per_key(met.unionByName(update, allowMissingColumns=True), key, *order).drop(PART), table)


def insert_new(update: DataFrame, table: str, *order: Column) -> list[int]:
    """Append the first row in order of every key that is not stored yet; the parts added to.

    Stored files stay as they are, and only the keys of the parts concerned are read. Doing
    it again adds nothing.
    """
    spark = update.sparkSession
    key, parts, schema = _layout(spark, table)
    update = first_per_key(_placed(update, key, parts, schema), key, *order)
    touched = _parts_of(update)
    known = _read(spark, table, schema).filter(F.col(PART).isin(touched)).select(F.col(key).alias("_key"), F.col(PART).alias("_part"))
    new = update.join(known, F.col(key).eqNullSafe(F.col("_key")) & (F.col(PART) == F.col("_part")), "left_anti")
    _write(new, table, "append")
    return sorted(touched)


def _delete(hit: DataFrame, kept, table: str, spark: SparkSession, schema: T.StructType) -> list[int]:
    touched = _parts_of(hit)
    if not touched:
        return []
    left = kept(_read(spark, table, schema).filter(F.col(PART).isin(touched)))
    # A part that keeps no row gets no new folder: its old one goes at the end.
    emptied = set(touched) - set(_parts_of(left))
    if len(emptied) < len(touched):
        _write(left, table, "overwrite")
    for part in emptied:
        fs, target = storage._path(spark, f"{table}/rows/{PART}={part}")
        fs.delete(target, True)
    return sorted(touched)


def delete_keys(keys: DataFrame, table: str) -> list[int]:
    """Delete the rows of all keys of ``keys``; the parts rewritten, those that held any."""
    spark = keys.sparkSession
    key, parts, schema = _layout(spark, table)
    keys = _placed(keys, key, parts, schema).select(F.col(key).alias("_key"), F.col(PART).alias("_part")).distinct()
    same = lambda rows: F.col(key).eqNullSafe(F.col("_key")) & (F.col(PART) == F.col("_part"))
    stored = _read(spark, table, schema)
    hit = stored.select(key, PART).join(keys, same(stored), "left_semi")
    return _delete(hit, lambda rows: rows.join(keys, same(rows), "left_anti"), table, spark, schema)


def delete_matching(spark: SparkSession, table: str, filters: Mapping[str, object]) -> list[int]:
    """Delete rows that match ANY filter; the parts rewritten, those that held any.

    As :func:`storage.delete_matching`; the filters reach the scan.
    """
    _, _, schema = _layout(spark, table)
    stored = _read(spark, table, schema)
    hit = F.lit(False)
    for name, value in filters.items():
        if name in stored.columns:
            hit = hit | (F.col(name) == F.lit(value))
    return _delete(stored.filter(hit), lambda rows: storage.delete_matching(rows, filters), table, spark, schema)
