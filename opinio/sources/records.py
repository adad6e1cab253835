"""Raw store records to canonical reviews, and batch ingest."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.functions import dates
from opinio.operators.ranking import first_per_key, top_k

# Raw field, canonical name, type, default of a missing field.
RAW_FIELDS = (
    ("reviewId", "review_id", "string", ""),
    ("userName", "author", "string", ""),
    ("score", "rating", "int", 0),
    ("content", "text", "string", ""),
    ("reviewCreatedVersion", "version", "string", ""),
)
RAW_OPTIONAL = (
    ("thumbsUpCount", "thumbsUpCount", "int"),
    ("replyContent", "replyContent", "string"),
)


def normalize_records(raw: DataFrame) -> DataFrame:
    """Raw API field names to the canonical schema.

    A field the source does not carry gets its default; null values stay null. The date
    comes from ``at`` (epoch seconds or ISO text), else from ``timeMillis``.
    """
    have = set(raw.columns)

    def field(name: str, kind: str, default: object) -> Column:
        return F.col(name).try_cast(kind) if name in have else F.lit(default).cast(kind)

    at = F.col("at") if "at" in have else F.lit(None).cast("string")
    millis = F.col("timeMillis") if "timeMillis" in have else None
    columns = [field(src, kind, default).alias(name) for src, name, kind, default in RAW_FIELDS]
    columns.append(dates.parse_timestamp(at, millis).alias("date"))
    columns.append(at.alias("timestamp"))
    columns += [F.col(s).try_cast(k).alias(n) for s, n, k in RAW_OPTIONAL if s in have]
    if "repliedAt" in have:
        columns.append(dates.parse_timestamp("repliedAt").alias("repliedAt"))
    return raw.select(*columns)


def merge_batches(batches: Sequence[DataFrame], key: str = "reviewId", target: int | None = None) -> DataFrame:
    """Union of batches in their order; the first copy of each id wins.

    With a target the earliest batches fill it first.
    """
    merged = None
    for number, batch in enumerate(batches):
        numbered = batch.withColumn("_batch", F.lit(number))
        merged = numbered if merged is None else merged.unionByName(numbered, allowMissingColumns=True)
    return dedupe_batches(merged, "_batch", key, target).drop("_batch")


def dedupe_batches(
    merged: DataFrame, batch: str | Column, key: str, target: int | None = None, *order: Column
) -> DataFrame:
    """First copy of each id by batch (then ``order``), cut at ``target`` if given."""
    batch = F.col(batch) if isinstance(batch, str) else batch
    unique = first_per_key(merged, key, batch.asc(), *order)
    return unique if target is None else top_k(unique, target, batch.asc(), F.asc(key))


def ingest_filter(
    df: DataFrame,
    start: object = None,
    end: object = None,
    most: int | None = None,
    date: str = "date",
    key: str = "review_id",
    now: datetime | None = None,
) -> DataFrame:
    """Reviews inside ``[start, end]``, newest first, cut at ``most``.

    Bounds may be relative literals; they are resolved on the driver so the comparison
    is pushed to the scan. Rows without a date drop out once a bound is given.
    """
    low, high = dates.resolve_date(start, now), dates.resolve_date(end, now)
    kind = dict(df.dtypes)[date]
    # Literals of the column's own type, so that no cast keeps the filter from the scan.
    if low is not None:
        df = df.filter(F.col(date) >= F.lit(low).cast(kind))
    if high is not None:
        df = df.filter(F.col(date) <= F.lit(high).cast(kind))
    order = (F.desc(date), F.asc(key))
    return df.orderBy(*order) if most is None else top_k(df, most, *order)
