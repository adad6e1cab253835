"""Canonical review schema, column aliases and text-column choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("date", T.TimestampType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("thumbsUpCount", T.IntegerType()),
        T.StructField("replyContent", T.StringType()),
        T.StructField("repliedAt", T.TimestampType()),
    ]
)

# Accepted aliases, target <- source.
COLUMN_ALIASES = {
    "text": ("content",),
    "rating": ("score",),
    "date": ("at",),
    "version": ("reviewCreatedVersion",),
    "sentiment": ("sentiment_category",),
}

# Which text column each analysis prefers.
TEXT_PREFERENCE = {
    "sentiment": ("cleaned_text", "normalized_text", "text"),
    "features": ("normalized_text", "cleaned_text", "text"),
    "word_cloud": ("text", "cleaned_text", "normalized_text", "review_text"),
}

# Metadata kept with an indexed document.
METADATA_FIELDS = (
    "review_id",
    "author",
    "date",
    "rating",
    "version",
    "sentiment",
    "primary_topic",
    "topic_confidence",
    "thumbsUpCount",
    "repliedAt",
    "timestamp",
)


def require(df: DataFrame, *names: str) -> DataFrame:
    """Raise before planning when a needed column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return df


def with_aliases(df: DataFrame, names: Sequence[str] = ("text", "rating", "date")) -> DataFrame:
    """Copy alias columns to their standard names where the standard one is absent.

    A frame with no text column at all gets an empty one.
    """
    present = set(df.columns)
    added: dict[str, Column] = {}
    for target in names:
        if target in present:
            continue
        source = next((a for a in COLUMN_ALIASES.get(target, ()) if a in present), None)
        if source is not None:
            added[target] = F.col(source)
        elif target == "text":
            added[target] = F.lit("")
    return df.withColumns(added) if added else df


def text_column(df: DataFrame, purpose: str, default: str | None = None) -> str:
    """The first column of the purpose's preference list that the frame has."""
    for name in TEXT_PREFERENCE[purpose]:
        if name in df.columns:
            return name
    if default and default in df.columns:
        return default
    raise ValueError(f"no text column for {purpose}")


def has_text(column: Column | str) -> Column:
    """True for rows that carry text; null counts as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.length(column) > 0, F.lit(False))
