"""Row cleaning, preprocessing and feature columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.columns import METADATA_FIELDS, require, with_aliases
from opinio.functions import dates, rates, text, versions
from opinio.operators.ranking import first_per_key
from opinio.operators.tokens import in_order, join_tokens, lemma_mapping, lookup, stems, together
from opinio.session import keep

# What a missing field reads as after cleaning.
FILLS = {"text": "", "author": "Anonymous", "version": versions.UNKNOWN}
CRITICAL = ("review_id", "date", "rating")


def dedupe(df: DataFrame, *order: Column, key: str = "review_id") -> DataFrame:
    """Keep the first row of each key in an explicit order."""
    return first_per_key(require(df, key), key, *order)


def fill_missing(df: DataFrame, fills: Mapping[str, object] = FILLS) -> DataFrame:
    return df.fillna({c: v for c, v in fills.items() if c in df.columns})


def drop_incomplete(df: DataFrame, subset: Sequence[str] = CRITICAL) -> DataFrame:
    return df.dropna(subset=list(subset))


def clean_reviews(df: DataFrame, *order: Column) -> DataFrame:
    """Deduplicate, fill, squeeze text, add its length, drop incomplete rows.

    The order names which copy of a review wins.
    """
    out = fill_missing(dedupe(df, *order))
    out = out.withColumn("text", text.squeeze("text"))
    out = out.withColumn("text_length", text.text_length("text"))
    return drop_incomplete(out).withColumn("rating", F.col("rating").try_cast("int"))


def repair_numbers(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast text columns to numbers; what is no number becomes null."""
    return df.withColumns(
        {c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns}
    )


def preprocess(
    df: DataFrame,
    column: str = "text",
    stops: Iterable[str] | None = None,
    lemmas: Mapping[str, str] | DataFrame | None = None,
    include_tokens: bool = False,
    stem: bool = False,
    key: str = "review_id",
) -> DataFrame:
    """Add ``cleaned_text`` and ``normalized_text`` (and ``tokens``).

    Narrow steps, unless lemmas come as a frame ``(form, lemma)`` of any size or stems are
    asked for: then rows are laid out by ``key``, which must be unique, as one with several
    rows gives them all one text. Words are looked up in a small frame; with a large one they are joined.
    """
    require(df, column)
    stops = text.chosen_stops(stops)
    out = df.withColumn("cleaned_text", text.clean_text(column))
    if isinstance(lemmas, DataFrame) or stem:
        tokens = text.remove_stopwords(text.tokenize("cleaned_text", squeezed=True), stops, exact=True)
        mapping = keep(lemma_mapping(lemmas)) if isinstance(lemmas, DataFrame) else None
        replaced = lookup(mapping) if mapping is not None else None
        out = out.withColumn("_tokens", text.lemmatize(tokens, lemmas) if mapping is None and lemmas else tokens)
        if mapping is not None and replaced is None:
            rows = join_tokens(out.select(key, "_tokens"), key, "_tokens", mapping, "lemmas")
            rows = rows.select(F.col(key).alias("_key"), F.col("lemmas").alias("_tokens"))
            # A null key is one key.
            out = out.drop("_tokens").join(rows, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
            out = out.withColumn("_tokens", stems("_tokens") if stem else F.col("_tokens"))
        else:
            out = out.withColumn("_lists", F.collect_list("_tokens").over(Window.partitionBy(key)))
            out = out.withColumns(together(F.col("_lists"), "_tokens")).drop("_lists")
            out = out.withColumn("_tokens", (replaced or stems)("_tokens"))
            out = out.withColumn("_tokens", in_order("_tokens")).drop("_places")
            if replaced is not None and stem:
                out = out.withColumn("_tokens", stems("_tokens"))
        out = out.withColumn("normalized_text", F.array_join(text.drop_short("_tokens"), " ")).drop("_tokens")
    else:
        out = out.withColumn("normalized_text", text.normalize_text("cleaned_text", stops, lemmas, squeezed=True))
    if include_tokens:
        out = out.withColumn("tokens", text.tokenize("normalized_text"))
    return out


def preprocess_basic(
    df: DataFrame, column: str = "text", stops: Iterable[str] = text.BASIC_STOP_WORDS
) -> DataFrame:
    """Plain variant: basic cleaning and stop-word removal, no token rules."""
    df = require(with_aliases(df), column)
    out = df.withColumn("cleaned_text", text.basic_clean(column))
    kept = text.remove_stopwords(text.words("cleaned_text"), stops, exact=True)
    return out.withColumn("normalized_text", F.array_join(kept, " "))


def add_features(df: DataFrame) -> DataFrame:
    """Sentiment from rating, calendar, text-size and version features."""
    require(df, "rating", "date", "text", "version")
    length = F.col("text_length") if "text_length" in df.columns else text.text_length("text")
    return df.withColumns(
        {
            "sentiment": rates.rating_sentiment("rating"),
            **dates.calendar_features("date"),
            "word_count": text.word_count("text"),
            "avg_word_length": text.avg_word_length("text"),
            "length_category": text.length_category(length),
            "major_version": versions.major_label("version"),
        }
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Non-null count and percentage of every column, from one aggregate row."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns]
    )
    return counts.unpivot("_rows", df.columns, "column_name", "non_null").select(
        "column_name", "non_null", rates.percent("non_null", "_rows").alias("pct")
    )


def date_validity(df: DataFrame, date: str = "date", least: float = 0.5) -> DataFrame:
    """One row ``(valid, n, enough)``: whether enough rows carry a date for time tables."""
    n, valid = F.count(F.lit(1)), F.count(date)
    return df.agg(valid.alias("valid"), n.alias("n"), ((n > 0) & (valid >= least * n)).alias("enough"))


def metadata(df: DataFrame, fields: Sequence[str] = METADATA_FIELDS, skip: Sequence[str] = ()) -> DataFrame:
    """The named fields that exist; everything but plain scalars is turned to text."""
    plain = {"string", "tinyint", "smallint", "int", "bigint", "float", "double", "boolean"}
    types = dict(df.dtypes)
    return df.select(
        *[
            F.col(c) if types[c] in plain else F.col(c).cast("string").alias(c)
            for c in fields
            if c in types and c not in skip
        ]
    )


def without_nulls(fields: Sequence[str]) -> Column:
    """Map of the non-null fields as text, the form a document store keeps."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in fields])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
