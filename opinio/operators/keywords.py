"""Word counts, TF-IDF features in relational form, and keywords."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinio.functions import text
from opinio.functions.rates import percent
from opinio.operators.ranking import top_k
from opinio.operators.tokens import one_per_row
from opinio.session import keep, kept

# Vocabulary limits.
MAX_FEATURES = 10_000
MIN_DF = 2
MAX_DF = 0.85


def word_frequency(df: DataFrame, column: str = "normalized_text", k: int = 15) -> DataFrame:
    """The ``k`` most frequent white-space words over all rows."""
    counts = (
        one_per_row(df, text.words(column), "word")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_k(counts, k, F.desc("n"), F.asc("word"))


def laid_out(df: DataFrame, key: str, column: str) -> DataFrame:
    """Texts shuffled by document. Every branch of a query that starts here shares the
    one shuffle, and with it the work of preparing the text."""
    return df.select(key, column).repartition(key)


def document_terms(df: DataFrame, key: str, column: str, stops: Iterable[str] | None = None) -> DataFrame:
    """``(key, term, tf)``. Texts are laid out by document before they are taken apart.

    That one shuffle moves whole texts, which are smaller than their term rows; counting
    terms per document and any window over a document then work on the same layout.
    """
    kept = text.remove_stopwords(text.terms(column), text.chosen_stops(stops), exact=True)
    return (
        one_per_row(laid_out(df, key, column), kept, "term", key)
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def vocabulary(
    terms: DataFrame,
    documents: int,
    max_features: int = MAX_FEATURES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
) -> DataFrame:
    """``(term, df, cf)`` of the terms kept as features: by document frequency limits,
    then the most frequent ``max_features``."""
    stats = terms.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")
    )
    return kept_terms(stats, documents, max_features, min_df, max_df)


def kept_terms(stats: DataFrame, documents: int, max_features: int, min_df: int, max_df: float) -> DataFrame:
    """Of the counted terms ``(term, df, cf)`` those that ``vocabulary`` keeps."""
    kept = stats.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.lit(documents)))
    return top_k(kept, max_features, F.desc("cf"), F.asc("term"))


def tfidf(
    df: DataFrame,
    key: str,
    column: str,
    stops: Iterable[str] | None = None,
    max_features: int = MAX_FEATURES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    documents: int | None = None,
) -> DataFrame:
    """``(key, term, tf, weight)`` with ``tf * (ln((1+n)/(1+df)) + 1)`` and unit rows."""
    n = df.count() if documents is None else documents
    # Texts are taken apart once; vocabulary and weights both read these rows.
    terms = keep(document_terms(df, key, column, stops))
    # At most max_features rows: a proven bound for the broadcast.
    vocab = F.broadcast(vocabulary(terms, n, max_features, min_df, max_df).select("term", "df"))
    raw = F.col("tf") * (F.log(F.lit(1.0 + n) / (F.lit(1) + F.col("df"))) + 1)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return (
        terms.join(vocab, "term")
        .withColumn("raw", raw)
        .withColumn("weight", F.col("raw") / norm)
        .select(key, "term", "tf", "df", "weight")
    )


def keywords(
    df: DataFrame,
    key: str,
    column: str,
    k: int = 20,
    stops: Iterable[str] | None = None,
    **limits,
) -> DataFrame:
    """Top ``k`` terms by summed TF-IDF weight with frequency and document share.

    ``frequency`` counts white-space tokens equal to the keyword; ``doc_count`` counts
    documents holding it as a whole word in any case; the share is over all rows.
    """
    # Texts are worked out once, for their number, terms and words.
    df = df.select(key, column) if kept(df) else keep(df.select(key, column))
    n = df.count()
    weights = tfidf(df, key, column, stops, documents=n, **limits)
    scored = weights.groupBy("term").agg(
        F.sum("weight").alias("score"), F.first("df").alias("doc_count")
    )
    top = top_k(scored, k, F.desc(F.round("score", 6)), F.asc("term"))
    frequency = (
        one_per_row(df, text.words(column), "term")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )
    return (
        # k rows against the token counts.
        frequency.join(F.broadcast(top), "term", "right")
        .select(
            F.col("term").alias("keyword"),
            "score",
            F.coalesce("frequency", F.lit(0)).alias("frequency"),
            "doc_count",
            percent("doc_count", F.lit(n)).alias("doc_pct"),
        )
        .orderBy(F.desc(F.round("score", 6)), "keyword")
    )
