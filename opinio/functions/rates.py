"""Rating classes, percentages and conditional rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATINGS = (1, 2, 3, 4, 5)
SENTIMENTS = ("positive", "neutral", "negative")

# Rating and compound-score class boundaries.
POSITIVE_RATING = 4
NEGATIVE_RATING = 2
COMPOUND_BOUND = 0.05


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rating_sentiment(rating: Column | str = "rating") -> Column:
    """Sentiment class of a rating; a missing rating is neutral, like any in between."""
    rating = _col(rating)
    return (
        F.when(rating >= POSITIVE_RATING, "positive")
        .when(rating <= NEGATIVE_RATING, "negative")
        .otherwise("neutral")
    )


def compound_sentiment(compound: Column | str) -> Column:
    compound = _col(compound)
    return (
        F.when(compound >= COMPOUND_BOUND, "positive")
        .when(compound <= -COMPOUND_BOUND, "negative")
        .otherwise("neutral")
    )


def is_negative(rating: Column | str = "rating") -> Column:
    return _col(rating) <= NEGATIVE_RATING


def is_positive(rating: Column | str = "rating") -> Column:
    return _col(rating) >= POSITIVE_RATING


def percent(part: Column | str, whole: Column | str) -> Column:
    """``100 * part / whole``, null when the whole is zero."""
    return F.lit(100.0) * _col(part) / F.nullif(_col(whole), F.lit(0))


def has_response(replied_at: Column | str = "replied_at") -> Column:
    return _col(replied_at).isNotNull()


def rate(flag: Column) -> Column:
    """Share of true values; null flags count as false."""
    return F.avg(F.coalesce(flag, F.lit(False)).cast("int"))
