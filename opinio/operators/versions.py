"""Rating, sentiment and topic tables by app version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.functions import rates, versions
from opinio.functions.rates import SENTIMENTS, percent
from opinio.operators.distributions import rating_distribution
from opinio.operators.ranking import top_k, top_n_per_key
from opinio.session import keep


def rows() -> Column:
    return F.count(F.lit(1))


def review_cube(df: DataFrame, *keys: str, more: Sequence[Column] = (), missing: bool = False) -> DataFrame:
    """One row per key with every count the version reports need.

    A single grouped pass: reviews, mean rating, sentiment counts and percentages,
    replies and reply rate, and any ``more`` aggregates. Everything else is derived from
    this small frame. Rows without a key count where ``missing``.
    """
    flags = list(more)
    if "sentiment" in df.columns:
        flags += [F.count_if(F.col("sentiment") == s).alias(f"n_{s}") for s in SENTIMENTS]
        flags.append(F.count("sentiment").alias("n_sentiment"))
    if "has_response" in df.columns:
        flags.append(F.count_if(F.col("has_response")).alias("responded"))
    kept = df if missing else df.dropna(subset=list(keys))
    cube = kept.groupBy(*keys).agg(
        rows().alias("n"),
        F.sum("rating").alias("rating_sum"),
        F.count("rating").alias("n_rated"),
        F.avg("rating").alias("avg_rating"),
        *flags,
    )
    if "sentiment" in df.columns:
        cube = cube.withColumns({s: percent(f"n_{s}", "n_sentiment") for s in SENTIMENTS})
    if "has_response" in df.columns:
        cube = cube.withColumn("response_rate", percent("responded", "n"))
    return cube


def metric_by_version(df: DataFrame, metric: str = "rating", min_reviews: int = 10) -> DataFrame:
    """Mean of a metric per version with enough reviews, lowest first."""
    return (
        df.filter(F.col("version").isNotNull())
        .groupBy("version")
        .agg(F.avg(metric).alias(f"avg_{metric}"), rows().alias("n"))
        .filter(F.col("n") >= min_reviews)
        .orderBy(f"avg_{metric}", "version")
    )


def version_ratings(df: DataFrame, min_reviews: int = 10, k: int = 10) -> DataFrame:
    """Mean rating and count of the ``k`` most reviewed versions."""
    rated = df.filter(F.col("version").isNotNull()).groupBy("version").agg(
        F.avg("rating").alias("avg_rating"), F.count("rating").alias("n")
    )
    return top_k(rated.filter(F.col("n") >= min_reviews), k, F.desc("n"), F.asc("version"))


def version_overview(df: DataFrame, min_reviews: int = 10, k: int = 10) -> DataFrame:
    """Reviews, mean rating, sentiment shares and reply rate of the top versions."""
    cube = review_cube(df, "version").filter(F.col("n") >= min_reviews)
    return top_k(cube, k, F.desc("n"), F.asc("version")).select(
        "version", "n", "avg_rating", *SENTIMENTS, "response_rate"
    )


def sentiment_by_version(df: DataFrame, min_reviews: int = 20, k: int = 10) -> DataFrame:
    """Row-percentage crosstab of sentiment by version, with review counts."""
    cube = review_cube(df.select("version", "rating", "sentiment"), "version")
    cube = cube.filter(F.col("n") >= min_reviews)
    return top_k(cube, k, F.desc("n"), F.asc("version")).select("version", *SENTIMENTS, "n")


def sentiment_pivot(df: DataFrame) -> DataFrame:
    """Counts of sentiment by version as a pivot with explicit values."""
    return (
        df.groupBy("version").pivot("sentiment", list(SENTIMENTS)).agg(rows()).fillna(0, list(SENTIMENTS))
    )


def melt(df: DataFrame, key: str, columns: tuple[str, ...], name: str, value: str) -> DataFrame:
    """Wide crosstab to long form."""
    return df.unpivot(key, list(columns), name, value)


def topic_by_version(df: DataFrame, k: int = 10) -> DataFrame:
    """Long table (version, topic, count, row percentage, reviews) of the top versions."""
    counts = (
        df.dropna(subset=["version", "primary_topic"])
        .groupBy("version", "primary_topic")
        .agg(rows().alias("n"))
    )
    totals = counts.groupBy("version").agg(F.sum("n").alias("review_count"))
    # k rows, so the broadcast does not grow with the data.
    top = F.broadcast(top_k(totals, k, F.desc("review_count"), F.asc("version")))
    return counts.join(top, "version").withColumn(
        "pct", F.round(percent("n", "review_count"), 1)
    )


def top_topics_per_version(df: DataFrame, n: int = 3, k: int = 10) -> DataFrame:
    """The ``n`` most discussed topics of each of the top versions."""
    table = topic_by_version(df, k)
    return top_n_per_key(table, "version", n, F.desc("n"), F.asc("primary_topic"), rank="rank")


def rating_histogram_top_versions(df: DataFrame, k: int = 5) -> DataFrame:
    """Reviews per (version, rating) of the ``k`` most reviewed versions."""
    counts = df.filter(F.col("version").isNotNull()).groupBy("version", "rating").agg(rows().alias("n"))
    totals = counts.groupBy("version").agg(F.sum("n").alias("total"))
    # k rows to broadcast. An inner join on the unique version stays above the counts,
    # so both branches share one scan; a semi join would be pushed below them.
    top = F.broadcast(top_k(totals, k, F.desc("total"), F.asc("version")).select("version"))
    return counts.join(top, "version").orderBy("version", "rating")


def segment_distribution(
    df: DataFrame, column: str = "rating", segments=versions.RELEASE_SEGMENTS
) -> DataFrame:
    """Count and share of a column's values inside each version segment."""
    counts = (
        df.withColumn("segment", versions.version_segment("version", segments))
        .filter(F.col("segment").isNotNull() & F.col(column).isNotNull())
        .groupBy("segment", column)
        .agg(rows().alias("n"))
    )
    # A handful of values per segment by now.
    share = percent("n", F.sum("n").over(Window.partitionBy("segment")))
    return counts.withColumn("pct", share).orderBy("segment", column)


def segment_means(df: DataFrame, segments=versions.RELEASE_SEGMENTS) -> DataFrame:
    return (
        df.withColumn("segment", versions.version_segment("version", segments))
        .filter(F.col("segment").isNotNull())
        .groupBy("segment")
        .agg(rows().alias("n"), F.avg("rating").alias("avg_rating"))
        .orderBy("segment")
    )


def with_major(df: DataFrame) -> DataFrame:
    return df.withColumn("major_version", versions.version_part("version", 1))


def major_versions(df: DataFrame) -> DataFrame:
    """Count and share of all reviews per major version."""
    counts = keep(with_major(df).groupBy("major_version").agg(rows().alias("n")))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    named = counts.filter(F.col("major_version").isNotNull())
    return named.withColumn("pct", percent("n", total)).orderBy("major_version")


def major_ratings(df: DataFrame, min_reviews: int = 5) -> DataFrame:
    return (
        with_major(df)
        .filter(F.col("major_version").isNotNull())
        .groupBy("major_version")
        .agg(F.avg("rating").alias("avg_rating"), F.count("rating").alias("n"))
        .filter(F.col("n") >= min_reviews)
        .orderBy("major_version")
    )


def major_sentiment(df: DataFrame, min_reviews: int = 5) -> DataFrame:
    cube = review_cube(with_major(df).select("major_version", "rating", "sentiment"), "major_version")
    return (
        cube.filter(F.col("n") >= min_reviews)
        .select("major_version", *SENTIMENTS, "n")
        .orderBy("major_version")
    )


def extremes(
    cube: DataFrame, measure: str, k: int, *, highest: bool, min_reviews: int = 10
) -> DataFrame:
    """The ``k`` versions at one end of a measure."""
    side = F.desc(measure) if highest else F.asc(measure)
    return top_k(cube.filter(F.col("n") >= min_reviews), k, side, F.asc("version"))


def best_and_worst(df: DataFrame, k: int = 3, min_reviews: int = 10) -> DataFrame:
    """Versions with the highest and the lowest mean rating, marked and ranked."""
    rated = metric_by_version(df, "rating", min_reviews)
    sides = []
    for side, highest in (("best", True), ("worst", False)):
        order = (F.desc("avg_rating") if highest else F.asc("avg_rating"), F.asc("version"))
        top = top_k(rated, k, *order)
        # k rows, ranked after the cut.
        rank = F.row_number().over(Window.orderBy(*order))
        sides.append(top.select(F.lit(side).alias("side"), rank.alias("rank"), "version", "avg_rating", "n"))
    return sides[0].unionByName(sides[1])


def sentiment_extremes(df: DataFrame, k: int = 5, min_reviews: int = 10) -> DataFrame:
    """Versions with the highest positive and the highest negative share."""
    # Both ends read the kept cube, so the reviews are scanned once.
    cube = keep(review_cube(df.select("version", "rating", "sentiment"), "version"))
    parts = [
        extremes(cube, s, k, highest=True, min_reviews=min_reviews).select(
            F.lit(s).alias("side"), "version", F.col(s).alias("pct"), "n"
        )
        for s in ("positive", "negative")
    ]
    return parts[0].unionByName(parts[1])


def dominant_versions(df: DataFrame) -> DataFrame:
    """Most reviewed version and dominant major version with its share of all rows."""
    counts = keep(with_major(df).groupBy("version", "major_version").agg(rows().alias("n")))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    counts = counts.filter(F.col("version").isNotNull())
    version = top_k(counts.groupBy("version").agg(F.sum("n").alias("n")), 1, F.desc("n"), F.asc("version"))
    major = counts.filter(F.col("major_version").isNotNull()).groupBy("major_version")
    major = top_k(major.agg(F.sum("n").alias("n")), 1, F.desc("n"), F.asc("major_version"))
    return version.select(F.lit("version").alias("kind"), F.col("version").alias("name"), "n").unionByName(
        major.select(
            F.lit("major_version").alias("kind"), F.col("major_version").cast("string").alias("name"), "n"
        )
    ).withColumn("pct", percent("n", total))


def major_version_changes(df: DataFrame, min_reviews: int = 10) -> DataFrame:
    """Mean rating per major version with the change from the previous one.

    Majors below ``min_reviews`` are left out before the comparison. The look-back runs
    over one row per major version.
    """
    w = Window.orderBy("major_version")
    return (
        major_ratings(df, min_reviews)
        .withColumn("previous_major", F.lag("major_version").over(w))
        .withColumn("rating_change", F.col("avg_rating") - F.lag("avg_rating").over(w))
    )


def overall_change(df: DataFrame, min_reviews: int = 10) -> DataFrame:
    """First and last major version by number, their means and the change between."""
    rated = major_ratings(df, min_reviews)
    return rated.agg(
        F.count(F.lit(1)).alias("majors"),
        F.min("major_version").alias("first_major"),
        F.min_by("avg_rating", "major_version").alias("first_rating"),
        F.max("major_version").alias("last_major"),
        F.max_by("avg_rating", "major_version").alias("last_rating"),
    ).withColumn("change", F.col("last_rating") - F.col("first_rating"))


def minor_version_trends(
    df: DataFrame,
    min_reviews: int = 10,
    rating_shift: float = 0.3,
    sentiment_shift: float = 5.0,
) -> DataFrame:
    """Rating and sentiment moves between successive minor versions of a major.

    Means are rounded to two places before they are compared; majors need
    ``min_reviews`` reviews and two qualifying minors.
    """
    parts = df.withColumns(
        {"major_version": versions.version_part("version", 1), "minor_version": versions.version_part("version", 2)}
    )
    cube = review_cube(
        parts.select("major_version", "minor_version", "rating", "sentiment"),
        "major_version",
        "minor_version",
    )
    major = Window.partitionBy("major_version")
    inner = major.orderBy("minor_version")
    minors = (
        cube.withColumn("_major_n", F.sum("n").over(major))
        .filter((F.col("_major_n") >= min_reviews) & (F.col("n") >= min_reviews))
        .withColumn("_minors", F.count(F.lit(1)).over(major))
        .filter("_minors >= 2")
        .withColumn("avg_rating", F.round("avg_rating", 2))
        .withColumn("previous_minor", F.lag("minor_version").over(inner))
        .withColumn("rating_change", F.round(F.col("avg_rating") - F.lag("avg_rating").over(inner), 2))
        .withColumn("positive_change", F.col("positive") - F.lag("positive").over(inner))
        .withColumn("negative_change", F.col("negative") - F.lag("negative").over(inner))
    )
    significant = F.coalesce(F.abs("rating_change") >= rating_shift, F.lit(False))

    def shifted(c: str) -> Column:
        return significant & F.coalesce(F.abs(c) >= sentiment_shift, F.lit(False))

    return minors.select(
        "major_version",
        "minor_version",
        "previous_minor",
        "avg_rating",
        "n",
        "rating_change",
        significant.alias("significant"),
        "positive_change",
        "negative_change",
        shifted("positive_change").alias("positive_shift"),
        shifted("negative_change").alias("negative_shift"),
    ).orderBy("major_version", "minor_version")


def compare_subset(df: DataFrame, subset: Column) -> DataFrame:
    """Sentiment shares of a subset against the whole, from one pass.

    Columns: sentiment, subset and whole percentages, difference and its direction.
    """
    inside = F.coalesce(subset, F.lit(False))
    one = df.agg(
        F.count_if(inside & F.col("sentiment").isNotNull()).alias("subset_n"),
        F.count("sentiment").alias("whole_n"),
        *[F.count_if(inside & (F.col("sentiment") == s)).alias(f"s_{s}") for s in SENTIMENTS],
        *[F.count_if(F.col("sentiment") == s).alias(f"w_{s}") for s in SENTIMENTS],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("sentiment"),
                percent(f"s_{s}", "subset_n").alias("subset_pct"),
                percent(f"w_{s}", "whole_n").alias("whole_pct"),
            )
            for s in SENTIMENTS
        ]
    )
    diff = F.col("subset_pct") - F.col("whole_pct")
    return one.select(F.inline(rows)).withColumns(
        {"diff": diff, "direction": F.when(diff > 0, "higher").otherwise("lower")}
    )


def sentiment_flag(df: DataFrame) -> DataFrame:
    """Add rating-derived sentiment where no sentiment column exists yet."""
    if "sentiment" in df.columns:
        return df
    return df.withColumn("sentiment", rates.rating_sentiment("rating"))

