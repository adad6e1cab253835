"""Threshold rules that turn version tables into short findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.functions import versions
from opinio.operators.ranking import top_k
from opinio.operators.responses import class_counters, class_rates, with_response
from opinio.operators.versions import review_cube, sentiment_flag, top_topics_per_version
from opinio.session import keep

# Thresholds of the rules.
MIN_REVIEWS = 10
LOW_RATING = 3.0
HIGH_RATING = 3.5
RATING_MOVE = 0.5
MIN_MAJORS = 3
STRONG_SENTIMENT = 60
HIGH_RESPONSE = 20
LOW_RESPONSE = 5
RESPONSE_FACTOR = 2

# Finding texts.
TEXTS = {
    "low_rating": "Version %s has a low average rating of %s/5 based on %d reviews.",
    "high_rating": "Version %s has a high average rating of %s/5 based on %d reviews.",
    "improvement": "Ratings show improvement across major versions, from %s (version %s) to %s (version %s).",
    "decline": "Ratings show decline across major versions, from %s (version %s) to %s (version %s).",
    "biggest_gain": "Biggest improvement was from version %s to %s, with ratings increasing by %s points.",
    "biggest_drop": "Biggest decline was from version %s to %s, with ratings dropping by %s points.",
    "most_positive": "Version %s has the highest positive sentiment at %s%% based on %d reviews.",
    "most_negative": "Version %s has the highest negative sentiment at %s%% based on %d reviews.",
    "high_response": "Version %s has the highest developer response rate at %s%% (%d/%d reviews).",
    "low_response": "Version %s has the lowest developer response rate at %s%% (%d/%d reviews).",
    "negative_first": (
        "Negative reviews (rating 1-2) receive significantly more developer responses (%s%%) "
        "than positive ones (%s%%)."
    ),
    "worst_topics": "The lowest-rated version (%s) most commonly discusses %s.",
    "best_topics": "The highest-rated version (%s) most commonly discusses %s.",
}


def _one(c: Column | str) -> Column:
    """One-decimal text, rounding half up."""
    return F.format_string("%.1f", F.round(c, 1))


def _rule(df: DataFrame, rule: str, subject: Column, value: Column, n: Column, *args: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"),
        subject.cast("string").alias("subject"),
        value.cast("double").alias("value"),
        n.cast("bigint").alias("n"),
        F.format_string(TEXTS[rule], *args).alias("finding"),
    )


def _rating_rules(cube: DataFrame) -> list[DataFrame]:
    version, avg, n = F.col("version"), F.col("avg_rating"), F.col("n")
    low = top_k(cube, 3, F.asc("avg_rating"), F.asc("version")).filter(avg < LOW_RATING)
    high = top_k(cube, 3, F.desc("avg_rating"), F.asc("version")).filter(avg > HIGH_RATING)
    return [
        _rule(frame, rule, version, avg, n, version, _one(avg), n)
        for rule, frame in (("low_rating", low), ("high_rating", high))
    ]


def _finding(rule: str, holds: Column, subject: Column, value: Column, n: Column, *args: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        subject.cast("string").alias("subject"),
        value.cast("double").alias("value"),
        n.cast("bigint").alias("n"),
        F.format_string(TEXTS[rule], *args).alias("finding"),
        F.coalesce(holds, F.lit(False)).alias("_holds"),
    )


def _held(df: DataFrame, found: list[Column]) -> DataFrame:
    """The findings of a one-row frame whose condition holds, one row each."""
    return df.select(F.inline(F.array(*found))).filter("_holds").drop("_holds")


def _first(measure: str, highest: bool, *kept: str) -> Column:
    """The row at one end of a measure, ties by the first kept column, as an aggregate."""
    order = -F.col(measure) if highest else F.col(measure)
    row = F.struct(order.alias("order"), *kept, F.col(measure).alias("value"))
    return F.min(F.when(F.col(measure).isNotNull(), row))


def _top_version_rules(cube: DataFrame) -> DataFrame:
    """Sentiment and reply-rate extremes, all from one aggregate of the cube."""
    ends = (
        ("most_positive", "positive", True, lambda v: v >= STRONG_SENTIMENT),
        ("most_negative", "negative", True, lambda v: v >= STRONG_SENTIMENT),
        ("high_response", "response_rate", True, lambda v: v > HIGH_RESPONSE),
        ("low_response", "response_rate", False, lambda v: v < LOW_RESPONSE),
    )
    picked = cube.agg(*[_first(m, high, "version", "n", "responded").alias(r) for r, m, high, _ in ends])
    found = []
    for rule, measure, _, holds in ends:
        row = F.col(rule)
        version, value, n = row["version"], row["value"], row["n"]
        counts = (row["responded"], n) if measure == "response_rate" else (n,)
        found.append(_finding(rule, holds(value), version, value, n, version, _one(value), *counts))
    return _held(picked, found)


def _major_rules(majors: DataFrame) -> DataFrame:
    """Rules over the chain of major versions, one row per major."""
    w = Window.orderBy("major_version")
    steps = majors.withColumns(
        {
            "previous": F.lag("major_version").over(w),
            "change": F.col("avg_rating") - F.lag("avg_rating").over(w),
        }
    )
    chain = steps.agg(
        F.count(F.lit(1)).alias("majors"),
        F.sum("n").alias("n"),
        F.min(F.struct("major_version", "avg_rating")).alias("a"),
        F.max(F.struct("major_version", "avg_rating")).alias("b"),
        _first("change", True, "major_version", "previous", "n").alias("gain"),
        _first("change", False, "major_version", "previous", "n").alias("drop"),
    ).filter(F.col("majors") >= MIN_MAJORS)
    change = F.col("b.avg_rating") - F.col("a.avg_rating")
    found = []
    for rule, holds in (("improvement", change >= RATING_MOVE), ("decline", change <= -RATING_MOVE)):
        ends = [x for e in ("a", "b") for x in (_one(f"{e}.avg_rating"), F.col(f"{e}.major_version").cast("string"))]
        found.append(_finding(rule, holds, F.lit("all"), change, F.col("n"), *ends))
    for rule, name, sign in (("biggest_gain", "gain", 1), ("biggest_drop", "drop", -1)):
        row = F.col(name)
        found.append(
            _finding(
                rule,
                row["value"] * sign >= RATING_MOVE,
                row["major_version"],
                row["value"],
                row["n"],
                row["previous"].cast("string"),
                row["major_version"].cast("string"),
                _one(F.abs(row["value"])),
            )
        )
    return _held(chain, found)


def _topic_rules(df: DataFrame, cube: DataFrame) -> list[DataFrame]:
    out = []
    for rule, order in (("worst_topics", F.asc("avg_rating")), ("best_topics", F.desc("avg_rating"))):
        chosen = F.broadcast(top_k(cube, 1, order, F.asc("version")).select("version", "avg_rating", "n"))
        topics = top_topics_per_version(df.join(chosen.select("version"), "version", "left_semi"), 3, 1)
        # At most three rows for the one version.
        named = topics.groupBy("version").agg(
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("rank", "primary_topic"))),
                    lambda t: F.concat(F.lit("Topic "), t["primary_topic"].cast("int").cast("string")),
                ),
                ", ",
            ).alias("topics")
        )
        out.append(
            _rule(
                named.join(chosen, "version"),
                rule,
                F.col("version"),
                F.col("avg_rating"),
                F.col("n"),
                F.col("version"),
                F.col("topics"),
            )
        )
    return out


def key_findings(df: DataFrame, min_reviews: int = MIN_REVIEWS) -> DataFrame:
    """Findings as rows ``(rule, subject, value, n, finding)``.

    The reviews are read once, for the cached per-version cube, from which the rules on
    versions, major versions and reply rates by class follow. Topic rules join in when the frame carries topics.
    """
    df = sentiment_flag(df)
    if "has_response" not in df.columns:
        df = with_response(df)
    whole = keep(review_cube(df, "version", more=class_counters(), missing=True))
    counters = ("negative_n", "negative_responded", "positive_n", "positive_responded")
    raw = whole.filter(F.col("version").isNotNull())
    cube = raw.filter(F.col("n") >= min_reviews)
    majors = (
        raw.withColumn("major_version", versions.version_part("version", 1))
        .filter(F.col("major_version").isNotNull())
        .groupBy("major_version")
        .agg(
            (F.sum("rating_sum") / F.sum("n_rated")).alias("avg_rating"),
            F.sum("n").alias("n"),
        )
        .filter(F.col("n") >= min_reviews)
    )
    reply = class_rates(whole.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])).filter(
        F.col("negative_rate") > RESPONSE_FACTOR * F.col("positive_rate")
    )
    frames = [
        *_rating_rules(cube),
        _major_rules(majors),
        _top_version_rules(cube),
        _rule(
            reply,
            "negative_first",
            F.lit("negative"),
            F.col("negative_rate"),
            F.col("negative_n"),
            _one("negative_rate"),
            _one("positive_rate"),
        ),
    ]
    if "primary_topic" in df.columns:
        frames += _topic_rules(df, cube)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out

