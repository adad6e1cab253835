"""Developer-reply tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.functions import rates
from opinio.functions.rates import percent
from opinio.operators.ranking import top_k

def rows() -> Column:
    return F.count(F.lit(1))


def with_response(df: DataFrame, replied_at: str = "replied_at") -> DataFrame:
    return df.withColumn("has_response", rates.has_response(replied_at))


def response_overall(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("has_response").alias("responded"), rows().alias("total")).withColumn(
        "response_rate", percent("responded", "total")
    )


def response_by(df: DataFrame, key: str, min_reviews: int = 0, decimals: int = 1) -> DataFrame:
    """Reply rate, replies and reviews per key."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count_if("has_response").alias("responded"), rows().alias("total"))
        .filter(F.col("total") >= min_reviews)
        .withColumn("response_rate", F.round(percent("responded", "total"), decimals))
    )


def response_by_version(df: DataFrame, min_reviews: int = 20, k: int = 10) -> DataFrame:
    """Reply rate of the ``k`` most reviewed versions."""
    return top_k(response_by(df, "version", min_reviews), k, F.desc("total"), F.asc("version"))


def rating_by_response(df: DataFrame) -> DataFrame:
    """Mean rating and count of answered and unanswered reviews."""
    return df.groupBy("has_response").agg(
        F.round(F.avg("rating"), 2).alias("avg_rating"), F.count("rating").alias("n")
    ).withColumn("response", F.when(F.col("has_response"), "Responded").otherwise("Not Responded")).select(
        "response", "avg_rating", "n"
    )


def class_counters() -> list[Column]:
    """Aggregates from which reply rates by class follow; sums of them serve as well."""
    negative, positive = rates.is_negative(), rates.is_positive()
    return [
        F.count_if(negative).alias("negative_n"),
        F.count_if(negative & F.col("has_response")).alias("negative_responded"),
        F.count_if(positive).alias("positive_n"),
        F.count_if(positive & F.col("has_response")).alias("positive_responded"),
    ]


def class_rates(counters: DataFrame) -> DataFrame:
    return (
        counters.withColumn("negative_rate", percent("negative_responded", "negative_n"))
        .withColumn("positive_rate", percent("positive_responded", "positive_n"))
        .withColumn("ratio", F.col("negative_rate") / F.nullif(F.col("positive_rate"), F.lit(0.0)))
    )


def response_by_class(df: DataFrame) -> DataFrame:
    """Reply rates of negative and positive reviews and their ratio, in one row."""
    return class_rates(df.agg(*class_counters()))


def compare_response(df: DataFrame, subset: Column) -> DataFrame:
    """Reply rate of a subset against the whole, from one pass."""
    inside = F.coalesce(subset, F.lit(False))
    rate = df.agg(
        F.count_if(inside).alias("subset_n"),
        F.count_if(inside & F.col("has_response")).alias("subset_responded"),
        rows().alias("whole_n"),
        F.count_if("has_response").alias("whole_responded"),
    ).withColumns(
        {
            "subset_rate": percent("subset_responded", "subset_n"),
            "whole_rate": percent("whole_responded", "whole_n"),
        }
    )
    diff = F.col("subset_rate") - F.col("whole_rate")
    return rate.withColumns({"diff": diff, "direction": F.when(diff > 0, "higher").otherwise("lower")})


def response_extremes(df: DataFrame, k: int = 5, min_reviews: int = 5) -> DataFrame:
    """Versions with the highest and the lowest reply rate."""
    table = response_by(df, "version", min_reviews, decimals=6)
    sides = [
        top_k(table, k, order, F.asc("version")).select(
            F.lit(side).alias("side"), "version", "response_rate", "responded", "total"
        )
        for side, order in (("highest", F.desc("response_rate")), ("lowest", F.asc("response_rate")))
    ]
    return sides[0].unionByName(sides[1])
