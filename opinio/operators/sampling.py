"""Reproducible samples by hashed order."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.operators.clusters import assigned, fit_groups, term_vectors
from opinio.operators.ranking import top_k, top_n_per_key
from opinio.session import keep

# Sample sizes and rating weights by focus.
PER_RATING = 20
SAMPLE_CAP = 100
FOCUS_WEIGHTS = {
    "negative": {1: 0.4, 2: 0.3, 3: 0.15, 4: 0.1, 5: 0.05},
    "positive": {1: 0.05, 2: 0.1, 3: 0.15, 4: 0.3, 5: 0.4},
    "equal": {1: 0.2, 2: 0.2, 3: 0.2, 4: 0.2, 5: 0.2},
    "balanced": {1: 0.25, 2: 0.15, 3: 0.2, 4: 0.15, 5: 0.25},
}
CLUSTER_TERMS = 100
CLUSTER_LEAST = 10
CLUSTERS = (3, 10)


def hashed(key: str, seed: int = 42) -> Column:
    """A position that depends on seed and id only, not on partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def stratified_sample(
    df: DataFrame,
    key: str = "review_id",
    per_rating: int = PER_RATING,
    cap: int = SAMPLE_CAP,
    seed: int = 42,
) -> DataFrame:
    """At most ``per_rating`` reviews of each rating, ``cap`` in all; without ratings
    a uniform sample of ``cap``."""
    ranked = df.withColumn("_h", hashed(key, seed))
    if "rating" in df.columns:
        ranked = ranked.filter(F.col("rating").isNotNull())
        ranked = top_n_per_key(ranked, "rating", per_rating, F.asc("_h"), F.asc(key), salt_on=[key])
    return top_k(ranked, cap, F.asc("_h"), F.asc(key)).drop("_h")


def rating_quotas(size: int, focus: str = "balanced") -> dict[int, int]:
    """Reviews wanted per rating: its share of the size rounded down, but at least one.

    What the shares leave over, or exceed the size by, is spread evenly in whole rounds;
    the remainder of a round falls to the ratings of largest weight.
    """
    weights = FOCUS_WEIGHTS.get(focus, FOCUS_WEIGHTS["balanced"])
    shares = {rating: max(1, math.floor(size * weight)) for rating, weight in weights.items()}
    left = size - sum(shares.values())
    rounds, remainder = divmod(abs(left), len(weights))
    sign = math.copysign(1, left)
    favoured = set(sorted(weights, key=weights.__getitem__, reverse=True)[:remainder])
    return {
        rating: max(1, share + int(sign * (rounds + (rating in favoured)))) for rating, share in shares.items()
    }


def quota_frame(spark, quotas: Mapping[int, int]) -> DataFrame:
    return spark.createDataFrame(sorted(quotas.items()), "rating int, quota int")


def quota_sample(
    df: DataFrame,
    size: int = 150,
    focus: str = "balanced",
    key: str = "review_id",
    seed: int = 42,
) -> DataFrame:
    """As many reviews per rating as the focus asks for (all, where there are fewer)."""
    quotas = rating_quotas(size, focus)
    ranked = top_n_per_key(
        df.withColumn("_h", hashed(key, seed)).join(
            # Five rows.
            F.broadcast(quota_frame(df.sparkSession, quotas)), "rating"
        ),
        "rating",
        max(quotas.values()),
        F.asc("_h"),
        F.asc(key),
        salt_on=[key],
        rank="_rank",
    )
    return ranked.filter(F.col("_rank") <= F.col("quota")).drop("_h", "_rank", "quota")


def cluster_sample(
    df: DataFrame,
    size: int = 150,
    focus: str = "balanced",
    key: str = "review_id",
    column: str = "text",
    seed: int = 42,
    stops: Iterable[str] | None = None,
    starts: int = 1,
) -> DataFrame:
    """Quota sample spread over content clusters inside each rating.

    A rating with more reviews than its quota, and more than ten, is clustered; equal
    shares come from each cluster and hashed order tops the rest up. All ratings are taken
    apart, fitted and ranked together. Other ratings give their first reviews in hashed order.
    """
    quotas = rating_quotas(size, focus)
    ratings = sorted(quotas)
    rated = df.filter(F.col("rating").isin(ratings))
    # Five rows.
    counts = {r["rating"]: r["count"] for r in rated.groupBy("rating").count().collect()}
    n = [counts.get(r, 0) for r in ratings]
    k = [
        min(CLUSTERS[1], max(CLUSTERS[0], quotas[r])) if n[i] > max(quotas[r], CLUSTER_LEAST) else 0
        for i, r in enumerate(ratings)
    ]
    number = F.array_position(F.array(*[F.lit(r) for r in ratings]), F.col("rating").cast("int")) - 1
    fitted = [r for i, r in enumerate(ratings) if k[i]]
    ids = rated.select(key, "rating", hashed(key, seed).alias("_h"))
    if fitted:
        vectors = term_vectors(
            rated.filter(F.col("rating").isin(fitted)), key, column, stops, CLUSTER_TERMS, 1, None, number, len(ratings)
        )
        fits = fit_groups(vectors, key, k, starts, seed)
        found = keep(assigned(vectors, key, fits).select(key, "cluster"))
        found.count()
        vectors.blocks.unpersist()
        ids = ids.join(found, key, "left").fillna({"cluster": -1})
    else:
        ids = ids.withColumn("cluster", F.lit(-1))
    shares = [(r, quotas[r], max(1, quotas[r] // k[i]) if k[i] else 0) for i, r in enumerate(ratings)]
    wanted = F.broadcast(df.sparkSession.createDataFrame(shares, "rating int, _quota int, _each int"))
    order = (F.asc("_h"), F.asc(key))
    most = max(1, *[each for _, _, each in shares])
    even = top_n_per_key(ids, ["rating", "cluster"], most, *order, salt_on=[key], rank="_place").join(wanted, "rating")
    even = even.filter(F.col("_place") <= F.col("_each")).select(key, F.lit(0).alias("_late"))
    # First everything chosen by cluster, then hashed order, cut at the quota.
    chosen = ids.join(even, key, "left").fillna({"_late": 1})
    first = top_n_per_key(chosen, "rating", max(quotas.values()), F.asc("_late"), *order, salt_on=[key], rank="_place")
    kept = first.join(wanted, "rating").filter(F.col("_place") <= F.col("_quota")).select(key)
    # No more rows than the sample has.
    return df.join(F.broadcast(kept), key, "left_semi")


def one_reply_per_rating(
    df: DataFrame, key: str = "review_id", reply: str = "reply_content", most: int = 3, seed: int = 42
) -> DataFrame:
    """One answered review per rating, lowest ratings first, at most ``most``."""
    replied = df.filter(F.col(reply).isNotNull()).withColumn("_h", hashed(key, seed))
    one = top_n_per_key(replied, "rating", 1, F.asc("_h"), F.asc(key), salt_on=[key])
    return top_k(one, most, F.asc("rating")).drop("_h")
