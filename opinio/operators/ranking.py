"""Top-k and keep-one operators that stay safe when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to this n Spark ranks below the shuffle.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"

#: Sub-groups a key is split into before its final ranking.
SALTS = 64


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First ``k`` rows; each task keeps only its own k before the merge."""
    return df.orderBy(*order).limit(k)


def first_per_key(df: DataFrame, keys: Sequence[str] | str, *order: Column) -> DataFrame:
    """One row per key, the first in the given order.

    ``row_number() = 1`` lets Spark place a group limit below the shuffle, so every map
    task sends at most one row per key and a key with a third of all rows is harmless.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_n_per_key(
    df: DataFrame,
    keys: Sequence[str] | str,
    n: int,
    *order: Column,
    salt_on: Sequence[str] | None = None,
    rank: str | None = None,
) -> DataFrame:
    """First ``n`` rows of each key, exact, in two ranking rounds.

    The first round ranks within (key, salt) and keeps n of each, the second ranks the
    at most ``n * SALTS`` survivors of a key. Both rounds get a map-side group limit, for
    which the session's threshold is raised where ``n`` exceeds it.
    """
    conf = df.sparkSession.conf
    if n > int(conf.get(GROUP_LIMIT, "1000")):
        conf.set(GROUP_LIMIT, str(n))
    keys = [keys] if isinstance(keys, str) else list(keys)
    name = rank or "_rn"
    salt = F.pmod(F.xxhash64(*(salt_on or [c for c in df.columns if c not in keys])), F.lit(SALTS))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    second = Window.partitionBy(*keys).orderBy(*order)
    out = (
        df.withColumn("_salt", salt)
        .withColumn("_local", F.row_number().over(first))
        .filter(F.col("_local") <= n)
        .drop("_local", "_salt")
        .withColumn(name, F.row_number().over(second))
        .filter(F.col(name) <= n)
    )
    return out if rank else out.drop(name)
