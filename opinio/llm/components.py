"""Connected components of a link table, worked out by Spark alone.

Links are contracted by alternating large and small stars (Kiveris et al., "Connected
components in MapReduce and beyond"): every node hands its larger neighbours, then its
smaller ones, to the smallest it knows. No node's neighbours are ever gathered: minima are
pre-aggregated, and a hub's rows are joined to its one minimum, which adaptive execution
can split. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import work_table


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    return (
        both.filter("b > a")
        .join(least, "a")
        .select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    met = links.join(least, "a")
    others = met.filter("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return others.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every linked node; the root is the smallest node of its component.

    ``links``: ``(a, b)``, two nodes of one ordered type. Links of a node with itself and
    nulls are ignored, repeats and direction do not matter. Nodes without links have no row.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = work_table(pairs, "links")

    def mark(df: DataFrame) -> tuple:
        digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        return tuple(df.agg(F.count(F.lit(1)), digest).first())

    before = mark(pairs)
    while before[0]:
        pairs = work_table(_small_star(_large_star(pairs)), "links")
        after = mark(pairs)
        if after == before:
            break
        before = after
    inner = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return inner.unionByName(roots)
