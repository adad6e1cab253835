"""Counts, shares and summaries of a review table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.functions import dates, rates, text
from opinio.functions.rates import RATINGS, SENTIMENTS, percent
from opinio.operators.ranking import top_k
from opinio.session import keep


def share_within(df: DataFrame, count: str, *keys: str) -> Column:
    """Percentage of ``count`` within its key group (of everything without keys).

    For frames already aggregated to a handful of rows per group.
    """
    return percent(count, F.sum(count).over(Window.partitionBy(*keys)))


def rating_distribution(df: DataFrame) -> DataFrame:
    """Count and percentage per rating, and the overall mean on each row."""
    counts = df.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))
    rated = F.when(F.col("rating").isNotNull(), F.col("n"))
    everything = Window.partitionBy()
    return (
        counts.withColumn("total", F.sum(rated).over(everything))
        .withColumn("mean_rating", F.sum(F.col("rating") * F.col("n")).over(everything) / F.col("total"))
        .filter(F.col("rating").isNotNull())
        .select("rating", "n", percent("n", "total").alias("pct"), "mean_rating")
        .orderBy("rating")
    )


def sentiment_distribution(df: DataFrame) -> DataFrame:
    counts = df.groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", share_within(counts, "n")).orderBy(F.desc("n"), "sentiment")


def category_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Rows per category, largest first, optionally only the first ``k``."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    order = (F.desc("n"), F.asc(column))
    return counts.orderBy(*order) if k is None else top_k(counts, k, *order)


def top_categories(df: DataFrame, column: str, k: int) -> DataFrame:
    """Largest ``k`` categories with their share of all rows.

    The rows are read once: their total is that of the counts, nulls among them.
    """
    counts = keep(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    named = counts.filter(F.col(column).isNotNull())
    return top_k(named, k, F.desc("n"), F.asc(column)).withColumn("pct", percent("n", total))


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row from one pass: totals, rating map, mean, date range, text sizes.

    Version counts are a table of their own, :func:`category_counts` by version, since
    their number grows with the data.
    """
    length = text.text_length("text")
    sizes = [
        F.round(F.avg(length), 1).alias("avg_length"),
        F.max(length).alias("max_length"),
        F.count_if(length == 0).alias("empty_reviews"),
    ]
    return df.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.round(F.avg("rating"), 2).alias("average_rating"),
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_date"),
        dates.span_days("date").alias("days"),
        F.map_from_arrays(
            F.array(*[F.lit(r) for r in RATINGS]),
            F.array(*[F.count_if(F.col("rating") == r) for r in RATINGS]),
        ).alias("rating_counts"),
        *(sizes if "text" in df.columns else []),
    )


def summary_values(df: DataFrame) -> DataFrame:
    """The scalar part of :func:`dataset_summary` with one count column per rating."""
    wide = [F.col("rating_counts")[r].alias(f"rating_{r}") for r in RATINGS]
    return dataset_summary(df).select("*", *wide).drop("rating_counts")


def data_info(df: DataFrame, k: int = 5) -> DataFrame:
    """Long table of the figures shown with a report: ``(section, item, value)``.

    Total, date range, top versions by count, sentiment and rating percentages (1 dp).
    """
    n = F.count(F.lit(1))
    one = df.agg(
        n.alias("n"),
        F.coalesce(F.date_format(F.min("date"), "yyyy-MM-dd"), F.lit("Unknown")).alias("first"),
        F.coalesce(F.date_format(F.max("date"), "yyyy-MM-dd"), F.lit("Unknown")).alias("last"),
        *[F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS],
        *[F.count_if(F.col("rating") == r).alias(f"r{r}") for r in RATINGS],
        F.count("sentiment").alias("n_sentiment"),
        F.count("rating").alias("n_rating"),
    )

    def item(section: str, name: str, value: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), F.lit(name).alias("item"), value.alias("value")
        )

    def pct(part: str, whole: str) -> Column:
        return F.round(percent(part, whole), 1).cast("string")

    items = F.array(
        item("dataset", "total_reviews", F.col("n").cast("string")),
        item("date_range", "start", F.col("first")),
        item("date_range", "end", F.col("last")),
        *[item("sentiment_pct", s, pct(s, "n_sentiment")) for s in SENTIMENTS],
        *[item("rating_pct", str(r), pct(f"r{r}", "n_rating")) for r in RATINGS],
    )
    figures = one.select(F.inline(items))
    top = category_counts(df.filter(F.col("version").isNotNull()), "version", k)
    top = top.select(
        F.lit("top_versions").alias("section"),
        F.col("version").alias("item"),
        F.col("n").cast("string").alias("value"),
    )
    return figures.unionByName(top)


def topic_distribution(df: DataFrame, labels: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Reviews per primary topic with share of all rows and label, largest ``k``."""
    out = top_categories(df, "primary_topic", k)
    if labels is None:
        return out.withColumn("label", text.topic_label("primary_topic", F.array().cast("array<string>")))
    # At most one row per topic, and the topic count is a model parameter.
    return out.join(
        F.broadcast(labels.select(F.col("topic_id").alias("primary_topic"), "label")),
        "primary_topic",
        "left",
    )


def observed_counts(spark, *seen) -> DataFrame:
    """``(stage, rows)`` of observations whose job has run, in the given order."""
    rows = [(name, observation.get["rows"]) for name, observation in seen]
    return spark.createDataFrame(rows, "stage string, rows long")


def stage_counts(df: DataFrame, name: str):
    """Count rows as they pass, without a job of its own.

    Returns the observed frame and the observation; read ``observation.get`` after the
    first action on the frame.
    """
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
