"""Time tables: every one a single grouped pass over the reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinio.functions import dates
from opinio.functions.rates import RATINGS, SENTIMENTS, percent
from opinio.operators.ranking import top_k
from opinio.session import keep


def dated(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows with a date; text dates are parsed first."""
    if dict(df.dtypes)[date] == "string":
        df = df.withColumn(date, F.try_to_timestamp(date))
    return df.filter(F.col(date).isNotNull())


def fill_bins(bins: DataFrame, freq: str, counts: Sequence[str]) -> DataFrame:
    """Add the empty bins between the first and the last one.

    ``bins`` has one row per ``bin``; its size is bounded by the calendar span, so the
    look-ahead to the next bin runs over that small frame and no join is needed.
    """
    following = F.col("_next")
    steps = F.sequence(F.col("bin"), following, dates.bin_step(freq))
    filler = F.when(following.isNull(), F.array("bin")).otherwise(
        F.filter(steps, lambda b: b < following)
    )
    spread = bins.withColumn("_next", F.lead("bin").over(Window.orderBy("bin"))).withColumn(
        "_bin", F.explode(filler)
    )
    real = F.col("_bin") == F.col("bin")
    columns = [
        F.when(real, F.col(c)).otherwise(F.lit(0)).alias(c) if c in counts else F.when(real, F.col(c)).alias(c)
        for c in bins.columns
        if c != "bin"
    ]
    return spread.select(F.col("_bin").alias("bin"), *columns)


def trend(
    df: DataFrame,
    date: str = "date",
    value: str = "rating",
    freq: str = "ME",
    rating_breakdown: bool = True,
    rolling_window: int = 0,
) -> DataFrame:
    """Mean and count per bin, labelled with the bin's last day; empty bins are kept.

    For ratings also count and percentage of each rating; optionally a mean of the last
    ``rolling_window`` bins that skips empty ones. ``freq='auto'`` picks the bin by span.
    """
    df = dated(df, date)
    freq = dates.auto_frequency(df, date) if freq == "auto" else dates.frequency(freq)
    breakdown = RATINGS if rating_breakdown and value == "rating" else ()
    per_rating = [f"rating_{r}_count" for r in breakdown]
    bins = df.groupBy(dates.bin_start(date, freq).alias("bin")).agg(
        F.avg(value).alias(f"avg_{value}"),
        F.count(value).alias("count"),
        *[F.count_if(F.col(value) == r).alias(c) for r, c in zip(breakdown, per_rating)],
    )
    out = fill_bins(bins, freq, ["count", *per_rating])
    out = out.withColumns({c.replace("_count", "_pct"): percent(c, "count") for c in per_rating})
    if rolling_window > 0:
        w = Window.orderBy("bin").rowsBetween(-(rolling_window - 1), 0)
        out = out.withColumn(f"rolling_avg_{rolling_window}", F.avg(f"avg_{value}").over(w))
    return out.withColumn(date, dates.bin_end("bin", freq)).drop("bin").orderBy(date)


def rating_trend(df: DataFrame, freq: str = "M", date: str = "date", value: str = "rating") -> DataFrame:
    """Mean, count and a short period label per bin, for charts."""
    table = trend(df, date, value, freq, rating_breakdown=False)
    day = F.col(date)
    label = {
        "D": F.date_format(day, "yyyy-MM-dd"),
        "W": dates.period_key(date, "week"),
        "ME": F.date_format(day, "yyyy-MM" if freq == "M" else "yyyy-MM-dd"),
        "Q": F.date_format(day, "yyyy-MM-dd"),
        "Y": F.date_format(day, "yyyy"),
    }[dates.frequency(freq)]
    return table.withColumn("period", label)


def rating_by_period(df: DataFrame, period: str = "month", date: str = "date") -> DataFrame:
    """Average rating, count and first date per period."""
    return (
        dated(df, date)
        .groupBy(dates.period_key(date, period).alias("period"))
        .agg(
            F.avg("rating").alias("avg_rating"),
            F.count("rating").alias("n"),
            F.min(date).alias("first_date"),
        )
        .orderBy("period")
    )


def volume_by_period(df: DataFrame, period: str = "month", date: str = "date") -> DataFrame:
    return (
        dated(df, date)
        .groupBy(dates.period_key(date, period).alias("period"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("period")
    )


def share_by_period(
    df: DataFrame, column: str, values: Sequence, period: str = "month", date: str = "date"
) -> DataFrame:
    """Long table (period, value, count, row percentage), zero-filled over ``values``.

    One conditional aggregate per period, then an in-row unpivot: no join, no second
    shuffle, and absent combinations appear as zeros.
    """
    counted = (
        dated(df, date)
        .groupBy(dates.period_key(date, period).alias("period"))
        .agg(F.count(column).alias("total"), *[F.count_if(F.col(column) == v).alias(f"v{i}") for i, v in enumerate(values)])
    )
    cells = F.array(
        *[
            F.struct(F.lit(v).alias(column), F.col(f"v{i}").alias("n"))
            for i, v in enumerate(values)
        ]
    )
    return (
        counted.select("period", "total", F.inline(cells))
        .select("period", column, "n", percent("n", "total").alias("pct"))
        .orderBy("period", column)
    )


def rating_share_by_period(df: DataFrame, period: str = "month", date: str = "date") -> DataFrame:
    return share_by_period(df, "rating", RATINGS, period, date)


def sentiment_share_by_period(df: DataFrame, period: str = "month", date: str = "date") -> DataFrame:
    return share_by_period(df, "sentiment", SENTIMENTS, period, date)


def versions_over_time(df: DataFrame, k: int = 5, period: str = "month", date: str = "date") -> DataFrame:
    """Reviews per version and period for the ``k`` most reviewed versions overall.

    The ranking counts undated reviews too. Both steps read the kept counts, so the
    reviews are scanned once.
    """
    if dict(df.dtypes)[date] == "string":
        df = df.withColumn(date, F.try_to_timestamp(date))
    counts = keep(
        df.filter(F.col("version").isNotNull())
        .groupBy("version", dates.period_key(date, period).alias("period"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("version").agg(F.sum("n").alias("total"))
    # k rows: safe to broadcast whatever the table size.
    top = F.broadcast(top_k(totals, k, F.desc("total"), F.asc("version")).select("version"))
    return (
        counts.filter(F.col("period").isNotNull())
        .join(top, "version", "left_semi")
        .orderBy("version", "period")
    )
