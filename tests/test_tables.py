from datetime import datetime

import pytest
from pyspark.sql import functions as F

from opinio.operators import distributions, findings, responses, trends
from opinio.operators import versions as by_version
from opinio.operators.ranking import first_per_key, top_n_per_key


def day(m, d=1):
    return datetime(2024, m, d)


@pytest.fixture
def dated(spark):
    rows = [(1, day(1), 5), (2, day(1, 31), 3), (3, day(4, 30), 1), (4, None, 2), (5, day(4), None)]
    return spark.createDataFrame(rows, "review_id int, date timestamp, rating int")


def test_trend_keeps_empty_bins(dated):
    rows = trends.trend(dated, rolling_window=2).collect()
    assert [str(r["date"]) for r in rows] == ["2024-01-31", "2024-02-29", "2024-03-31", "2024-04-30"]
    assert [r["count"] for r in rows] == [2, 0, 0, 1]
    assert [r["avg_rating"] for r in rows] == [4.0, None, None, 1.0]
    assert [r["rating_5_pct"] for r in rows] == [50.0, None, None, 0.0]
    assert [r["rolling_avg_2"] for r in rows] == [4.0, 4.0, None, 1.0]


def test_trend_of_one_row_and_of_none(dated):
    one = trends.trend(dated.filter("review_id = 1"), freq="auto").collect()
    assert len(one) == 1 and str(one[0]["date"]) == "2024-01-01"
    assert trends.trend(dated.filter("review_id = 4")).count() == 0


def test_sunday_closes_its_week(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 3, 23), 4), (datetime(2024, 3, 4), 2)], "date timestamp, rating int")
    rows = trends.trend(df, freq="W").collect()
    assert [(str(r["date"]), r["count"]) for r in rows] == [("2024-03-03", 1), ("2024-03-10", 1)]


def test_rating_distribution_ignores_missing(dated):
    rows = {r["rating"]: (r["n"], r["pct"], r["mean_rating"]) for r in distributions.rating_distribution(dated).collect()}
    assert rows == {r: (1, 25.0, 2.75) for r in (1, 2, 3, 5)}


def test_share_by_period_fills_zeros(dated):
    rows = trends.rating_share_by_period(dated).filter("period = '2024-01'").collect()
    assert [(r["rating"], r["n"], r["pct"]) for r in rows] == [
        (1, 0, 0.0),
        (2, 0, 0.0),
        (3, 1, 50.0),
        (4, 0, 0.0),
        (5, 1, 50.0),
    ]


def test_summary_of_dirty_rows(spark):
    rows = [(1, day(1), 4, None, "1.0"), (2, None, None, "abcd", None), (3, day(1, 3), 5, "", "1.0")]
    df = spark.createDataFrame(rows, "review_id int, date timestamp, rating int, text string, version string")
    row = distributions.dataset_summary(df).first()
    assert (row["total_reviews"], row["average_rating"], row["days"]) == (3, 4.5, 2)
    assert (row["avg_length"], row["max_length"], row["empty_reviews"]) == (1.3, 4, 2)
    assert row["rating_counts"] == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}
    counts = distributions.category_counts(df, "version").collect()
    assert [tuple(r) for r in counts] == [("1.0", 2), (None, 1)]


def test_export_order_is_newest_first(dated):
    from opinio.sources.storage import newest_first

    assert [r["review_id"] for r in newest_first(dated).collect()] == [3, 5, 2, 1, 4]


def hot(spark, n=6000):
    """A third of all rows under one key."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)
    return spark.range(n).select(F.col("id"), key.alias("k"), ((F.col("id") * 7919) % 1009).alias("v"))


@pytest.mark.parametrize("n", [1, 7, 1500])
def test_top_n_per_key_is_exact_under_skew(spark, n):
    df = hot(spark)
    order = (F.desc("v"), F.asc("id"))
    got = {(r["k"], r["id"], r["rk"]) for r in top_n_per_key(df, "k", n, *order, rank="rk").collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r["k"], []).append((-r["v"], r["id"]))
    want = {(k, i, p) for k, rows in groups.items() for p, (_, i) in enumerate(sorted(rows)[:n], 1)}
    assert got == want


def test_first_per_key_limits_before_the_shuffle(spark):
    df = first_per_key(hot(spark), "k", F.asc("id"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.count("WindowGroupLimit") == 2
    assert df.count() == 50


def version_rows(spark):
    rows, i = [], 0
    for version, ratings, replies in (
        ("1.0", [1] * 12, 6),
        ("1.1", [2] * 12, 0),
        ("2.0", [3] * 12, 0),
        ("3.0", [5] * 12, 0),
        ("3.1", [5] * 4, 4),
    ):
        for j, rating in enumerate(ratings):
            i += 1
            rows.append((i, version, rating, day(1) if j < replies else None))
    return spark.createDataFrame(rows, "review_id int, version string, rating int, replied_at timestamp")


def test_findings(spark):
    rows = {r["rule"]: r for r in findings.key_findings(version_rows(spark)).filter("rule <> 'low_rating'").collect()}
    assert set(rows) == {
        "high_rating",
        "improvement",
        "biggest_gain",
        "most_positive",
        "most_negative",
        "high_response",
        "low_response",
    }
    assert rows["improvement"]["finding"] == (
        "Ratings show improvement across major versions, from 1.5 (version 1) to 5.0 (version 3)."
    )
    assert rows["biggest_gain"]["subject"] == "3" and rows["biggest_gain"]["value"] == 2.0
    assert rows["high_response"]["finding"] == (
        "Version 1.0 has the highest developer response rate at 50.0% (6/12 reviews)."
    )
    assert rows["low_response"]["subject"] == "1.1"


def test_minor_trends_follow_the_previous_minor(spark):
    rows = [(i, v, r, s) for i, (v, r, s) in enumerate([("4.1", 2, "negative")] * 10 + [("4.3", 4, "positive")] * 10)]
    df = spark.createDataFrame(rows, "review_id int, version string, rating int, sentiment string")
    first, second = by_version.minor_version_trends(df).collect()
    assert (first["previous_minor"], first["significant"]) == (None, False)
    assert (second["previous_minor"], second["rating_change"], second["significant"]) == (1, 2.0, True)
    assert (second["positive_change"], second["positive_shift"], second["negative_shift"]) == (100.0, True, True)


def test_response_rates_without_positive_reviews(spark):
    df = responses.with_response(version_rows(spark).filter("rating <= 3"))
    row = responses.response_by_class(df).first()
    assert row["negative_rate"] == 25.0 and row["positive_rate"] is None and row["ratio"] is None


def test_stage_counts_come_with_the_job(spark):
    observed, seen = distributions.stage_counts(spark.range(37), "numbers")
    assert observed.collect() and seen.get["rows"] == 37
