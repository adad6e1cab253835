from datetime import datetime

import pytest
from pyspark.sql import functions as F

from opinio.functions import dates, versions

NOW = datetime(2024, 3, 1, 12)


@pytest.mark.parametrize(
    "value,expected",
    [
        ("now", NOW),
        ("1 year ago", datetime(2023, 3, 2, 12)),
        ("2 months ago", datetime(2024, 1, 1, 12)),
        ("3 Weeks ago", datetime(2024, 2, 9, 12)),
        ("90 minutes ago", datetime(2024, 3, 1, 10, 30)),
        ("86400", datetime(1970, 1, 2)),
        (86400, datetime(1970, 1, 2)),
        ("2020-02-03", datetime(2020, 2, 3)),
        ("2 fortnights ago", None),
        ("soon", None),
        (None, None),
    ],
)
def test_date_literals(value, expected):
    assert dates.resolve_date(value, NOW) == expected


def test_parse_timestamp(spark):
    rows = [("86400", None), ("1970-01-02", None), ("junk", 86400000), ("junk", None), (None, None), ("1e400", None)]
    df = spark.createDataFrame(rows, "at string, ms long")
    out = [r[0] for r in df.select(dates.parse_timestamp("at", "ms").cast("string")).collect()]
    assert out == ["1970-01-02 00:00:00"] * 3 + [None] * 3


def test_week_of_year_matches_strftime(spark):
    days = spark.sql("select explode(sequence(date'2018-01-01', date'2024-12-31', interval 1 day)) d")
    for row in days.select("d", dates.period_key("d", "week").alias("w")).collect():
        assert row["w"] == row["d"].strftime("%Y-%U")


def test_version_edges(spark):
    given = [None, "Unknown", "7", "7.2", "7.2.4", "7.2.4.9", "v7.x", "10.0.0", "6.100.0"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, version string")
    out = df.select(
        "i",
        *[c.alias(n) for n, c in versions.version_parts().items()],
        versions.version_code("version").alias("code"),
        versions.in_version_range("version", "7.0.0", "10.0.0").alias("inside"),
        versions.version_segment("version").alias("segment"),
        versions.major_label("version").alias("label"),
    ).orderBy("i")
    rows = [tuple(r)[1:] for r in out.collect()]
    assert rows == [
        (None, None, None, None, False, None, "Unknown"),
        (None, None, None, None, False, "Unknown", "Unknown"),
        (7, None, None, 70000, True, "latest", "Unknown"),
        (7, 2, None, 70200, True, "latest", "7"),
        (7, 2, 4, 70204, True, "latest", "7"),
        (7, 2, 4, 70204, True, "latest", "7"),
        (None, None, None, None, False, None, "v7"),
        (10, 0, 0, 100000, False, "latest", "10"),
        (6, 100, 0, 70000, True, "current", "6"),
    ]


@pytest.mark.parametrize(
    "freq,expected", [("D", "2024-02-14"), ("W", "2024-02-18"), ("M", "2024-02-29"), ("Q", "2024-03-31"), ("Y", "2024-12-31")]
)
def test_bin_labels(spark, freq, expected):
    day = F.lit("2024-02-14").cast("date")
    out = spark.range(1).select(dates.bin_end(dates.bin_start(day, freq), freq).cast("string")).first()[0]
    assert out == expected
