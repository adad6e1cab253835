"""Joins, aggregates, windows, ordering and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinio.functions import text, versions
from opinio.functions.rates import SENTIMENTS
from opinio.operators import distributions, findings, responses, trends
from opinio.operators import versions as by_version
from opinio.operators.ranking import top_k, top_n_per_key
from opinio.plans.base import query, rated, review_texts, reviews, table, with_views

# --- A: distributions and summaries --------------------------------------------------

DISTRIBUTION = """select rating, count(*) as n, 100.0 * count(*) / sum(count(*)) over () as pct,
  sum(rating * count(*)) over () / sum(count(*)) over () as mean_rating from {src} where rating is not null group by rating"""


@query("A1_rating_distribution", with_views(DISTRIBUTION.format(src="reviews")))
def rating_distribution(spark, sf):
    return distributions.rating_distribution(reviews(spark, sf))


@query(
    "A2_sentiment_distribution",
    with_views(
        "select sentiment, count(*) as n, 100.0 * count(*) / sum(count(*)) over () as pct from rated group by sentiment"
    ),
)
def sentiment_distribution(spark, sf):
    return distributions.sentiment_distribution(rated(spark, sf))


@query(
    "A3_dataset_summary",
    with_views(
        """select count(*) as total_reviews, round(avg(rating), 2) as average_rating,
           strftime(min(date), '%Y-%m-%d') as first_date, strftime(max(date), '%Y-%m-%d') as last_date,
           datediff('day', min(date), max(date)) as days, round(avg(length(text)), 1) as avg_length,
           max(length(text)) as max_length, count(*) filter (length(text) = 0) as empty_reviews, """
        + ", ".join(f"count(*) filter (rating = {r}) as rating_{r}" for r in range(1, 6))
        + " from texts"
    ),
)
def dataset_summary(spark, sf):
    return distributions.summary_values(review_texts(spark, sf))


@query(
    "A3_version_counts",
    with_views("select version, count(*) as n from reviews group by version"),
)
def version_counts(spark, sf):
    return distributions.category_counts(reviews(spark, sf), "version")


@query(
    "A4_length_categories",
    """select length_category, count(*) as n from (select case when n = 0 then 'empty' when n < 50 then 'very_short'
         when n < 200 then 'short' when n < 500 then 'medium' else 'long' end as length_category
         from (select length(text) as n from documents)) group by 1""",
)
def length_categories(spark, sf):
    category = text.length_category(text.text_length("text"))
    rows = table(spark, sf, "documents").select(category.alias("length_category"))
    return distributions.category_counts(rows, "length_category")


@query(
    "A4_major_versions_top5",
    with_views(
        """select case when version like '%.%' then split_part(version, '.', 1) else 'Unknown' end as major_version,
           count(*) as n from reviews group by 1 order by n desc, 1 limit 5"""
    ),
)
def major_versions_top5(spark, sf):
    rows = reviews(spark, sf).select(versions.major_label("version").alias("major_version"))
    return distributions.category_counts(rows, "major_version", 5)


@query(
    "A5_top_versions",
    with_views(
        """select version, count(*) as n, 100.0 * count(*) / (select count(*) from reviews) as pct from reviews
           group by version order by n desc, version limit 15"""
    ),
)
def top_versions(spark, sf):
    return distributions.top_categories(reviews(spark, sf), "version", 15)


@query(
    "A6_metric_by_version",
    with_views(
        "select version, avg(rating) as avg_rating, count(*) as n from reviews group by version having count(*) >= 10"
    ),
)
def metric_by_version(spark, sf):
    return by_version.metric_by_version(reviews(spark, sf), "rating", 10)


@query(
    "A6_thumbs_by_version",
    with_views(
        "select version, avg(thumbs_up) as avg_thumbs_up, count(*) as n from reviews group by version having count(*) >= 10"
    ),
)
def thumbs_by_version(spark, sf):
    return by_version.metric_by_version(reviews(spark, sf), "thumbs_up", 10)


def _version_ratings_sql(least: int, k: int) -> str:
    return with_views(
        f"""select version, avg(rating) as avg_rating, count(rating) as n from reviews group by version
            having count(rating) >= {least} order by n desc, version limit {k}"""
    )


@query("A7_version_ratings", _version_ratings_sql(10, 10))
def version_ratings(spark, sf):
    return by_version.version_ratings(reviews(spark, sf), 10, 10)


@query("A7_version_ratings_min20", _version_ratings_sql(20, 10))
def version_ratings_min20(spark, sf):
    return by_version.version_ratings(reviews(spark, sf), 20, 10)


@query("A7_version_ratings_top15", _version_ratings_sql(0, 15))
def version_ratings_top15(spark, sf):
    return by_version.version_ratings(reviews(spark, sf), 0, 15)


SHARES = ", ".join(f"100.0 * count(*) filter (sentiment = '{s}') / count(*) as {s}" for s in SENTIMENTS)


@query(
    "A7_version_overview",
    with_views(
        f"""select version, count(*) as n, avg(rating) as avg_rating, {SHARES},
            100.0 * count(*) filter (has_response) / count(*) as response_rate
            from rated group by version having count(*) >= 10 order by n desc, version limit 10"""
    ),
)
def version_overview(spark, sf):
    return by_version.version_overview(rated(spark, sf))


def _sentiment_by_version_sql(least: int, k: int) -> str:
    return with_views(
        f"""select version, {SHARES}, count(*) as n from rated group by version having count(*) >= {least}
            order by n desc, version limit {k}"""
    )


@query("A8_sentiment_by_version", _sentiment_by_version_sql(20, 10))
def sentiment_by_version(spark, sf):
    return by_version.sentiment_by_version(rated(spark, sf), 20, 10)


@query("A8_sentiment_by_version_top5", _sentiment_by_version_sql(10, 5))
def sentiment_by_version_top5(spark, sf):
    return by_version.sentiment_by_version(rated(spark, sf), 10, 5)


def _share_sql(column: str, values: str, key: str) -> str:
    return with_views(
        f"""select p.period, v.value as {column}, count(r.review_id) as n, 100.0 * count(r.review_id) / p.total as pct
            from (select {key} as period, count(*) as total from rated group by 1) p
            cross join (select unnest([{values}]) as value) v
            left join rated r on {key.replace('date', 'r.date')} = p.period and r.{column} = v.value
            group by p.period, v.value, p.total"""
    )


MONTH = "strftime(date, '%Y-%m')"
QUARTER = "concat(year(date), '-Q', quarter(date))"
WEEK = "strftime(date, '%Y-%U')"


@query("A10_rating_by_month", _share_sql("rating", "1, 2, 3, 4, 5", MONTH))
def rating_by_month(spark, sf):
    return trends.rating_share_by_period(rated(spark, sf), "month")


@query("A10_rating_by_quarter", _share_sql("rating", "1, 2, 3, 4, 5", QUARTER))
def rating_by_quarter(spark, sf):
    return trends.rating_share_by_period(rated(spark, sf), "quarter")


@query("A11_sentiment_by_month", _share_sql("sentiment", "'positive', 'neutral', 'negative'", MONTH))
def sentiment_by_month(spark, sf):
    return trends.sentiment_share_by_period(rated(spark, sf), "month")


@query(
    "A12_versions_by_month",
    with_views(
        f"""select version, {MONTH} as period, count(*) as n from reviews where version in (
              select version from reviews group by version order by count(*) desc, version limit 5) group by 1, 2"""
    ),
)
def versions_by_month(spark, sf):
    return trends.versions_over_time(reviews(spark, sf))


def _period_rating_sql(key: str) -> str:
    return with_views(
        f"select {key} as period, avg(rating) as avg_rating, count(rating) as n, min(date) as first_date from reviews group by 1"
    )


@query("A13_rating_by_month", _period_rating_sql(MONTH))
def average_by_month(spark, sf):
    return trends.rating_by_period(reviews(spark, sf), "month")


@query("A13_rating_by_week", _period_rating_sql(WEEK))
def average_by_week(spark, sf):
    return trends.rating_by_period(reviews(spark, sf), "week")


@query("A14_volume_by_month", with_views(f"select {MONTH} as period, count(*) as n from reviews group by 1"))
def volume_by_month(spark, sf):
    return trends.volume_by_period(reviews(spark, sf), "month")


@query("A14_volume_by_quarter", with_views(f"select {QUARTER} as period, count(*) as n from reviews group by 1"))
def volume_by_quarter(spark, sf):
    return trends.volume_by_period(reviews(spark, sf), "quarter")


TREND_VIEWS = {
    "bins": """select unnest(generate_series(date_trunc('month', (select min(date) from reviews)),
      date_trunc('month', (select max(date) from reviews)), interval 1 month)) as bin""",
    "counted": f"""select b.bin, avg(rating) as avg_rating, count(rating) as count,
      {", ".join(f"count(*) filter (rating = {r}) as rating_{r}_count" for r in range(1, 6))}
      from bins b left join reviews g on date_trunc('month', g.date) = b.bin group by b.bin""",
}
RATING_COUNTS = ", ".join(
    f"rating_{r}_count, 100.0 * rating_{r}_count / nullif(count, 0) as rating_{r}_pct" for r in range(1, 6)
)
ROLLING = "avg(avg_rating) over (order by bin rows between 2 preceding and current row)"


@query(
    "A15_monthly_trend",
    with_views(
        f"""select last_day(bin) as date, avg_rating, count, {RATING_COUNTS}, round({ROLLING}, 9) as rolling_avg_3
            from counted""",
        **TREND_VIEWS,
    ),
)
def monthly_trend(spark, sf):
    table_ = trends.trend(reviews(spark, sf), rolling_window=3)
    return table_.withColumn("rolling_avg_3", F.round("rolling_avg_3", 9))


@query(
    "A15_auto_trend",
    with_views(
        f"""select make_date(year(date), 12, 31) as date, avg(rating) as avg_rating, count(rating) as count,
            {", ".join(f"count(*) filter (rating = {r}) as rating_{r}_count, "
                       f"100.0 * count(*) filter (rating = {r}) / count(rating) as rating_{r}_pct" for r in range(1, 6))}
            from reviews group by year(date)"""
    ),
)
def auto_trend(spark, sf):
    return trends.trend(reviews(spark, sf), freq="auto")


@query(
    "A15_weekly_value_trend",
    """select cast(bin as date) + 6 as ts, avg(value) as avg_value, count(value) as count from (
         select unnest(generate_series(date_trunc('week', min(ts)), date_trunc('week', max(ts)), interval 7 days)) as bin
         from events) b
       left join events e on date_trunc('week', e.ts) = b.bin group by bin""",
)
def weekly_value_trend(spark, sf):
    return trends.trend(table(spark, sf, "events"), "ts", "value", "W")


@query(
    "A16_rating_trend_chart",
    with_views(
        "select last_day(bin) as date, avg_rating, count, strftime(bin, '%Y-%m') as period from counted", **TREND_VIEWS
    ),
)
def rating_trend_chart(spark, sf):
    return trends.rating_trend(reviews(spark, sf), "M")


RESPONSE = "count(*) filter (has_response) as responded, count(*) as total"
RATE = "100.0 * count(*) filter (has_response) / count(*)"


@query("A17_response_overall", with_views(f"select {RESPONSE}, {RATE} as response_rate from rated"))
def response_overall(spark, sf):
    return responses.response_overall(rated(spark, sf))


@query(
    "A17_response_by_rating",
    with_views(f"select rating, {RESPONSE}, round({RATE}, 1) as response_rate from rated group by rating"),
)
def response_by_rating(spark, sf):
    return responses.response_by(rated(spark, sf), "rating")


@query(
    "A17_response_by_version",
    with_views(
        f"""select version, {RESPONSE}, round({RATE}, 1) as response_rate from rated group by version
            having count(*) >= 20 order by total desc, version limit 10"""
    ),
)
def response_by_version(spark, sf):
    return responses.response_by_version(rated(spark, sf), 20, 10)


@query(
    "A18_rating_by_response",
    with_views(
        """select case when has_response then 'Responded' else 'Not Responded' end as response,
           round(avg(rating), 2) as avg_rating, count(rating) as n from rated group by has_response"""
    ),
)
def rating_by_response(spark, sf):
    return responses.rating_by_response(rated(spark, sf))


CLASSES = """select count(*) filter (rating <= 2) as negative_n,
  count(*) filter (rating <= 2 and has_response) as negative_responded, count(*) filter (rating >= 4) as positive_n,
  count(*) filter (rating >= 4 and has_response) as positive_responded from rated"""


@query(
    "A19_response_by_class",
    with_views(
        """select *, negative_rate / positive_rate as ratio from (select *, 100.0 * negative_responded / negative_n
           as negative_rate, 100.0 * positive_responded / positive_n as positive_rate from classes)""",
        classes=CLASSES,
    ),
)
def response_by_class(spark, sf):
    return responses.response_by_class(rated(spark, sf))


@query(
    "A20_subset_sentiment",
    with_views(
        """select *, subset_pct - whole_pct as diff, case when subset_pct - whole_pct > 0 then 'higher' else 'lower' end
           as direction from (select sentiment, 100.0 * count(*) filter (major_version >= 7 and major_version < 11)
             / (select count(*) from rated where major_version >= 7 and major_version < 11) as subset_pct,
             100.0 * count(*) / (select count(*) from rated) as whole_pct from rated group by sentiment)"""
    ),
)
def subset_sentiment(spark, sf):
    inside = versions.in_version_range("version", "7.0.0", "11.0.0")
    return by_version.compare_subset(rated(spark, sf), inside)


@query(
    "A20_subset_response",
    with_views(
        """select *, subset_rate - whole_rate as diff, case when subset_rate - whole_rate > 0 then 'higher' else 'lower'
           end as direction from (select *, 100.0 * subset_responded / subset_n as subset_rate,
             100.0 * whole_responded / whole_n as whole_rate from (
               select count(*) filter (inside) as subset_n, count(*) filter (inside and has_response) as subset_responded,
                 count(*) as whole_n, count(*) filter (has_response) as whole_responded from (
                   select *, coalesce(major_version >= 7 and major_version < 11, false) as inside from rated)))"""
    ),
)
def subset_response(spark, sf):
    inside = versions.in_version_range("version", "7.0.0", "11.0.0")
    return responses.compare_response(rated(spark, sf), inside)


SEGMENTED = """select *, case when version = 'Unknown' then 'Unknown' when major_version >= 7 then 'latest'
  when major_version = 6 then 'current' when major_version = 5 then 'older' when major_version < 5 then 'legacy' end
  as segment from rated"""


def _segment_sql(column: str) -> str:
    return with_views(
        f"""select segment, {column}, count(*) as n, 100.0 * count(*) / sum(count(*)) over (partition by segment) as pct
            from segmented where segment is not null group by segment, {column}""",
        segmented=SEGMENTED,
    )


@query("A21_segment_ratings", _segment_sql("rating"))
def segment_ratings(spark, sf):
    return by_version.segment_distribution(rated(spark, sf), "rating")


@query("A21_segment_sentiment", _segment_sql("sentiment"))
def segment_sentiment(spark, sf):
    return by_version.segment_distribution(rated(spark, sf), "sentiment")


@query(
    "A21_segment_means",
    with_views(
        "select segment, count(*) as n, avg(rating) as avg_rating from segmented where segment is not null group by segment",
        segmented=SEGMENTED,
    ),
)
def segment_means(spark, sf):
    return by_version.segment_means(rated(spark, sf))


@query(
    "A22_major_versions",
    with_views(
        """select major_version, count(*) as n, 100.0 * count(*) / (select count(*) from rated) as pct from rated
           where major_version is not null group by major_version"""
    ),
)
def major_versions(spark, sf):
    return by_version.major_versions(reviews(spark, sf))


MAJORS = """select major_version, avg(rating) as avg_rating, count(rating) as n from rated
  where major_version is not null group by major_version having count(rating) >= 10"""


@query("A22_major_ratings", with_views(MAJORS.replace(">= 10", ">= 5")))
def major_ratings(spark, sf):
    return by_version.major_ratings(reviews(spark, sf), 5)


@query(
    "A23_major_sentiment",
    with_views(
        f"""select major_version, {SHARES}, count(*) as n from rated where major_version is not null
            group by major_version having count(*) >= 5"""
    ),
)
def major_sentiment(spark, sf):
    return by_version.major_sentiment(rated(spark, sf), 5)


@query(
    "A24_rating_histogram",
    with_views(
        """select version, rating, count(*) as n from reviews where version in (
             select version from reviews group by version order by count(*) desc, version limit 5) group by 1, 2"""
    ),
)
def rating_histogram(spark, sf):
    return by_version.rating_histogram_top_versions(reviews(spark, sf), 5)


VERSION_CUBE = f"""select version, count(*) as n, avg(rating) as avg_rating, {SHARES},
  count(*) filter (has_response) as responded, {RATE} as response_rate from rated group by version"""


def _ends(column: str, sides, k: int, least: int) -> str:
    parts = [
        f"""(select '{side}' as side, row_number() over (order by {column} {way}, version) as rank, version, avg_rating, n
             from cube where n >= {least} order by {column} {way}, version limit {k})"""
        for side, way in sides
    ]
    return " union all ".join(parts)


@query(
    "A25_best_and_worst",
    with_views(_ends("avg_rating", (("best", "desc"), ("worst", "asc")), 3, 10), cube=VERSION_CUBE),
)
def best_and_worst(spark, sf):
    return by_version.best_and_worst(reviews(spark, sf))


@query(
    "A26_sentiment_extremes",
    with_views(
        """(select 'positive' as side, version, positive as pct, n from cube where n >= 10 order by positive desc, version limit 5)
           union all (select 'negative', version, negative, n from cube where n >= 10 order by negative desc, version limit 5)""",
        cube=VERSION_CUBE,
    ),
)
def sentiment_extremes(spark, sf):
    return by_version.sentiment_extremes(rated(spark, sf))


@query(
    "A27_response_extremes",
    with_views(
        """(select 'highest' as side, version, round(response_rate, 6) as response_rate, responded, n as total from cube
             where n >= 5 order by round(response_rate, 6) desc, version limit 5)
           union all (select 'lowest', version, round(response_rate, 6), responded, n from cube
             where n >= 5 order by round(response_rate, 6), version limit 5)""",
        cube=VERSION_CUBE,
    ),
)
def response_extremes(spark, sf):
    return responses.response_extremes(rated(spark, sf))


@query(
    "A28_dominant_versions",
    with_views(
        """select kind, name, n, 100.0 * n / (select count(*) from rated) as pct from (
             (select 'version' as kind, version as name, count(*) as n from rated group by version
               order by n desc, version limit 1)
             union all (select 'major_version', cast(major_version as varchar), count(*) as n from rated
               where major_version is not null group by major_version order by n desc, major_version limit 1))"""
    ),
)
def dominant_versions(spark, sf):
    return by_version.dominant_versions(reviews(spark, sf))


FINDINGS = """
(select 'low_rating' as rule, version as subject, avg_rating as value, n, printf(
   'Version %s has a low average rating of %s/5 based on %d reviews.', version, printf('%.1f', round(avg_rating, 1)), n)
   as finding from (select * from cube where n >= 10 order by avg_rating, version limit 3) where avg_rating < 3.0)
union all
(select 'high_rating', version, avg_rating, n, printf(
   'Version %s has a high average rating of %s/5 based on %d reviews.', version, printf('%.1f', round(avg_rating, 1)), n)
   from (select * from cube where n >= 10 order by avg_rating desc, version limit 3) where avg_rating > 3.5)
union all
(select 'improvement', 'all', b - a, n, printf(
   'Ratings show improvement across major versions, from %s (version %s) to %s (version %s).',
   printf('%.1f', round(a, 1)), cast(va as varchar), printf('%.1f', round(b, 1)), cast(vb as varchar)) from ends where b - a >= 0.5)
union all
(select 'decline', 'all', b - a, n, printf(
   'Ratings show decline across major versions, from %s (version %s) to %s (version %s).',
   printf('%.1f', round(a, 1)), cast(va as varchar), printf('%.1f', round(b, 1)), cast(vb as varchar)) from ends where b - a <= -0.5)
union all
(select 'biggest_gain', cast(major_version as varchar), change, n, printf(
   'Biggest improvement was from version %s to %s, with ratings increasing by %s points.', cast(previous as varchar),
   cast(major_version as varchar), printf('%.1f', round(abs(change), 1)))
   from (select * from steps where change is not null order by change desc, major_version limit 1) where change >= 0.5)
union all
(select 'biggest_drop', cast(major_version as varchar), change, n, printf(
   'Biggest decline was from version %s to %s, with ratings dropping by %s points.', cast(previous as varchar),
   cast(major_version as varchar), printf('%.1f', round(abs(change), 1)))
   from (select * from steps where change is not null order by change, major_version limit 1) where change <= -0.5)
union all
(select 'most_positive', version, positive, n, printf(
   'Version %s has the highest positive sentiment at %s%% based on %d reviews.', version, printf('%.1f', round(positive, 1)), n)
   from (select * from cube where n >= 10 order by positive desc, version limit 1) where positive >= 60)
union all
(select 'most_negative', version, negative, n, printf(
   'Version %s has the highest negative sentiment at %s%% based on %d reviews.', version, printf('%.1f', round(negative, 1)), n)
   from (select * from cube where n >= 10 order by negative desc, version limit 1) where negative >= 60)
union all
(select 'high_response', version, response_rate, n, printf(
   'Version %s has the highest developer response rate at %s%% (%d/%d reviews).', version,
   printf('%.1f', round(response_rate, 1)), responded, n)
   from (select * from cube where n >= 10 order by response_rate desc, version limit 1) where response_rate > 20)
union all
(select 'low_response', version, response_rate, n, printf(
   'Version %s has the lowest developer response rate at %s%% (%d/%d reviews).', version,
   printf('%.1f', round(response_rate, 1)), responded, n)
   from (select * from cube where n >= 10 order by response_rate, version limit 1) where response_rate < 5)
union all
(select 'negative_first', 'negative', negative_rate, negative_n, printf(
   'Negative reviews (rating 1-2) receive significantly more developer responses (%s%%) than positive ones (%s%%).',
   printf('%.1f', round(negative_rate, 1)), printf('%.1f', round(positive_rate, 1)))
   from (select *, 100.0 * negative_responded / negative_n as negative_rate,
     100.0 * positive_responded / positive_n as positive_rate from classes) where negative_rate > 2 * positive_rate)
"""
FINDING_VIEWS = {
    "cube": VERSION_CUBE,
    "classes": CLASSES,
    "majors": MAJORS,
    "ends": """select arg_min(avg_rating, major_version) as a, arg_max(avg_rating, major_version) as b,
      min(major_version) as va, max(major_version) as vb, cast(sum(n) as bigint) as n from majors having count(*) >= 3""",
    "steps": """select *, avg_rating - lag(avg_rating) over (order by major_version) as change,
      lag(major_version) over (order by major_version) as previous from majors
      where (select count(*) from majors) >= 3""",
}


@query("A29_key_findings", with_views(FINDINGS, **FINDING_VIEWS))
def key_findings(spark, sf):
    return findings.key_findings(rated(spark, sf))


# The same rules where ratings drift with the major version, so that the trend rules fire.
DRIFT = """case when major_version >= 9 then least(5, rating + 2) when major_version is not null
  then greatest(1, rating - 1) else rating end"""


@query(
    "A29_findings_drifting",
    with_views(
        FINDINGS,
        drifted=f"""select * replace ({DRIFT} as rating) from rated""",
        resent="""select * replace (case when rating >= 4 then 'positive' when rating <= 2 then 'negative'
          else 'neutral' end as sentiment) from drifted""",
        **{k: v.replace("from rated", "from resent") for k, v in FINDING_VIEWS.items()},
    ),
)
def findings_drifting(spark, sf):
    major = versions.version_part("version", 1)
    drifted = (
        F.when(major >= 9, F.least(F.lit(5), F.col("rating") + 2))
        .when(major.isNotNull(), F.greatest(F.lit(1), F.col("rating") - 1))
        .otherwise(F.col("rating"))
    )
    rows = rated(spark, sf).drop("sentiment").withColumn("rating", drifted)
    return findings.key_findings(rows)


@query(
    "A34_data_info",
    with_views(
        """select 'dataset' as section, 'total_reviews' as item, cast(count(*) as varchar) as value from rated
           union all select 'date_range', 'start', strftime(min(date), '%Y-%m-%d') from rated
           union all select 'date_range', 'end', strftime(max(date), '%Y-%m-%d') from rated
           union all select 'sentiment_pct', sentiment,
             cast(round(100.0 * count(*) / (select count(*) from rated), 1) as varchar) from rated group by sentiment
           union all select 'rating_pct', cast(rating as varchar),
             cast(round(100.0 * count(*) / (select count(*) from rated), 1) as varchar) from rated group by rating
           union all select 'top_versions', version, cast(n as varchar) from (
             select version, count(*) as n from rated group by version order by n desc, version limit 5)"""
    ),
)
def data_info(spark, sf):
    return distributions.data_info(rated(spark, sf))


@query(
    "A35_stage_counts",
    with_views(
        """select 'loaded' as stage, count(*) as rows from reviews
           union all select 'with_author', count(*) from reviews where author is not null
           union all select 'with_version', count(*) from reviews where author is not null and version <> 'Unknown'"""
    ),
)
def stage_counts(spark, sf):
    loaded, n_loaded = distributions.stage_counts(reviews(spark, sf), "loaded")
    named, n_named = distributions.stage_counts(loaded.filter("author is not null"), "with_author")
    kept, n_kept = distributions.stage_counts(named.filter("version <> 'Unknown'"), "with_version")
    kept.write.format("noop").mode("overwrite").save()
    return distributions.observed_counts(
        spark, ("loaded", n_loaded), ("with_author", n_named), ("with_version", n_kept)
    )


# --- W: windows ----------------------------------------------------------------------


@query(
    "W1_major_version_changes",
    with_views(
        """select *, lag(major_version) over (order by major_version) as previous_major,
           avg_rating - lag(avg_rating) over (order by major_version) as rating_change from majors""",
        majors=MAJORS,
    ),
)
def major_version_changes(spark, sf):
    return by_version.major_version_changes(reviews(spark, sf))


@query(
    "W1_overall_change",
    with_views(
        """select count(*) as majors, min(major_version) as first_major, arg_min(avg_rating, major_version) as first_rating,
           max(major_version) as last_major, arg_max(avg_rating, major_version) as last_rating,
           arg_max(avg_rating, major_version) - arg_min(avg_rating, major_version) as change from majors""",
        majors=MAJORS,
    ),
)
def overall_change(spark, sf):
    return by_version.overall_change(reviews(spark, sf))


@query(
    "W2_rolling_mean",
    with_views(
        f"select last_day(bin) as date, avg_rating, count, round({ROLLING.replace('2 preceding', '5 preceding')}, 9) as rolling_avg_6 from counted",
        **TREND_VIEWS,
    ),
)
def rolling_mean(spark, sf):
    table_ = trends.trend(reviews(spark, sf), rating_breakdown=False, rolling_window=6)
    return table_.withColumn("rolling_avg_6", F.round("rolling_avg_6", 9))


@query(
    "W3_minor_version_trends",
    with_views(
        """select major_version, minor_version, previous_minor, avg_rating, n, rating_change,
             coalesce(abs(rating_change) >= 0.05, false) as significant, positive_change, negative_change,
             coalesce(abs(rating_change) >= 0.05 and abs(positive_change) >= 1.0, false) as positive_shift,
             coalesce(abs(rating_change) >= 0.05 and abs(negative_change) >= 1.0, false) as negative_shift
           from (select *, lag(minor_version) over w as previous_minor,
                   round(avg_rating - lag(avg_rating) over w, 2) as rating_change,
                   positive - lag(positive) over w as positive_change, negative - lag(negative) over w as negative_change
                 from (select *, count(*) over (partition by major_version) as minors from minors
                       where n >= 10 and major_n >= 10) where minors >= 2
                 window w as (partition by major_version order by minor_version))""",
        minors=f"""select major_version, minor_version, count(*) as n, round(avg(rating), 2) as avg_rating, {SHARES},
          sum(count(*)) over (partition by major_version) as major_n from rated
          where major_version is not null and minor_version is not null group by 1, 2""",
    ),
)
def minor_version_trends(spark, sf):
    return by_version.minor_version_trends(rated(spark, sf), 10, 0.05, 1.0)


@query(
    "W5_share_of_partition",
    with_views(
        """select version, rating, count(*) as n, 100.0 * count(*) / sum(count(*)) over (partition by version) as pct
           from reviews group by version, rating"""
    ),
)
def share_of_partition(spark, sf):
    counts = reviews(spark, sf).groupBy("version", "rating").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", distributions.share_within(counts, "n", "version"))


@query(
    "W6_top_n_per_stratum",
    with_views(
        """select rating, rank, review_id from (select rating, review_id, row_number() over (
             partition by rating order by thumbs_up desc, review_id) as rank from reviews) where rank <= 20"""
    ),
)
def top_n_per_stratum(spark, sf):
    rows = reviews(spark, sf).select("rating", "review_id", "thumbs_up")
    order = (F.desc("thumbs_up"), F.asc("review_id"))
    ranked = top_n_per_key(rows, "rating", 20, *order, salt_on=["review_id"], rank="rank")
    return ranked.select("rating", "rank", "review_id")


# --- J: joins ------------------------------------------------------------------------


@query(
    "J1_period_left_join",
    with_views(
        "select last_day(bin) as date, avg_rating, count, rating_1_count, rating_5_count from counted", **TREND_VIEWS
    ),
)
def period_left_join(spark, sf):
    return trends.trend(reviews(spark, sf)).select("date", "avg_rating", "count", "rating_1_count", "rating_5_count")


@query(
    "J2_period_inner_join",
    with_views(
        """select m.day, m.avg_rating, c.n from (select cast(date as date) as day, avg(rating) as avg_rating from reviews
           group by 1) m join (select cast(date as date) as day, count(*) as n from reviews group by 1) c using (day)"""
    ),
)
def period_inner_join(spark, sf):
    rows = reviews(spark, sf).groupBy(F.col("date").cast("date").alias("day"))
    return rows.agg(F.avg("rating").alias("avg_rating"), F.count(F.lit(1)).alias("n"))


@query(
    "J3_semi_top_versions",
    with_views(
        """select review_id, version from reviews where version in (
             select version from reviews group by version order by count(*) desc, version limit 10)"""
    ),
)
def semi_top_versions(spark, sf):
    rows = reviews(spark, sf).select("review_id", "version")
    top = distributions.category_counts(rows, "version", 10).select("version")
    return rows.join(F.broadcast(top), "version", "left_semi").select("review_id", "version")


@query(
    "J4_anti_join",
    with_views("select review_id, rating from reviews where review_id not in (select doc_id from documents)"),
)
def anti_join(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"))
    return reviews(spark, sf).join(docs, "review_id", "left_anti").select("review_id", "rating")


@query(
    "J5_label_lookup",
    with_views(
        """select review_id, case rating when 1 then 'awful' when 2 then 'poor' when 3 then 'fair' when 4 then 'good'
           when 5 then 'great' end as label from reviews"""
    ),
)
def label_lookup(spark, sf):
    names = [(1, "awful"), (2, "poor"), (3, "fair"), (4, "good"), (5, "great")]
    labels = spark.createDataFrame(names, "rating int, label string")
    return reviews(spark, sf).join(F.broadcast(labels), "rating", "left").select("review_id", "label")


@query(
    "J6_aligned_counts",
    with_views(f"select version, {SHARES}, count(*) as n from rated group by version"),
)
def aligned_counts(spark, sf):
    return by_version.review_cube(rated(spark, sf), "version").select("version", *SENTIMENTS, "n")


# --- O: order, limit, sets, reshaping ------------------------------------------------


@query("O1_sorted_reviews", with_views("select review_id, date, rating from reviews order by rating desc, date desc, review_id"))
def sorted_reviews(spark, sf):
    rows = reviews(spark, sf).select("review_id", "date", "rating")
    return rows.orderBy(F.desc("rating"), F.desc("date"), F.asc("review_id"))


@query(
    "O2_newest_reviews",
    with_views("select review_id, date, rating from reviews order by rating desc, date desc, review_id limit 100"),
)
def newest_reviews(spark, sf):
    rows = reviews(spark, sf).select("review_id", "date", "rating")
    return top_k(rows, 100, F.desc("rating"), F.desc("date"), F.asc("review_id"))


@query(
    "O3_union_by_name",
    with_views(
        """select review_id, rating, null as lang from reviews
           union all select doc_id, null, lang from documents"""
    ),
)
def union_by_name(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), "lang")
    rows = reviews(spark, sf).select("review_id", "rating")
    return rows.unionByName(docs, allowMissingColumns=True)


@query(
    "O4_set_difference",
    "select doc_id, lang from documents where doc_id not in (select doc_id from labels)",
)
def set_difference(spark, sf):
    labelled = table(spark, sf, "labels").select("doc_id")
    return table(spark, sf, "documents").join(labelled, "doc_id", "left_anti").select("doc_id", "lang")


@query(
    "O5_pivot",
    with_views(
        "select version, "
        + ", ".join(f"count(*) filter (sentiment = '{s}') as {s}" for s in SENTIMENTS)
        + " from rated group by version"
    ),
)
def pivot(spark, sf):
    return by_version.sentiment_pivot(rated(spark, sf))


@query(
    "O5_melt",
    with_views(
        """select version, v.sentiment, count(r.review_id) as n from (select distinct version from rated) x
           cross join (select unnest(['positive', 'neutral', 'negative']) as sentiment) v
           left join rated r using (version, sentiment) group by 1, 2"""
    ),
)
def melt(spark, sf):
    wide = by_version.sentiment_pivot(rated(spark, sf))
    return by_version.melt(wide, "version", SENTIMENTS, "sentiment", "n")
