"""Date, arithmetic, array, map and JSON functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from opinio.functions import dates, rates, text
from opinio.operators import distributions
from opinio.plans.base import query, rated, reviews, table, terms_sql, with_views

NOW = datetime(2024, 2, 1, 12, 0, 0)

# The same instant in every form the parser knows, one form per row.
MIXED = """select o_orderkey, o_orderdate, case o_orderkey % 4
    when 0 then cast(cast(epoch(o_orderdate) as bigint) as varchar)
    when 1 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
    when 2 then 'not a date' end as at,
  case when o_orderkey % 8 < 4 then cast(epoch(o_orderdate) as bigint) * 1000 end as millis from orders"""


def mixed_stamps(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    seconds = F.unix_timestamp("o_orderdate")
    form = F.col("o_orderkey") % 4
    return orders.withColumns(
        {
            "at": F.when(form == 0, seconds.cast("string"))
            .when(form == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
            .when(form == 2, "not a date"),
            "millis": F.when(F.col("o_orderkey") % 8 < 4, seconds * 1000),
        }
    )


@query(
    "D1_parse_timestamp",
    f"""select o_orderkey, case when o_orderkey % 4 < 2 or millis is not null then
          strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as parsed from ({MIXED})""",
)
def parse_timestamp(spark, sf):
    parsed = dates.parse_timestamp("at", "millis")
    return mixed_stamps(spark, sf).select(
        "o_orderkey", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed")
    )


@query(
    "D2_relative_dates",
    f"""select event_id, strftime(timestamp '{NOW}' - to_minutes(cast(user_id % 30 as int) * (case event_id % 6
          when 0 then 525600 when 1 then 43200 when 2 then 10080 when 3 then 1440 when 4 then 60 else 1 end)),
          '%Y-%m-%d %H:%M:%S') as resolved from events""",
)
def relative_dates(spark, sf):
    units = F.array(*[F.lit(u) for u in ("years", "months", "weeks", "days", "hours", "minutes")])
    unit = F.element_at(units, (F.col("event_id") % 6 + 1).cast("int"))
    phrase = F.concat_ws(" ", (F.col("user_id") % 30).cast("string"), unit, F.lit("ago"))
    resolved = dates.relative_date("phrase", F.lit(NOW).cast("timestamp_ntz"))
    return (
        table(spark, sf, "events")
        .select("event_id", phrase.alias("phrase"))
        .select("event_id", F.date_format(resolved, "yyyy-MM-dd HH:mm:ss").alias("resolved"))
    )


@query(
    "D3_reformat_dates",
    with_views(
        """select review_id, case when review_id % 9 <> 0 then strftime(date, '%Y-%m-%d') end as day from reviews"""
    ),
)
def reformat_dates(spark, sf):
    printed = F.when(F.col("review_id") % 9 != 0, F.date_format("date", "dd/MM/yyyy")).otherwise("n/a")
    rows = reviews(spark, sf).select("review_id", printed.alias("printed"))
    return rows.select("review_id", dates.reformat("printed", "dd/MM/yyyy").alias("day"))


@query(
    "D4_calendar_features",
    """select event_id, year(ts) as year, month(ts) as month, dayname(ts) as day_of_week,
       dayofweek(ts) in (0, 6) as is_weekend from events""",
)
def calendar_features(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", *[c.alias(n) for n, c in dates.calendar_features("ts").items()]
    )


PERIODS = """strftime({c}, '%Y-%m-%d') as day, strftime({c}, '%Y-%U') as week,
  concat(year({c}), '-Q', quarter({c})) as quarter, strftime({c}, '%Y-%m') as month"""


@query("D5_period_keys", with_views(f"select review_id, {PERIODS.format(c='date')} from reviews"))
def period_keys(spark, sf):
    return reviews(spark, sf).select(
        "review_id", *[dates.period_key("date", p).alias(p) for p in ("day", "week", "quarter", "month")]
    )


@query(
    "D6_month_keys",
    with_views("select strftime(date, '%Y-%m') as month, min(date) as first_date from reviews group by 1"),
)
def month_keys(spark, sf):
    rows = reviews(spark, sf).groupBy(dates.period_key("date", "month").alias("month"))
    return rows.agg(F.min("date").alias("first_date"))


@query(
    "D7_bin_labels",
    with_views(
        """select review_id, cast(date as date) as d, cast(date_trunc('week', date) as date) + 6 as w,
           last_day(date) as me, last_day(date_trunc('quarter', date) + interval 2 months) as q,
           make_date(year(date), 12, 31) as y from reviews"""
    ),
)
def bin_labels(spark, sf):
    codes = {"d": "D", "w": "W", "me": "ME", "q": "Q", "y": "Y"}
    return reviews(spark, sf).select(
        "review_id", *[dates.bin_end(dates.bin_start("date", f), f).alias(n) for n, f in codes.items()]
    )


@query(
    "D8_auto_frequency",
    with_views(
        """select rating, case when days > 730 then 'Y' when days > 180 then 'Q' when days > 60 then 'ME'
             when days > 14 then 'W' else 'D' end as freq
           from (select rating, datediff('day', min(date), max(date)) as days from reviews group by rating)
           union all select -1, case when days > 730 then 'Y' when days > 180 then 'Q' when days > 60 then 'ME'
             when days > 14 then 'W' else 'D' end
           from (select cast(floor((epoch(max(ts)) - epoch(min(ts))) / 86400) as int) as days from events)"""
    ),
)
def auto_frequency(spark, sf):
    per_rating = reviews(spark, sf).groupBy("rating").agg(
        dates.frequency_for(dates.span_days("date")).alias("freq")
    )
    events = table(spark, sf, "events").agg(dates.frequency_for(dates.span_days("ts")).alias("freq"))
    return per_rating.unionByName(events.withColumn("rating", F.lit(-1)))


@query(
    "D9_date_range",
    with_views(
        """select rating, strftime(min(date), '%Y-%m-%d') as first_date, strftime(max(date), '%Y-%m-%d') as last_date,
           datediff('day', min(date), max(date)) as days from reviews group by rating"""
    ),
)
def date_range(spark, sf):
    return reviews(spark, sf).groupBy("rating").agg(
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_date"),
        dates.span_days("date").alias("days"),
    )


@query(
    "M1_percentages",
    with_views(
        """select rating, sentiment, count(*) as n, 100.0 * count(*) / sum(count(*)) over () as pct_of_total,
           100.0 * count(*) / sum(count(*)) over (partition by sentiment) as pct_of_sentiment
           from rated group by rating, sentiment"""
    ),
)
def percentages(spark, sf):
    counts = rated(spark, sf).groupBy("rating", "sentiment").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumns(
        {
            "pct_of_total": distributions.share_within(counts, "n"),
            "pct_of_sentiment": distributions.share_within(counts, "n", "sentiment"),
        }
    )


@query(
    "M2_rounding",
    """select l_returnflag, l_linestatus, round(avg(l_quantity), 2) as avg_2dp, round(100.0 * avg(l_linenumber), 1)
       as pct_1dp from lineitem group by 1, 2""",
)
def rounding(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.avg("l_quantity"), 2).alias("avg_2dp"),
        F.round(100.0 * F.avg("l_linenumber"), 1).alias("pct_1dp"),
    )


@query(
    "M3_boolean_rates",
    with_views(
        """select version, avg(case when replied_at is not null then 1 else 0 end) as reply_rate,
           avg(case when author is not null and thumbs_up > 75 then 1 else 0 end) as popular_rate
           from reviews group by version"""
    ),
)
def boolean_rates(spark, sf):
    return reviews(spark, sf).groupBy("version").agg(
        rates.rate(F.col("replied_at").isNotNull()).alias("reply_rate"),
        rates.rate(F.when(F.col("author").isNotNull(), F.col("thumbs_up") > 75)).alias("popular_rate"),
    )


@query(
    "R1_array_functions",
    f"""select doc_id, array_to_string(w[1:3], ' ') as lead, len(list_filter(w, lambda t: length(t) > 5)) as n_long,
          array_to_string(list_transform(w, lambda t: concat('#', t))[1:2], ' ') as tagged, list_contains(w, 'the') as has_the
        from (select doc_id, {terms_sql('text')} as w from documents)""",
)
def array_functions(spark, sf):
    w = F.col("w")
    rows = table(spark, sf, "documents").select("doc_id", text.terms("text").alias("w"))
    return rows.select(
        "doc_id",
        F.array_join(F.slice(w, 1, 3), " ").alias("lead"),
        F.size(F.filter(w, lambda t: F.length(t) > 5)).alias("n_long"),
        F.array_join(F.slice(F.transform(w, lambda t: F.concat(F.lit("#"), t)), 1, 2), " ").alias("tagged"),
        F.array_contains(w, "the").alias("has_the"),
    )


@query(
    "R2_map_functions",
    with_views(
        """select version, n_1, n_5, label from (select version, count(*) filter (rating = 1) as n_1,
             count(*) filter (rating = 5) as n_5 from reviews group by version),
           lateral (select case when n_1 > n_5 then 'critical' else 'fond' end as label)"""
    ),
)
def map_functions(spark, sf):
    counts = reviews(spark, sf).groupBy("version", "rating").agg(F.count(F.lit(1)).alias("n"))
    # Five ratings at most per version.
    maps = counts.groupBy("version").agg(
        F.map_from_entries(F.collect_list(F.struct("rating", "n"))).alias("m")
    )
    labels = F.create_map(F.lit(True), F.lit("critical"), F.lit(False), F.lit("fond"))
    return maps.select(
        "version",
        F.coalesce(F.try_element_at("m", F.lit(1)), F.lit(0)).alias("n_1"),
        F.coalesce(F.try_element_at("m", F.lit(5)), F.lit(0)).alias("n_5"),
    ).withColumn("label", F.element_at(labels, F.col("n_1") > F.col("n_5")))


@query(
    "R3_json_functions",
    """select event_id, cast(json_extract(props, '$.k') as int) as k,
       concat('{"id":', event_id, ',"kind":"', event_type, '"}') as packed from events""",
)
def json_functions(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.from_json("props", "k int")["k"].alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("packed"),
    )
