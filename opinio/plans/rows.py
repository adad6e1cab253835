"""Row cleaning, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinio.columns import METADATA_FIELDS, has_text, text_column
from opinio.functions import rates, text, versions
from opinio.operators import cleaning, trends
from opinio.plans.base import basic_sql, query, review_texts, rated, reviews, squeeze_sql, table, with_views


@query(
    "P1_dedupe_keep_first",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from (
         select *, row_number() over (partition by l_orderkey, l_linenumber
           order by l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) rn from lineitem) where rn = 1""",
)
def dedupe_keep_first(spark, sf):
    from opinio.operators.ranking import first_per_key

    order = [F.asc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    rows = first_per_key(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], *order)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def sparse_reviews(spark, sf):
    """Reviews with gaps: a text, a version or a date is missing here and there."""
    rows = review_texts(spark, sf)
    gap = F.col("review_id")
    return rows.withColumns(
        {
            "text": F.when(gap % 11 != 0, F.col("text")),
            "version": F.when(gap % 7 != 0, F.col("version")),
            "date": F.when(gap % 13 != 0, F.col("date")),
        }
    )


SPARSE = """select * replace (case when review_id % 11 <> 0 then text end as text,
  case when review_id % 7 <> 0 then version end as version,
  case when review_id % 13 <> 0 then date end as date) from texts"""


@query(
    "P2_fill_missing",
    with_views(
        """select review_id, coalesce(author, 'Anonymous') as author, coalesce(version, 'Unknown') as version,
           length(coalesce(text, '')) as text_length from sparse""",
        sparse=SPARSE,
    ),
)
def fill_missing(spark, sf):
    rows = cleaning.fill_missing(sparse_reviews(spark, sf))
    return rows.select("review_id", "author", "version", text.text_length("text").alias("text_length"))


@query(
    "P3_drop_incomplete",
    with_views(
        "select review_id, date, rating from sparse where review_id is not null and date is not null and rating is not null",
        sparse=SPARSE,
    ),
)
def drop_incomplete(spark, sf):
    return cleaning.drop_incomplete(sparse_reviews(spark, sf)).select("review_id", "date", "rating")


def repeated_reviews(spark, sf):
    """Sparse reviews arriving once per order line, so that ids repeat."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("review_id"), F.col("l_shipdate").alias("seen"), "l_partkey"
    )
    return lines.join(sparse_reviews(spark, sf), "review_id")


@query(
    "P4_clean_reviews",
    with_views(
        f"""select review_id, author, version, text, length(text) as text_length, rating, l_partkey from (
              select review_id, coalesce(author, 'Anonymous') as author, coalesce(version, 'Unknown') as version,
                {squeeze_sql("coalesce(text, '')")} as text, rating, date, l_partkey, row_number() over (
                  partition by review_id order by l_shipdate, l_partkey) rn
              from sparse join lineitem on l_orderkey = review_id) where rn = 1 and date is not null""",
        sparse=SPARSE,
    ),
)
def clean_reviews(spark, sf):
    rows = cleaning.clean_reviews(repeated_reviews(spark, sf), F.asc("seen"), F.asc("l_partkey"))
    return rows.select("review_id", "author", "version", "text", "text_length", "rating", "l_partkey")


@query(
    "P5_drop_null_dates",
    with_views("select review_id, date from sparse where date is not null", sparse=SPARSE),
)
def drop_null_dates(spark, sf):
    return trends.dated(sparse_reviews(spark, sf)).select("review_id", "date")


@query(
    "P6_version_segments",
    with_views(
        """select review_id, version, case when version = 'Unknown' then 'Unknown' when major_version >= 7 then 'latest'
           when major_version = 6 then 'current' when major_version = 5 then 'older'
           when major_version < 5 then 'legacy' end as segment from rated"""
    ),
)
def version_segments(spark, sf):
    return reviews(spark, sf).select(
        "review_id", "version", versions.version_segment("version").alias("segment")
    )


@query(
    "P7_dashboard_segments",
    with_views(
        """select segment, count(*) as n from (select case when version = 'Unknown' then 'Unknown'
           when major_version >= 11 then 'Latest' when major_version = 10 then 'Current'
           when major_version >= 8 and major_version < 10 then 'Older' end as segment from rated)
           where segment is not null group by segment"""
    ),
)
def dashboard_segments(spark, sf):
    segment = versions.version_segment("version", versions.DASHBOARD_SEGMENTS)
    rows = reviews(spark, sf).select(segment.alias("segment")).filter("segment is not null")
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


CODE = """case when regexp_matches(version, '^[0-9]+([.][0-9]+)*$') then
  try_cast(split_part(version, '.', 1) as int) * 10000
  + coalesce(try_cast(split_part(version, '.', 2) as int), 0) * 100
  + coalesce(try_cast(split_part(version, '.', 3) as int), 0) end"""


@query(
    "P8_version_range",
    with_views(f"select review_id, version from reviews where {CODE} >= 70000 and {CODE} < 110000"),
)
def version_range(spark, sf):
    rows = reviews(spark, sf).filter(versions.in_version_range("version", "7.0.0", "11.0.0"))
    return rows.select("review_id", "version")


@query(
    "P9_text_column_choice",
    f"select doc_id, length({basic_sql('text')}) as chosen_length, 'cleaned_text' as chosen from documents",
)
def text_column_choice(spark, sf):
    docs = table(spark, sf, "documents").withColumn("cleaned_text", text.basic_clean("text"))
    name = text_column(docs, "features")
    return docs.select("doc_id", F.length(name).alias("chosen_length"), F.lit(name).alias("chosen"))


@query(
    "P10_non_empty_text",
    with_views(
        """select review_id, case when text is not null and length(text) > 0 then length(text) end as measured
           from sparse""",
        sparse=SPARSE,
    ),
)
def non_empty_text(spark, sf):
    rows = sparse_reviews(spark, sf).select("review_id", "text")
    return rows.select("review_id", F.when(has_text("text"), F.length("text")).alias("measured"))


@query(
    "P11_date_validity",
    with_views(
        """select count(date) as valid, count(*) as n, count(*) > 0 and count(date) >= 0.5 * count(*) as enough
           from sparse""",
        sparse=SPARSE,
    ),
)
def date_validity(spark, sf):
    return cleaning.date_validity(sparse_reviews(spark, sf))


@query(
    "P11_column_profile",
    with_views(
        " union all ".join(
            f"select '{c}' as column_name, count({c}) as non_null, 100.0 * count({c}) / count(*) as pct from reviews"
            for c in ("review_id", "author", "date", "rating", "version", "thumbs_up", "replied_at", "reply_content")
        )
    ),
)
def column_profile(spark, sf):
    return cleaning.column_profile(reviews(spark, sf))


@query(
    "P12_metadata_projection",
    with_views(
        """select review_id, author, strftime(date, '%Y-%m-%d %H:%M:%S') as date, rating, version,
           sentiment from rated"""
    ),
)
def metadata_projection(spark, sf):
    return cleaning.metadata(rated(spark, sf), METADATA_FIELDS)


@query(
    "P12_metadata_map",
    with_views(
        """select review_id, key, value from (
             select review_id, 'author' as key, author as value from reviews
             union all select review_id, 'rating', cast(rating as varchar) from reviews
             union all select review_id, 'reply_content', reply_content from reviews) where value is not null"""
    ),
)
def metadata_map(spark, sf):
    fields = ("author", "rating", "reply_content")
    return reviews(spark, sf).select("review_id", F.explode(cleaning.without_nulls(fields)))


@query(
    "P13_rating_classes",
    with_views(
        """select review_id, rating <= 2 as negative, rating >= 4 as positive from reviews
           where rating <= 2 or rating >= 4"""
    ),
)
def rating_classes(spark, sf):
    negative, positive = rates.is_negative(), rates.is_positive()
    rows = reviews(spark, sf).filter(negative | positive)
    return rows.select("review_id", negative.alias("negative"), positive.alias("positive"))
