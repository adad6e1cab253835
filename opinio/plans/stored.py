"""Sources, sinks and stored-table changes, written to and read back from the shared folder."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from opinio.columns import with_aliases
from opinio.functions import text
from opinio.operators import cleaning, distributions, trends
from opinio.plans.base import clean_sql, query, rated, review_texts, reviews, squeeze_sql, table, with_views
from opinio.session import scratch_path
from opinio.sources import keyed, records, storage

COLUMNS = ("review_id", "rating", "version", "date")
CORE = with_views("select review_id, rating, version, date from reviews")


def core(spark, sf):
    return reviews(spark, sf).select(*COLUMNS)


@query("S1_scan_parquet", CORE)
def scan_parquet(spark, sf):
    target = scratch_path(spark, "s1")
    storage.store(core(spark, sf), target)
    return storage.retrieve(spark, target)


@query(
    "S1_scan_csv",
    "select doc_id, text, lang, n_chars from documents",
)
def scan_csv(spark, sf):
    target = scratch_path(spark, "s1csv")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    storage.store(docs, target, fmt="csv")
    return storage.retrieve(spark, target, fmt="csv", schema=docs.schema)


@query(
    "S2_scan_filtered",
    with_views("select review_id, rating, version, date from reviews where rating = 5 and version = 'Unknown'"),
)
def scan_filtered(spark, sf):
    target = scratch_path(spark, "s2")
    storage.store(core(spark, sf), target)
    return storage.retrieve(spark, target, {"rating": 5, "version": "Unknown", "no_such_column": 1})


@query("S3_overwrite", CORE)
def overwrite(spark, sf):
    target = scratch_path(spark, "s3")
    rows = core(spark, sf)
    storage.store(rows.filter("rating = 1"), target)
    storage.store(rows, target, by_year=True)
    return storage.retrieve(spark, target).select(*COLUMNS)


@query(
    "S4_append",
    """select o_orderkey as id, cast(o_totalprice as double) as amount, null as lang from orders
       union all select doc_id, null, lang from documents""",
)
def append(spark, sf):
    target = scratch_path(spark, "s4")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    storage.store(orders, target)
    storage.store(docs, target, append=True)
    return storage.retrieve(spark, target).select("id", "amount", "lang")


UPDATE = """select l_orderkey as review_id, cast(l_linenumber as int) as rating, l_returnflag as version from lineitem"""


@query(
    "S5_upsert",
    with_views(
        f"""select review_id, rating, version from reviews where review_id not in (select review_id from ({UPDATE}))
            union all select review_id, rating, version from ({UPDATE})"""
    ),
)
def upsert(spark, sf):
    target = scratch_path(spark, "s5")
    storage.store(reviews(spark, sf).select("review_id", "rating", "version"), target)
    update = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("review_id"),
        F.col("l_linenumber").cast("int").alias("rating"),
        F.col("l_returnflag").alias("version"),
    )
    storage.update_table(update, target)
    return storage.retrieve(spark, target)


@query(
    "S6_delete_matching",
    with_views(
        """select review_id, author, rating, version from reviews
           where not (rating is not distinct from 1 or author is not distinct from 'user_7'
                      or version is not distinct from 'Unknown')"""
    ),
)
def delete_matching(spark, sf):
    target = scratch_path(spark, "s6")
    storage.store(reviews(spark, sf).select("review_id", "author", "rating", "version"), target)
    storage.delete_rows(spark, target, {"rating": 1, "author": "user_7", "version": "Unknown", "other": 3})
    return storage.retrieve(spark, target)


@query(
    "S5_keyed_upsert",
    with_views(
        f"""select review_id, rating, version from reviews where review_id not in (select review_id from ({UPDATE}))
            union all select review_id, rating, version from ({UPDATE})"""
    ),
)
def keyed_upsert(spark, sf):
    """The upsert on a table laid out by key."""
    target = scratch_path(spark, "s5-keyed")
    keyed.create(reviews(spark, sf).select("review_id", "rating", "version"), target, parts=16)
    update = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("review_id"),
        F.col("l_linenumber").cast("int").alias("rating"),
        F.col("l_returnflag").alias("version"),
    )
    keyed.upsert(update, target)
    return keyed.retrieve(spark, target)


@query(
    "S6_keyed_delete",
    with_views(
        """select review_id, author, rating from reviews
           where author is distinct from 'user_7' and review_id not in (select doc_id from labels where toxic = 1)"""
    ),
)
def keyed_delete(spark, sf):
    """Deletion by filter, then by keys, on a table laid out by key."""
    target = scratch_path(spark, "s6-keyed")
    keyed.create(reviews(spark, sf).select("review_id", "author", "rating"), target, parts=16)
    keyed.delete_matching(spark, target, {"author": "user_7", "other": 3})
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("review_id"))
    keyed.delete_keys(toxic, target)
    return keyed.retrieve(spark, target)


@query("S7_delete_all", with_views("select review_id, rating from reviews where false"))
def delete_all(spark, sf):
    target = scratch_path(spark, "s7")
    storage.store(reviews(spark, sf).select("review_id", "rating"), target)
    storage.delete_rows(spark, target)
    return storage.retrieve(spark, target, schema=reviews(spark, sf).select("review_id", "rating").schema)


def raw_records(spark, sf):
    """Reviews under their raw field names, with every accepted date form and gaps."""
    rows = review_texts(spark, sf)
    form = F.col("review_id") % 4
    seconds = F.unix_timestamp("date")
    return rows.select(
        F.col("review_id").cast("string").alias("reviewId"),
        F.col("author").alias("userName"),
        F.when(form == 0, seconds.cast("string"))
        .when(form == 1, F.date_format("date", "yyyy-MM-dd HH:mm:ss"))
        .when(form == 2, "yesterday")
        .alias("at"),
        F.when(F.col("review_id") % 8 < 4, seconds * 1000).alias("timeMillis"),
        F.when(F.col("review_id") % 5 == 0, "n/a").otherwise(F.col("rating").cast("string")).alias("score"),
        F.col("text").alias("content"),
        F.col("version").alias("reviewCreatedVersion"),
        F.col("thumbs_up").alias("thumbsUpCount"),
        F.col("reply_content").alias("replyContent"),
        F.unix_timestamp("replied_at").alias("repliedAt"),
    )


STAMP = "'%Y-%m-%d %H:%M:%S'"


@query(
    "S8_normalize_records",
    with_views(
        f"""select cast(review_id as varchar) as review_id, author, case when review_id % 5 <> 0 then rating end as rating,
            length(text) as text_length, version, case when review_id % 4 < 2 or review_id % 8 < 4 then strftime(date, {STAMP}) end as date,
            thumbs_up as thumbsUpCount, reply_content as replyContent, strftime(replied_at, {STAMP}) as repliedAt from texts"""
    ),
)
def normalize_records(spark, sf):
    rows = records.normalize_records(raw_records(spark, sf))
    return rows.select(
        "review_id",
        "author",
        "rating",
        F.length("text").alias("text_length"),
        "version",
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"),
        "thumbsUpCount",
        "replyContent",
        F.date_format("repliedAt", "yyyy-MM-dd HH:mm:ss").alias("repliedAt"),
    )


@query(
    "S9_column_aliases",
    with_views("select review_id, text, rating, version from texts"),
)
def column_aliases(spark, sf):
    rows = review_texts(spark, sf).select(
        "review_id",
        F.col("text").alias("content"),
        F.col("rating").alias("score"),
        F.col("version").alias("reviewCreatedVersion"),
    )
    return with_aliases(rows, ("text", "rating", "version")).select("review_id", "text", "rating", "version")


@query(
    "S10_cascading_load",
    with_views(f"select review_id, rating, {clean_sql('text')} as cleaned_text from texts"),
)
def cascading_load(spark, sf):
    folder = scratch_path(spark, "s10")
    storage.store(review_texts(spark, sf).select("review_id", "rating", "text"), f"{folder}/reviews")

    def prepare(rows):
        return rows.withColumn("cleaned_text", text.clean_text("text"))

    storage.load_reviews(spark, folder, prepare)
    return storage.load_reviews(spark, folder, prepare).select("review_id", "rating", "cleaned_text")


BATCHES = """select l_orderkey, l_linenumber, min(l_partkey) as l_partkey from lineitem l
  where l_linenumber = (select min(l_linenumber) from lineitem m where m.l_orderkey = l.l_orderkey)
  group by l_orderkey, l_linenumber"""


@query("S11_ingest_dedupe", BATCHES)
def ingest_dedupe(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return records.dedupe_batches(lines, "l_linenumber", "l_orderkey", None, F.asc("l_partkey"))


@query(
    "S11_ingest_target",
    f"select * from ({BATCHES}) order by l_linenumber, l_orderkey limit 5000",
)
def ingest_target(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return records.dedupe_batches(lines, "l_linenumber", "l_orderkey", 5000, F.asc("l_partkey"))


@query(
    "S11_merge_batches",
    """select item, lang from (select doc_id as item, lang from documents
       union all select o_orderkey, null from orders where o_orderkey not in (select doc_id from documents))""",
)
def merge_batches(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item"), "lang")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"))
    return records.merge_batches([docs, orders], "item")


@query(
    "S12_ingest_filter",
    with_views(
        """select review_id, date, rating from reviews where date >= timestamp '1996-03-01' and date <= timestamp '1998-06-30'
           order by date desc, review_id limit 500"""
    ),
)
def ingest_filter(spark, sf):
    rows = reviews(spark, sf).select("review_id", "date", "rating")
    return records.ingest_filter(rows, "1996-03-01", "1998-06-30", 500)


@query(
    "S12_ingest_relative",
    with_views("select review_id, date from reviews where date >= timestamp '2001-08-01' - interval 730 days"),
)
def ingest_relative(spark, sf):
    rows = reviews(spark, sf).select("review_id", "date")
    return records.ingest_filter(rows, "2 years ago", "now", now=datetime(2001, 8, 1))


@query(
    "S13_export_csv",
    with_views("select review_id, rating, sentiment, strftime(date, '%Y-%m-%d') as day from rated"),
)
def export_csv(spark, sf):
    rows = rated(spark, sf).select(
        "review_id", "rating", "sentiment", "date", F.date_format("date", "yyyy-MM-dd").alias("day")
    )
    target = storage.export_csv(rows, scratch_path(spark, "s13"))
    return storage.read_any(spark, target, "csv", rows.schema).drop("date")


@query(
    "S13_prepare_chain",
    with_views(
        f"""select review_id, rating, sentiment, year(date) as year, month(date) as month, dayname(date) as day_of_week,
            dayofweek(date) in (0, 6) as is_weekend, length(t) as text_length, case when length(t) = 0 then 'empty'
              when length(t) < 50 then 'very_short' when length(t) < 200 then 'short' when length(t) < 500 then 'medium'
              else 'long' end as length_category,
            case when version like '%.%' then split_part(version, '.', 1) else 'Unknown' end as major_version
            from (select *, {squeeze_sql("coalesce(text, '')")} as t from texts)"""
    ),
)
def prepare_chain(spark, sf):
    rows = cleaning.add_features(cleaning.clean_reviews(review_texts(spark, sf), F.asc("date")))
    return storage.newest_first(rows).select(
        "review_id",
        "rating",
        "sentiment",
        "year",
        "month",
        "day_of_week",
        "is_weekend",
        "text_length",
        "length_category",
        "major_version",
    )


@query("S14_chart_export", with_views(
    "select strftime(date, '%Y-%m') as period, count(*) as n from reviews group by 1"
))
def chart_export(spark, sf):
    rows = reviews(spark, sf)
    tables = {
        "volume": trends.volume_by_period(rows, "month"),
        "ratings": distributions.rating_distribution(rows),
    }
    paths = storage.export_charts(tables, scratch_path(spark, "s14"))
    return spark.read.schema("period string, n bigint").json(paths["volume"])


@query(
    "S15_type_repair",
    """select event_id, try_cast(case when event_id % 3 = 0 then 'n/a' else cast(user_id as varchar) end as int) as user_id,
       case when event_id % 5 <> 0 then value end as value from events""",
)
def type_repair(spark, sf):
    damaged = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(F.col("event_id") % 5 == 0, "?").otherwise(F.col("value").cast("string")).alias("value"),
    )
    return cleaning.repair_numbers(damaged, {"user_id": "int", "value": "double"})
