"""Vector collections built from the embeddings and documents tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinio.functions import rates
from opinio.operators import neighbours, vectors
from opinio.plans.base import query, review_texts, table, with_views
from opinio.session import scratch_path
from opinio.sources import keyed, storage


def embeddings(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def label_centres(spark, sf):
    """One query vector per label: the mean of its vectors, worked out over the table."""
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    means = cells.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # One entry per dimension.
    ordered = F.sort_array(F.collect_list(F.struct("dim", "m")))
    return means.groupBy("label").agg(F.transform(ordered, lambda c: c["m"]).alias("embedding")).select(
        F.col("label").alias("query_id"), "embedding"
    )


CENTRES = """select label, dim, avg(cast(x as double)) as m from (
  select label, unnest(embedding) as x, unnest(generate_series(1, len(embedding))) as dim from embeddings) group by 1, 2"""
CELLS = """select vec_id, label, unnest(embedding) as x, unnest(generate_series(1, len(embedding))) as dim from embeddings"""
DISTANCES = """select c.label as query_id, e.vec_id as id, round(sum((e.x - c.m) * (e.x - c.m)), 6) as score
  from cells e join centres c using (dim) group by c.label, e.vec_id"""


def _nearest_sql(where: str = "true") -> str:
    return with_views(
        """select query_id, id, score, rank from (select *, row_number() over (partition by query_id
           order by score, id) as rank from distances) where rank <= 10""",
        centres=CENTRES,
        cells=CELLS.replace("from embeddings", f"from embeddings where {where}"),
        distances=DISTANCES,
    )


@query(
    "V1_index_documents",
    with_views(
        """select cast(review_id as varchar) as id, length(text) as text_length, 5 as dims, author,
           strftime(date, '%Y-%m-%d %H:%M:%S') as date, rating, version, sentiment from texts where length(text) > 0"""
    ),
)
def index_documents(spark, sf):
    rows = review_texts(spark, sf).withColumn("sentiment", rates.rating_sentiment("rating"))
    collection = vectors.index_documents(rows, "text")
    return collection.select(
        "id",
        F.length("text").alias("text_length"),
        F.size("embedding").alias("dims"),
        "author",
        "date",
        "rating",
        "version",
        "sentiment",
    )


@query("V2_nearest_neighbours", _nearest_sql())
def nearest_neighbours(spark, sf):
    rows = vectors.search_many(embeddings(spark, sf), label_centres(spark, sf))
    return rows.withColumn("score", F.round("score", 6))


@query("V3_filtered_search", _nearest_sql("label = 3"))
def filtered_search(spark, sf):
    rows = vectors.search_many(embeddings(spark, sf), label_centres(spark, sf), criteria={"label": 3})
    return rows.withColumn("score", F.round("score", 6))


@query(
    "J7_nearest_to_mean",
    f"""select vec_id as id, label, round(sum((x - m) * (x - m)), 6) as score from ({CELLS}) join (
          select dim, avg(cast(x as double)) as m from ({CELLS}) group by dim) using (dim)
        group by vec_id, label order by score, id limit 10""",
)
def nearest_to_mean(spark, sf):
    cells = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("dim", "x"))
    means = cells.groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # One entry per dimension: the query vector of the search.
    ordered = F.array_sort(F.collect_list(F.struct("dim", "m")))
    mean = means.agg(F.transform(ordered, lambda c: c["m"]).alias("embedding")).select(F.lit(0).alias("query_id"), "embedding")
    rows = vectors.search_many(embeddings(spark, sf), mean, keep=("label",))
    return rows.select("id", "label", F.round("score", 6).alias("score"))


def every(spark, sf, step):
    """Every so many vectors of the table, as queries."""
    rows = embeddings(spark, sf).filter(F.col("id") % step == 0)
    return rows.select(F.col("id").alias("query_id"), "embedding")


@query(
    "V2_all_neighbours",
    f"""with cells as ({CELLS}), distances as (
          select q.vec_id as query_id, e.vec_id as id, round(sum((q.x - e.x) * (q.x - e.x)), 6) as score
          from (select vec_id, cast(x as double) as x, dim from cells) q
          join (select vec_id, cast(x as double) as x, dim from cells) e using (dim) group by 1, 2)
        select query_id, id, score, cast(rank as int) as rank from (select *, row_number() over (
          partition by query_id order by score, id) as rank from distances) where rank <= 3""",
)
def all_neighbours(spark, sf):
    """The table joined with itself: each vector and its two nearest others."""
    rows = vectors.search_many(embeddings(spark, sf), every(spark, sf, 1), 3)
    return rows.withColumn("score", F.round("score", 6))


@query(
    "V2_search_text",
    """select cast(doc_id as varchar) as id, round((d1 - q1) * (d1 - q1) + (d2 - q2) * (d2 - q2) + (d3 - q3) * (d3 - q3)
         + (d4 - q4) * (d4 - q4) + (d5 - q5) * (d5 - q5), 9) as score from (
         select doc_id, least(1.0, len / 1000.0) as d1, code / 1000.0 as d2, (code * 7919 + 101) % 10007 / 10007.0 as d3,
           (code * 7919 + 211) % 10007 / 10007.0 as d4, (code * 7919 + 307) % 10007 / 10007.0 as d5 from (
           select doc_id, length(text) as len, list_sum(list_transform(string_split(substr(text, 1, 100), ''),
             lambda c: unicode(c))) % 1000 as code from documents where length(text) > 0)),
       (select least(1.0, len / 1000.0) as q1, code / 1000.0 as q2, (code * 7919 + 101) % 10007 / 10007.0 as q3,
          (code * 7919 + 211) % 10007 / 10007.0 as q4, (code * 7919 + 307) % 10007 / 10007.0 as q5 from (
          select length(t) as len, list_sum(list_transform(string_split(substr(t, 1, 100), ''),
            lambda c: unicode(c))) % 1000 as code from (select 'the app keeps crashing at login' as t)))
       order by score, id limit 10""",
)
def search_text(spark, sf):
    docs = table(spark, sf, "documents")
    collection = vectors.index_documents(docs, "text", "doc_id", fields=())
    rows = vectors.search_text(collection, "the app keeps crashing at login")
    return rows.select("id", F.round("score", 9).alias("score"))


def index_of(spark, sf):
    return neighbours.build_index(embeddings(spark, sf), scratch_path(spark, "v4-index"), keep=("label",))


@query("V4_approximate_search")
def approximate_search(spark, sf):
    return neighbours.search_index(spark, index_of(spark, sf), every(spark, sf, 50))


@query(
    "V4_recall",
    """select count(*) as n_queries, sum(least(10, n)) as n_rows, true as enough
       from embeddings, (select count(*) as n from embeddings) where vec_id % 50 = 0""",
)
def index_recall(spark, sf):
    """Rows found by the index, and whether nine of ten of the exact ones are among them."""
    asked = every(spark, sf, 50)
    found = neighbours.search_index(spark, index_of(spark, sf), asked).select("query_id", "id")
    exact = vectors.search_many(embeddings(spark, sf), asked).select("query_id", "id", F.lit(1).alias("is_near"))
    both = found.join(exact, ["query_id", "id"], "left")
    return both.agg(
        F.count_distinct("query_id").alias("n_queries"),
        F.count(F.lit(1)).cast("decimal(38,0)").alias("n_rows"),
        (F.count("is_near") >= 0.9 * F.count(F.lit(1))).alias("enough"),
    )


@query(
    "V4_filtered_index",
    _nearest_sql("label = 3").replace("select query_id, id,", "select count(*) as n from (select query_id, id,") + ")",
)
def filtered_index(spark, sf):
    """An index search with a filter finds as many rows as the exact one."""
    found = neighbours.search_index(spark, index_of(spark, sf), label_centres(spark, sf), criteria={"label": 3})
    return found.agg(F.count(F.lit(1)).alias("n"))


@query(
    "V5_delete_by_ids",
    "select vec_id as id, label from embeddings where vec_id not in (select doc_id from labels where toxic = 1)",
)
def delete_by_ids(spark, sf):
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return vectors.delete_documents(embeddings(spark, sf), toxic).select("id", "label")


@query("V5_delete_by_filter", "select vec_id as id, label from embeddings where label <> 3")
def delete_by_filter(spark, sf):
    return vectors.delete_documents(embeddings(spark, sf), criteria={"label": 3}).select("id", "label")


@query("V6_clear_collection", "select vec_id as id, label from embeddings")
def clear_collection(spark, sf):
    target = scratch_path(spark, "v6")
    rows = embeddings(spark, sf)
    storage.store(rows, target)
    storage.delete_rows(spark, target)
    storage.store(rows, target)
    return storage.retrieve(spark, target).select("id", "label")


@query(
    "V7_read_back",
    "select cast(doc_id as varchar) as review_id, text, lang from documents where length(text) > 0",
)
def read_back(spark, sf):
    target = scratch_path(spark, "v7")
    collection = vectors.index_documents(table(spark, sf, "documents"), "text", "doc_id", fields=("lang",))
    storage.store(collection, target)
    return vectors.as_reviews(storage.retrieve(spark, target))


@query(
    "A33_collection_stats",
    "select count(*) as n, 'label' as metadata_fields, 'given' as model from embeddings",
)
def collection_stats(spark, sf):
    return vectors.collection_stats(embeddings(spark, sf), "given")


@query(
    "V5_upsert_collection",
    """select vec_id as id, label, false as replaced from embeddings where vec_id not in (select doc_id from labels)
       union all select doc_id, toxic, true from labels""",
)
def upsert_collection(spark, sf):
    target = scratch_path(spark, "v5-upsert")
    stored = embeddings(spark, sf).select("id", "label", F.lit(False).alias("replaced"))
    keyed.create(stored, target, "id", parts=16)
    update = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("toxic").alias("label"), F.lit(True).alias("replaced")
    )
    keyed.upsert(update, target)
    return keyed.retrieve(spark, target)
