"""Document collections with embeddings: indexing, search, deletion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.columns import METADATA_FIELDS, has_text, text_column
from opinio.functions import text
from opinio.operators.neighbours import matches, nearest_join
from opinio.operators.ranking import top_k


def index_documents(
    df: DataFrame,
    text_field: str | None = None,
    id_field: str | None = "review_id",
    fields: Sequence[str] = METADATA_FIELDS,
    embedding: str | None = None,
) -> DataFrame:
    """Collection rows ``(id, text, embedding, metadata columns)``.

    Rows without text or embedding are left out. Without an id column the id is the hash of the row.
    The embedding is an existing column or the built-in hash embedding.
    """
    text_field = text_field or text_column(df, "features")
    plain = {"string", "tinyint", "smallint", "int", "bigint", "float", "double", "boolean"}
    types = dict(df.dtypes)
    identity = (
        F.col(id_field).cast("string")
        if id_field and id_field in types
        else F.sha2(F.to_json(F.struct(*df.columns)), 256)
    )
    metadata = [
        F.col(c) if types[c] in plain else F.col(c).cast("string").alias(c)
        for c in fields
        if c in types and c not in (text_field, id_field)
    ]
    vector = F.col(embedding) if embedding else text.hash_embedding(text_field)
    rows = df.filter(has_text(text_field))
    return (rows.filter(F.col(embedding).isNotNull()) if embedding else rows).select(
        identity.alias("id"), F.col(text_field).alias("text"), vector.alias("embedding"), *metadata
    )


def squared_distance(column: str, vector: Sequence[float]) -> Column:
    """Squared Euclidean distance to one vector."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    parts = F.zip_with(F.col(column), query, lambda a, b: (a - b) * (a - b))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def search(
    collection: DataFrame,
    vector: Sequence[float],
    k: int = 10,
    criteria: Mapping[str, object] | None = None,
    id_column: str = "id",
) -> DataFrame:
    """The ``k`` rows nearest to one vector, lowest score first.

    The criteria reach the scan as filters; each task keeps its own k rows, so the
    collection is never shuffled.
    """
    scored = collection.filter(matches(criteria) & F.col("embedding").isNotNull()).withColumn(
        "score", squared_distance("embedding", vector)
    )
    return top_k(scored, k, F.asc("score"), F.asc(id_column)).drop("embedding")


def search_text(collection: DataFrame, query: str, k: int = 10, criteria=None) -> DataFrame:
    """Search with a text, embedded the way :func:`index_documents` does by default."""
    one = collection.sparkSession.createDataFrame([(query,)], "q string")
    vector = one.select(text.hash_embedding("q").alias("v")).first()["v"]
    return search(collection, vector, k, criteria)


def search_many(
    collection: DataFrame,
    queries: DataFrame,
    k: int = 10,
    criteria: Mapping[str, object] | None = None,
    id_column: str = "id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Exact ``k`` nearest rows of every query, see :func:`neighbours.nearest_join`."""
    return nearest_join(collection, queries, k, criteria, id_column, keep)


def delete_documents(
    collection: DataFrame,
    ids: DataFrame | Sequence | None = None,
    criteria: Mapping[str, object] | None = None,
    id_column: str = "id",
) -> DataFrame:
    """The collection without the named ids, or without rows meeting the criteria."""
    if ids is not None:
        if not isinstance(ids, DataFrame):
            kind = dict(collection.dtypes)[id_column]
            ids = collection.sparkSession.createDataFrame([(i,) for i in ids], f"{id_column} {kind}")
        return collection.join(ids.select(id_column).distinct(), id_column, "left_anti")
    if criteria:
        return collection.filter(~F.coalesce(matches(criteria), F.lit(False)))
    raise ValueError("name ids or criteria to delete by")


def collection_stats(collection: DataFrame, model: str = "hash") -> DataFrame:
    """Row count, metadata field names and embedding name, in one row."""
    fields = [c for c in collection.columns if c not in ("id", "text", "embedding")]
    return collection.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.lit(", ".join(fields)).alias("metadata_fields"), F.lit(model).alias("model")
    )


def as_reviews(collection: DataFrame) -> DataFrame:
    """The whole collection read back as a review table."""
    return collection.drop("embedding").withColumnRenamed("id", "review_id")
