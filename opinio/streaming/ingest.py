"""Streaming ingest, daily aggregates and streaming upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from opinio.operators.ranking import first_per_key
from opinio.sources import keyed, storage


def stream_files(spark: SparkSession, folder: str, schema, name_filter: str | None = None, **options) -> DataFrame:
    """Stream of the Parquet files of a folder."""
    reader = spark.readStream.schema(schema).options(**options)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(folder)


def dedupe_stream(stream: DataFrame, key: str, time: str, delay: str = "7 days") -> DataFrame:
    """First arrival of each id; ids are forgotten once older than the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def daily_ratings(
    stream: DataFrame, time: str = "date", value: str = "rating", delay: str = "1 day"
) -> DataFrame:
    """Average and volume per day; appended once the watermark has passed it, or updated
    with every batch."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, "1 day").alias("_w"))
        .agg(F.avg(value).alias("avg_value"), F.count(value).alias("n"))
        .select(F.col("_w.start").alias("day"), "avg_value", "n")
    )


def _into(stream: DataFrame, checkpoint: str, apply) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(lambda batch, _epoch: apply(batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, key: str, *order) -> StreamingQuery:
    """Upsert every micro-batch into a table stored by key, rewriting only the parts it touches.

    Of all rows of a key, stored ones included, the first in the given order wins, so
    batches may come late and a batch may run again after a failure. Null is a key like any
    other. A table that is not there begins with the first batch.
    """

    def apply(batch: DataFrame) -> None:
        if not keyed.exists(batch.sparkSession, table):
            keyed.create(batch.limit(0), table, key, keyed.NEW_PARTS)
        keyed.upsert_first(batch, table, *order)

    return _into(stream, checkpoint, apply)


def insert_stream(stream: DataFrame, table: str, checkpoint: str, key: str, *order) -> StreamingQuery:
    """Append the rows of every micro-batch whose key is not stored yet, one of each key.

    Unlike :func:`dedupe_stream`, this forgets no id: a repeat is dropped however late it
    comes, in this run or a later one.
    """

    def apply(batch: DataFrame) -> None:
        if not keyed.exists(batch.sparkSession, table):
            keyed.create(batch.limit(0), table, key, keyed.NEW_PARTS)
        keyed.insert_new(batch, table, *order)

    return _into(stream, checkpoint, apply)


def drain(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now into a Parquet folder and read it back."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def drain_latest(stream: DataFrame, target: str, checkpoint: str, key: str) -> DataFrame:
    """Run an updating stream over what is there now; the latest row of each key.

    Every batch writes the rows it changed to a folder of its own, which a second run of
    the batch writes again. Groups that are still open are there too.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/_batch_no={number}")

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not storage.exists(stream.sparkSession, target):
        # No batch has come.
        return stream.sparkSession.createDataFrame([], stream.schema)
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch_no", T.LongType())])
    rows = stream.sparkSession.read.schema(schema).option("basePath", target).parquet(f"{target}/*")
    return first_per_key(rows, key, F.desc("_batch_no")).drop("_batch_no")
