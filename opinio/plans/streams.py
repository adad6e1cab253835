"""Streaming forms, drained over what the events table holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinio.plans.base import query, table
from opinio.session import scratch_path
from opinio.sources import keyed
from opinio.streaming import ingest


def events_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return ingest.stream_files(spark, sf, schema, name_filter="events.parquet")


@query("ST1_stream_dedupe", "select event_id, event_type from events")
def stream_dedupe(spark, sf):
    stream = events_stream(spark, sf)
    doubled = stream.unionByName(stream).withColumn("ts", F.col("ts").cast("timestamp"))
    unique = ingest.dedupe_stream(doubled, "event_id", "ts").select("event_id", "event_type")
    target = scratch_path(spark, "st1")
    return ingest.drain(unique, f"{target}/out", f"{target}/checkpoint")


@query(
    "ST2_stream_daily",
    """select strftime(day, '%Y-%m-%d') as day, avg_value, n from (
         select date_trunc('day', ts) as day, round(avg(value), 9) as avg_value, count(value) as n from events group by 1)""",
)
def stream_daily(spark, sf):
    stream = events_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    target = scratch_path(spark, "st2")
    days = ingest.drain_latest(
        ingest.daily_ratings(stream, "ts", "value"), f"{target}/out", f"{target}/checkpoint", "day"
    )
    return days.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("avg_value", 9).alias("avg_value"), "n"
    )


@query(
    "ST3_stream_upsert",
    """select user_id, arg_max(event_type, ts) as event_type, max(ts) as ts from events group by user_id
       union all select c_custkey, 'none', null from customer where c_custkey not in (select user_id from events)""",
)
def stream_upsert(spark, sf):
    target = scratch_path(spark, "st3")
    stream = events_stream(spark, sf).select("user_id", "event_type", "ts")
    base = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.lit("none").alias("event_type"),
        F.lit(None).cast(stream.schema["ts"].dataType).alias("ts"),
    )
    keyed.create(base, f"{target}/table", "user_id")
    query_ = ingest.upsert_stream(
        stream, f"{target}/table", f"{target}/checkpoint", "user_id", F.desc("ts"), F.asc("event_type")
    )
    query_.awaitTermination()
    return keyed.retrieve(spark, f"{target}/table")


@query("ST1_dedupe_across_runs", "select event_id, event_type from events")
def dedupe_across_runs(spark, sf):
    """A second run over the same events, a year later, adds nothing."""
    target = scratch_path(spark, "st1-runs")
    for run in (0, 1):
        stream = events_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp") + F.make_interval(years=F.lit(run)))
        rows = ingest.insert_stream(stream, f"{target}/table", f"{target}/checkpoint-{run}", "event_id", F.asc("ts"))
        rows.awaitTermination()
    return keyed.retrieve(spark, f"{target}/table").select("event_id", "event_type")
