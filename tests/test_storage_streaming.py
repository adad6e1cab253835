from datetime import datetime

import pytest
from pyspark.sql import functions as F

from opinio.session import scratch_path
from opinio.sources import keyed, records, storage
from opinio.streaming import ingest


@pytest.fixture(params=["parquet", "csv"])
def fmt(request):
    return request.param


SCHEMA = "review_id string, rating int, note string"


def rows_of(df):
    return sorted(((r["review_id"], r["rating"], r["note"]) for r in df.collect()), key=repr)


@pytest.fixture
def stored(spark, fmt):
    target = scratch_path(spark, "t")
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), (None, 3, "z")], SCHEMA)
    storage.store(df, target, fmt=fmt)
    return target, df.schema


def test_round_trip_and_filters(spark, stored, fmt):
    target, schema = stored
    read = storage.retrieve(spark, target, fmt=fmt, schema=schema)
    assert rows_of(read) == [("a", 1, "x"), ("b", 2, None), (None, 3, "z")]
    hit = storage.retrieve(spark, target, {"rating": 2, "nope": 1}, fmt=fmt, schema=schema)
    assert rows_of(hit) == [("b", 2, None)]


def test_append_unites_by_name(spark, stored, fmt):
    target, schema = stored
    more = spark.createDataFrame([("c", 9, "n")], SCHEMA)
    storage.store(more, target, append=True, fmt=fmt)
    assert ("c", 9, "n") in rows_of(storage.retrieve(spark, target, fmt=fmt, schema=schema))


def test_upsert_keeps_repeated_and_null_keys(spark, stored, fmt):
    target, schema = stored
    update = spark.createDataFrame([("a", 5, "u1"), ("a", 6, "u2"), (None, 7, "u3")], SCHEMA)
    storage.update_table(update, target, fmt=fmt)
    got = rows_of(storage.retrieve(spark, target, fmt=fmt, schema=schema))
    assert got == sorted([("b", 2, None), ("a", 5, "u1"), ("a", 6, "u2"), (None, 7, "u3")], key=repr)


def test_delete_any_match_keeps_nulls(spark, stored, fmt):
    target, schema = stored
    storage.delete_rows(spark, target, {"review_id": "a", "rating": 2, "nope": 1}, fmt=fmt, schema=schema)
    assert rows_of(storage.retrieve(spark, target, fmt=fmt, schema=schema)) == [(None, 3, "z")]
    storage.delete_rows(spark, target, fmt=fmt, schema=schema)
    assert storage.retrieve(spark, target, fmt=fmt, schema=schema).count() == 0


def test_unfinished_snapshot_is_not_read(spark):
    import os

    target = scratch_path(spark, "half")
    storage.store(spark.range(5), target)
    os.makedirs(f"{target}/snapshot-00000002")
    assert storage.retrieve(spark, target).count() == 5
    assert storage.replace_table(spark.range(7), target).endswith("00000003")
    assert storage.retrieve(spark, target).count() == 7


def test_missing_table_is_empty(spark):
    empty = storage.retrieve(spark, scratch_path(spark, "none"))
    assert empty.count() == 0 and "review_id" in empty.columns


def test_filters_reach_the_scan(spark, stored, fmt):
    if fmt == "csv":
        pytest.skip("column format only")
    df = storage.retrieve(spark, stored[0], {"rating": 2}).select("review_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(rating,2)" in plan and "note" not in plan.split("ReadSchema")[1]


def test_normalize_fills_absent_fields_only(spark):
    raw = spark.createDataFrame([("r1", "5", "86400"), ("r2", "x", None)], "reviewId string, score string, at string")
    a, b = records.normalize_records(raw).orderBy("review_id").collect()
    assert (a["rating"], a["text"], a["version"], str(a["date"])) == (5, "", "", "1970-01-02 00:00:00")
    assert (b["rating"], b["date"]) == (None, None)


def test_merge_batches_first_copy_wins(spark):
    one = spark.createDataFrame([("a", 1), ("b", 1)], "reviewId string, n int")
    two = spark.createDataFrame([("b", 2), ("c", 2)], "reviewId string, n int")
    got = {(r["reviewId"], r["n"]) for r in records.merge_batches([one, two]).collect()}
    assert got == {("a", 1), ("b", 1), ("c", 2)}
    assert {r["reviewId"] for r in records.merge_batches([one, two], target=2).collect()} == {"a", "b"}


def test_streamed_daily_ratings_equal_the_batch(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = ingest.stream_files(spark, sf, events.schema, "events.parquet")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    target = scratch_path(spark, "daily")
    out = ingest.drain(ingest.daily_ratings(stream, "ts", "value"), f"{target}/o", f"{target}/c")
    got = {str(r["day"])[:10]: r["n"] for r in out.collect()}
    want = {r["d"]: r["n"] for r in events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(F.count("value").alias("n")).collect()}
    assert got and all(want[d] == n for d, n in got.items())
    assert len(want) - len(got) <= 2


def test_upsert_stream_keeps_the_newest_row_of_late_batches(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "k int, v string, t int"

    def batch(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = ingest.stream_files(spark, source, spark.createDataFrame([], schema).schema)
        ingest.upsert_stream(stream, target, str(tmp_path / "cp"), "k", F.desc("t")).awaitTermination()

    batch([(1, "new", 9), (2, "a", 1)])
    batch([(1, "old", 3), (2, "b", 2), (3, "c", 1)])
    batch([(None, "n9", 9), (None, "n8", 8)])
    batch([(None, "n5", 5)])
    rows = keyed.retrieve(spark, target).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == [(1, "new", 9), (2, "b", 2), (3, "c", 1), (None, "n9", 9)]


def test_open_days_are_given_out(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(datetime(2024, 1, 1, 5), 2), (datetime(2024, 1, 1, 6), 4), (datetime(2024, 1, 2), 1)]
    spark.createDataFrame(rows, "date timestamp, rating int").write.parquet(source)
    stream = ingest.stream_files(spark, source, spark.read.parquet(source).schema)
    days = ingest.drain_latest(ingest.daily_ratings(stream), str(tmp_path / "out"), str(tmp_path / "cp"), "day")
    assert sorted((r["avg_value"], r["n"]) for r in days.collect()) == [(1.0, 1), (3.0, 2)]


def test_a_stream_without_files_gives_no_days(spark, tmp_path):
    source = str(tmp_path / "in")
    empty = spark.createDataFrame([], "date timestamp, rating int")
    (tmp_path / "in").mkdir()
    days = ingest.daily_ratings(ingest.stream_files(spark, source, empty.schema))
    got = ingest.drain_latest(days, str(tmp_path / "out"), str(tmp_path / "cp"), "day")
    assert got.columns == ["day", "avg_value", "n"] and got.count() == 0


def test_inserting_streams_drop_repeats_however_late(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "k string, day int"

    def run(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = ingest.stream_files(spark, source, spark.createDataFrame([], schema).schema)
        ingest.insert_stream(stream, target, str(tmp_path / name), "k", F.asc("day")).awaitTermination()

    run([("a", 1), ("b", 1), ("a", 2), (None, 1)], "one")
    run([("a", 31), ("c", 31), (None, 31)], "one")
    run([("d", 60), ("b", 60)], "another")  # reads all files again
    assert sorted((tuple(r) for r in keyed.retrieve(spark, target).collect()), key=repr) == [("a", 1), ("b", 1), ("c", 31), ("d", 60), (None, 1)]


# --- tables by key -------------------------------------------------------------------


def files_of(target):
    import os

    found = {}
    for folder, _, names in os.walk(f"{target}/rows"):
        for name in names:
            if name.endswith(".parquet"):
                found[f"{folder}/{name}"] = os.stat(f"{folder}/{name}").st_mtime_ns
    return found


def parts_of(paths):
    return {int(p.split("key_part=")[1].split("/")[0]) for p in paths}


@pytest.fixture
def by_key(spark):
    target = scratch_path(spark, "keyed")
    rows = [(str(i), i % 5, "x") for i in range(200)] + [(None, 7, "n"), ("3", 9, "again")]
    keyed.create(spark.createDataFrame(rows, SCHEMA), target, parts=20)
    return target, rows


def test_keyed_upsert_rewrites_the_parts_it_touches(spark, by_key):
    target, rows = by_key
    before = files_of(target)
    update = [("3", 1, "u"), ("3", 2, "u"), (None, 3, "u"), ("new", 4, "u")]
    touched = keyed.upsert(spark.createDataFrame(update, SCHEMA), target)
    after = files_of(target)
    assert len(touched) <= 3
    assert parts_of(set(before) ^ set(after)) == set(touched)
    left = [r for r in rows if r[0] not in ("3", None)]
    assert rows_of(keyed.retrieve(spark, target)) == sorted(left + update, key=repr)
    assert keyed.upsert(spark.createDataFrame([], SCHEMA), target) == [] and files_of(target) == after


def test_keyed_deletes_rewrite_only_parts_that_held_rows(spark, by_key):
    target, rows = by_key
    before = files_of(target)
    assert keyed.delete_keys(spark.createDataFrame([("nobody",), ("nothing",)], "review_id string"), target) == []
    assert keyed.delete_matching(spark, target, {"rating": 77, "nope": 1}) == []
    assert files_of(target) == before
    touched = keyed.delete_keys(spark.createDataFrame([("3",), (None,), ("nobody",)], "review_id string"), target)
    assert parts_of(set(before) ^ set(files_of(target))) == set(touched) and len(touched) <= 2
    left = [r for r in rows if r[0] not in ("3", None)]
    assert rows_of(keyed.retrieve(spark, target)) == sorted(left, key=repr)
    keyed.delete_matching(spark, target, {"rating": 4, "note": "again"})
    assert rows_of(keyed.retrieve(spark, target)) == sorted((r for r in left if r[1] != 4), key=repr)


def test_keyed_parts_that_lose_all_rows_are_empty(spark):
    target = scratch_path(spark, "keyed-empty")
    keyed.create(spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], SCHEMA), target, parts=50)
    keyed.delete_keys(spark.createDataFrame([("a",)], "review_id string"), target)
    assert rows_of(keyed.retrieve(spark, target)) == [("b", 2, "y")]
    keyed.delete_matching(spark, target, {"rating": 2})
    assert rows_of(keyed.retrieve(spark, target)) == []
    keyed.upsert(spark.createDataFrame([("c", 3, "z")], SCHEMA), target)
    assert rows_of(keyed.retrieve(spark, target)) == [("c", 3, "z")]


def test_keyed_tables_take_new_columns_and_other_key_types(spark):
    target = scratch_path(spark, "keyed-more")
    keyed.create(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), target, "id", parts=4)
    keyed.upsert(spark.createDataFrame([(2, "B", 5)], "id int, v string, w int"), target)
    got = keyed.retrieve(spark, target)
    assert sorted((r["id"], r["v"], r["w"]) for r in got.collect()) == [(1, "a", None), (2, "B", 5)]
    first = spark.createDataFrame([(2, "old", 1), (3, "c", 9)], "id int, v string, w int")
    keyed.upsert_first(first, target, F.desc("w"))
    assert sorted((r["id"], r["v"], r["w"]) for r in keyed.retrieve(spark, target).collect()) == [(1, "a", None), (2, "B", 5), (3, "c", 9)]
    with pytest.raises(ValueError):
        keyed.create(spark.range(3), target, "nope")
