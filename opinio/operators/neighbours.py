"""Nearest neighbours of many query vectors: an exact join in blocks, and an inverted index.

Vectors of both sides are packed into blocks of bounded size, one row each; blocks are
joined by an equal key and every pair of blocks is one matrix product. A pair leaves at
most ``k`` rows per query behind, so what is ranked afterwards grows with the number of
blocks, not of rows. No vector passes through the driver: a small set of query blocks is
broadcast by its size, a large one is shuffled.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from opinio.session import scratch_path

#: Bytes of vectors in one block.
BLOCK_BYTES = 512 << 10

#: Blocks of queries that one task holds against its part of the collection.
CELL_BLOCKS = 128

#: Pairs compared exactly at once; neighbours a task holds before it passes them on.
COMPARED, HELD = 1 << 15, 1 << 22

#: Decimals of a distance: equal rows stay equal whatever the order of summation.
DECIMALS = 12

#: Bounds of an index: rows its centres are fitted on, lists, bytes of all centres.
FITTED_ON, MOST_LISTS, CENTRE_BYTES = 20_000, 4096, 16 << 20
FIT_ROUNDS = 10

#: Queries, and neighbours of each, on which the lists to look at are measured; share to find.
MEASURED, NEIGHBOURS, RECALL = 200, 10, 0.95

#: The list of vectors of another length than the index; every query looks there.
OTHERS = -1


def matches(criteria: Mapping[str, object] | None) -> Column:
    """All of the equality criteria; no criteria match everything."""
    out = F.lit(True)
    for name, value in (criteria or {}).items():
        out = out & (F.col(name) == F.lit(value))
    return out


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def _stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back: a lost executor costs a read."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def blocks(rows: DataFrame) -> DataFrame:
    """``(list, dims, entries, vectors)``: rows ``(list int, entry struct, vector array<double>)`` packed.

    A block holds vectors of one list and one length. Rows of one list should come together.
    """
    kind = rows.schema["entry"].dataType
    entry = to_arrow_type(kind)
    schema = pa.schema([("list", pa.int32()), ("dims", pa.int32()), ("entries", pa.list_(entry)), ("vectors", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple[int, int], list] = {}

        def close(key: tuple[int, int]) -> pa.RecordBatch:
            parts = open_.pop(key)
            entries = pa.concat_arrays([e for e, _ in parts])
            matrix = np.concatenate([m for _, m in parts])
            columns = [
                pa.array([key[0]], pa.int32()),
                pa.array([key[1]], pa.int32()),
                pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries).cast(schema.field("entries").type),
                pa.array([matrix.astype("<f8").tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0).to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for list_, dims in sorted(set(zip(lists.tolist(), sizes.tolist())), key=lambda k: k[0] == lists[-1]):
                at = pa.array(np.flatnonzero((lists == list_) & (sizes == dims)))
                key, step = (list_, dims), max(1, BLOCK_BYTES // (8 * max(1, dims)))
                entries, vectors = batch.column(1).take(at), _matrix(batch.column(2).take(at), dims)
                held = open_.setdefault(key, [])
                while len(vectors):
                    room = step - sum(len(m) for _, m in held)
                    held.append((entries.slice(0, room), vectors[:room]))
                    entries, vectors = entries.slice(room), vectors[room:]
                    if len(held[-1][1]) == room:
                        yield close(key)
                        held = open_.setdefault(key, [])
                if not held or list_ != lists[-1]:
                    if held:
                        yield close(key)
                    open_.pop(key, None)
        for key in list(open_):
            yield close(key)

    packed = f"list int, dims int, entries array<{kind.simpleString()}>, vectors binary"
    return rows.select("list", "entry", "vector").mapInArrow(pack, packed)


class _Best:
    """The nearest rows met so far of the queries of one block.

    ``bound`` is the score of each query's ``k``-th: what is further need not be looked at.
    """

    def __init__(self, asked: pa.Array, k: int) -> None:
        self.asked, self.k = asked, k
        self.scores = np.full((len(asked), k), np.inf)
        self.bound = self.scores[:, -1]
        self.held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.rows = 0

    def meet(self, query: np.ndarray, rows: np.ndarray, entries: pa.Array, order: np.ndarray) -> None:
        """The expanded square finds who may be near; differences, exact for near-identical
        vectors, settle it."""
        k = self.k
        of_query, of_rows = (query * query).sum(axis=1), (rows * rows).sum(axis=1)
        rough = of_query[:, None] + of_rows[None, :] - 2 * (query @ rows.T)
        slack = 8 * (query.shape[1] + 4) * np.finfo(float).eps * (of_query + of_rows.max(initial=0)) + 10.0**-DECIMALS
        limit = self.bound
        if len(rows) > k and np.isinf(limit).any():
            limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)
        near = rough <= (limit + slack)[:, None]
        upto = np.cumsum(near.sum(axis=1))
        for part in np.split(np.arange(len(query)), np.flatnonzero(np.diff(upto // COMPARED)) + 1):
            of, at = np.nonzero(near[part])
            of = part[of]
            diff = rows[at] - query[of]
            score = np.round(np.einsum("ij,ij->i", diff, diff), DECIMALS)
            first = np.lexsort((order[at], score, of))
            of, at, score = of[first], at[first], score[first]
            place = np.arange(len(of)) - np.searchsorted(of, of)
            kept = (place < k) & (score <= self.bound[of])
            of, at, score, place = of[kept], at[kept], score[kept], place[kept]
            if not len(of):
                continue
            new = np.full((len(part), k), np.inf)
            new[of - part[0], place] = score
            both = np.concatenate([self.scores[part], new], axis=1)
            self.scores[part] = np.sort(both, axis=1)[:, :k]
            self.held.append((of, entries.take(pa.array(at)), score))
            self.rows += len(of)
        self.bound = self.scores[:, -1]
        if self.rows > 8 * self.scores.size:
            self.held = [self.best()]
            self.rows = len(self.held[0][0])

    def best(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        of, score = (np.concatenate([h[i] for h in self.held]) for i in (0, 2))
        entries = pa.concat_arrays([h[1] for h in self.held])
        table = pa.table({"of": of, "score": score, "id": entries.field(0)})
        first = pc.sort_indices(table, [(c, "ascending") for c in ("of", "score", "id")]).to_numpy()
        sorted_ = of[first]
        first = first[np.arange(len(of)) - np.searchsorted(sorted_, sorted_) < self.k]
        return of[first], entries.take(pa.array(first)), score[first]


def _scored(pairs: DataFrame, k: int) -> DataFrame:
    """``(asked, entry, score)`` of joined blocks: the ``k`` nearest of all that a task meets.

    ``_block`` tells blocks of queries apart.
    """
    asked_type, entry_type = (pairs.schema[c].dataType.elementType for c in ("asked", "entries"))
    schema = pa.schema([("asked", to_arrow_type(asked_type)), ("entry", to_arrow_type(entry_type)), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, _Best] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for found in open_.values():
                if found.held:
                    of, entries, score = found.best()
                    columns = [found.asked.take(pa.array(of)), entries, pa.array(score)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
            open_.clear()

        for batch in batches:
            for at in range(batch.num_rows):
                dims, block = batch.column(0)[at].as_py(), batch.column(5)[at].as_py()
                sides = []
                for entries, vectors in ((1, 2), (3, 4)):
                    sides.append(batch.column(entries)[at].values)
                    sides.append(np.frombuffer(batch.column(vectors)[at].as_py(), "<f8").reshape(len(sides[-1]), dims))
                asked, query, entries, rows = sides
                order = np.empty(len(rows), dtype=np.int64)
                order[pc.sort_indices(entries.field(0)).to_numpy()] = np.arange(len(rows))
                if block not in open_:
                    open_[block] = _Best(asked, k)
                open_[block].meet(query, rows, entries, order)
            if sum(found.rows for found in open_.values()) > HELD:
                yield from out()
        yield from out()

    kinds = f"asked {asked_type.simpleString()}, entry {entry_type.simpleString()}, score double"
    return pairs.select("dims", "asked", "asked_vectors", "entries", "vectors", "_block").mapInArrow(run, kinds)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` first of each query row by score, then id."""
    named = found.select("asked.*", "entry.*", "score")
    names = [f.name for f in found.schema["entry"].dataType.fields]
    by = Window.partitionBy("_row").orderBy("score", F.asc_nulls_last(names[0]))
    best = named.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return best.select("query_id", *names, "score", "rank")


def _entries(collection: DataFrame, id_column: str, keep: Sequence[str], *more: Column) -> DataFrame:
    entry = F.struct(F.col(id_column).alias("id"), *keep).alias("entry")
    return collection.filter(usable("embedding")).select(*more, entry, F.col("embedding").cast("array<double>").alias("vector"))


def _queries(queries: DataFrame) -> DataFrame:
    asked = F.struct(F.monotonically_increasing_id().alias("_row"), "query_id").alias("entry")
    return queries.filter(usable("embedding")).select(asked, F.col("embedding").cast("array<double>").alias("vector"))


def nearest_join(
    collection: DataFrame,
    queries: DataFrame,
    k: int = 10,
    criteria: Mapping[str, object] | None = None,
    id_column: str = "id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Exact ``k`` nearest rows of every query: ``(query_id, id, columns of keep, score, rank)``.

    ``queries`` holds ``(query_id, embedding)``; scores are squared Euclidean distances, ties
    go to the smaller id. The plan is the same for any number of queries. Vectors that are
    null or hold a null or non-finite component take no part; vectors of different lengths
    do not meet. Repeated query rows are answered each.
    """
    asked = blocks(_queries(queries).withColumn("list", F.lit(0)))
    asked = _stored(asked.withColumn("_block", F.monotonically_increasing_id()), "query-blocks")
    # A grid of cells: queries by rows. Each side is sent as often as the other has parts, so
    # that what is moved grows with the rows, not with their square.
    n = max(1, asked.count())
    tasks = 4 * collection.sparkSession.sparkContext.defaultParallelism
    cells = min(n, max(math.ceil(n / CELL_BLOCKS), math.ceil(tasks**0.5)))
    parts = math.ceil(tasks / cells)
    cell = F.pmod(F.xxhash64("_block"), F.lit(cells)).cast("int")
    asked = asked.select("dims", "_block", cell.alias("cell"), F.col("entries").alias("asked"), F.col("vectors").alias("asked_vectors"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = blocks(_entries(collection.filter(matches(criteria)), id_column, keep, F.lit(0).alias("list")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("entries"), F.lit(parts)).cast("int"))
    dealt = rows.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    return _ranked(_scored(dealt.join(asked, ["dims", "cell", "part"]), k), k)


# --- inverted index ----------------------------------------------------------------


def _centres(sample: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Centres of ``lists`` clusters of a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(FIT_ROUNDS):
        home = np.argmin((centres * centres).sum(axis=1) - 2 * sample @ centres.T, axis=1)
        counts = np.bincount(home, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        empty = counts == 0
        centres = np.where(empty[:, None], centres, sums / np.maximum(counts, 1)[:, None])
    return centres


def _by_distance(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argsort((centres * centres).sum(axis=1) - 2 * vectors @ centres.T, axis=1, kind="stable")


def _probes(sample: np.ndarray, centres: np.ndarray, recall: float) -> int:
    """Lists to look at, so that the sample's own nearest neighbours are found at the rate asked for.

    Neighbours in a sample are further than those in all rows, so this is on the safe side.
    """
    query = sample[:: max(1, len(sample) // MEASURED)]
    rough = (sample * sample).sum(axis=1) - 2 * query @ sample.T
    near = np.argsort(rough, axis=1)[:, : NEIGHBOURS + 1]
    rank_of = np.argsort(_by_distance(query, centres), axis=1)
    ranks = np.sort(np.take_along_axis(rank_of, _by_distance(sample, centres)[:, 0][near], axis=1), axis=None)
    return int(ranks[int(np.ceil(recall * len(ranks))) - 1]) + 1


def _lists(centres: np.ndarray, probes: int = 1, counts: np.ndarray | None = None, k: int = 0):
    """Column function: the lists a vector goes to, nearest first.

    With ``counts``, lists without rows are passed over, and further ones follow until
    they hold ``k`` rows.
    """

    @F.arrow_udf("array<int>")
    def lists(vectors: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        own = np.flatnonzero(sizes == centres.shape[1])
        out = [[OTHERS] for _ in range(len(vectors))]
        if len(own) and len(centres):
            order = _by_distance(_matrix(vectors.take(pa.array(own)), centres.shape[1]), centres)
            for at, near in zip(own, order):
                if counts is None:
                    out[at] = near[:probes].tolist()
                    continue
                near = near[counts[near] > 0]
                least = int(np.searchsorted(np.cumsum(counts[near]), k)) + 1
                out[at] = near[: max(probes, least)].tolist()
        return pa.array(out, pa.list_(pa.int32()))

    return lists


def build_index(
    collection: DataFrame,
    path: str,
    id_column: str = "id",
    keep: Sequence[str] = (),
    lists: int | None = None,
    sample: int = FITTED_ON,
    seed: int = 42,
    recall: float = RECALL,
) -> str:
    """Store a collection as lists of vectors around centres; returns ``path``.

    Centres are fitted on at most about ``sample`` rows; every usable row is stored, in the list of its
    nearest centre. How many lists a search looks at is measured on the sample, so that it finds
    the share ``recall`` of the exact neighbours. There are as many lists as the root of the number of rows, within the
    bounds of the module. Rows of other lengths than the most frequent one form a list of
    their own. ``keep`` names columns to search by and to return.
    """
    spark = collection.sparkSession
    rows = _stored(_entries(collection, id_column, keep), "index-rows")
    sizes = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims, n = (sizes["dims"], sizes["count"]) if sizes else (0, 0)
    share = min(1.0, sample / n) if n else 1.0
    chosen = (F.size("vector") == dims) & (F.pmod(F.xxhash64("vector", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    fitted = rows.filter(chosen).select("vector").toPandas()["vector"]
    points = np.array(fitted.tolist(), dtype=np.float64).reshape(len(fitted), dims)
    most = min(MOST_LISTS, max(1, len(points) // 8), max(1, CENTRE_BYTES // (8 * max(1, dims))))
    lists = min(lists or int(n**0.5), most) or 1
    centres = _centres(points, lists, seed) if len(points) else np.empty((0, dims))
    probes = _probes(points, centres, recall) if len(points) else 1
    layout = [(probes, T.StructType([f for f in rows.schema if f.name != "list"]).json())]
    spark.createDataFrame(layout, "probes int, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    schema = "list int, centre array<double>"
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    _store_lists(rows, centres, path, "overwrite")
    return path


def _store_lists(rows: DataFrame, centres: np.ndarray, path: str, mode: str) -> None:
    homed = rows.withColumn("list", F.element_at(_lists(centres)("vector"), 1))
    # By range of list and vector: a list with most rows is written by many tasks.
    homed = homed.repartitionByRange("list", F.xxhash64("vector")).sortWithinPartitions("list")
    homed.write.mode(mode).partitionBy("list").parquet(f"{path}/lists")


def _read_centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # as many as lists, bounded
    return np.array([r["centre"] for r in rows], dtype=np.float64) if rows else np.empty((0, 0))


def _read_lists(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Stored rows ``(entry, vector, list)``, and how many lists a search looks at."""
    layout = spark.read.parquet(f"{path}/layout").first()
    schema = T.StructType.fromJson(json.loads(layout["schema"])).add("list", T.IntegerType())
    return spark.read.schema(schema).option("basePath", f"{path}/lists").parquet(f"{path}/lists"), layout["probes"]


def add_to_index(collection: DataFrame, path: str, id_column: str = "id") -> None:
    """Add rows to a stored index; its centres stay. Columns to keep are those of the index."""
    spark = collection.sparkSession
    stored = _read_lists(spark, path)[0].schema["entry"].dataType
    rows = _entries(collection, id_column, [f.name for f in stored.fields if f.name != "id"])
    _store_lists(rows.select(F.col("entry").cast(stored).alias("entry"), "vector"), _read_centres(spark, path), path, "append")


def search_index(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int = 10,
    probes: int | None = None,
    criteria: Mapping[str, object] | None = None,
) -> DataFrame:
    """Approximate ``k`` nearest rows of every query from a stored index.

    Same columns as :func:`nearest_join`. Each query looks at its ``probes`` nearest lists (as
    many as the index found enough) that hold rows meeting the criteria, and at further ones until they hold ``k``, so it gets
    ``k`` rows wherever there are as many. Only lists that some query looks at are read.
    """
    centres = _read_centres(spark, path)
    stored, measured = _read_lists(spark, path)
    probes = probes or measured
    stored = stored.filter(matches({f"entry.{c}": v for c, v in (criteria or {}).items()}))
    counts = np.zeros(len(centres), dtype=np.int64)
    for r in stored.groupBy("list").count().collect():  # a row per list
        if r["list"] != OTHERS:
            counts[r["list"]] = r["count"]
    # Rows of other lengths are met by queries of their length only.
    asked = _queries(queries).withColumn("list", F.explode(_lists(centres, probes, counts, k)("vector")))
    asked = _stored(asked.select("list", "entry", "vector"), "index-queries")
    wanted = [r["list"] for r in asked.select("list").distinct().collect()]
    if len(wanted) <= len(centres):
        stored = stored.filter(F.col("list").isin(wanted)) if wanted else stored.limit(0)
    spread = asked.repartitionByRange("list", "entry._row").sortWithinPartitions("list")
    packed = blocks(spread).withColumnsRenamed({"entries": "asked", "vectors": "asked_vectors"})
    packed = packed.withColumn("_block", F.monotonically_increasing_id())
    # A query is there once for each list it looks at. Stored, these repeats take next to no
    # room, so the planner would take them for few and send all of them to the driver.
    return _ranked(_scored(blocks(stored).join(packed.hint("merge"), ["list", "dims"]), k), k)
