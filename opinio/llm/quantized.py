"""Near-duplicate embeddings by product quantisation with exact reranking.

Vectors lie in coarse inverted lists, each with a code per subspace of its residual. A
vector probes every list whose border lies within reach of it; there, table lookups bound
its cosine with each member from above, and only members whose bound reaches the threshold
are compared exactly, in double precision. The bound includes each code's own error, so
the codes lose nothing; what probing may lose depends on ``reach`` alone.

Equal vectors are one member with a count. A list is dealt out in blocks of bounded many
members and queries, so a list with a third of all vectors is many tasks. A block gives
link counts and the links that join its components, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import query, table, work_table
from opinio.llm.components import components

#: Most members and most queries of one block.
BLOCK = 2048


@dataclass(frozen=True)
class Index:
    #: Vectors the lists and codes are fitted on, at most about so many, by hash.
    sample: int = 20_000
    #: Lists for each square root of the number of different vectors, and at most.
    lists: float = 2.0
    most_lists: int = 4096
    subspaces: int = 16
    #: Distance from a list's border up to which the list is probed.
    reach: float = 0.16
    rounds: int = 8
    seed: int = 11


@dataclass(frozen=True)
class Fitted:
    centers: np.ndarray
    codebooks: np.ndarray  # subspace, code, its dimensions


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centers = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        order = np.argsort(near, kind="stable")
        used, first = np.unique(near[order], return_index=True)
        centers[used] = np.add.reduceat(x[order], first) / np.diff([*first, len(x)])[:, None]
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = 0.5 * (centers**2).sum(axis=1)
    parts = [np.argmax(x[i : i + 4096] @ centers.T - half, axis=1) for i in range(0, len(x), 4096)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def fit_index(sample: np.ndarray, n: int, index: Index) -> Fitted:
    """Centers of the lists and codes of the residuals, from unit vectors."""
    rng = np.random.default_rng(index.seed)
    k = int(np.clip(round(index.lists * n**0.5), 1, index.most_lists))
    centers = _k_means(sample, k, index.rounds, rng)
    rest = sample - centers[_nearest(sample, centers)]
    parts = np.array_split(np.arange(sample.shape[1]), min(index.subspaces, sample.shape[1]))
    width = max(map(len, parts))
    books = np.zeros((len(parts), 256, width))
    for s, dims in enumerate(parts):
        book = _k_means(rest[:, dims], 256, index.rounds, rng)
        books[s, : len(book), : len(dims)] = book
        books[s, len(book) :] = books[s, 0]
    return Fitted(centers, books)


def _split(x: np.ndarray, fitted: Fitted) -> list[np.ndarray]:
    return np.array_split(x, len(fitted.codebooks), axis=1)


def encode(rest: np.ndarray, fitted: Fitted) -> tuple[np.ndarray, np.ndarray]:
    """Codes of residuals, and the vectors they stand for."""
    codes = np.empty((len(rest), len(fitted.codebooks)), dtype=np.uint8)
    stands = []
    for s, part in enumerate(_split(rest, fitted)):
        book = fitted.codebooks[s][:, : part.shape[1]]
        codes[:, s] = _nearest(part, book)
        stands.append(book[codes[:, s]])
    return codes, np.hstack(stands)


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _vectors(column) -> np.ndarray:
    blobs = list(column)
    return np.frombuffer(b"".join(blobs), dtype="<f8").reshape(len(blobs), -1)


PLACED = "cid long, copies long, vector binary, list int, code binary, error double, probes array<int>"


def _place(fitted: Fitted, reach: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centers = fitted.centers
        gaps = np.sqrt(np.maximum(((centers[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2), 0)) if len(centers) <= 512 else None
        half = 0.5 * (centers**2).sum(axis=1)
        for batch in batches:
            x = _unit(_vectors(batch["vector"])) if len(batch) else np.empty((0, centers.shape[1]))
            score = x @ centers.T - half
            at = np.argmax(score, axis=1)
            rest = x - centers[at]
            codes, stands = encode(rest, fitted)
            probes = []
            for i, home in enumerate(at):
                gap = gaps[home] if gaps is not None else np.sqrt(((centers - centers[home]) ** 2).sum(axis=1))
                # Distance of the vector from the border between its list and another's.
                probes.append(np.flatnonzero(score[i, home] - score[i] <= reach * gap).tolist())
            yield pd.DataFrame(
                {
                    "cid": batch["cid"],
                    "copies": batch["copies"],
                    "vector": [v.astype("<f8").tobytes() for v in x],
                    "list": at.astype(np.int32),
                    "code": [c.tobytes() for c in codes],
                    "error": np.linalg.norm(rest - stands, axis=1),
                    "probes": probes,
                }
            )

    return run


FOUND = "cid long, links long, other long"


def _joined(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids that join what ``mask``, left ids by right ids, joins."""
    rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    inner = mask[np.ix_(rows, columns)]
    label, none = np.arange(len(rows)), len(rows)
    while True:
        over = np.where(inner, label[:, None], none).min(axis=0)
        next_ = np.minimum(label, np.where(inner, over[None, :], none).min(axis=1))
        if (next_ == label).all():
            break
        label = next_
    lead = left[rows]
    return np.r_[lead, right[columns]], np.r_[lead[label], lead[over]]


def _compare(fitted: Fitted, threshold: float):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        asked, members = block[block["probe"]], block[~block["probe"]]
        if not len(asked) or not len(members):
            return pd.DataFrame({"cid": [], "links": [], "other": []}, dtype="int64")
        q, y = _vectors(asked["vector"]), _vectors(members["vector"])
        q_id, y_id = asked["cid"].to_numpy(), members["cid"].to_numpy()
        codes = np.frombuffer(b"".join(members["code"]), dtype=np.uint8).reshape(len(y), -1)
        # One table per subspace: each query's product with each code.
        bound = (q @ fitted.centers[int(members["list"].iloc[0])])[:, None] + members["error"].to_numpy()[None, :]
        for s, part in enumerate(_split(q, fitted)):
            tables = part @ fitted.codebooks[s][:, : part.shape[1]].T
            bound += tables[:, codes[:, s]]
        near = (bound >= threshold - 1e-9) & (q_id[:, None] != y_id[None, :])
        for i in np.flatnonzero(near.any(axis=1)):
            at = np.flatnonzero(near[i])
            near[i, at] = (y[at] * q[i]).sum(axis=1) >= threshold
        links = near @ members["copies"].to_numpy()
        hit = np.flatnonzero(links)
        out = [pd.DataFrame({"cid": q_id[hit], "links": links[hit], "other": q_id[hit]})]
        if len(hit):
            # A member that does not look into the query's list would not count the pair itself.
            homes, home = np.unique(asked["home"].to_numpy(dtype=np.int64), return_inverse=True)
            looks = np.stack([np.isin(homes, p) for p in members["probes"]])
            back = (near & ~looks[:, home].T).T @ asked["copies"].to_numpy()
            met = np.flatnonzero(back)
            out.append(pd.DataFrame({"cid": y_id[met], "links": back[met], "other": y_id[met]}))
            a, b = _joined(near, q_id, y_id)
            out.append(pd.DataFrame({"cid": a, "links": 0, "other": b}))
        return pd.concat(out, ignore_index=True).astype("int64")

    return run


def _dealt(placed: DataFrame) -> DataFrame:
    """Members and probing vectors of each list, in blocks of bounded size."""
    lists = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n_members"))
    probes = placed.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("n_probes"))
    # A row per list; their number is bounded by the index.
    parts = lists.join(probes, "list", "left").select(
        "list",
        F.ceil(F.col("n_members") / (BLOCK // 2)).cast("int").alias("m"),
        F.ceil(F.coalesce("n_probes", F.lit(1)) / (BLOCK // 2)).cast("int").alias("p"),
    )
    parts = F.broadcast(work_table(parts, "quantized-lists"))
    part = lambda n, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), n)
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    members = (
        placed.select("cid", "copies", "vector", "list", "code", "error", "probes")
        .join(parts, "list")
        .withColumns({"mp": part(F.col("m"), "m").cast("int"), "pp": F.explode(every("p")), "probe": F.lit(False)})
    )
    asked = (
        placed.select("cid", "copies", "vector", F.col("list").alias("home"), F.explode("probes").alias("list"))
        .join(parts, "list")
        .withColumns({"pp": part(F.col("p"), "p").cast("int"), "mp": F.explode(every("m")), "probe": F.lit(True)})
    )
    columns = ["list", "mp", "pp", "probe", "cid", "copies", "vector"]
    members = members.select(*columns, "code", "error", "probes")
    return members.unionByName(asked.select(*columns, "home"), allowMissingColumns=True)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, index: Index = Index()) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors`` (``vec_id``, ``embedding``).

    Rows link where their cosine reaches ``threshold``. A vector that is null, zero or
    empty, or holds a null or non-finite component, links with nothing. Vectors link with
    ones of their own length, each length having an index of its own. Repeated rows are vectors of their own and
    link with each other. ``component_id`` is the smallest vec_id reachable; null ids count
    for nothing, and a component of them alone has a null ``component_id``. An empty table
    gives no rows.
    """
    clean = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(clean, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", clean.alias("v"), (F.coalesce(finite, F.lit(False)) & F.exists(clean, lambda v: v != 0)).alias("usable"))
    # Minus zero is zero, so that equal vectors group.
    rows = rows.select("vec_id", F.when(F.col("usable"), F.transform("v", lambda v: v + F.lit(0.0))).alias("v"))
    rows = rows.withColumn("key", F.xxhash64("v"))
    groups = rows.filter("v is not null").groupBy("key", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    groups = work_table(groups.withColumn("cid", F.monotonically_increasing_id()), "quantized-vectors")
    # A row per length of vectors.
    sizes = {r["d"]: r["count"] for r in groups.groupBy(F.size("v").alias("d")).count().collect()}
    none = rows.filter("v is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    if sizes:
        each = [_linked(groups.filter(F.size("v") == d), n, threshold, index) for d, n in sorted(sizes.items())]
        found = reduce(DataFrame.unionByName, each)
        links = found.groupBy("cid").agg(F.sum("links").alias("links"))
        roots = work_table(components(found.filter("cid <> other").select(F.col("cid").alias("a"), F.col("other").alias("b"))), "quantized-roots")
        named = groups.join(roots.withColumnRenamed("node", "cid"), "cid", "left").join(links, "cid", "left")
        named = named.withColumn("root", F.coalesce("root", "cid"))
        least = named.groupBy("root").agg(F.min("least").alias("component_id"))
        named = named.join(least, "root").select(
            "key", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
        )
        some = rows.filter("v is not null").join(named, ["key", "v"]).select("vec_id", "n_links", "component_id")
        none = none.unionByName(some)
    return none.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _linked(groups: DataFrame, n: int, threshold: float, index: Index) -> DataFrame:
    share = min(1.0, index.sample / n)
    chosen = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1_000_000)) < max(1, int(share * 1_000_000))
    sample = groups.filter(chosen).select("v").toPandas()["v"]
    if not len(sample):
        sample = groups.limit(1).select("v").toPandas()["v"]
    fitted = fit_index(_unit(np.array(sample.tolist(), dtype=np.float64)), n, index)
    packed = groups.select("cid", "copies", "v").mapInArrow(_pack, "cid long, copies long, vector binary")
    placed = work_table(packed.mapInPandas(_place(fitted, index.reach), PLACED), "quantized-placed")
    found = _dealt(placed).groupBy("list", "mp", "pp").applyInPandas(_compare(fitted, threshold), FOUND)
    return work_table(found, "quantized-found")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of doubles as little-endian bytes."""
    for batch in batches:
        column = batch.column(2)
        width = len(column.flatten()) // max(1, len(column))
        flat = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), dtype="<f8").reshape(-1, max(1, width))
        blobs = pa.array([v.tobytes() for v in flat], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blobs], names=["cid", "copies", "vector"])


@query("op8_quantized")
def op8_quantized(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
