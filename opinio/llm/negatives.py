"""Hard negatives by slot-decomposed selection.

Every positive of an anchor opens a window of negative scores below its own. The upper
limits of an anchor's windows split the scores into disjoint slots, so a scored row
belongs to one slot, however many windows it lies in. Tasks keep the best few rows of each
slot; what the slots from a window's upper limit downwards kept, merged in descending
order, starts with the window's best rows.

Scores are worked out in blocks: anchors and rows are dealt by hash into a grid of cells of
bounded size, and a cell is one matrix product. No cell grows with the number of rows of a
label, and only the kept rows leave it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.llm.common import query, table, work_table

#: Bytes of vectors that one cell holds of rows and of anchors.
ROW_BYTES = 8 << 20
ANCHOR_BYTES = 2 << 20

#: Scores worked out at once in a cell.
SCORES = 1 << 22


@dataclass(frozen=True)
class Window_:
    """What is mined: for each of the first ``positives`` of an anchor the first
    ``negatives`` rows whose score is from ``low`` to ``high`` percent of the positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


FOUND = pa.schema([("anchor", pa.int64()), ("slot", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def whole_numbers(vector: Column | str, scale: int) -> Column:
    """Each component times ``scale``, rounded down; null where any is null or not finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    clean = F.transform(vector, lambda v: v.cast("double"))
    usable = F.forall(clean, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(usable, F.transform(clean, lambda v: F.floor(v * scale)))


def _matrix(rows: pa.Table) -> np.ndarray:
    flat = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(rows.num_rows, -1)


def _products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products. Floating point serves where all of its sums are whole numbers."""
    most = lambda m: int(max(-m.min(initial=0), m.max(initial=0)))
    bound = most(anchors) * most(rows) * max(1, rows.shape[1])
    if bound < 1 << 53:
        return (anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return anchors @ rows.T
    raise OverflowError("components too large: an inner product may pass 64 bits")


def _first(score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores; equal ones in the order given."""
    if len(score) > k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        near = np.arange(len(score))
    return near[np.lexsort((order[near], -score[near]))][:k]


def _cells(pick):
    """Cell by cell, what ``pick(anchor, scores, rows)`` keeps: ``(slot, places)`` pairs."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return FOUND.empty_table()
        y, x = _matrix(rows), _matrix(anchors)
        ids = rows.column("id").combine_chunks()
        # Null ids come last among equal scores; which of two equal ids does not matter.
        numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.empty(len(y), dtype=np.int64)
        order[np.lexsort((numbers, ids.is_null().to_numpy(zero_copy_only=False)))] = np.arange(len(y))
        meta = {c: rows.column(c).to_numpy() for c in ("row", "label")}
        asked = anchors.drop_columns(["vector"]).to_pylist()
        out = {"anchor": [], "slot": [], "at": [], "score": []}
        step = max(1, SCORES // len(y))
        for begin in range(0, len(x), step):
            scores = _products(x[begin : begin + step], y)
            for anchor, score in zip(asked[begin : begin + step], scores):
                for slot, at in pick(anchor, score, order, meta):
                    out["anchor"].append(np.full(len(at), anchor["row"]))
                    out["slot"].append(np.full(len(at), slot))
                    out["at"].append(at)
                    out["score"].append(score[at])
        if not out["at"]:
            return FOUND.empty_table()
        flat = {c: np.concatenate(parts).astype(np.int64) for c, parts in out.items()}
        columns = [pa.array(flat["anchor"]), pa.array(flat["slot"]), ids.take(pa.array(flat["at"])), pa.array(flat["score"])]
        return pa.Table.from_arrays(columns, schema=FOUND)

    return run


def _alike(k: int):
    def pick(anchor, score, order, meta):
        other = np.flatnonzero(meta["row"] != anchor["row"])
        yield 0, other[_first(score[other], order[other], k)]

    return pick


def _in_slots(k: int):
    def pick(anchor, score, order, meta):
        tops = np.array(anchor["tops"], dtype=np.int64)  # ascending
        inside = np.flatnonzero((score >= anchor["least"]) & (score <= tops[-1]) & (meta["label"] != anchor["label"]))
        slots = np.searchsorted(tops, score[inside], side="left")
        for slot in np.unique(slots):
            at = inside[slots == slot]
            yield int(tops[slot]), at[_first(score[at], order[at], k)]

    return pick


def _grid(rows: DataFrame, anchors: DataFrame, by: list[str], pick) -> DataFrame:
    """Rows and anchors that agree in ``by``, each pair of their parts met in one cell."""
    width = F.greatest(F.col("dims"), F.lit(1)) * 8
    count = lambda df, size, name: df.groupBy(*by).agg(
        F.ceil(F.count(F.lit(1)) * F.first(width) / size).cast("int").alias(name)
    )
    parts = count(rows, ROW_BYTES, "row_parts").join(count(anchors, ANCHOR_BYTES, "anchor_parts"), by)
    parts = work_table(parts, "negatives-parts")
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = [*by, "row_part", "anchor_part"]
    y = rows.join(parts, by).withColumn("row_part", part("row_parts")).withColumn("anchor_part", every("anchor_parts"))
    x = anchors.join(parts, by).withColumn("anchor_part", part("anchor_parts")).withColumn("row_part", every("row_parts"))
    extra = [c for c in anchors.columns if c not in rows.columns]
    columns = list(dict.fromkeys(["row", "id", "label", "dims", "vector"]))
    y = y.select(*columns, *[c for c in cell if c not in columns])
    x = x.select(*columns, *extra, *[c for c in cell if c not in columns])
    # Both come from one table: new names for one side keep them apart.
    x = x.toDF(*x.columns)
    met = y.groupBy(*cell).cogroup(x.groupBy(*cell))
    return met.applyInArrow(_cells(pick), "anchor long, slot long, id long, score long")


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, window: Window_ = Window_()) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``vectors`` has ``id`` (whole number), ``label`` and ``vector`` (array of whole
    numbers); ``anchor``, a condition over its columns, names the anchors. A row's score is its inner
    product with the anchor; higher ones come first, then smaller ids, null ids last. An
    anchor's positives are its first other rows of the same label; the negatives of each
    are the first rows of other labels in its window, fewer where fewer are there.

    Rows whose label or vector is null take no part. Rows of equal content, repeated ids
    included, are rows of their own: each of two equal rows is the other's positive.
    Vectors meet vectors of their own length only. Inner products that may pass 64 bits
    are an error. An empty table, or one without anchors, gives no rows.
    """
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("id").cast("long").alias("id"),
        "label",
        F.size("vector").alias("dims"),
        F.col("vector").cast("array<bigint>").alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).filter("label is not null and vector is not null")
    rows = work_table(rows, "negatives-rows")
    anchors = rows.filter("anchor").drop("anchor")
    rows = rows.drop("anchor")

    alike = _grid(rows, anchors, ["dims", "label"], _alike(window.positives))
    best = _ranked(alike, ["anchor"], window.positives)
    percent = lambda p: F.col("score") * F.lit(p)
    positives = best.select(
        "anchor",
        F.col("rank").alias("number"),
        F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
        F.ceil(percent(window.low).cast("decimal(22,0)") / 100).cast("long").alias("least"),
        F.floor(percent(window.high).cast("decimal(22,0)") / 100).cast("long").alias("top"),
    )
    positives = work_table(positives.filter("least <= top"), "negatives-positives")

    # As many upper limits as positives at most.
    slots = positives.groupBy("anchor").agg(F.array_sort(F.collect_set("top")).alias("tops"), F.min("least").alias("least"))
    asked = anchors.join(slots.withColumnRenamed("anchor", "row"), "row")
    scored = _grid(rows, asked, ["dims"], _in_slots(window.negatives))
    kept = _ranked(scored, ["anchor", "slot"], window.negatives)
    # Bounded by positives times negatives; descending by score, then by id.
    entry = F.struct((-F.col("score")).alias("minus"), F.col("id").isNull().alias("last"), "id", "score", "slot")
    merged = kept.groupBy("anchor").agg(F.array_sort(F.collect_list(entry)).alias("kept"))
    suffix = F.filter("kept", lambda e: (e["slot"] <= F.col("top")) & (e["score"] >= F.col("least")))
    answers = positives.join(merged, "anchor").select(
        "anchor", "positive_id", "positive_score", F.posexplode(F.slice(suffix, 1, window.negatives)).alias("at", "e")
    )
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return answers.join(names, "anchor").select(
        "anchor_id",
        "positive_id",
        (F.col("at") + 1).alias("rank"),
        F.col("e.id").alias("negative_id"),
        "positive_score",
        F.col("e.score").alias("negative_score"),
    )


SCALE = 256
LABELS = 10

SQL_TWIN = f"""
with usable as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % {LABELS} else label end as label,
    list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.id as anchor_id, b.id as id, a.label = b.label as same,
    cast(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) as bigint) as score
  from usable a join usable b on a.id % 100 = 0 and a.id <> b.id),
positives as (
  select anchor_id, id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from (
  select p.*, s.id as negative_id, s.score as negative_score,
    row_number() over (partition by anchor_id, positive_id order by s.score desc, s.id) as rank
  from positives p join scores s using (anchor_id)
  where not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
where rank <= 10"""


@query("op11_hard_negatives", SQL_TWIN)
def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).alias("label"),
        whole_numbers("embedding", SCALE).alias("vector"),
    )
    return hard_negatives(rows, F.col("id") % 100 == 0)
