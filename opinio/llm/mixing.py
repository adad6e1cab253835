"""Mix sources to target weights along a low-discrepancy schedule.

Every source is a stream: its documents in a shuffled order, laid end to end and repeated,
cut into blocks of equal token counts. A golden-ratio point per slot of the mix falls into
one source's share of the unit interval; the slots of a source, ranked, take its blocks one
after another. So any stretch of the mix holds the sources in nearly their target shares.

Only sizes and keys are moved, never texts. A source with a third of all rows is split by
ranges of the shuffle key; running sums are worked out within such a range and completed
by the sums of the ranges before it. Slots are ranked the same way, in chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.llm.common import WORD, query, table, work_table

#: Points of the schedule: ``i * GOLDEN mod CIRCLE``, GOLDEN the odd number nearest to
#: CIRCLE divided by the golden ratio. All arithmetic is exact.
CIRCLE = 1 << 31
GOLDEN = 1_327_217_885

#: Parts of the circle by which slots and shares of sources are brought together.
ARCS = 1 << 12

#: Slots ranked together, and documents expected in one range of a source.
CHUNK_SLOTS = 1 << 15
RANGE_DOCS = 1 << 11


@dataclass(frozen=True)
class Mix:
    """``sources``: a row per source with its words, target and planned words.
    ``documents``: a row per document with its place in its source's stream.
    ``pieces``: a row per slot of the mix and document in it, with the words taken."""

    sources: DataFrame
    documents: DataFrame
    pieces: DataFrame


def word_count(text: Column | str) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """Words each source is to give, from a frame ``(skey, source, source_size)``.

    Sources take ``weights`` in turn, by code point with null last. Each gets ``share``
    times all words by weight, but at most ``epochs`` times its own; what exceeds that
    goes to the others by weight. That is one water level over the sources in the order in
    which they fill up, so one pass over a row per source is enough.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = sizes.withColumns(
        {
            "weight": F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long"),
            "limit": F.col("source_size") * epochs,
        }
    )
    all_rows = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    total = F.sum("source_size").over(all_rows) * F.lit(float(share))
    # If this source and all that fill up later share what the earlier leave:
    left = total - F.coalesce(F.sum("limit").over(before), F.lit(0))
    heavy = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    leveled = weighed.withColumns({"left": left, "heavy": heavy})
    # The level is that of the first source it does not fill; those before are full.
    open_rank = F.when(F.col("left") * F.col("weight") < F.col("limit") * F.col("heavy"), F.struct("heavy", "left"))
    first_open = F.max(open_rank).over(all_rows)
    full = F.col("limit").cast("double")
    even = first_open["left"] * F.col("weight") / first_open["heavy"]
    target = F.when(first_open.isNull() | (F.col("heavy") > first_open["heavy"]), full).otherwise(F.least(full, even))
    return leveled.select(
        "skey",
        "source",
        "source_size",
        "weight",
        target.alias("target"),
        F.least(F.round(target).cast("long"), F.col("limit")).alias("planned"),
    )


def _ranked_documents(docs: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their first word's place in their source, and the sources."""
    n_ranges = max(1, docs.count() // RANGE_DOCS)
    order = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in ("doc_id", "size", "copy")]))
    keyed = docs.withColumn("key", order).withColumn(
        "part", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n_ranges, 32)
    )
    parts = keyed.groupBy("skey", "source", "part").agg(F.sum("size").alias("words"))
    parts = work_table(parts, "mix-ranges")
    earlier = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "skey", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("skey", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        keyed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, ["skey", "part"])
        .withColumn("start", F.col("offset") + F.col("within"))
        .drop("offset", "within", "part", "key")
    )
    return placed, parts.groupBy("skey", "source").agg(F.sum("words").alias("source_size"))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """Slots ``(slot, skey, turn)`` of the mix; ``turn`` counts a source's own slots.

    A source whose points come short by a few closes with the slots it still needs.
    """
    spark = sources.sparkSession
    need = F.ceil(F.col("planned") / block).cast("long")
    needed = work_table(sources.select("skey", need.alias("need")).filter("need > 0"), "mix-need")
    n_slots = needed.agg(F.sum("need")).first()[0] or 0
    upto = F.sum("need").over(Window.orderBy("skey"))
    # Bounds of each source's arc on the circle, exact in integers below 2**62.
    arcs = needed.select(
        "skey",
        "need",
        F.floor((upto - F.col("need")).cast("decimal(20,0)") * CIRCLE / max(n_slots, 1)).cast("long").alias("low"),
        F.floor(upto.cast("decimal(20,0)") * CIRCLE / max(n_slots, 1)).cast("long").alias("high"),
    )
    width = CIRCLE // ARCS
    arcs = arcs.filter("low < high").withColumn(
        "arc", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width)))
    )
    point = (F.col("id") % CIRCLE) * GOLDEN % CIRCLE
    slots = spark.range(n_slots).withColumn("point", point).withColumn("arc", F.floor(F.col("point") / width))
    hit = slots.join(arcs, "arc").filter("low <= point and point < high").select("id", "skey", "need")
    hit = hit.withColumn("chunk", F.floor(F.col("id") / CHUNK_SLOTS))
    counts = work_table(hit.groupBy("skey", "chunk").agg(F.count(F.lit(1)).alias("n")), "mix-slots")
    earlier = Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("skey", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("skey", "chunk").orderBy("id")
    ranked = (
        hit.withColumn("rank", F.row_number().over(inside) - 1)
        .join(ahead, ["skey", "chunk"])
        .withColumn("turn", F.col("ahead") + F.col("rank"))
        .filter("turn < need")
        .select(F.col("id").alias("slot"), "skey", "turn")
    )
    had = counts.groupBy("skey").agg(F.sum("n").alias("had"))
    closing = (
        needed.join(had, "skey", "left")
        .withColumn("had", F.coalesce("had", F.lit(0)))
        .filter("had < need")
        .withColumn("turn", F.explode(F.sequence(F.col("had"), F.col("need") - 1)))
        .select(F.lit(n_slots).cast("long").alias("slot"), "skey", F.col("turn").cast("long"))
    )
    return ranked.select("slot", "skey", F.col("turn").cast("long")).unionByName(closing)


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    epochs: int = 2,
    block: int = 2048,
    seed: str = "mix",
) -> Mix:
    """Plan a mix of ``docs`` (``doc_id``, ``text``, ``source``; others are ignored).

    ``weights`` go round the sources in code-point order, null last. The mix takes
    ``share`` times all words, none more than ``epochs`` times. Nulls: a null text has no
    words; null sources are one source; a null id is an id like any other. Repeated rows
    are numbered (``copy``) and each is a document. Documents without words appear in
    ``documents`` but in no piece. An empty table gives empty frames.
    """
    sized = docs.select(
        F.col("doc_id"), F.col("source"), word_count("text").alias("size")
    ).withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    rows = (
        sized.groupBy("doc_id", "source", "skey", "size")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .drop("copies")
    )
    rows = work_table(rows, "mix-sizes")
    placed, sizes = _ranked_documents(rows, seed)
    sources = work_table(targets(sizes, weights, share, epochs), "mix-sources")
    documents = work_table(
        placed.join(sources.select("skey", "source_size", "target", "planned"), "skey"), "mix-documents"
    )
    # Where the document lies in the repeated stream, and the blocks it reaches into.
    times = documents.filter("size > 0").withColumn(
        "begin", F.explode(F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: F.col("start") + e * F.col("source_size")))
    )
    times = times.withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("planned"))).filter("begin < end")
    reached = times.withColumn(
        "turn", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block)))
    )
    low = F.greatest(F.col("begin"), F.col("turn") * block)
    high = F.least(F.col("end"), (F.col("turn") + 1) * block)
    pieces = reached.join(schedule(sources, block), ["skey", "turn"]).select(
        "slot",
        "turn",
        "doc_id",
        "source",
        "skey",
        "copy",
        "size",
        (low - F.col("begin")).alias("from_word"),
        (high - low).alias("words"),
    )
    return Mix(sources, documents, pieces)


def taken(plan: Mix) -> DataFrame:
    """A row per document: its size, its source's size and target, the words taken."""
    keys = ["skey", "doc_id", "copy", "size"]
    words = plan.pieces.groupBy(*keys).agg(F.sum("words").alias("words"))
    none = plan.documents.select(*keys, F.lit(0).cast("long").alias("words"), "source", "source_size", "target")
    both = none.unionByName(words, allowMissingColumns=True)
    return (
        both.groupBy(*keys)
        .agg(
            F.sum("words").alias("taken"),
            F.max("source").alias("source"),
            F.max("source_size").alias("source_size"),
            F.max("target").alias("target"),
        )
        .select("doc_id", "source", "copy", "size", "source_size", "target", "taken")
    )


def mixed_documents(docs: DataFrame, plan: Mix) -> DataFrame:
    """``docs`` as often as ``plan``, made from them, takes them, with the words it takes.

    A document comes once for each time it is taken whole. One that the end of the mix
    cuts comes once more with its first words, joined by blanks; ``n_chars``, where ``docs``
    has it, is that of the cut text. Documents that are not taken do not come. Rows are dealt
    out by hash, whatever their source, and each part is sorted by the slot in which they
    begin, so that any stretch of a written part holds the sources in their shares. An empty table gives no rows; columns may have any names.
    """
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rows = docs.select(
        F.struct(*docs.columns).alias("_doc"), F.col("doc_id").alias("_id"), skey.alias("_skey"), word_count("text").alias("_size"), F.col("text").alias("_text")
    )
    repeated = (plan.documents.agg(F.max("copy")).first()[0] or 1) > 1
    same = Window.partitionBy("_id", "_skey", "_size").orderBy("_text")
    rows = rows.withColumn("_copy", F.row_number().over(same).cast("long") if repeated else F.lit(1).cast("long"))
    # Whole times and, of the last, the words and the slots it begins in: at most one a time.
    begins = F.array_sort(F.collect_list(F.when(F.col("from_word") == 0, F.col("slot"))))
    words = plan.pieces.groupBy("doc_id", "skey", "size", "copy").agg(F.sum("words").alias("_taken"), begins.alias("_slots"))
    # One key without nulls: texts are dealt out by it once, for the join and for the order.
    key = lambda *c: F.to_json(F.struct(*[F.col(n).alias(k) for n, k in zip(c, "abcd")])).alias("_key")
    words = words.select(key("doc_id", "skey", "size", "copy"), "_taken", "_slots")
    rows = rows.select("_doc", "_text", "_size", key("_id", "_skey", "_size", "_copy")).repartition("_key")
    met = rows.join(words, "_key")
    whole = F.floor(F.col("_taken") / F.col("_size")).cast("int")
    rest = (F.col("_taken") % F.col("_size")).cast("int")
    times = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    out = met.select("_doc", "_text", "_slots", F.posexplode(times).alias("_time", "_cut"))
    slot = F.coalesce(F.get("_slots", F.col("_time")), F.lit(0))
    taken_words = F.slice(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), 1, F.greatest("_cut", F.lit(0)))
    cut = F.col("_cut") >= 0
    out = out.select("_doc", "_cut", slot.alias("_slot"), F.when(cut, F.array_join(taken_words, " ")).otherwise(F.col("_text")).alias("_text"))
    out = out.sortWithinPartitions("_slot", F.xxhash64("_text"))
    values = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        n = F.length("_text").cast(docs.schema["n_chars"].dataType)
        values["n_chars"] = F.when(cut, n).otherwise(F.col("_doc.n_chars"))
    return out.select(*[values.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])


SEED = "mix"

_SQL = f"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size from documents),
numbered as (select *, row_number() over (partition by doc_id, source, size) as copy from sized),
sums as (select source, cast(sum(size) as bigint) as s from sized group by source),
weighed as (
  select *, 2 * s as lim,
    [3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] as w from sums),
leveled as (
  select *,
    cast(sum(s) over () as bigint) * 1.5::double
      - cast(coalesce(sum(lim) over (order by lim / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as bigint) as remaining,
    cast(sum(w) over () - coalesce(sum(w) over (order by lim / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as bigint) as heavy
  from weighed),
level as (
  select heavy as h, remaining as r from leveled where remaining * w < lim * heavy order by heavy desc limit 1),
aimed as (
  select source, s, lim,
    case when h is null or heavy > h then lim::double else least(lim::double, r * w / h) end as target
  from leveled left join level on true),
planned as (select *, least(cast(round(target) as bigint), lim) as p from aimed),
placed as (
  select *, coalesce(sum(size) over (partition by source
      order by md5(concat_ws('|', '{SEED}', doc_id::varchar, size::varchar, copy::varchar))
      rows between unbounded preceding and 1 preceding), 0)::bigint as a
  from numbered)
select doc_id, size::bigint as size, s as source_size, target,
  (case when size = 0 then 0 else
    greatest(0, least(a + size, p) - a) + greatest(0, least(a + s + size, p) - a - s) end)::bigint as taken
from placed join planned on planned.source is not distinct from placed.source
"""


@query("op1_mixing", _SQL)
def op1_mixing(spark, sf_dir):
    return taken(mix(table(spark, sf_dir, "documents"), seed=SEED)).select(
        "doc_id", "size", "source_size", "target", "taken"
    )
