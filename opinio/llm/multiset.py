"""Document fingerprints as homomorphic multiset hashes of paragraphs.

A paragraph (a line) is hashed to a wide vector; a document's fingerprint is the sum of its
paragraphs' vectors, each coordinate modulo a power of two. So the order of paragraphs does
not matter, and a paragraph is put in or taken out by adding or subtracting its vector.

The vector has two parts. Eight coordinates modulo 2**32 are the SHA-256 of the paragraph:
equal sums mean equal multisets of paragraphs. The others tell how like two fingerprints
are: the paragraph is taken in runs of four words, each hashed to 63 bits, and a coordinate
modulo 2**20 counts the runs that have its bit set; one more counts the runs. Centred at
half that count, coordinates are sums of random signs, and the cosine of two such vectors
estimates the share of common runs.

Everything is built from SQL expressions over one text at a time. The next document of each
is found on ids alone, level by level in buckets of neighbouring ids, and a text is shuffled
once, plus the third of it that goes to the neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.llm.common import query, table, work_table

#: Three counters of 20 bits, each with one bit of room for its carry, in one long.
LANES = 1 | 1 << 21 | 1 << 42
KEPT = ((1 << 20) - 1) * LANES
SHIFTS = 21
HALF = (1 << 32) - 1

#: Up to four words of one line.
RUN = r"[^\s]+(?:[^\S\n]+[^\s]+){0,3}"

#: Ids that share all but this many bits are one bucket; so many are put in order by one task.
BUCKET_BITS = 12
ORDERED = 1 << BUCKET_BITS


def _mod(c: Column, keep: int) -> Column:
    return c.bitwiseAND(F.lit(keep))


def fingerprint(text: Column) -> Column:
    """``struct(sums array<long>, lanes array<long>)`` of a text without null.

    ``sums`` holds the eight coordinates of paragraphs, ``lanes`` the packed counts of runs
    and, last, their number. An empty text is one empty paragraph without runs.
    """
    zero = F.array_repeat(F.lit(0).cast("long"), 8)
    parts = F.array(*[F.lit(1 + 8 * i) for i in range(8)])

    def add_paragraph(sums: Column, paragraph: Column) -> Column:
        word = lambda at: F.conv(F.substr(paragraph, at, F.lit(8)), 16, 10).cast("long")
        return F.zip_with(sums, parts, lambda s, at: _mod(s + word(at), HALF))

    hashed = F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 256))
    sums = F.aggregate(hashed, zero, add_paragraph)
    runs = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda r: F.xxhash64(r))
    shifts = F.array(*[F.lit(i) for i in range(SHIFTS)])

    def add_run(lanes: Column, run: Column) -> Column:
        bits = lambda k: _mod(F.call_function("shiftright", run, k), LANES)
        return F.zip_with(lanes, shifts, lambda a, k: _mod(a + bits(k), KEPT))

    lanes = F.aggregate(runs, F.array_repeat(F.lit(0).cast("long"), SHIFTS), add_run)
    n = _mod(F.size(runs).cast("long"), (1 << 20) - 1)
    return F.struct(sums.alias("sums"), F.concat(lanes, F.array(n)).alias("lanes"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both texts' paragraphs, or with ``sign`` -1 of ``a`` without ``b``."""
    sums = F.zip_with(a["sums"], b["sums"], lambda x, y: _mod(x + sign * y + (HALF + 1), HALF))
    room = 1 << 20
    lanes = F.zip_with(a["lanes"], b["lanes"], lambda x, y: _lanewise(x, y, sign, room))
    return F.struct(sums.alias("sums"), lanes.alias("lanes"))


def _lanewise(x: Column, y: Column, sign: int, room: int) -> Column:
    lane = lambda c, k: _mod(F.shiftright(c, 21 * k), room - 1)
    each = [_mod(lane(x, k) + sign * lane(y, k) + room, room - 1) * (1 << 21 * k) for k in range(3)]
    return each[0] + each[1] + each[2]


def text_of(fingerprint: Column) -> Column:
    """The fingerprint as lowercase hexadecimal digits."""
    digits = lambda c, n: F.array_join(F.transform(c, lambda v: F.lpad(F.hex(v), n, "0")), "")
    return F.lower(F.concat(digits(fingerprint["sums"], 8), digits(fingerprint["lanes"], 16)))


def _signs(lanes: Column) -> Column:
    n = F.element_at(lanes, SHIFTS + 1)
    counts = F.flatten(
        F.transform(
            F.slice(lanes, 1, SHIFTS),
            lambda v: F.array(*[_mod(F.shiftright(v, 21 * k), (1 << 20) - 1) for k in range(3)]),
        )
    )
    return F.transform(counts, lambda c: (2 * c - n).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common runs of two fingerprints' ``lanes``, from 0 to 1.

    Equal lanes give 1; without runs on one side, it is 0.
    """
    x, y = _signs(a), _signs(b)
    size = F.sqrt(_dot(x, x) * _dot(y, y))
    cosine = F.when(size > 0, _dot(x, y) / size).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def lower_neighbours(ids: DataFrame) -> DataFrame:
    """``(id, below)`` for distinct non-null longs ``id``: the next smaller one, or null.

    Buckets of ids that agree in their leading bits are put in order each by itself; the
    lowest of a bucket is followed by the highest of the next lower bucket, which is found
    in the same way among the buckets.
    """
    if ids.count() <= ORDERED:
        return ids.select("id", F.lead("id").over(Window.orderBy(F.desc("id"))).alias("below"))
    keyed = ids.withColumn("bucket", F.shiftright("id", BUCKET_BITS))
    inside = keyed.withColumn("below", F.lead("id").over(Window.partitionBy("bucket").orderBy(F.desc("id"))))
    tops = work_table(keyed.groupBy("bucket").agg(F.max("id").alias("top")), "multiset-buckets")
    order = lower_neighbours(tops.select(F.col("bucket").alias("id"))).withColumnRenamed("below", "lower")
    after = order.join(tops.withColumnRenamed("bucket", "lower"), "lower").select(F.col("id").alias("bucket"), "top")
    joined = inside.join(after, "bucket", "left")
    return joined.select("id", F.coalesce("below", "top").alias("below"))


def _followers(docs: DataFrame) -> tuple[DataFrame, bool]:
    """For each id: which one it follows, in how many characters of it that one is
    interested, the row that stands for it, and whether ids repeat."""
    sizes = docs.select("doc_id", F.length("text").alias("n"), F.xxhash64("text").alias("hash"))
    ids = sizes.groupBy("doc_id").agg(
        F.max(F.floor(F.col("n") / 3)).alias("third"), F.min("hash").alias("hash"), F.count(F.lit(1)).alias("rows")
    )
    ids = work_table(ids, "multiset-ids")
    least, most, rows, n, nulls = ids.agg(
        F.min("doc_id"), F.max("doc_id"), F.sum("rows"), F.count(F.lit(1)), F.max(F.col("doc_id").isNull())
    ).first()
    order = lower_neighbours(ids.filter("doc_id is not null").select(F.col("doc_id").alias("id")))
    # The last is followed by a null id, where there is one, and that or else the last by the first.
    after_last = F.lit(None) if nulls else F.lit(most)
    order = order.select(
        F.col("id").alias("doc_id"), F.when(F.col("id") == least, after_last).otherwise(F.col("below")).cast("long").alias("next_id")
    )
    if nulls:
        spark = docs.sparkSession
        order = order.unionByName(spark.range(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(most).cast("long").alias("next_id")))
    order = work_table(order, "multiset-order")
    named = ids.select("doc_id", "third").alias("i").join(
        order.alias("o"), F.col("i.doc_id").eqNullSafe(F.col("o.doc_id"))
    ).select(F.col("o.next_id").alias("id"), F.col("o.doc_id").alias("for_id"), "third")
    stands = ids.select(F.col("doc_id").alias("own_id"), "hash")
    met = stands.join(named, F.col("own_id").eqNullSafe(F.col("id")))
    return work_table(met.select("own_id", "hash", "for_id", "third"), "multiset-followers"), (rows or 0) > n


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` (``doc_id long``, ``text``) with its fingerprint and its edited text's.

    Edited: the last third of its characters, rounded down, replaced by as many of the
    first of the next document, or all of them. Documents follow in descending doc_id, a
    null id last, and the last is followed by the first, so a single document by itself. A
    null text is empty. Of rows with one id, the one with the smallest text hash is the
    next document of the row before; each row is edited by itself. An empty table gives no
    rows. Columns: ``doc_id, n_chars, edited, fp, edited_fp, next_lanes``.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    followers, repeated = _followers(docs)
    met = docs.join(followers, F.col("doc_id").eqNullSafe(F.col("own_id")))
    # Written so that it is no join key: both uses of ``met`` then share one shuffle.
    stands = F.xxhash64("text").bitwiseXOR(F.col("hash")) == 0
    first = met.filter(stands).select(
        "for_id",
        F.substr("text", F.lit(1), F.col("third").cast("int")).alias("begin"),
        fingerprint(F.col("text"))["lanes"].alias("next_lanes"),
    )
    if repeated:
        first = first.groupBy("for_id").agg(F.min(F.struct("begin", "next_lanes")).alias("f")).select("for_id", "f.*")
    both = met.select("doc_id", "text").join(first, F.col("doc_id").eqNullSafe(F.col("for_id")))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - third), F.substr("begin", F.lit(1), third))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_lanes")
    return both.select(
        "doc_id",
        "n_chars",
        "edited",
        fingerprint(F.col("text")).alias("fp"),
        fingerprint(F.col("edited")).alias("edited_fp"),
        "next_lanes",
    )


@query("op6_multiset")
def op6_multiset(spark, sf_dir):
    found = fingerprints(table(spark, sf_dir, "documents"))
    fp, edited = F.col("fp"), F.col("edited_fp")
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        text_of(fp).alias("fingerprint"),
        text_of(edited).alias("edited_fingerprint"),
        likeness(fp["lanes"], edited["lanes"]).alias("near_edited"),
        likeness(fp["lanes"], F.col("next_lanes")).alias("near_next"),
    )
