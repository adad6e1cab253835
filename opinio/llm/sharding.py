"""Cut a corpus into shards of bounded size by extendible hashing.

A row's hash is a string of bits; a bucket is a prefix of it. A bucket over the byte limit
splits on its next bit, and only that one, until every bucket fits. The directory has an
entry per prefix of one common depth and says which bucket it belongs to, as several short
prefixes share one. It is worked out from one sum per entry, rolled up to every shorter
prefix; buckets too large even at that depth are taken on to a deeper directory.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import query, table, work_table

#: Bits of one word of the hash: the id, then the content, then the row as it was read.
WORD_BITS = 60
BITS = 3 * WORD_BITS

#: Bits a directory has beyond those that buckets of even size would need.
SPARE_BITS = 4

LIMIT = 32 << 20


def _bits(c: Column) -> Column:
    return F.lpad(F.conv(F.substring(F.md5(c), 1, WORD_BITS // 4), 16, 2), WORD_BITS, "0")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def prefix_of(depth: int) -> Column:
    """The first bits of a row's hash; words that ``depth`` does not reach are not hashed."""
    words = [_bits(_text("doc_id"))]
    if depth > WORD_BITS:
        words.append(_bits(F.concat_ws("|", _text("doc_id"), F.col("content"))))
    if depth > 2 * WORD_BITS:
        words.append(_bits(_text("row")))
    return F.substring(F.concat(*words), 1, depth)


def directory(rows: DataFrame, limit: int, base: int, depth: int) -> DataFrame:
    """``(entry, bits)``: how many of an entry's bits its bucket has, null if still too large.

    ``rows``: ``(entry, bytes)``, entries of ``depth`` bits whose buckets are known to be
    too large with fewer than ``base`` bits. A bucket of one row cannot get smaller.
    """
    sums = rows.groupBy("entry").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    sums = work_table(sums, "shard-sums")
    prefixes = sums.withColumn("bits", F.explode(F.sequence(F.lit(base), F.lit(depth)))).withColumn(
        "prefix", F.substr("entry", F.lit(1), F.col("bits"))
    )
    fits = (
        prefixes.groupBy("bits", "prefix")
        .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        .filter((F.col("bytes") <= limit) | (F.col("n") == 1) | (F.col("bits") == BITS))
        .select("bits", "prefix", F.lit(True).alias("fits"))
    )
    found = prefixes.select("entry", "bits", "prefix").join(fits, ["bits", "prefix"], "left")
    return found.groupBy("entry").agg(F.min(F.when(F.col("fits"), F.col("bits"))).alias("bits"))


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, row, bytes, shard, depth)`` per row of ``docs`` (``doc_id``, ``text``).

    ``bytes`` is the length of the text in UTF-8, zero for null. ``shard`` is the bucket's
    prefix as ``0`` and ``1``, empty for a corpus that fits one shard. A row larger than
    the limit is a shard by itself. Rows of one id part by their texts, equal rows by their
    number when read; null ids hash like empty ones. An empty table gives no rows.
    """
    rows = docs.select(
        "doc_id",
        F.md5(_text("text")).alias("content"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
    )
    return _assigned(work_table(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows"), limit)


def _assigned(rows: DataFrame, limit: int) -> DataFrame:
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    base, depth = 0, min(WORD_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS)
    done, open_ = [], rows
    while True:
        keyed = open_.withColumn("entry", prefix_of(depth))
        found = work_table(directory(keyed.select("entry", "bytes"), limit, base, depth), "shard-directory")
        met = keyed.join(found, "entry")
        done.append(
            met.filter("bits is not null").select(
                "doc_id", "row", "bytes", F.substr("entry", F.lit(1), F.col("bits")).alias("shard"), F.col("bits").alias("depth")
            )
        )
        if not found.filter("bits is null").limit(1).count():
            break
        open_ = work_table(met.filter("bits is null").select(*rows.columns), "shard-open")
        base, depth = depth + 1, min(BITS, depth + 2 * SPARE_BITS)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write ``docs`` to ``path``, a folder ``_shard=...`` per shard, each by one task."""
    kept = work_table(docs.withColumn("_row", F.monotonically_increasing_id()), "shard-texts")
    rows = kept.select(
        "doc_id",
        F.md5(_text("text")).alias("content"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        F.col("_row").alias("row"),
    )
    # A letter in front: folder names of digits would be read back as numbers.
    named = _assigned(work_table(rows, "shard-rows"), limit).select(
        F.col("row").alias("_row"), F.concat(F.lit("b"), "shard").alias("_shard")
    )
    kept.join(named, "_row").drop("_row").repartition("_shard").write.partitionBy("_shard").parquet(path)


def sql(limit: int = LIMIT, deepest: int = 24) -> str:
    return f"""
with hashed as (
  select doc_id, coalesce(strlen(text), 0)::bigint as bytes,
    to_base(cast(concat('0x', substr(md5(coalesce(doc_id::varchar, '')), 1, 15)) as bigint), 2, 60) as h
  from documents),
prefixes as (select *, substr(h, 1, d::int) as p from hashed, (select unnest(range({deepest + 1})) as d)),
sums as (select d, p, sum(bytes) as b, count(*) as n from prefixes group by d, p),
leaves as (
  select doc_id, bytes, h, min(d) as depth from prefixes join sums using (d, p)
  where b <= {limit} or n = 1 group by doc_id, bytes, h)
select doc_id, bytes, substr(h, 1, depth::int) as shard, depth::int as depth from leaves
"""


#: Small enough that a corpus of a few megabytes has several shards.
QUERY_LIMIT = 1 << 20


@query("op4_sharding", sql(QUERY_LIMIT))
def op4_sharding(spark, sf_dir):
    return assign(table(spark, sf_dir, "documents"), QUERY_LIMIT).select("doc_id", "bytes", "shard", "depth")
