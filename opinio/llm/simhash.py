"""Near-duplicates by SimHash: pigeonhole blocks, then verified Hamming distance.

A fingerprint is cut into ``blocks`` parts. Two that differ in at most ``bits`` bits agree
in at least ``blocks - bits`` whole parts, so they share the key of at least one choice of
that many parts: joining on all those keys loses no pair. Keys that only one fingerprint
has fall away by a count; the others are verified key by key. Equal fingerprints are one
fingerprint throughout, so copies cost nothing. A key that very many fingerprints share is
dealt out in pairs of bounded parts, and a key never gives more links than join what it
holds: a spanning forest of the verified pairs, from which the components follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import query, table, work_table
from opinio.llm.components import components

#: Fingerprints of one key verified together; a key with more is dealt out in parts.
PART = 4096

#: Keys with at most so many fingerprints are verified side by side.
SMALL = 32

SEED = 42
HASHED_TOGETHER = 1 << 16
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hash of every shingle of one text, repeats included; none where it has no words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return np.empty(0, dtype="<u8")
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[min(words, len(found)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends)), dtype="<u8", count=len(ends))


def fingerprint_of(text: str | None, words: int = 4) -> int:
    """The fingerprint of one text, as an unsigned number; zero where it has no words."""
    hashes = shingle_hashes(text, words)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), HASHED_TOGETHER):
        octets = hashes[i : i + HASHED_TOGETHER].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    majority = counts * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprint(text: Column | str, words: int = 4) -> Column:
    """Fingerprint of a text over its shingles of ``words`` words, as a signed long.

    A-Z count as a-z. A text with fewer words is one shingle; a null or wordless text has
    fingerprint zero.
    """

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint_of(t, words) for t in texts], dtype=np.uint64)
        return pd.Series(values.view(np.int64))

    return prints(text)


def block_masks(bits: int, blocks: int) -> list[int]:
    """Masks, as signed longs, of every choice of parts that close fingerprints may share."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(choice) for choice in combinations(parts, blocks - bits)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def block_count(n: int, bits: int) -> int:
    """Parts to cut fingerprints into, so that a key holds few unrelated ones.

    More fingerprints need longer keys, hence more parts. The pairs found are the same.
    """
    blocks = bits + 2
    while (1 << (64 * (blocks - bits) // blocks)) * 256 < n and blocks < 2 * bits + 2:
        blocks += 1
    return blocks


def _near(prints: np.ndarray, others: np.ndarray | np.int64, bits: int) -> np.ndarray:
    # Counting bits of a signed number would count those of its absolute value.
    return np.bitwise_count((prints ^ others).view(np.uint64)) <= bits


def _forest(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join all of ``prints`` that close pairs join, at most one per print."""
    links, open_ = [], prints
    while len(open_) > 1:
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            at = queue.pop()
            near = _near(open_, at, bits)
            if near.any():
                found = open_[near]
                links.extend((int(at), int(x)) for x in found)
                queue.extend(found)
                open_ = open_[~near]
    return links


def _verified(keys: np.ndarray, prints: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Links among prints with equal keys; keys come in runs."""
    left, right = [], []
    bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(bounds)
    small = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, SMALL):
        at = np.flatnonzero((keys[step:] == keys[:-step]) & small[:-step])
        if not len(at):
            break
        at = at[_near(prints[at], prints[at + step], bits)]
        left.extend(prints[at].tolist())
        right.extend(prints[at + step].tolist())
    for k in np.flatnonzero(sizes > SMALL):
        for a, b in _forest(np.unique(prints[bounds[k] : bounds[k + 1]]), bits):
            left.append(a)
            right.append(b)
    return left, right


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.empty(0, np.int64), np.empty(0, np.int64)

        def links(upto: int) -> pa.RecordBatch:
            found = _verified(keys[:upto], prints[:upto], bits)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], schema=LINKS)

        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy()]
            prints = np.r_[prints, batch.column(1).to_numpy()]
            # The last key may go on in the next batch.
            whole = int(np.searchsorted(keys == keys[-1], True)) if len(keys) else 0
            if whole:
                yield links(whole)
                keys, prints = keys[whole:], prints[whole:]
        if len(keys):
            yield links(len(keys))

    return run


def linked(prints: DataFrame, bits: int = 4) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints at most ``bits`` bits apart.

    ``prints`` has one column, ``fp``, each value once. Not every close pair is a row, but
    any two close fingerprints are joined by a path of rows, and every row is a close pair.
    """
    masks = block_masks(bits, block_count(prints.count(), bits))
    choices = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    keyed = prints.select("fp", F.explode(choices).alias("key"))
    dealt = _dealt(keyed, "fp")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(bits), "a long, b long")


def classes(prints: DataFrame, bits: int = 4) -> DataFrame:
    """``(fp, root, component_id)`` for a frame ``(doc_id, fp)``.

    ``root`` is the component's smallest fingerprint, ``component_id`` its smallest doc_id.
    """
    ids = work_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = work_table(components(linked(ids.select("fp"), bits)), "simhash-roots")
    named = ids.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, bits: int = 4, words: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs`` (``doc_id``, ``text``).

    Rows are linked where their fingerprints differ in at most ``bits`` bits;
    ``component_id`` is the smallest doc_id reachable, the row's own included. Null and
    wordless texts have fingerprint zero and link like any other. Null ids never count as
    smallest: a component of null ids only has a null ``component_id``. Repeated rows stay
    repeated; an empty table gives no rows.
    """
    prints = work_table(docs.select("doc_id", fingerprint("text", words).alias("fp")), "simhash-prints")
    return prints.join(classes(prints, bits), "fp").select("doc_id", "fp", "component_id")


def _text_key() -> Column:
    return F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))


def _one_of_each(docs: DataFrame, narrow: DataFrame, named: DataFrame, by: str) -> DataFrame:
    """``docs`` rows that stay: one of each ``root``, from ``narrow`` rows ``(doc_id, by, key)``."""
    rows = narrow.select("doc_id", by, "key").join(named, by).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = work_table(rows.groupBy("root").agg(F.min("key").alias("key")), "simhash-kept").select("key")
    repeated = narrow.join(kept, "key", "left_semi").count() > kept.count()
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), _text_key().alias("key")).join(kept, "key", "left_semi")
    return (whole.dropDuplicates(["key"]) if repeated else whole).select("_doc.*")


def one_of_each(docs: DataFrame, bits: int = 4, words: int = 4) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row of the smallest doc_id.

    Null ids come last; of several texts with that id, the one of smallest hash stays, and
    any of equal rows. All of that is settled on fingerprints and hashes; texts are moved
    once, to be met with the hashes of those that stay.
    """
    narrow = docs.select("doc_id", fingerprint("text", words).alias("fp"), _text_key().alias("key"))
    narrow = work_table(narrow, "simhash-keys")
    return _one_of_each(docs, narrow, classes(narrow.select("doc_id", "fp"), bits), "fp")


# --- near copies by the share of common shingles -----------------------------------
#
# Texts that share four fifths of their shingles differ in ten of a fingerprint's 64 bits
# on average: blocks of bits short enough to be shared would be shared by all. The same
# scheme over a wider fingerprint does find them: a fingerprint of PARTS minima of shingle
# hashes, cut into blocks; join on blocks, verify the number of equal minima, then the texts.

#: Minima in a wide fingerprint, how many make a block, and how many must agree.
PARTS, IN_BLOCK, ALIKE = 50, 5, 34


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each of ``PARTS`` ranges of the sorted distinct ``hashes``.

    A range without hashes takes the next one's, changed by how far that is.
    """
    if not len(hashes):
        return np.zeros(PARTS, dtype=np.uint32)
    part = ((hashes >> np.uint64(32)) * np.uint64(PARTS)) >> np.uint64(32)
    first = np.searchsorted(part, np.arange(PARTS, dtype=np.uint64))
    held = np.zeros(PARTS, dtype=bool)
    held[part.astype(np.int64)] = True
    least = (hashes[np.minimum(first, len(hashes) - 1)] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    filled = np.flatnonzero(held)
    places = np.arange(PARTS)
    source = filled[np.searchsorted(filled, places) % len(filled)]
    return least[source] + ((source - places) % PARTS).astype(np.uint32) * np.uint32(0x9E3779B1)


def signatures(text: Column | str, words: int) -> Column:
    """``(digest, minima, blocks)`` of a text: equal for equal sets of shingles."""

    @F.pandas_udf("digest long, minima binary, blocks array<long>")
    def sign(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            hashes = np.unique(shingle_hashes(text, words))
            wide = wide_fingerprint(hashes)
            digest = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
            blocks = [
                xxhash.xxh64_intdigest(wide[i : i + IN_BLOCK].tobytes(), SEED + i) for i in range(0, PARTS, IN_BLOCK)
            ]
            out.append((np.uint64(digest).view(np.int64), wide.tobytes(), np.array(blocks, dtype=np.uint64).view(np.int64)))
        return pd.DataFrame(out, columns=["digest", "minima", "blocks"])

    return sign(text)


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each block's members to the first member they are alike with."""

    def links(key: int, members: dict[int, bytes]) -> pa.RecordBatch:
        # Another order for every block: what one leader hides another shows.
        ids = np.array(sorted(members, key=lambda d: xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), key & 0xFFFFFFFF)))
        wide = np.frombuffer(b"".join(members[int(i)] for i in ids), dtype=np.uint32).reshape(-1, PARTS)
        a, b = [], []
        while len(ids) > 1:
            alike = (wide[1:] == wide[0]).sum(axis=1) >= ALIKE
            a.append(np.full(int(alike.sum()), ids[0]))
            b.append(ids[1:][alike])
            ids, wide = ids[1:][~alike], wide[1:][~alike]
        left, right = (np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], schema=LINKS)

    key, members = None, {}
    for batch in batches:
        for k, digest, minima in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                if len(members) > 1:
                    yield links(key, members)
                key, members = k, {}
            members[digest] = minima
    if len(members) > 1:
        yield links(key, members)


def _dealt(keyed: DataFrame, node: str) -> DataFrame:
    """``(key, node)`` of the keys that several share; one held by many in pairs of parts."""
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = keyed.join(shared, "key")
    n_parts = F.ceil(F.col("n") / PART)
    part = F.pmod(F.xxhash64(node, F.lit("part")), n_parts)
    with_part = F.transform(
        F.sequence(F.lit(0).cast("long"), n_parts - 1),
        lambda other: F.xxhash64("key", F.least(part, other), F.greatest(part, other)),
    )
    return met.select(F.explode(F.when(F.col("n") <= PART, F.array("key")).otherwise(with_part)).alias("key"), node)


def _similar(words: int, similarity: float):
    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(c.as_py(), dtype="<u8") for c in (a, b))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], schema=LINKS).filter(pa.array(keep, pa.bool_()))

    return share


def _print_links(narrow: DataFrame, bits: int) -> DataFrame:
    """Links among the ``digest`` of rows whose fingerprints ``fp`` close pairs join.

    A star of each component of fingerprints, from its smallest digest to the others.
    """
    held = work_table(narrow.select("digest", "fp").distinct(), "near-prints")
    roots = components(linked(held.select("fp").distinct(), bits)).withColumnRenamed("node", "fp")
    named = held.join(work_table(roots, "near-print-roots"), "fp", "left").select("digest", F.coalesce("root", "fp").alias("root"))
    middle = named.groupBy("root").agg(F.min("digest").alias("a"))
    return named.join(middle, "root").filter("a <> digest").select("a", F.col("digest").alias("b")).distinct()


def one_of_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int | None = None) -> DataFrame:
    """``docs`` without near copies: of each group the row of the smallest doc_id.

    Two texts are linked where they share at least ``similarity`` of their distinct shingles of
    ``words`` words; a text with fewer words is one shingle, and null and wordless texts
    are all alike. Candidates agree in a block of their wide fingerprints and in ``ALIKE`` of
    its parts, which misses few of the links and lets most others go; what is linked has been
    verified on the whole sets of shingles. With ``bits``, texts are also linked where their
    fingerprints (:func:`fingerprint`) differ in at most so many; groups follow from both kinds
    of links together. Ids, repeated rows and empty tables are as in
    :func:`one_of_each`; columns may have any names.
    """
    prints = [] if bits is None else [fingerprint("text").alias("fp")]
    sign = docs.select("doc_id", _text_key().alias("key"), signatures("text", words).alias("s"), *prints)
    sign = sign.select("doc_id", "key", "s.digest", "s.minima", "s.blocks", *["fp" for _ in prints])
    narrow = work_table(sign, "near-signs")
    nodes = narrow.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"))
    nodes = work_table(nodes, "near-nodes")
    lead = nodes.select("key").join(narrow.select("key", "digest", "minima", "blocks"), "key").dropDuplicates(["digest"])
    lead = work_table(lead.drop("key"), "near-lead")
    dealt = _dealt(lead.select("digest", F.explode("blocks").alias("key")), "digest")
    sided = dealt.join(lead.select("digest", "minima"), "digest").select("key", "digest", "minima")
    pairs = sided.repartition("key").sortWithinPartitions("key").mapInArrow(_leaders, "a long, b long").distinct()
    pairs = work_table(pairs, "near-pairs")

    # The whole sets of shingles, of one text of each set that is in a pair.
    asked = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct()
    wanted = nodes.join(asked, "digest", "left_semi").select("key", "digest")

    @F.pandas_udf("binary")
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, words)).tobytes() for t in texts])

    texts = docs.select(_text_key().alias("key"), "text").join(wanted, "key").dropDuplicates(["key"])
    sets = work_table(texts.select("digest", whole("text").alias("shingles")), "near-sets")
    of = lambda c: sets.select(F.col("digest").alias(c), F.col("shingles").alias(f"of_{c}"))
    # The members first, so that a leader of many is met with rows that can be split.
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "of_a", "of_b")
    links = both.mapInArrow(_similar(words, similarity), "a long, b long")
    if bits is not None:
        links = links.unionByName(_print_links(narrow, bits))
    roots = work_table(components(links), "near-roots").withColumnRenamed("node", "digest")
    named = nodes.select("digest", "least").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return _one_of_each(docs, narrow, named.drop("least").join(least, "root"), "digest")


@query("op5_simhash")
def op5_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
