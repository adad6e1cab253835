"""Phrase collocations from sorted count streams.

A phrase is frequent only if both phrases it is made of by leaving out an end are, so longer
ones are counted only where a filter of bounded size, made of the frequent shorter ones,
lets both through; it never stops a frequent one. Those frequent enough are a stream of ``(group, words, count)``
rows that is kept in two orders: by words from the first on (prefix order) and from the
last on (suffix order). In prefix order a phrase follows its own beginnings and precedes
its extensions to the right; in suffix order the same holds of its endings and its
extensions to the left. Walking a stream in lockstep with its own shorter phrases yields the
counts of all left parts, right parts and extensions without a hash table: a walk keeps
one row of each length.

Streams are partitioned by range over all words, so a beginning that most phrases share
is spread over many partitions. A partition that starts amid such a run does not hold the
run's own row: at most one run of each length is open at its start, so all that is missing
is as many rows as there are partitions, and those are joined in afterwards.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.llm.common import query, table, work_table

#: Words of a phrase.
SHORTEST, LONGEST = 2, 3

#: Words of a text taken apart at once, and words counted together before rows leave a task.
CHUNK_BYTES = 4 << 20
COUNTED_WORDS = 1 << 20
ROWS_OUT = 1 << 15

#: Most bits of the filter of frequent phrases. Beyond about a sixteenth as many phrases it
#: lets more of the others through, which costs counting and changes no result.
FILTER_BITS = 1 << 28

#: A byte that UTF-8 never holds stands between pieces.
GAP = b"\xff"
#: A-Z become a-z, what ends a piece a line feed, a tab a blank.
SPLIT = bytes(
    b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b for b in range(256)
)

WORDS = [f"w{i + 1}" for i in range(LONGEST)]
SCHEMA = ", ".join(["lang string", *[f"{w} string" for w in WORDS], "n long"])
COUNTS = pa.schema([("lang", pa.string()), *[(w, pa.string()) for w in WORDS], ("n", pa.int64())])


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text with ``GAP`` between pieces, in chunks of bounded size."""
    whole = text.translate(SPLIT)
    at = 0
    while at < len(whole):
        end = at + CHUNK_BYTES
        if end < len(whole):
            end = min((i for i in (whole.find(b" ", end), whole.find(b"\n", end)) if i >= 0), default=len(whole))
        # Blanks alone separate words here: line feeds have become gaps.
        yield [w for w in whole[at:end].replace(b"\n", b" " + GAP + b" ").split(b" ") if w]
        at = end


@dataclass(frozen=True)
class Filter:
    """Bits set by hashes of phrases: what was added is always found, little else is."""

    bits: np.ndarray

    @staticmethod
    def empty(size: int) -> Filter:
        return Filter(np.zeros(size // 64, dtype=np.uint64))

    def _places(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for shift in (0, 32):
            place = (hashes >> np.uint64(shift)) & np.uint64(64 * len(self.bits) - 1)
            yield (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63))

    def add(self, hashes: np.ndarray) -> None:
        for at, bit in self._places(hashes):
            np.bitwise_or.at(self.bits, at, bit)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(self.bits[at] & bit) != 0 for at, bit in self._places(hashes)])


def phrase_hash(words: list[np.ndarray], group: str) -> np.ndarray:
    """Hashes of phrases from the hashes of their words."""
    out = np.full(len(words[0]), xxhash.xxh64_intdigest(group), dtype=np.uint64)
    for word in words:
        out = (out ^ word) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def word_hash(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


class Counts:
    """Counts of the phrases of one group of texts, a bounded number of words at a time."""

    def __init__(self, lengths: tuple[int, ...], frequent: Filter | None = None) -> None:
        self.lengths, self.frequent = lengths, frequent
        self._begin([])

    def _begin(self, context: list[bytes]) -> None:
        self.number = defaultdict(count(1).__next__, {GAP: 0})
        self.blocks, self.context = [], len(context)
        self.add(context)

    def add(self, words: list[bytes]) -> None:
        self.blocks.append(np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words)))

    def _candidates(self, at: np.ndarray, length: int, group: str) -> np.ndarray:
        """Places where a phrase of the length begins that is not yet counted and may be frequent."""
        n = len(at) - length + 1
        whole = np.ones(max(n, 0), dtype=bool)
        whole[: max(0, self.context - length + 1)] = False
        for i in range(length):
            whole &= at[i : i + len(whole)] > 0
        begins = np.flatnonzero(whole)
        if self.frequent and len(begins):
            hashes = word_hash(list(self.number))
            for shift in (0, 1):
                part = [hashes[at[begins + shift + i]] for i in range(length - 1)]
                begins = begins[self.frequent.holds(phrase_hash(part, group))]
        return begins

    def take(self, group: str) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """For each length the distinct phrases, as numbers of their words, and their counts."""
        at = np.concatenate(self.blocks)
        total = len(self.number)
        for length in self.lengths:
            begins = self._candidates(at, length, group)
            # Ranks and word numbers are below the words counted together: no overflow.
            rank, words = at[begins], [np.arange(total)]
            for i in range(1, length):
                distinct, rank = np.unique(rank * total + at[begins + i], return_inverse=True)
                before, last = np.divmod(distinct, total)
                words = [*[w[before] for w in words], last]
            counts = np.bincount(rank, minlength=len(words[0]))
            met = counts > 0
            yield [w[met] for w in words], counts[met]

    def rows(self, group: str) -> Iterator[pa.RecordBatch]:
        """Count rows of the words added since the last call.

        The last words stay as context of what is added next; they are not counted again.
        """
        spelled = pa.array([b"", *list(self.number)[1:]], pa.binary()).cast(pa.string())
        n_words = 0
        for words, counts in self.take(group):
            if len(words) == 1:
                n_words = int(counts.sum())
            columns = [spelled.take(pa.array(w)) for w in words]
            columns += [pa.nulls(len(counts), pa.string())] * (LONGEST - len(words))
            lang = pa.repeat(pa.scalar(group, pa.string()), len(counts))
            made = pa.Table.from_arrays([lang, *columns, pa.array(counts, pa.int64())], schema=COUNTS)
            yield from made.to_batches(max_chunksize=ROWS_OUT)
        # The empty phrase stands for all words.
        if n_words:
            empty = {"lang": group, **dict.fromkeys(WORDS), "n": n_words}
            yield pa.RecordBatch.from_pylist([empty], schema=COUNTS)
        names = list(self.number)
        self._begin([names[i] for i in np.concatenate(self.blocks)[1 - LONGEST :]])


def counted(lengths: tuple[int, ...], frequent: Callable[[], Filter] | None = None):
    """Count rows of the phrases of the lengths, for batches of ``(lang, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent() if frequent else None
        groups: dict[str, Counts] = {}
        size = 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for group, text in zip(batch.column(0).to_pylist(), texts):
                if group not in groups:
                    groups[group] = Counts(lengths, known)
                for words in tokens(text.as_py()):
                    groups[group].add(words)
                    size += len(words)
                    if size >= COUNTED_WORDS:
                        for name, counts in groups.items():
                            yield from counts.rows(name)
                        size = 0
                groups[group].add([GAP])
        for name, counts in groups.items():
            yield from counts.rows(name)

    return run


def frequent_filter(stream: DataFrame, length: int):
    """A filter of the stream's phrases of one length, as a broadcast of bounded size."""
    words = WORDS[:length]
    is_length = F.col(words[-1]).isNotNull()
    if length < LONGEST:
        is_length &= F.col(WORDS[length]).isNull()
    rows = stream.filter(is_length).select("lang", *words)
    size = 1 << 16
    wanted = 16 * rows.count()
    while size < min(wanted, FILTER_BITS):
        size *= 2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Filter.empty(size)
        for batch in batches:
            hashes = [word_hash(batch.column(1 + i).cast(pa.binary()).to_pylist()) for i in range(length)]
            groups = batch.column(0).to_pylist()
            for group in set(groups):
                own = np.array([g == group for g in groups])
                made.add(phrase_hash([h[own] for h in hashes], group))
        at = np.flatnonzero(made.bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(made.bits[at].view(np.int64))], names=["at", "bits"])

    parts = rows.mapInArrow(fill, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    whole, made = parts.toArrow(), Filter.empty(size)
    made.bits[whole.column("at").to_numpy()] = whole.column("bits").to_numpy().view(np.uint64)
    shared = stream.sparkSession.sparkContext.broadcast(made.bits)
    return lambda: Filter(shared.value)


def phrase_counts(docs: DataFrame, least: int = 1) -> DataFrame:
    """``(lang, w1 … w3, n)``: phrases of one to three words with at least ``least`` places.

    Words beyond a phrase's length are null. The empty phrase, all words null, counts all
    words of its group, whatever ``least``. ``docs`` has ``lang`` and ``text``; null texts are
    empty, a null ``lang`` is ``und``. Groups without words have no rows.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    rows = docs.select(lang, "text").filter("text is not null")

    def summed(count_rows) -> DataFrame:
        # Counted per task already: dealt out before the sums, so that none is tried again.
        dealt = rows.mapInArrow(count_rows, SCHEMA).repartition("lang", *WORDS)
        sums = dealt.groupBy("lang", *WORDS).agg(F.sum("n").alias("n"))
        return work_table(sums.filter((F.col("n") >= least) | F.col(WORDS[0]).isNull()), "collocations-counts")

    whole = summed(counted((1, 2)))
    for length in range(3, LONGEST + 1):
        whole = whole.unionByName(summed(counted((length,), frequent_filter(whole, length - 1))))
    return whole


class Walk:
    """Walks batches of a sorted stream in lockstep with the stream's own shorter phrases.

    A batch holds ``lang``, the words in the stream's order and ``n``, then further columns.
    Each row gets, for each shorter length, the count of its beginning (null where that row
    is not in this partition), and the greatest count of its extensions by one word. Runs
    whose row is in an earlier partition leave rows without ``n`` for their extensions.
    """

    def __init__(self, schema: pa.Schema):
        self.added = [pa.field(f"head{j}", pa.int64()) for j in range(1, LONGEST)] + [pa.field("ext", pa.int64())]
        self.schema = pa.schema([*schema, *self.added])
        self.last: list[pa.Array] | None = None
        self.head = dict.fromkeys(range(1, LONGEST), -1)
        #: Length -> the row whose run is open, or its key where it was not here; extensions.
        self.open: dict[int, tuple[pa.RecordBatch, int]] = {}

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from self._step(batch)
        for length in list(self.open):
            yield from self._close(length)

    def _close(self, length: int) -> Iterator[pa.RecordBatch]:
        if length in self.open:
            row, ext = self.open.pop(length)
            most = pa.array([ext if ext >= 0 else None], pa.int64())
            yield pa.RecordBatch.from_arrays([*row.columns[:-1], most], schema=self.schema)

    def _step(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = batch.num_rows
        n = batch.column(LONGEST + 1).to_numpy(zero_copy_only=False)
        # No word holds a blank, so a blank can stand for null.
        keys = [batch.column(0), *[pc.fill_null(batch.column(1 + i), " ") for i in range(LONGEST)]]
        length = sum((~batch.column(1 + i).is_null().to_numpy(zero_copy_only=False)).astype(int) for i in range(LONGEST))
        differs = []
        for i, key in enumerate(keys[:LONGEST]):
            first = self.last[i] if self.last else key.slice(0, 1)
            before = pa.concat_arrays([first, key.slice(0, size - 1)])
            differs.append(pc.not_equal(key, before).to_numpy(zero_copy_only=False))
        if self.last is None:
            differs[0] = np.r_[True, differs[0][1:]]
        self.last = [key.slice(size - 1, 1) for key in keys[:LONGEST]]

        heads, ext, held = [], np.full(size, -1), np.zeros(size, dtype=bool)
        for j in range(1, LONGEST):
            change = np.logical_or.reduce(differs[: j + 1])
            starts = np.flatnonzero(change)
            own = np.where(length[starts] == j, n[starts], -1)
            known = np.r_[self.head[j], own][np.cumsum(change)]
            self.head[j] = known[-1]
            heads.append(pa.array(known, pa.int64(), mask=(length <= j) | (known < 0)))
            if j < SHORTEST:
                continue
            longer = np.where(length == j + 1, n, -1)
            bounds = np.r_[0, starts[starts > 0]]
            most = np.maximum.reduceat(longer, bounds)
            if not change[0] and most[0] >= 0:
                # The run goes on from the last batch, or from another partition.
                row, so_far = self.open.get(j, (self._orphan(batch, j), -1))
                self.open[j] = (row, max(so_far, int(most[0])))
            if len(starts):
                yield from self._close(j)
                rows = starts[length[starts] == j]
                ext[rows] = most[np.searchsorted(bounds, rows)]
                if length[starts[-1]] == j:
                    held[starts[-1]] = True
            # A run that begins with an extension lacks its row: it began in another partition.
            for at in starts[(length[starts] > j) & (most[np.searchsorted(bounds, starts)] >= 0)]:
                self.open[j] = (self._orphan(batch.slice(at, 1), j), int(most[np.searchsorted(bounds, at)]))
                if at != starts[-1]:
                    yield from self._close(j)
        out = pa.RecordBatch.from_arrays(
            [*batch.columns, *heads, pa.array(ext, pa.int64(), mask=ext < 0)], schema=self.schema
        )
        for at in np.flatnonzero(held):
            self.open[int(length[at])] = (out.slice(at, 1), int(ext[at]))
        yield out.filter(pa.array(~held))

    def _orphan(self, batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
        """A row of only a key: the first ``length`` words of the batch's first row."""
        key = [batch.column(i).slice(0, 1) for i in range(length + 1)]
        rest = [pa.nulls(1, f.type) for f in list(self.schema)[length + 1 :]]
        return pa.RecordBatch.from_arrays([*key, *rest], schema=self.schema)


def turned(stream: DataFrame) -> DataFrame:
    """The words of every phrase in opposite order."""
    back = F.reverse(F.array_compact(F.array(*WORDS)))
    return stream.withColumns({w: F.get(back, F.lit(i)) for i, w in enumerate(WORDS)})


def walked(stream: DataFrame, name: str) -> DataFrame:
    """``stream`` with the counts of its phrases' beginnings, ``{name}1``, ``{name}2`` …

    ``{name}_ext`` is the greatest count of a phrase that has one more word at its end.
    """
    key = ["lang", *WORDS]
    others = [c for c in stream.columns if c not in (*key, "n")]
    rows = stream.select(*key, "n", *others).repartitionByRange(*key).sortWithinPartitions(*key)
    schema = pa.schema([*COUNTS, *[(c, pa.int64()) for c in others]])
    heads = [f"head{j}" for j in range(1, LONGEST)]
    kinds = ", ".join([SCHEMA, *[f"{c} long" for c in (*others, *heads, "ext")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return Walk(schema)(pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in batches)

    out = work_table(rows.mapInArrow(run, kinds), f"collocations-{name}")
    made = out.filter("n is not null")
    for j, head in enumerate(heads, 1):
        # At most one run of a length is open where a partition starts: as many keys as partitions.
        start, after = key[: j + 1], F.col(key[j + 1])
        missing = made.filter(after.isNotNull() & F.col(head).isNull()).select(*start).distinct()
        whole = out.filter(F.col("n").isNotNull() & F.col(key[j]).isNotNull() & after.isNull())
        found = whole.join(F.broadcast(missing), start, "left_semi").select(*start, F.col("n").alias("_n"))
        made = made.join(F.broadcast(found), start, "left")
        made = made.withColumn(head, F.when(after.isNotNull(), F.coalesce(head, "_n"))).drop("_n")
    for j in range(SHORTEST, LONGEST):
        start, own = key[: j + 1], F.col(key[j]).isNotNull() & F.col(key[j + 1]).isNull()
        late = out.filter(F.col("n").isNull() & own).groupBy(*start).agg(F.max("ext").alias("_ext"))
        made = made.join(F.broadcast(late), start, "left")
        made = made.withColumn("ext", F.when(own, F.greatest("ext", "_ext")).otherwise(F.col("ext"))).drop("_ext")
    named = [F.col(h).alias(f"{name}{j}") for j, h in enumerate(heads, 1)]
    return made.select(*key, "n", *others, *named, F.col("ext").alias(f"{name}_ext"))


def phrases(docs: DataFrame, least: int = 10, swallowed: int = 50, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each language by how much oftener their words meet than by chance.

    ``(lang, rank, phrase, a, l, r, n, score)``: a phrase of two or three words with
    ``a >= least`` places is cut in two parts with ``l`` and ``r`` places; ``score`` is
    ``1000000 a² / (l r)``, rounded down, of the cut where it is lowest, the first of equal
    ones. ``n`` is the number of words of the language. Phrases that stand within a longer
    candidate with at least ``swallowed`` percent of their places are left out.

    A null ``lang`` is ``und``, null texts are empty. Ids are not looked at: repeated rows
    count as often as they are there, other columns do nothing, and a table without phrases
    gives no rows.
    """
    stream = phrase_counts(docs, least)
    worded = F.col(WORDS[0]).isNotNull()
    totals = stream.filter(~worded).select("lang", F.col("n").alias("words"))
    both = turned(walked(turned(walked(stream.filter(worded), "left")), "right"))

    def cut(length: int, k: int) -> Column:
        l, r = f"left{k}", f"right{length - k}"
        exact = "cast(n as decimal(19,0))"
        score = F.expr(f"({exact} * {exact} * 1000000BD) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))")
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))

    least_cut = F.lit(None)
    for length in range(SHORTEST, LONGEST + 1):
        cuts = F.array_min(F.array(*[cut(length, k) for k in range(1, length)]))
        least_cut = F.when(F.col(WORDS[length - 1]).isNotNull(), cuts).otherwise(least_cut)
    inside = F.coalesce(F.greatest("left_ext", "right_ext"), F.lit(0)) * 100 >= F.col("n") * swallowed
    found = both.filter(F.col(WORDS[SHORTEST - 1]).isNotNull() & ~inside).select(
        "lang", F.concat_ws(" ", *WORDS).alias("phrase"), F.col("n").alias("a"), least_cut.alias("cut")
    )
    found = work_table(found.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "collocations-found")
    return first_of_each(found, top).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score"
    )


def first_of_each(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their ``rank``, in two rounds.

    The first round ranks parts of a language; parts and survivors grow alike with its rows.
    """
    n = found.count()
    parts = max(1, int((n / top) ** 0.5))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    local = Window.partitionBy("lang", part).orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    kept = found.withColumn("rank", F.row_number().over(local)).filter(F.col("rank") <= top)
    return kept.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= top)


SQL_TWIN = r"""with taken as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^ 	]+') as w from taken),
places as (select lang, w, unnest(range(1, len(w) + 1)) as i from words),
totals as (select lang, count(*) as n from places group by lang),
counted as (
  select lang, w, count(*) as f from (
    select lang, w[i : i] as w from places
    union all select lang, w[i : i + 1] from places where i + 1 <= len(w)
    union all select lang, w[i : i + 2] from places where i + 2 <= len(w)) group by lang, w),
frequent as materialized (select * from counted where f >= 10),
candidates as (select lang, w, f as a from frequent where len(w) >= 2),
parts as (
  select lang, w, a, k, w[1 : k] as left_part, w[k + 1 : len(w)] as right_part
  from (select *, unnest(range(1, len(w))) as k from candidates)),
cuts as (
  select c.lang, c.w, c.a, c.k, x.f as l, y.f as r, cast((1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f) as bigint) as score
  from parts c join frequent x on x.lang = c.lang and x.w = c.left_part
  join frequent y on y.lang = c.lang and y.w = c.right_part),
cut as (select * from cuts qualify row_number() over (partition by lang, w order by score, k) = 1),
longer as (
  select lang, w[1 : 2] as w, a from candidates where len(w) = 3
  union all select lang, w[2 : 3], a from candidates where len(w) = 3),
largest as (select lang, w, max(a) as most from longer group by lang, w),
kept as (select cut.* from cut left join largest o on o.lang = cut.lang and o.w = cut.w
  where o.most is null or 100 * o.most < 50 * cut.a),
ranked as (select *, array_to_string(w, ' ') as phrase from kept)
select lang, rank, phrase, a, l, r, n, score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from ranked)
join totals using (lang) where rank <= 2000"""


@query("op13_collocations", SQL_TWIN)
def op13_collocations(spark, sf_dir):
    return phrases(table(spark, sf_dir, "documents"))
