"""Toxicity of whole texts: boosted trees over dense features, isotonically calibrated.

Words and word beginnings that mark toxic texts are learned from one part of the labelled
rows, the trees from a second, the calibration from a third; a fifth of all rows is never
learned from. Features are densities of learned and of fixed words, how many of them stand
near a second person, capitals, punctuation, and words that hide letters behind digits or
signs. Ids, languages and sources are not features.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.llm.boosting import fit
from opinio.llm.common import query, table, work_table
from opinio.llm.simhash import classes, fingerprint

#: Labelled rows learned from, at most about so many; they are chosen by a hash of their id.
LABELLED = 40_000

#: Words and beginnings kept, and what they must show: texts, and odds against other texts.
UNITS = 2_000
LEAST_TEXTS = 5
LEAST_ODDS = 8.0
BEGINNINGS = (4, 5, 6)

# Insults and second persons, in alphabetical order.
INSULTS = tuple(
    """
    abruti arschloch asshole bastard bitch bloody cabron clown connard crap cretin damn
    depp disgusting dumb dummkopf estupido fool freak fuck gilipollas idiot idiota idiote
    imbecil imbecile jerk loser merde mierda moron pathetic pendejo puta putain
    salaud scheisse schlampe scum shit stupid sucker trash trottel tonto ugly useless
    vermin worthless wichser
    """.split()
)
SECOND_PERSONS = tuple(
    """
    dein deine dich dir du euch euer ihr ta te tes ti toi ton tu tus tuyo u ustedes usted vos
    votre vous vuestro you your yours yourself
    """.split()
)

#: Signs that stand for letters in hidden words.
HIDDEN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})
MIXED = re.compile(r"[A-Za-z]+[0-9@$*_!]+[A-Za-z][A-Za-z0-9@$*_!]*")
ALL_CAPITALS = re.compile(r"\b[A-Z]{3,}\b")

#: Characters between a hit and a second person that count as near.
NEAR = 40

N_FEATURES = 17
FIXED, LEARNED, BEGINNING, SECOND = range(4)


@lru_cache(maxsize=2)
def automaton(units: tuple[tuple[str, float], ...]) -> ahocorasick.Automaton:
    """All words to look for; one automaton per worker."""
    found: dict[str, list] = {}
    for kind, words in ((FIXED, INSULTS), (SECOND, SECOND_PERSONS)):
        for word in words:
            found.setdefault(word, []).append((kind, 1.0))
    for unit, weight in units:
        kind = BEGINNING if unit[0] == "p" else LEARNED
        found.setdefault(unit[2:], []).append((kind, weight))
    out = ahocorasick.Automaton()
    for word, kinds in found.items():
        out.add_word(word, (len(word), kinds))
    out.make_automaton()
    return out


def features_of(text: str | None, look: ahocorasick.Automaton) -> list[float]:
    """The features of one text; an empty one has zeros."""
    text = text or ""
    words = len(text.split())
    if not words:
        return [0.0] * N_FEATURES
    low = text.lower()
    fixed, learned, second = [], {}, []
    end_of_text = len(low)
    for end, (length, kinds) in look.iter(low):
        start = end - length + 1
        if start and low[start - 1].isalnum():
            continue
        whole = end + 1 == end_of_text or not low[end + 1].isalnum()
        for kind, weight in kinds:
            if kind == BEGINNING or (kind == LEARNED and whole):
                learned[start] = max(learned.get(start, 0.0), weight)
            elif whole:
                (fixed if kind == FIXED else second).append(start)
    hits = np.array(sorted({*fixed, *learned}), dtype=np.int64)
    near = 0
    if len(hits) and second:
        persons = np.array(second, dtype=np.int64)
        at = np.searchsorted(persons, hits)
        before = np.abs(hits - persons[np.maximum(at - 1, 0)])
        after = np.abs(persons[np.minimum(at, len(persons) - 1)] - hits)
        near = int((np.minimum(before, after) <= NEAR).sum())
    octets = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    size = float(octets.sum())
    mixed = MIXED.findall(text)
    opened = sum(1 for w in mixed if w.lower().translate(HIDDEN) in look)
    weights = list(learned.values())
    named = len({low[s : s + 5] for s in learned})
    return [
        math.log1p(words),
        len(weights) / words,
        math.log1p(len(weights)),
        math.log1p(named),
        sum(weights) / words,
        max(weights, default=0.0),
        len(fixed) / words,
        math.log1p(len(fixed)),
        near / len(hits) if len(hits) else 0.0,
        float(octets[65:91].sum()) / size,
        len(ALL_CAPITALS.findall(text)) / words,
        float(octets[33]) / words,
        float(octets[63]) / words,
        float(octets[34:48].sum() + octets[58:63].sum()) / size,
        float(octets[48:58].sum()) / size,
        len(mixed) / words,
        math.log1p(opened),
    ]


def features(text: Column | str, units: tuple[tuple[str, float], ...]) -> Column:
    """Feature array of a text, given the learned ``(unit, weight)`` pairs."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        look = automaton(units)
        return pd.Series([features_of(t, look) for t in texts])

    return run(text)


def fold(doc_id: Column) -> Column:
    """Fifth of the rows a row belongs to; rows of fifth 0 are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def labelled(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """About ``most`` rows ``(doc_id, label, fold)`` to learn from, chosen by hash of the id.

    Null ids and labels are left out; an id with several labels is toxic if one says so.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("label")
    )
    known = known.withColumn("fold", fold(F.col("doc_id"))).filter("fold <> 0")
    n = known.count()
    share = min(1.0, most / n) if n else 1.0
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    return known.filter(chosen)


def _beginnings(words: Column, k: int) -> Column:
    longer = F.filter(words, lambda w: F.length(w) > k)
    return F.transform(longer, lambda w: F.concat(F.lit("p:"), F.substring(w, 1, k)))


def distinct_texts(texts: DataFrame) -> DataFrame:
    """``(text, label)``, of each group of near-copies with a label one text."""
    printed = texts.select("text", "label", fingerprint("text").alias("fp"), F.xxhash64("text").alias("_hash"))
    printed = work_table(printed.withColumn("_row", F.monotonically_increasing_id()), "toxic-prints")
    narrow = printed.drop("text")
    kept = []
    for label in (0, 1):
        own = narrow.filter(F.col("label") == label)
        # Classes name a group by its smallest fingerprint: texts with that one stand for it.
        named = classes(own.select(F.col("_hash").alias("doc_id"), "fp")).filter("fp = root").select("fp")
        kept.append(own.join(named, "fp").groupBy("fp").agg(F.min_by("_row", "_hash").alias("_row")).select("_row"))
    # Chosen by number, so that no text is moved for a group but its own.
    whole = printed.join(kept[0].unionByName(kept[1]), "_row", "left_semi")
    return work_table(whole.select("text", "label"), "toxic-distinct")


def telling_units(texts: DataFrame) -> tuple[tuple[str, float], ...]:
    """Words and beginnings by how much likelier toxic texts hold them, with log odds.

    ``texts``: ``(text, label)``. Near-copies of one label count once, so that the words of
    a text copied often do not look toxic or harmless for that; of a group, the text of the
    smallest fingerprint and hash counts. What texts share, such as a beginning, does not
    make them copies.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))
    once = distinct_texts(texts)
    units = F.array_distinct(
        F.concat(
            F.transform(words, lambda w: F.concat(F.lit("w:"), w)),
            *[_beginnings(words, k) for k in BEGINNINGS],
        )
    )
    sizes = {r["label"]: r["count"] for r in once.groupBy("label").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return ()
    counts = once.select("label", F.explode(units).alias("unit")).groupBy("unit").agg(
        F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("o")
    )
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("o") + 0.5) / (other + 1.0))
    best = (
        counts.filter(F.col("t") >= LEAST_TEXTS)
        .withColumn("odds", odds)
        .filter(F.col("odds") >= math.log(LEAST_ODDS))
        .orderBy(F.desc("t"), F.desc("odds"), "unit")
        .limit(UNITS)
    )
    return tuple((r["unit"], round(r["odds"], 4)) for r in best.collect())


def scores(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    ``labels``: ``(doc_id, toxic)``. Null and empty texts have all features zero and get
    the score the trees give that. Repeated rows are scored alike; a null id counts as held
    out. Without labels of both classes every score is the share of toxic ones, zero where
    there are none. An empty table gives no rows. Columns of ``docs`` other than ``text``
    are passed through, whatever their names, but those three are replaced.
    """
    docs = docs.drop("held_out", "score", "predicted")
    known = work_table(labelled(labels, most), "toxic-labels")
    # Its size is bounded by ``most``.
    joined = docs.select("doc_id", F.col("text").alias("text")).join(F.broadcast(known), "doc_id")
    lexicon = joined.filter("fold in (1, 2) and text is not null").select("text", "label")
    units = telling_units(work_table(lexicon, "toxic-texts"))
    rest = joined.filter("fold in (3, 4)").select(
        features("text", units).alias("features"), "label", (F.col("fold") == 4).alias("calibrate")
    )
    model = fit(work_table(rest, "toxic-features"))
    # In a struct, no column of theirs meets one that scoring adds.
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), features("text", units).alias("features"))
    return model.score(whole).select(
        "_doc.*",
        (fold(F.col("_doc.doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scores(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")
