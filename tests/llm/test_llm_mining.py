"""Hard negatives, licence scans and collocations against brute force, and on odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opinio.llm import collocations, licenses, negatives
from opinio.llm.common import prepare

# --- hard negatives ----------------------------------------------------------------


def brute_negatives(rows, window=negatives.Window_()):
    """Rows are (id, label, vector); anchors have ids divisible by 10."""
    last = lambda i: (i is None, i or 0)
    used = [r for r in rows if r[1] is not None and r[2] is not None]
    out = []
    for a in used:
        if a[0] is None or a[0] % 10:
            continue
        met = [(r, sum(x * y for x, y in zip(a[2], r[2]))) for r in used if r is not a and len(r[2]) == len(a[2])]
        met.sort(key=lambda m: (-m[1], last(m[0][0])))
        for p, top in [m for m in met if m[0][1] == a[1]][: window.positives]:
            found = [m for m in met if m[0][1] != a[1] and window.low * top <= 100 * m[1] <= window.high * top]
            out += [(a[0], p[0], i + 1, n[0], top, s) for i, (n, s) in enumerate(found[: window.negatives])]
    return sorted(out, key=repr)


def mined(spark, rows, window=negatives.Window_()):
    # Rows of a test are told apart by place, also where they are equal.
    df = spark.createDataFrame(rows, "id long, label int, vector array<long>")
    found = negatives.hard_negatives(df, F.col("id") % 10 == 0, window).collect()
    return sorted((tuple(r) for r in found), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_negatives_equal_brute_force(spark, monkeypatch, seed):
    prepare(spark)
    # Many cells, ties, a label with most rows, repeated and null ids, two lengths.
    monkeypatch.setattr(negatives, "ROW_BYTES", 400)
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 100)
    rnd = random.Random(seed)
    rows = []
    for i in range(150):
        vector = [rnd.randint(0, 4) for _ in range(rnd.choice([3, 3, 3, 2]))]
        rows.append((rnd.choice([i, i, i, i // 2, None]), rnd.choice([1, 1, 1, 2, 3, None]), vector))
    rows += [(200, 1, None), (210, 1, []), (220, None, [1, 2, 3]), (230, 9, [1, 2, 3]), (240, 1, [-5, -5, -5]), (250, 1, [0, 0, 0])]
    assert mined(spark, rows) == brute_negatives(rows)
    wide = negatives.Window_(positives=9, negatives=4, low=-50, high=200)
    assert mined(spark, rows, wide) == brute_negatives(rows, wide)


def test_negatives_without_rows_or_anchors(spark):
    prepare(spark)
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1]), (2, 2, [1])]) == []


def test_products_are_exact():
    x = np.array([[1 << 30, 1], [-(1 << 30), 3]], dtype=np.int64)
    assert negatives._products(x, x).tolist() == [[(1 << 60) + 1, -(1 << 60) + 3], [-(1 << 60) + 3, (1 << 60) + 9]]
    with pytest.raises(OverflowError):
        negatives._products(x * (1 << 10), x)


def test_whole_numbers(spark):
    df = spark.createDataFrame(
        [([0.5, -0.001],), ([1.0, None],), ([float("nan")],), ([float("inf")],), ([],), (None,)], "v array<float>"
    )
    got = [r[0] for r in df.select(negatives.whole_numbers("v", 256)).collect()]
    assert got == [[128, -1], None, None, None, [], None]


# --- licences ----------------------------------------------------------------------

SMALL = {
    "plain": "a b c",
    "left out": "a <<optional>>b <<optional>>c<</optional>><</optional>> d",
    "choice": 'b <<var;match="(a|c c|)">> d',
    "any": 'a <<var;match=".{1,3}">> b <<var;match=".{0,2}">> c',
    "first": '<<optional>>d<</optional>> c a',
}


def regex_ends(line: str, pattern: str) -> set[int]:
    """Words after which some match of the pattern ends."""
    starts = [m.start() for m in re.finditer(" ", line)]
    whole = re.compile(pattern)
    return {
        line[:end + 1].count(" ") - 1
        for begin in starts
        for end in starts
        if end > begin and whole.fullmatch(line, begin + 1, end + 1)
    }


def ends_of(made: licenses.Automaton, words: list[bytes]) -> set[int]:
    """All ends the automaton accepts, each found in the text cut off there."""
    out = set()
    for end in range(1, len(words) + 1):
        if end in made.matches(words[:end], list(range(end))).values():
            out.add(end)
    return out


@pytest.mark.parametrize("label", SMALL)
def test_automata_equal_regular_expressions(label):
    made = licenses.compile_template(SMALL[label])
    pattern = licenses.pattern_of(SMALL[label])
    rnd = random.Random(label)
    for _ in range(120):
        words = [rnd.choice("aabccd") for _ in range(rnd.randint(0, 12))]
        line = "".join(f" {w}" for w in words) + " "
        found = ends_of(made, [w.encode() for w in words])
        assert found == regex_ends(line, pattern)
        # From the openings alone the same is found as from every word.
        begins = {i for o in made.openings() for i in range(len(words)) if " ".join(words[i:] + [""]).startswith(o.decode() + " ")}
        coded = [w.encode() for w in words]
        assert made.matches(coded, sorted(begins)) == made.matches(coded, list(range(len(words))))


def test_templates_accept_their_wording_and_need_every_mandatory_word():
    scanner = licenses.Scanner(licenses.TEMPLATES, {})
    for label, markup in licenses.TEMPLATES.items():
        # The fullest wording: optional regions kept, the first choice, one free word each.
        text = re.sub(r'<<var;match="\(([^|)]*)[^)]*\)">>', r"\1", re.sub(r"<</?optional>>", " ", markup))
        text = re.sub(r"<<var;match=[^>]*>>", "example", text)
        words = text.split()
        assert label in {place[0] for place in scanner.scan("So: " + text + ", ok.")[1]}
        bare = re.sub(r"<<optional>>.*?<</optional>>", " ", re.sub(r"<<var[^>]*>>", "", markup), flags=re.S).split()
        for gone in set(bare):
            if not re.search(rf"<<var[^>]*\b{gone}\b", markup) and words.count(gone) == 1:
                left = " ".join(w for w in words if w != gone)
                assert label not in {place[0] for place in scanner.scan(left)[1]}, (label, gone)


def test_license_places_and_summary_on_odd_rows(spark):
    prepare(spark)
    text = "MIT License, mit-license; Released under the MIT license. mitlicense éMIT license"
    rows = [
        (1, text), (1, text), (None, "general  public\tLICENSE"), (2, None), (3, ""), (4, "\x00 !"),
        (5, "Licensed under CC BY-NC 4.0."), (6, "licensed under the Apache License, Version 2.0"),
        (7, "licensed under cc by nc sa 4.0"), (8, "mit license " * 100_000),
    ]
    schema = "doc_id int, text string, places string, label string, n_words string"
    df = spark.createDataFrame([(*r, "p", "l", "w") for r in rows], schema)
    got = {}
    for r in licenses.summary(licenses.scan(df)).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert got[1] == [(12, 3, 0, 7, "mit", "mit", 1.0)] * 2
    assert got[None] == [(3, 1, 0, 0, "gpl", "gpl", 0.5)]
    assert got[2] == got[3] == got[4] == [(0, 0, None, None, "", "", 0.0)]
    assert got[5] == [(7, 0, None, None, "", "cc-by-nc-4.0", 1.0)]
    assert got[6] == [(8, 1, 3, 3, "apache", "apache,apache-2.0", 1.0)]
    assert got[7][0][5] == "cc-by-nc-sa-4.0"
    assert got[8] == [(200_000, 100_000, 0, 199_998, "mit", "mit", 0.5)]
    assert licenses.scan(df.limit(0)).count() == 0


def test_long_texts_of_open_regions_take_linear_time():
    scanner = licenses.Scanner({"any": 'a <<var;match=".{0,500}">> never'}, {})
    assert scanner.scan("a b " * 100_000) == (200_000, [])


@pytest.mark.parametrize("markup", ["<<optional>>a", "a<</optional>>", '<<var;match=".{0,3}">> a', "", "<<optional>>a<</optional>>"])
def test_templates_that_cannot_be(markup):
    with pytest.raises(ValueError):
        licenses.Scanner({"x": markup}, {})


# --- collocations ------------------------------------------------------------------


def brute_counts(rows) -> Counter:
    out = Counter()
    for lang, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^ \t]+", piece)
            for length in (1, 2, 3):
                for i in range(len(words) - length + 1):
                    out["und" if lang is None else lang, tuple(words[i : i + length])] += 1
    return out


def brute_phrases(rows, least, swallowed, top):
    counts = brute_counts(rows)
    out = []
    for lang in {k[0] for k in counts}:
        f = {words: n for (at, words), n in counts.items() if at == lang}
        total = sum(n for words, n in f.items() if len(words) == 1)
        candidates = {w: n for w, n in f.items() if len(w) > 1 and n >= least}
        found = []
        for w, a in candidates.items():
            longer = [n for o, n in candidates.items() if len(o) > len(w) and w in (o[:2], o[1:])]
            if any(100 * n >= swallowed * a for n in longer):
                continue
            score, _, l, r = min(
                (1_000_000 * a * a // (f[w[:k]] * f[w[k:]]), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w))
            )
            found.append((-score, -a, " ".join(w).encode(), " ".join(w), a, l, r))
        out += [(lang, i + 1, p, a, l, r, total, -s) for i, (s, _, _, p, a, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(seed: int, n: int = 60):
    rnd = random.Random(seed)
    vocabulary = ["the", "The", "of", "a\x01", "é", "z", "😀", "mit", "x-y", "ß"]
    weights = [30, 10, 9, 6, 5, 4, 3, 3, 2, 1]
    joins = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " "]
    rows = [
        (rnd.choice(["en", "en", "de", None, "und"]), "".join(rnd.choices(vocabulary, weights)[0] + rnd.choice(joins) for _ in range(rnd.randint(0, 60))))
        for _ in range(n)
    ]
    return [*rows, ("en", None), ("en", ""), ("fr", " .,"), ("de", "the of the of the of " * 40), rows[0], rows[0]]


@pytest.mark.parametrize("seed", range(2))
def test_phrases_equal_brute_force(spark, seed):
    prepare(spark)
    rows = corpus(seed)
    # Many small partitions and batches: runs of one beginning cross all of them.
    changed = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "9",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "3",
    }
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame([(r[1], r[0], 1, 2) for r in rows], "text string, lang string, n long, w1 long").repartition(5)
        for least, swallowed, top in ((10, 50, 2000), (1, 50, 2000), (2, 30, 7)):
            got = sorted(tuple(r) for r in collocations.phrases(df, least, swallowed, top).collect())
            assert got == brute_phrases(rows, least, swallowed, top)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_phrases_of_nothing(spark):
    prepare(spark)
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations.phrases(df).count() == 0
    assert collocations.phrases(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_counts_go_on_across_blocks_and_chunks(monkeypatch):
    monkeypatch.setattr(collocations, "COUNTED_WORDS", 7)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 11)
    rows = [("en" if lang is None else lang, text or "") for lang, text in corpus(5, 30)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])
    got = Counter()
    for out in collocations.counted((1, 2, 3))([batch.slice(0, 4), batch.slice(4)]):
        for r in out.to_pylist():
            words = tuple(r[w] for w in collocations.WORDS if r[w] is not None)
            if words:
                got[r["lang"], words] += r["n"]
    assert got == brute_counts(rows)


def test_filter_keeps_what_was_added():
    rng = np.random.default_rng(3)
    made = collocations.Filter.empty(1 << 16)
    added, other = (rng.integers(0, 1 << 64, 2000, dtype=np.uint64) for _ in range(2))
    made.add(added)
    assert made.holds(added).all() and made.holds(other).mean() < 0.02
    full = collocations.Filter(np.full(4, (1 << 64) - 1, dtype=np.uint64))
    assert full.holds(other).all()


def test_a_full_filter_changes_no_count(monkeypatch):
    rows = [("en" if lang is None else lang, text or "") for lang, text in corpus(6, 30)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])
    full = collocations.Filter(np.full(4, (1 << 64) - 1, dtype=np.uint64))
    got = Counter()
    for out in collocations.counted((3,), lambda: full)([batch]):
        for r in out.to_pylist():
            got[r["lang"], tuple(r[w] for w in collocations.WORDS)] += r["n"]
    assert got == Counter({k: n for k, n in brute_counts(rows).items() if len(k[1]) == 3})
