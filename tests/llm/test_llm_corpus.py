"""The corpus operators against SQL, brute force and held-out labels, and on odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
from opinio.llm import (
    components,
    mixing,
    multiset,
    packing,
    privacy,
    quantized,
    secrets,
    sharding,
    simhash,
    toxicity,
    urls,
)
from opinio.llm.common import SQL, prepare
from opinio.llm.tokenizing import Encoder

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "size long, fp long, component_id long, score double, features string, probability string, copy long, `row` long"
)
LONG = "lorem ipsum dolor sit amet " * 40_000
ODD = [
    (1, "A plain text of a few words.\nAnd a second line.", "en", "a"),
    (1, "A plain text of a few words.\nAnd a second line.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (None, "No id but words, mail me@x.org or +1 (555) 010-9999.", "en", None),
    (None, "No id but words, mail me@x.org or +1 (555) 010-9999.", "en", None),
    (4, " \t\n ", "de", "b"),
    (5, LONG, "en", "b"),
    (6, "a plain text of a few words.\nand a second line.", "en", "c"),
    (1, "The same id, another text.", None, "a"),
    (7, "é😀 12345678901234567890 4111 1111 1111 1111", "fr", "ü"),
    (-9, "Below zero.", "en", ""),
]


def frame(spark, rows):
    full = [(*r, len(r[1]) if r[1] is not None else None, 1, 2, 3, 0.5, "f", "p", 4, 5) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, ODD[:1]).limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    assert oracle.compare(contract.queries()[name](spark, sf), oracle.connect(sf), SQL[name]) is None


# --- mixing --------------------------------------------------------------------------


def test_mixing_takes_what_was_planned(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = mixing.mix(docs, block=64)
    by_source = {r["source"]: r for r in plan.sources.collect()}
    taken = mixing.taken(plan).collect()
    got = Counter()
    for r in taken:
        assert 0 <= r["taken"] <= 2 * r["size"]
        got[r["source"]] += r["taken"]
    for source, r in by_source.items():
        assert abs(got[source] - r["target"]) <= 0.5
    assert sum(got.values()) == pytest.approx(1.5 * sum(r["source_size"] for r in by_source.values()), abs=len(by_source))
    assert sorted(map(tuple, mixing.taken(mixing.mix(docs, block=64)).collect())) == sorted(map(tuple, taken))


def test_mixing_keeps_shares_in_every_stretch(spark):
    docs = spark.createDataFrame([(i, "w " * 50, f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    plan = mixing.mix(docs, block=50)
    slots = [r["skey"] for r in plan.pieces.select("slot", "skey").distinct().orderBy("slot").collect()]
    whole = Counter(slots)
    half = Counter(slots[: len(slots) // 2])
    for key, n in whole.items():
        assert abs(half[key] - n / 2) <= 4


def test_targets_stop_at_two_epochs_and_pass_on_the_rest(spark):
    sizes = spark.createDataFrame([("sa", "a", 10), ("sb", "b", 1000), ("sc", "c", 500), ("n", None, 90)], "skey string, source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes, (3, 1, 2), 1.5, 2).collect()}
    # By hand: 2400 words; a and null fill up at 20 and 180, then c at 1000, b takes 1200.
    assert got == {"a": 20.0, None: 180.0, "c": 1000.0, "b": 1200.0}


def test_mixing_odd_rows(odd, none):
    rows = mixing.taken(mixing.mix(odd)).collect()
    assert len(rows) == len(ODD)
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.taken(mixing.mix(none)).count() == 0


def test_mixed_documents_hold_the_words_taken(odd):
    plan = mixing.mix(odd)
    out = mixing.mixed_documents(odd, plan)
    assert out.columns == odd.columns
    got, want = Counter(), Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(words_of(r["text"]))
        assert r["n_chars"] == len(r["text"])
    for r in mixing.taken(plan).collect():
        want[r["doc_id"]] += r["taken"]
    assert +want == got


# --- packing -------------------------------------------------------------------------


def test_encoder_equals_the_tokenizer(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, theirs = Encoder(path), Tokenizer.from_file(path)
    odd = ["", " ", "  ", "\n", "a ", "a  b", "a \n b", " a", " \n", "don't 's", "a\xa0b \xa0c", "a\x1c b \x1cc", "x <|endoftext|> y", "1 22  333", "😀 é", " a "]
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for text in odd + texts:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == np.array(ids, dtype="<u4").tobytes()


def check_packing(docs, pieces, most=2048):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        head = len(ids) % most if len(ids) > most else len(ids)
        cuts = [0, *([head] if head else []), *range(head + most, len(ids) + 1, most)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(doc_id, k, a, b - a, np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in pieces) == want
    bins = defaultdict(list)
    for r in pieces:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return bins


def test_packing_is_whole_and_tight(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(docs, path).collect()
    bins = check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], pieces)
    assert len(bins) <= 1.02 * sum(r["length"] for r in pieces) / 2048 + 1


def test_packing_keeps_every_constraint():
    limits = packing.Limits(tokens=100, documents=3, cost=100 * 100)
    rng = np.random.default_rng(1)
    for choose in ("norm", "dot"):
        bins = packing.Bins(packing.Limits(100, 3, 10_000, choose), 0)
        lengths = rng.integers(1, 60, 500)
        numbers, _ = bins.place(lengths)
        for k in set(numbers):
            mine = lengths[numbers == k]
            assert mine.sum() <= limits.tokens and len(mine) <= 3 and (mine**2).sum() <= limits.cost


def test_packing_odd_rows(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    check_packing([(r[0], r[1]) for r in ODD], packing.pack(odd, path).collect())
    assert packing.pack(none, path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, path, packing.Limits(cost=100))


# --- toxicity ------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.scores(docs.select("doc_id", "text"), labels).join(labels, "doc_id").collect()
    for r in rows[:200]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["score"], r["toxic"]) for r in rows if r["held_out"]]
    ones, zeros = ([s for s, y in held if y == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    assert auc > 0.9
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95


def test_toxicity_odd_rows(odd, none, labels):
    rows = toxicity.scores(odd, labels)
    assert set(rows.columns) == {*odd.columns, "held_out", "score", "predicted"}
    assert rows.count() == len(ODD)
    assert toxicity.scores(none, labels).count() == 0
    assert {r["score"] for r in toxicity.scores(odd, labels.limit(0)).collect()} == {0.0}


def test_a_common_beginning_does_not_hide_texts(spark):
    rng = np.random.default_rng(3)
    header = "This work is given under the terms of the common open license, as is. "

    def words():
        return " ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(40))

    toxic = [(header + words() + " vilest " + words(), 1) for _ in range(12)]
    copied = (words() + " oftcopied " + words(), 1)
    texts = toxic + [copied] * 9 + [(copied[0].upper(), 1)] + [(header + words(), 0) for _ in range(40)]
    once = toxicity.distinct_texts(prepare(spark).createDataFrame(texts, "text string, label int"))
    assert Counter(r["label"] for r in once.collect()) == {1: 13, 0: 40}
    units = {u for u, _ in toxicity.telling_units(spark.createDataFrame(texts, "text string, label int"))}
    assert "w:vilest" in units and "w:oftcopied" not in units


def test_toxic_features():
    look = toxicity.automaton((("w:vile", 3.0), ("p:gros", 2.0)))
    f = toxicity.features_of("You are VILE, grossly so! st*pid", look)
    assert f[1] == 2 / 6 and f[5] == 3.0 and f[8] == 1.0 and f[15] == 1 / 6
    assert toxicity.features_of(None, look) == [0.0] * toxicity.N_FEATURES
    assert toxicity.features_of("evileness", look)[1] == 0


# --- simhash -------------------------------------------------------------------------


def slow_fingerprint(text, n=4):
    words = words_of(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: slow_fingerprint(r["text"]) for r in rows}
    ids = sorted(prints)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = slow_components(ids, links)
    got = contract.queries()["op5_simhash"](spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


@pytest.mark.parametrize("part", [4096, 20])
def test_close_fingerprints_are_linked(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng = np.random.default_rng(3)
    near = {int(x) for x in (rng.integers(0, 1 << 63) ^ np.array([(1 << int(a)) | (1 << int(b)) for a, b in rng.integers(0, 62, (150, 2))]))}
    prints = sorted(near | {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 300)})
    frame_ = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = [(r["a"], r["b"]) for r in simhash.linked(frame_).collect()]
    close = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4
    assert all(close(a, b) for a, b in got)
    links = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if close(a, b)]
    assert slow_components(prints, got) == slow_components(prints, links)


def test_simhash_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in rows}
    empty = {c for (i, f), c in by.items() if f == 0}
    assert empty == {2}  # null, empty and blank texts are one group
    assert next(c for (i, f), c in by.items() if i == 6) == 1  # case does not count
    assert next(c for (i, f), c in by.items() if i is None) is None
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == {1: 2, 2: 1, None: 1, 5: 1, 7: 1, -9: 1}
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


# --- multiset ------------------------------------------------------------------------


def test_multiset_edits_and_likeness(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), reverse=True)
    got = {r["doc_id"]: r for r in contract.queries()["op6_multiset"](spark, sf).collect()}
    prints = {}
    for i, (doc_id, text) in enumerate(docs):
        third = len(text) // 3
        edited = text[: len(text) - third] + docs[(i + 1) % len(docs)]["text"][:third]
        r = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert len(set(prints.values())) == len({tuple(sorted(t.split("\n"))) for t in prints})
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.95


def test_multiset_is_homomorphic(spark):
    one = lambda t: multiset.fingerprint(F.lit(t))
    a, b = "first line\nsecond longer line of words here", "third\nthird"
    row = spark.range(1).select(
        multiset.text_of(one(f"{a}\n{b}")).alias("whole"),
        multiset.text_of(one("third\nsecond longer line of words here\nthird\nfirst line")).alias("moved"),
        multiset.text_of(multiset.combine(one(a), one(b))).alias("put"),
        multiset.text_of(one(a)).alias("a"),
        multiset.text_of(multiset.combine(one(f"{a}\n{b}"), one(b), -1)).alias("taken"),
        multiset.text_of(one(f"{a}\nthird")).alias("other"),
    ).first()
    assert row["whole"] == row["moved"] == row["put"] != row["other"]
    assert row["a"] == row["taken"]


def test_neighbours_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(multiset, "ORDERED", 4)
    monkeypatch.setattr(multiset, "BUCKET_BITS", 3)
    ids = sorted({-900, -8, -1, 0, 1, 7, 8, 9, 100, 1 << 40, (1 << 62) + 5, *range(30, 40)})
    got = {r["id"]: r["below"] for r in multiset.lower_neighbours(spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    assert got == dict(zip(ids, [None, *ids]))


def test_multiset_odd_rows(odd, none):
    rows = multiset.fingerprints(odd).select("doc_id", "n_chars", "edited").collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in rows) == Counter((r[0], len(r[1] or "")) for r in ODD)
    assert next(r["edited"] for r in rows if r["doc_id"] == 3) == ""
    # Null comes last and is followed by the first, which is 7.
    text = ODD[4][1]
    assert {r["edited"] for r in rows if r["doc_id"] is None} == {text[: len(text) - len(text) // 3] + ODD[10][1][: len(text) // 3]}
    assert multiset.fingerprints(none).count() == 0


# --- personal data -------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_spans(text):
    def luhn(digits):
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0

    checks = {
        "email": lambda v, d: True,
        "ip": lambda v, d: all(int(p) <= 255 for p in v.split(".")),
        "card": lambda v, d: 12 <= len(d) <= 19 and luhn(d),
        "phone": lambda v, d: 9 <= len(d) <= 15,
    }
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            if checks[kind](m.group(), re.sub("[^0-9]", "", m.group())):
                out.append((m.start(), k, m.end()))
    return sorted(out)


TRICKY = [
    "a@b.co_d@e.fr", "a@b.co@c.de x@y", "x@-.a.b-", "😀 é a.b+c%d@e-f.g.h!", "1.2.3.4.5.6.7.8", "256.1.1.1 025.001.1.255", "001.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111 1111 1111 1112", "+1 (222) 333-4444", "+1.2.3.4.5.6.7.8.9", "+1 234", "+123456789012345678", "++49 30 1234567-", "@", "a@b", "12345678901 +", "0" * 13, "1" * 5000, "a" * 20000, "1 " * 20000, "+1" * 3000, None, "",
]


def test_base_spans_equal_the_patterns(spark, sf):
    texts = TRICKY + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in privacy.personal_spans(docs).collect():
        assert [tuple(s) for s in r["base"]] == slow_spans(texts[r["doc_id"]]), texts[r["doc_id"]][:80]
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]}


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é mail a@b.co or +1 (222) 333-4444."), (2, None), (3, "1.2.3.4")], "doc_id long, text string")
    rows = privacy.personal_spans(docs, keep=("text",)).select("doc_id", privacy.redacted("text", "stretches").alias("t"))
    assert {r["doc_id"]: r["t"] for r in rows.collect()} == {1: "é mail [email] or [phone].", 2: "", 3: "[ip]"}


def test_written_addresses_are_candidates(spark):
    docs = spark.createDataFrame([(1, "write to jo (at) site [dot] org now")], "_row long, text string")
    rows = privacy.places(docs.select("_row", privacy.candidates(F.col("text")).alias("_all"))).collect()
    assert [(r["start"], r["end"], privacy.KINDS[r["kind"]], r["good"], r["open"]) for r in rows] == [(9, 31, "written_email", False, True)]


def slow_redaction(text, spans):
    parts, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            parts += [text[at:start], f"[{privacy.KINDS[kind]}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def test_texts_full_of_candidates(spark):
    """Many thousands of candidates in one text: no step gathers them per candidate."""
    many = " ".join(f"é{i % 250}.{i % 7}.0.{i % 300} call 0151 {2000000 + i}" for i in range(20_000))
    rows = [(1, many), (2, "+1 (222) 333-4444" * 3000), (3, "a@b.co," * 5000), (4, "1 " * 50_000), (5, "call 030 1234567.89.1.2 4111 1111 1111 1111")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in privacy.personal_spans(docs, keep=("text",)).select("*", privacy.redacted("text", "stretches").alias("clean")).collect():
        base, spans = ([tuple(s) for s in r[c]] for c in ("base", "spans"))
        assert base == slow_spans(r["text"]) and set(base) <= set(spans) and spans == sorted(spans)
        assert r["clean"] == slow_redaction(r["text"], spans)
        if r["doc_id"] == 1:
            assert len(base) == sum(i % 300 <= 255 for i in range(20_000)) and len(spans) >= len(base) + 20_000
        added = [s for s in spans if s not in set(base)]
        assert not any(a[0] < b[2] and b[0] < a[2] for a in added[:200] for b in base)


def test_redaction_keeps_columns_of_any_name(spark):
    schema = "doc_id string, text string, _all string, base int, spans int, _row long, _doc string, n_chars int, start int"
    rows = [("a", "mail a@b.co", "x", 1, 2, 3, "d", 11, 4), (None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = privacy.redact(docs)
    assert got.dtypes == docs.dtypes
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", "mail [email]", "x", 1, 2, 3, "d", 12, 4), rows[1]], key=repr)
    assert privacy.redact(docs.drop("n_chars")).count() == 2


def test_local_numbers_and_written_addresses_are_selected(spark):
    def wrap(i, body):
        return (i, f"Some words before. {body} and words after.")

    rows = [wrap(i, f"Please call 0{i % 7}51 {2000000 + i * 37}") for i in range(200)]
    rows += [wrap(i, f"Write jo{i} (at) site{i % 9} (dot) org") for i in range(200, 400)]
    rows += [wrap(i, f"The order {70000000 + i * 911} was sent") for i in range(400, 600)]
    rows += [wrap(600, "You get me under 0351 2005555"), wrap(601, "Tel: 555-0134 here"), wrap(602, "See page 1234567 there")]
    rows = [*rows, (603, "call 0151 2345678, or +1 (222) 333-4444, jo[at]x[dot]org")]
    rows += [wrap(i, f"Please phone 0{i % 7}51 {3000000 + i * 37}") for i in range(604, 1004)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in privacy.personal_spans(docs).collect():
        got[r["doc_id"]] = [(privacy.KINDS[s["kind"]], rows[r["doc_id"]][1][s["start"] : s["end"]]) for s in r["spans"]]
    assert all([k for k, _ in got[i]] == ["number"] for i in range(200))
    assert all(got[i] == [("written_email", f"jo{i} (at) site{i % 9} (dot) org")] for i in range(200, 400))
    assert not any(got[i] for i in range(400, 600)) and not got[602]
    assert got[600] == [("number", "0351 2005555")]  # no telling word, but like those that have one
    assert got[601] == [("number", "555-0134")]
    assert got[603] == [("number", "0151 2345678"), ("phone", "+1 (222) 333-4444"), ("written_email", "jo[at]x[dot]org")]


def test_all_open_candidates_are_learned_from(spark, monkeypatch):
    """More texts than a sample of 50,000 would hold: trees and threshold see each candidate."""
    seen = []
    fit = privacy.fit
    monkeypatch.setattr(privacy, "fit", lambda shown, **kw: seen.append(shown.count()) or fit(shown, **kw))
    docs = spark.range(0, 60_000, numPartitions=4).select(F.col("id").alias("doc_id"), F.concat(F.lit("order 7000"), F.col("id") + 100_000).alias("text"))
    assert privacy.personal_spans(docs).filter("size(spans) = 0").count() == 60_000
    assert seen == [60_000]


def test_privacy_odd_rows(odd, none):
    rows = privacy.personal_spans(odd, keep=("source", "size", "score")).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)
    assert all(len(r["base"]) == 2 for r in rows if r["doc_id"] is None)
    assert privacy.personal_spans(none).count() == 0


# --- embeddings ----------------------------------------------------------------------


def test_embeddings_equal_brute_force(spark, sf):
    rng = np.random.default_rng(5)
    table = [list(map(float, r["embedding"])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").limit(600).collect()]
    d = len(table[0])
    near = [(np.array(table[i % 7]) + rng.normal(0, 0.3 * np.linalg.norm(table[i % 7]) / d**0.5, d)).tolist() for i in range(300)]
    vectors = table + near + [table[0]] * 40 + [[2 * x for x in table[1]]]
    ids = rng.permutation(len(vectors)).tolist()
    frame_ = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<double>")
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    want = slow_components(ids, [(ids[a], ids[b]) for a, b in np.argwhere(close)])
    rows = {r["vec_id"]: r for r in quantized.near_duplicates(frame_).collect()}
    found = sum(r["n_links"] for r in rows.values())
    assert 0.99 * close.sum() <= found <= close.sum()
    assert all(rows[ids[i]]["n_links"] <= n for i, n in enumerate(close.sum(axis=1)))
    assert np.mean([rows[i]["component_id"] == want[i] for i in ids]) > 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows.values())


def test_embeddings_odd_rows(spark):
    rows = [
        (5, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [2.0, 0.0]), (7, [0.0, 0.0]), (8, [-0.0, 0.0]), (9, None), (10, [1.0, None]),
        (11, [float("nan"), 1.0]), (12, [float("inf"), 1.0]), (13, []), (14, [1.0]), (None, [0.0, 1.0]), (None, [0.0, 1.0]), (15, [1.0, -0.0]),
    ]
    schema = "vec_id long, embedding array<double>"
    with_more = spark.createDataFrame(rows, schema).withColumns({"cid": F.lit(1), "key": F.lit(2), "list": F.lit(3)})
    got = Counter(tuple(r) for r in quantized.near_duplicates(with_more).collect())
    lone = Counter({(i, 0, i, True): 1 for i in (7, 8, 9, 10, 11, 12, 13, 14)})
    assert got == lone + Counter({(5, 3, 3, False): 1, (3, 3, 3, True): 2, (15, 3, 3, False): 1, (None, 1, None, True): 2})
    assert quantized.near_duplicates(spark.createDataFrame([], schema)).count() == 0


# --- secrets -------------------------------------------------------------------------


def test_secrets_are_found(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    planted = re.compile(r"AKIA[A-Z0-9]{16}|password=[0-9a-f]{18}|token = \"\w{40}\"")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    with_, without = [], []
    for i, text in texts.items():
        (with_ if planted.search(text) else without).append(got[i]["n_secrets"] > 0)
    assert np.mean(with_) > 0.95 and np.mean(without) < 0.02
    for i, r in got.items():
        for f in r["findings"]:
            assert 0 <= f["start"] < f["end"] <= len(texts[i])


def test_secrets_learn_from_labelled_findings(spark):
    rng = np.random.default_rng(2)
    code = lambda letters: "".join(rng.choice(list(letters), 24))
    rows, truth = [], []
    for i in range(120):
        value = code("ABCDEF0123456789") if i % 2 else code("xyz019")
        rows.append((i, f"some words {value} end"))
        truth.append((i, 11, 11 + len(value), bool(i % 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame(truth, "doc_id long, start int, end int, secret boolean")
    got = {r["doc_id"]: r["n_secrets"] for r in secrets.scan(docs, labelled).collect()}
    assert sum(got[i] == i % 2 for i in got) > 110


def test_secrets_odd_rows(odd, none):
    rows = secrets.scan(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)
    assert secrets.scan(none).count() == 0


@pytest.mark.parametrize("dims", [4, 8])
def test_every_link_counts_for_both_in_low_dimensions(spark, dims):
    """Where many lists meet, one side of a pair often does not look into the other's."""
    rng = np.random.default_rng(dims)
    seeds = rng.normal(size=(12, dims))
    vectors = [seeds[i % 12] / np.linalg.norm(seeds[i % 12]) + rng.normal(0, 0.22 / dims**0.5, dims) for i in range(1200)]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(5000, [1.0, 2.0, 3.0]), (5001, [2.0, 4.0, 6.0]), (5002, [1.0]), (5003, [-1.0]), (5004, [3.0])]
    got = {r["vec_id"]: r for r in quantized.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    assert [got[i]["n_links"] for i in range(1200)] == close.sum(axis=1).tolist()
    want = slow_components(list(range(1200)), [(int(a), int(b)) for a, b in np.argwhere(close)])
    assert all(got[i]["component_id"] == want[i] for i in range(1200))
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(5000, 5005)] == [(1, 5000), (1, 5000), (1, 5002), (0, 5003), (1, 5002)]


@pytest.mark.parametrize("kind", ["smallint", "string", "decimal(10,0)"])
def test_ids_of_any_type_are_packed(spark, kind):
    docs = spark.createDataFrame([(1, "a few words"), (None, None)], "doc_id int, text string")
    rows = packing.pack(docs.withColumn("doc_id", F.col("doc_id").cast(kind)), public_tokenizers.path("byte_bpe_50k.json"))
    assert dict(rows.dtypes)["doc_id"] == kind and rows.count() == 2


def test_remembered_pieces_are_bounded_by_bytes(monkeypatch):
    from opinio.llm import tokenizing

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = " ".join(f"word{i}" for i in range(500)) + " " + "x" * 5000
    want = Encoder(path).encode(text)
    monkeypatch.setattr(tokenizing, "REMEMBERED", 10_000)
    small = Encoder(path)
    for _ in range(3):
        assert small.encode(text) == want
    small.encode("next")
    assert small.held <= 10_000


def test_siblings_merge_at_every_level(spark):
    """Four languages below one section, each with too few labels to be judged alone; deeper ones too."""
    rows, labels, n = [], [], 0
    for section, depth in (("blog", ""), ("news", "/a/b"), ("shop", "")):
        for lang in ("en", "fr", "de", "es"):
            for i in range(25):
                n += 1
                rows.append((n, f"https://h.org/{section}/{lang}{depth}/{n}"))
                # Two labels each of blog and news, all bad; shop's are all good.
                if i < 4:
                    labels.append((n, section != "shop"))
    for i in range(400):
        n += 1
        rows.append((n, f"https://h.org/good/{n}"))
        labels.append((n, False))
    frame_ = spark.createDataFrame(rows, "page_id long, url string")
    out = urls.filter_urls(frame_, spark.createDataFrame(labels, "doc_id long, bad boolean")).collect()
    verdicts = defaultdict(set)
    for r in out:
        verdicts[r["path"].split("/")[1]].add(r["verdict"])
    assert verdicts == {"blog": {"block"}, "news": {"block"}, "shop": {"allow"}, "good": {"allow"}}


def test_url_templates_equal_sql_on_deep_paths(spark, tmp_path):
    import duckdb

    rnd = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(4000):
        depth = int(rnd.integers(1, 6))
        path = "/".join(rnd.choice(["a", "b", "c", "{", "x1", str(i % 50)]) for _ in range(depth))
        rows.append((i, f"http://{rnd.choice(['p.org', 'q.de', 'r.net'])}/{path}/{i}"))
        labels.append((i, int(rnd.random() < 0.5), int(rnd.random() < (0.8 if path.startswith("a/b") else 0.05))))
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar); create table labels (doc_id bigint, quality int, toxic int)")
    con.executemany("insert into pages values (?, ?)", rows)
    con.executemany("insert into labels values (?, ?, ?)", labels)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known = known.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    assert oracle.compare(urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), known), con, SQL["op10_url_templates"]) is None


# --- sharding ------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [300_000, 20_000, 3_000])
def test_shards_fit_and_equal_sql(spark, sf, limit):
    got = sharding.assign(spark.read.parquet(f"{sf}/documents.parquet"), limit)
    assert oracle.compare(got.select("doc_id", "bytes", "shard", "depth"), oracle.connect(sf), sharding.sql(limit)) is None
    sizes = got.groupBy("shard").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["b"] <= limit or r["n"] == 1 for r in sizes)


def test_equal_rows_part(spark):
    rows = [(1, "x" * 50)] * 64 + [(None, None), (2, "y" * 500)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 100)
    sizes = got.groupBy("shard").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in sizes) == len(rows) and all(r["b"] <= 100 or r["n"] == 1 for r in sizes)


def test_written_shards_round_trip(spark, odd, none, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(odd, path, 1000)
    back = spark.read.parquet(path)
    assert Counter(map(tuple, back.select(*odd.columns).collect())) == Counter(map(tuple, odd.collect()))
    assert sharding.assign(none).count() == 0


# --- urls ----------------------------------------------------------------------------


def test_urls_parts_and_rules(spark):
    given = {
        "http://WWW.Example.com/en/1?x#y": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
        "http://x.net?a=/es/": ("x.net", "", None, "allow"),
        "ftp://h://i/j": ("h:", "//i/j", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "http://com/": ("com", "/", "com/", "allow"),
        "x\n://h.org/a\nb": ("h.org", "/a\nb", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").withColumns({"host": F.lit(1), "shape": F.lit(2)})
    labels = spark.createDataFrame([], "doc_id long, bad boolean")
    got = {r["page_id"]: tuple(r)[1:5] for r in urls.filter_urls(pages, labels).collect()}
    assert got == {i: v for i, v in enumerate(given.values())}
    assert urls.filter_urls(pages.limit(0), labels).count() == 0


def test_bad_templates_are_rejected(spark):
    rows, labels = [], []
    for i in range(300):
        branch = ("good", "fine", "spam")[i % 3]
        rows.append((i, f"http://h.org/{branch}/{i}.html"))
        labels.append((i, branch == "spam" and i % 10 != 0))
    rows += [(1000 + i, f"http://h.org/user{i}/about") for i in range(100)] + [(None, "http://h.org/spam/7.html")]
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, bad boolean")).collect()
    verdicts = {(r["template"], r["verdict"]) for r in out}
    assert verdicts == {("/good/{n}.html", "allow"), ("/fine/{n}.html", "allow"), ("/spam/{n}.html", "block"), ("/*/about", "allow")}
    purity = {r["template"]: r["purity"] for r in out}
    assert purity["/good/{n}.html"] == purity["/fine/{n}.html"]  # merged and judged together


def test_deep_and_small_sections_of_large_hosts_are_judged(spark):
    rows, labels = [], []
    for i in range(6000):
        bad = i % 200 == 0  # 30 pages, half a hundredth of the host
        rows.append((i, f"http://h.org/{'spam' if bad else 'good'}/{i}"))
        labels.append((i, bad))
    for i in range(6000, 6400):
        rows.append((i, f"http://deep.org/a/b/c/d/e/{('bad', 'fine')[i % 2]}/{i}"))
        labels.append((i, i % 2 == 0))
    rows.append((7000, "http://trap.org" + "/x" * 60 + "/7"))
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, bad boolean")).collect()
    assert {(r["template"], r["verdict"]) for r in out} == {
        ("/good/{n}", "allow"), ("/spam/{n}", "block"), ("/a/b/c/d/e/bad/{n}", "block"), ("/a/b/c/d/e/fine/{n}", "allow"),
        ("/*" * 60 + "/{n}", "allow"),
    }
