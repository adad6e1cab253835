"""Every stage of the pipeline against a plain version of it, on what the stage before kept."""

from __future__ import annotations

from collections import Counter

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from test_llm_corpus import ODD, check_packing, frame, slow_components, slow_fingerprint, slow_spans, words_of

import corpus_pipeline
from opinio.llm import mixing, privacy, simhash
from opinio.llm.common import prepare

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows before and after each stage, by name."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, out = docs.collect(), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = (before, docs.collect(), docs.columns)
        before = out[name][1]
    return out


def test_columns_stay(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "privacy", "mixing", "packing"]
    assert all(columns == COLUMNS for name, (_, _, columns) in stages.items() if name != "packing")


def test_toxic_documents_go(spark):
    sf = "/root/testdata/sf0.1"  # labels enough to learn from
    prepare(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    after = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert after.columns == COLUMNS and after.exceptAll(docs).count() == 0
    kept = {r["doc_id"] for r in after.select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect()
    harmless = [r["doc_id"] in kept for r in labels if r["toxic"] == 0]
    toxic = [r["doc_id"] in kept for r in labels if r["toxic"] == 1]
    assert sum(harmless) / len(harmless) > 0.99
    assert sum(toxic) / len(toxic) < 0.3


def shingles(text, words=5):
    found = [w for w in re.split("[ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def similar_pairs(rows, least=0.8):
    """Pairs of ids whose texts share at least that part of their shingles, by comparing all."""
    sets = {doc_id: shingles(text) for doc_id, text in rows}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y):
                yield a, b


def check_near_copies(rows, kept, recall=0.9):
    """``kept`` ids hold the smallest of every group, nothing clean is gone, few copies stay."""
    ids = sorted(i for i, _ in rows)
    root = slow_components(ids, list(similar_pairs(rows)))
    assert set(root.values()) <= kept
    copies = [i for i in ids if root[i] != i]
    gone = [i for i in ids if i not in kept]
    assert set(gone) <= set(copies)
    assert len(gone) >= recall * len(copies), (len(gone), len(copies))
    return len(gone), len(copies)


def test_one_of_each_group_stays(stages):
    before, after, _ = stages["simhash"]
    assert all(r in before for r in after) and len({r["doc_id"] for r in after}) == len(after)
    check_near_copies([(r["doc_id"], r["text"]) for r in before], {r["doc_id"] for r in after})


@pytest.mark.parametrize("edits", [0.01, 0.02])
def test_near_copies_are_found_like_by_comparing_all(spark, monkeypatch, edits):
    """Groups of copies with random edits, one of them large and dealt out in parts."""
    prepare(spark)
    monkeypatch.setattr(simhash, "PART", 40)
    rnd = random.Random(int(edits * 1000))
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for group in range(120):
        text = [rnd.choice(words) for _ in range(rnd.choice([12, 60, 200, 600]))]
        for _ in range(150 if group == 0 else rnd.randint(1, 3)):
            rows.append([w if rnd.random() > edits else rnd.choice(words) for w in text])
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = {r["doc_id"] for r in simhash.one_of_near_copies(docs).collect()}
    check_near_copies(rows, kept)


def test_near_copies_on_odd_rows(spark):
    docs = frame(spark, ODD)
    got = simhash.one_of_near_copies(docs)
    assert got.dtypes == docs.dtypes
    # Ids 1 and 6 have one set of shingles, 2, 3 and 4 none; null ids come last.
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted([-9, 1, 1, 2, 5, 7, None], key=repr)


def test_columns_of_any_name_pass_through(spark, sf):
    extra = ["score", "predicted", "_size", "_cut", "_row", "base", "spans", "digest", "key", "_all", "_slot", "copy", "root", "_doc"]
    docs = frame(spark, ODD).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"kept {c}").alias(c) for c in extra])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, sf)
        assert rows.columns == docs.columns, name
        assert all(r[c] == f"kept {c}" for r in rows.collect() for c in extra), name


def test_the_mix_is_interleaved(spark, sf):
    prepare(spark)
    rows = [(i, "word " * 64, "en", f"s{i // 600}", 320) for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mix_sources(spark, docs, sf).collect()
    shares = Counter(r["source"] for r in out)
    for begin in range(0, len(out) - 300, 300):
        part = Counter(r["source"] for r in out[begin : begin + 300])
        assert all(abs(part[s] / 300 - n / len(out)) < 0.15 for s, n in shares.items())


def test_personal_data_is_redacted(stages):
    before, after, _ = stages["privacy"]
    texts = {r["doc_id"]: r for r in after}
    assert len(after) == len(before)
    for r in before:
        text, at, parts = r["text"], 0, []
        for start, kind, end in slow_spans(text):
            if start >= at:
                parts += [text[at:start], f"[{privacy.KINDS[kind]}]"]
            at = max(at, end)
        got = texts[r["doc_id"]]
        assert got["text"] == "".join(parts) + text[at:]
        assert got["n_chars"] == len(got["text"]) or not parts
        assert (got["lang"], got["source"]) == (r["lang"], r["source"])


def test_mix_holds_the_planned_words(stages):
    before, after, _ = stages["mixing"]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", [tuple(r) for r in before])
    cursor = con.execute(mixing._SQL)
    names = [d[0] for d in cursor.description]
    want = {row[names.index("doc_id")]: row[names.index("taken")] for row in cursor.fetchall()}
    whole = {r["doc_id"]: r for r in before}
    expected = Counter()
    for doc_id, taken in want.items():
        r, words = whole[doc_id], words_of(whole[doc_id]["text"])
        if not words:
            continue
        times, rest = divmod(taken, len(words))
        if times:
            expected[tuple(r)] += times
        if rest:
            cut = " ".join(words[:rest])
            expected[(doc_id, cut, r["lang"], r["source"], len(cut))] += 1
    assert Counter(map(tuple, after)) == expected


def test_packed_sequences_hold_the_mix(stages):
    before, after, _ = stages["packing"]
    check_packing([(r["doc_id"], r["text"]) for r in before], after)


def test_run_gives_what_its_last_stage_gives(spark, sf, stages):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == stages["packing"][2]
    assert {r["doc_id"] for r in rows.select("doc_id").collect()} == {r["doc_id"] for r in stages["packing"][1]}


def test_odd_rows_pass_through(spark, sf):
    docs = frame(spark, ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.count() > 0
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.select(F.col("doc_id"), "text"), sf).count() > len(ODD)


def test_links_of_fingerprints_count_in_the_pipeline(spark, sf):
    """Texts of one fingerprint whose shingles have less than four fifths in common."""
    words = "a b c d e f g h i j k l m n o p q r s t".split()
    line = " ".join(words)
    # A shingle of four words repeated weighs more in a fingerprint than in a set of shingles.
    rows = [(1, " ".join([line] * 40)), (2, " ".join([line] * 40) + " u v w x y z uu vv ww xx"), (3, "something else entirely , of other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [slow_fingerprint(t) for _, t in rows]
    assert bin(prints[0] ^ prints[1]).count("1") <= 4 and not list(similar_pairs(rows))
    assert {r["doc_id"] for r in simhash.one_of_near_copies(docs).collect()} == {1, 2, 3}
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 3}
