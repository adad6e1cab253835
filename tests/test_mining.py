import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opinio.operators import analysis, blocks, clusters, keywords, neighbours, prompts, sampling, sentiment, tokens, topics, vectors
from opinio.functions import lexicon as lex
from opinio.functions import text
from opinio.session import scratch_path

TEXTS = ["battery drains fast battery", "battery drains overnight", "login screen crash", "login crash again", ""]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t, 1 + i % 5) for i, t in enumerate(TEXTS * 6)]
    return spark.createDataFrame(rows, "review_id int, text string, rating int")


def compound(s):
    return round(s / math.sqrt(s * s + 15), 4)


@pytest.mark.parametrize(
    "text,score",
    [
        ("a good app", 1.9),
        ("a very good app", 1.9 + 0.293),
        ("a very nice good app", 1.8 + 0.293 + 1.9 + 0.293 * 0.95),
        ("a slightly good app", 1.9 - 0.293),
        ("not good", 1.9 * -0.74),
        ("not very good", (1.9 + 0.293) * -0.74),
        ("never so good", (1.9 + 0.293) * 1.5),
        ("it never was this good", 1.9 * 1.25),
        ("never so very good", ((1.9 + 0.293) + 0.293 * 0.95) * 1.25),
        ("we say good bad", 1.9 - 2.5),
        ("not great good", 3.1 * -0.74 + 1.9 * -0.74),
        ("they are so so good", (1.9 + 0.293 + 0.293 * 0.95) * 1.25),
        ("all in all bad ass", 1.5),
        ("bad ass", -2.5),
        ("so great of all bad ass", 3.1 + 0.293 - 2.5),
        ("we got the kiss of death bad thing", -1.5),
        ("it is kind of good", 1.9 - 0.293),
        ("it was kind of nice good", 1.8 - 0.293 + 1.9 - 0.293),
        ("good but bad", 1.9 * 0.5 - 2.5 * 1.5),
        ("least good", 1.9 * -0.74),
        ("at least good", 1.9),
        ("plain words", 0.0),
        ("", 0.0),
    ],
)
def test_sentiment_rules(spark, text, score):
    df = spark.createDataFrame([(1, text)], "id int, cleaned_text string")
    row = sentiment.sentiment_scores(df, "id").first()
    assert row["sentiment_compound"] == pytest.approx(compound(score), abs=1e-4)
    want = "positive" if score > 0.2 else "negative" if score < -0.2 else "neutral"
    assert row["sentiment"] == want


def test_sentiment_keeps_every_row_and_column(spark):
    rows = [(1, "great", 5), (2, None, 1), (3, "   ", 2)]
    df = spark.createDataFrame(rows, "review_id int, text string, rating int")
    out = {r["review_id"]: r for r in sentiment.add_sentiment(df).collect()}
    assert len(out) == 3 and out[2]["sentiment"] == "neutral" and out[1]["rating"] == 5
    assert out[1]["sentiment_positive"] == 1.0 and out[3]["sentiment_neutral"] == 0.0


def test_phrases_come_from_a_table(spark):
    phrases = lex.phrase_table(spark, {"good grief": -3.0, "good": 9.0, "a good grief": 1.0, "good grief now": -1.0})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["it was all good grief", "it was all good grief now", "good grief"])], "id int, cleaned_text string")
    got = {r["id"]: r["sentiment_compound"] for r in sentiment.sentiment_scores(df, "id", phrases=phrases).collect()}
    # The longest that begins with the word; none for one of the first three words.
    assert got == {0: pytest.approx(compound(-3.0), abs=1e-4), 1: pytest.approx(compound(-1.0), abs=1e-4), 2: pytest.approx(compound(1.9), abs=1e-4)}


def test_lexicon_table_can_be_replaced(spark):
    words = lex.word_table(spark, {"meh": -1.0})
    df = spark.createDataFrame([(1, "meh good")], "id int, cleaned_text string")
    assert sentiment.sentiment_scores(df, "id", lexicon=words).first()["sentiment"] == "negative"


def test_tfidf_rows_have_unit_length(corpus):
    rows = keywords.tfidf(corpus, "review_id", "text")
    norms = rows.groupBy("review_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert len(norms) == 24 and all(abs(r["s"] - 1) < 1e-9 for r in norms)


def test_vocabulary_limits(spark, corpus):
    terms = keywords.document_terms(corpus, "review_id", "text")
    kept = {r["term"] for r in keywords.vocabulary(terms, 30, max_df=0.3).collect()}
    assert "fast" in kept and "battery" not in kept
    assert keywords.vocabulary(terms, 30, max_features=2).count() == 2


def test_lda_assigns_one_topic_per_text(corpus):
    result = topics.lda_topics(corpus, k=3)
    rows = result.documents.join(corpus, "review_id").collect()
    assert len(rows) == 30
    for r in rows:
        if r["text"]:
            assert 0 <= r["primary_topic"] < 3 and 0 < r["topic_confidence"] <= 1
        else:
            assert r["primary_topic"] is None and r["topic_confidence"] is None
    labels = result.labels().collect()
    assert len(labels) == 3 and all(r["label"].startswith(f"Topic {r['topic_id']}: ") for r in labels)


def test_nmf_separates_disjoint_subjects(corpus):
    rows = topics.nmf_topics(corpus, k=2).documents.join(corpus, "review_id").collect()
    by_word = {w: {r["primary_topic"] for r in rows if r["text"].startswith(w)} for w in ("battery", "login")}
    assert all(len(t) == 1 for t in by_word.values()) and by_word["battery"] != by_word["login"]
    assert all(r["primary_topic"] is None for r in rows if not r["text"])


def test_nmf_takes_rows_that_share_a_key_as_one_document(spark):
    once = [(i, f"{'battery drains' if i % 2 else 'login screen'} w{i} w{i + 2}") for i in range(20)]
    halves = [(i, half) for i, t in once for half in (t.rsplit(" ", 2)[0], " ".join(t.split()[-2:]))]
    fits = []
    for rows in (once, halves):
        df = spark.createDataFrame([*rows, (None, "battery login")], "review_id int, text string")
        found = topics.nmf_topics(df, k=2, stops=(), iterations=20).documents.distinct()
        fits.append({r[0]: r[1:] for r in found.collect()})
    assert fits[0].keys() == fits[1].keys() and fits[0][None] == (None, None)
    assert all(fits[0][i] == pytest.approx(fits[1][i]) for i in range(20))


def test_passes_move_blocks_in_as_many_tasks_as_there_are_cores_for(spark):
    """Not a task for each of many partitions, and no row per number that is added up."""
    rows = [(i, [f"w{j}" for j in range(i % 7)], i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>, grp int").select("id", "grp", "tokens").repartition(40)
    places = [{f"w{j}": (j, 1.0 + j) for j in range(5)}, {"w3": (0, 2.0)}]
    packed = df.mapInArrow(blocks.packed(places, unit=False), blocks.block_schema("int"))
    dealt = blocks.dealt(packed)
    assert dealt.rdd.getNumPartitions() <= blocks.TASKS_PER_CORE * spark.sparkContext.defaultParallelism < 40
    got = {r["id"]: (r["grp"], list(r["at"]), list(r["weight"])) for r in blocks.unpacked(dealt, "id", "int").collect()}
    assert got == {
        i: (g, [0], [2.0]) if g and "w3" in t else (g, [], []) if g else (g, list(range(min(len(t), 5))), [1.0 + j for j in range(min(len(t), 5))])
        for i, t, g in rows
    }

    def sums(batches):
        total = np.zeros(20_000)
        for batch in batches:
            for group, lengths, at, weight in blocks.entries(batch):
                np.add.at(total, 10_000 * group + at, weight)
                total[-1] += len(lengths)
        yield from blocks.pieces(total)

    parts = dealt.mapInArrow(sums, blocks.PIECES)
    # Two of the three pieces hold anything but zeros.
    assert parts.count() <= 3 * blocks.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    whole = blocks.added(parts, 20_000)
    assert whole[-1] == 400 and whole[10_000] == 2.0 * sum(g and "w3" in t for _, t, g in rows)
    assert whole[4] == 5.0 * sum(not g and "w4" in t for _, t, g in rows)


def test_terms_are_counted_by_group(spark):
    rows = [(0, ["a", "b", "a"]), (0, ["a"]), (1, ["b"]), (1, []), (1, ["b", "b"])]
    df = spark.createDataFrame(rows, "grp int, tokens array<string>").coalesce(1)
    got = {tuple(r) for r in df.mapInArrow(blocks.counted, blocks.COUNTS).collect()}
    assert got == {(0, "a", 3, 2), (0, "b", 1, 1), (1, "b", 3, 2)}


def test_clusters_and_their_keywords(corpus):
    out = clusters.cluster_reviews(corpus, k=2, include_keywords=True, starts=2)
    rows = out.join(corpus, "review_id").collect()
    groups = {}
    for r in rows:
        if r["text"]:
            groups.setdefault(r["text"].split()[0], set()).add(r["cluster"])
            assert r["cluster_keywords"]
        else:
            assert r["cluster"] is None and r["cluster_keywords"] == []
    assert groups["battery"].isdisjoint(groups["login"])


@pytest.mark.parametrize("wanted,documents,k", [(10, 100, 10), (10, 9, 4), (5, 3, 2)])
def test_small_data_rule(wanted, documents, k):
    assert topics.fit_size(wanted, documents) == k


def test_analysis_keeps_all_columns(corpus):
    result = analysis.analyze(corpus, ("sentiment", "topics", "keywords"), n_topics=2, n_keywords=3)
    assert {"rating", "sentiment", "sentiment_compound", "primary_topic"} <= set(result["reviews"].columns)
    assert result["reviews"].count() == 30 and result["keywords"].count() == 3
    with pytest.raises(ValueError):
        analysis.analyze(corpus, ("mood",))


def test_groups_and_starts_fitted_together_equal_each_alone(spark):
    rng = np.random.default_rng(4)
    words = [f"{c}{i}" for c in "abcd" for i in range(12)]
    rows = []
    for i in range(240):
        theme = "abcd"[i % 4]
        own = [w for w in words if w.startswith(theme)]
        rows.append((i, " ".join([*rng.choice(own, 9), *rng.choice(words, 3)]), i % 2))
    df = spark.createDataFrame(rows, "review_id int, text string, half int").repartition(4)
    both = clusters.term_vectors(df, "review_id", "text", (), 40, 1, None, F.col("half"), 2)
    fits = clusters.fit_groups(both, "review_id", [2, 3], starts=4)
    vectors = {r["review_id"]: r for r in both.rows.collect()}

    def dense(r):
        out = np.zeros(len(both.terms[r["grp"]]))
        out[r["at"]] = r["weight"]
        return out

    home = {r["review_id"]: r["cluster"] for r in clusters.assigned(both, "review_id", fits).collect()}
    assert set(home) == set(range(240))
    for half in (0, 1):
        centres = fits.of(half)
        own = {i: dense(r) for i, r in vectors.items() if r["grp"] == half}
        # Everyone is with the nearest centre, every centre is the mean of its own, the cost is theirs.
        for i, x in own.items():
            assert home[i] == int(((centres - x) ** 2).sum(axis=1).argmin())
        for c, centre in enumerate(centres):
            assert np.allclose(centre, np.mean([x for i, x in own.items() if home[i] == c], axis=0), atol=1e-3)
        cost = sum(((centres[home[i]] - x) ** 2).sum() for i, x in own.items())
        assert fits.cost[half] == pytest.approx(cost, rel=1e-3)
        # One group alone, start by start: none is cheaper.
        alone = clusters.term_vectors(df.filter(F.col("half") == half), "review_id", "text", (), 40, 1, None)
        single = [clusters.fit_groups(alone, "review_id", [[2, 3][half]], 1, clusters.SEED + s).cost[0] for s in range(4)]
        assert fits.cost[half] == pytest.approx(min(single), rel=1e-6)


def test_term_vectors_equal_their_definition(spark):
    rows = [(1, "login crash crash", 0), (2, "login screen", 0), (3, "", 0), (4, "login battery", 0), (5, "other words", 1)]
    df = spark.createDataFrame(rows, "review_id int, text string, g int")
    got = clusters.term_vectors(df, "review_id", "text", (), 10, 1, 0.9, F.col("g"), 3)
    # In every text of its group: too frequent. The third group has no rows.
    assert [sorted(t) for t in got.terms] == [["battery", "crash", "screen"], [], []] and got.sizes == [3, 1, 0]
    by_id = {r["review_id"]: dict(zip([got.terms[r["grp"]][i] for i in r["at"]], r["weight"])) for r in got.rows.collect()}
    assert by_id == {1: {"crash": 1.0}, 2: {"screen": 1.0}, 4: {"battery": 1.0}, 5: {}}


# --- vectors -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], i % 3) for i in range(300)]
    # A third of the collection are copies of one vector.
    rows += [(1000 + i, rows[0][1], 1) for i in range(150)]
    return spark.createDataFrame(rows, "id int, embedding array<float>, label int").repartition(5)


def brute(points, query, k, label=None):
    rows = [
        (round(float(((np.array(r["embedding"], dtype="f8") - query) ** 2).sum()), 9), r["id"])
        for r in points.collect()
        if label is None or r["label"] == label
    ]
    return [i for _, i in sorted(rows)[:k]]


@pytest.mark.parametrize("size", [100, 1000, 1 << 19])
def test_search_many_is_exact(spark, monkeypatch, points, size):
    # Many blocks of a few vectors, or one.
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", size)
    rows = [r for r in points.orderBy("id").limit(5).collect()]
    queries = spark.createDataFrame([(r["id"], r["embedding"]) for r in rows], "query_id int, embedding array<float>")
    found = vectors.search_many(points, queries, 7).collect()
    for r in rows:
        got = [f["id"] for f in sorted((f for f in found if f["query_id"] == r["id"]), key=lambda f: f["rank"])]
        assert got == brute(points, np.array(r["embedding"], dtype="f8"), 7)


def test_filtered_search(points):
    query = np.array(points.filter("id = 5").first()["embedding"], dtype="f8")
    got = [r["id"] for r in vectors.search(points, query, 4, {"label": 2}).collect()]
    assert got == brute(points, query, 4, 2)


def test_nearest_join_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 64)
    rows = [("a", [0.0, 0.0]), ("a", [0.0, 0.0]), (None, [0.0, 0.0]), ("b", [1.0]), ("c", None), ("d", [1.0, None]),
            ("e", [float("nan"), 1.0]), ("f", [3.0, 4.0]), ("g", [])]
    df = spark.createDataFrame([(i, v, "k", 1) for i, v in rows], "id string, embedding array<double>, kind string, rank int")
    asked = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [2.0]), (3, None), (4, [])], "query_id int, embedding array<double>")
    got = sorted((tuple(r) for r in vectors.search_many(df, asked, 4, {"kind": "k"}, keep=("kind",)).collect()), key=repr)
    one = [(1, "a", "k", 0.0, 1), (1, "a", "k", 0.0, 2), (1, None, "k", 0.0, 3), (1, "f", "k", 25.0, 4)]
    assert got == sorted([*one, *one, (2, "b", "k", 1.0, 1), (4, "g", "k", 0.0, 1)], key=repr)
    assert vectors.search_many(df.limit(0), asked).count() == 0 and vectors.search_many(df, asked.limit(0)).count() == 0


@pytest.fixture(scope="module")
def index(spark, points):
    rare = F.when(F.col("id") % 25 == 0, "rare").otherwise("often")
    more = spark.createDataFrame([(5000, [1.0, 2.0], 0), (5001, [1.0, 2.5], 0), (5002, None, 0)], "id int, embedding array<float>, label int")
    rows = points.unionByName(more).withColumn("kind", rare)
    return rows, neighbours.build_index(rows, scratch_path(spark, "index"), keep=("label", "kind"))


def test_index_recall_against_the_exact_search(spark, index):
    rows, path = index
    asked = rows.filter("id < 60").select(F.col("id").alias("query_id"), "embedding")
    pairs = lambda df: {(r["query_id"], r["id"]) for r in df.collect()}
    exact, found = pairs(vectors.search_many(rows, asked, 10)), pairs(neighbours.search_index(spark, path, asked, 10))
    assert len(found) == len(exact) == 600 and len(found & exact) >= 0.9 * len(exact)
    # All lists looked at: nothing is missing.
    assert pairs(neighbours.search_index(spark, path, asked, 10, probes=1000)) == exact


def test_index_search_widens_until_there_are_k_rows(spark, index):
    rows, path = index
    asked = rows.filter("id in (1, 2, 3)").select(F.col("id").alias("query_id"), "embedding")
    n_rare = rows.filter("kind = 'rare' and size(embedding) = 8").count()
    for k in (5, n_rare, n_rare + 10):
        got = neighbours.search_index(spark, path, asked, k, probes=1, criteria={"kind": "rare"}).collect()
        assert len(got) == 3 * min(k, n_rare) and {r["kind"] for r in got} == {"rare"}
    assert neighbours.search_index(spark, path, asked, 3, criteria={"kind": "none"}).count() == 0


def test_index_holds_other_lengths_and_takes_more_rows(spark, index):
    rows, path = index
    asked = spark.createDataFrame([(1, [1.0, 2.1]), (2, [1.0]), (3, None)], "query_id int, embedding array<double>")
    got = neighbours.search_index(spark, path, asked, 5).orderBy("rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(1, 5000), (1, 5001)]
    added = spark.createDataFrame([(6000, [1.0, 2.1], 4, "new")], "id int, embedding array<double>, label int, kind string")
    neighbours.add_to_index(added, path)
    assert neighbours.search_index(spark, path, asked, 1).first()["id"] == 6000


def test_index_of_nothing(spark, points):
    path = neighbours.build_index(points.limit(0), scratch_path(spark, "index-empty"))
    asked = points.limit(3).select(F.col("id").alias("query_id"), "embedding")
    assert neighbours.search_index(spark, path, asked).count() == 0


def test_delete_needs_a_condition(spark, points):
    with pytest.raises(ValueError):
        vectors.delete_documents(points)
    assert vectors.delete_documents(points, [5, 6]).count() == 448
    assert vectors.delete_documents(points, criteria={"label": 0}).filter("label = 0").count() == 0


def test_index_skips_empty_text(spark, corpus):
    collection = vectors.index_documents(corpus)
    assert collection.count() == 24 and dict(collection.dtypes)["id"] == "string"


# --- samples and prompts -------------------------------------------------------------


@pytest.mark.parametrize("focus", ["negative", "positive", "equal", "balanced", "other"])
@pytest.mark.parametrize("size", [7, 100, 150, 151])
def test_quotas_add_up(focus, size):
    quotas = sampling.rating_quotas(size, focus)
    assert sum(quotas.values()) == size and min(quotas.values()) >= 1


def test_quota_values():
    assert sampling.rating_quotas(150) == {1: 38, 2: 22, 3: 30, 4: 22, 5: 38}


def skewed(spark, n=900):
    rating = F.when(F.col("id") % 3 > 0, 5).otherwise(1 + (F.col("id") / 3).cast("int") % 3)
    return spark.range(n).select(F.col("id").alias("review_id"), rating.alias("rating"))


def test_sample_does_not_depend_on_partitioning(spark):
    df = skewed(spark)
    one = {r["review_id"] for r in sampling.stratified_sample(df.repartition(1)).collect()}
    many = {r["review_id"] for r in sampling.stratified_sample(df.repartition(13)).collect()}
    assert one == many and len(one) == 80


def test_quota_sample_takes_all_of_a_small_rating(spark):
    df = skewed(spark).filter("rating <> 2 or review_id < 20")
    counts = {r["rating"]: r["count"] for r in sampling.quota_sample(df, 100).groupBy("rating").count().collect()}
    small = df.filter("rating = 2").count()
    assert counts == {1: 25, 2: small, 3: 20, 5: 25}


def test_cluster_sample_of_small_ratings_and_nothing(spark, corpus):
    few = corpus.withColumn("rating", F.when(F.col("review_id") < 3, 5).when(F.col("review_id") < 12, 4).otherwise(1))
    out = sampling.cluster_sample(few, 20, "positive").groupBy("rating").count().collect()
    quotas = sampling.rating_quotas(20, "positive")
    assert {r["rating"]: r["count"] for r in out} == {5: min(3, quotas[5]), 4: min(9, quotas[4]), 1: quotas[1]}
    assert sampling.cluster_sample(corpus.limit(0), 20).count() == 0


def test_cluster_sample_meets_its_quotas(spark, corpus):
    out = sampling.cluster_sample(corpus.withColumn("rating", F.lit(1)), 20, "negative")
    assert out.count() == sampling.rating_quotas(20, "negative")[1]
    assert out.select("review_id").distinct().count() == out.count()


def test_large_samples_give_several_prompts(spark):
    df = spark.range(1, 251).select(F.col("id").alias("position"), F.lit(4).alias("rating"), F.lit("t").alias("text"))
    df = df.withColumn("date", F.lit(None).cast("timestamp"))
    rows = prompts.prompt_table(df, types=("general", "issues"), closing="Bye.").collect()
    assert sorted((r["analysis_type"], r["prompt_no"]) for r in rows) == [
        (t, i) for t in ("general", "issues") for i in (1, 2, 3)
    ]
    assert sum(r["prompt"].count("Review ") for r in rows) == 500
    assert all(r["prompt"].startswith("Task: ") and r["prompt"].endswith("\n\nBye.") for r in rows)


def test_searches_pass_over_null_embeddings(spark):
    rows = spark.createDataFrame([(1, None), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id int, embedding array<double>")
    assert [r["id"] for r in vectors.search(rows, [0.0, 1.0], 3).collect()] == [2, 3]
    asked = spark.createDataFrame([(7, [1.0, 1.0]), (8, None)], "query_id int, embedding array<double>")
    assert [(r["query_id"], r["id"]) for r in vectors.search_many(rows, asked, 1).collect()] == [(7, 3)]


def test_unknown_models_have_the_default_limit(spark):
    df = spark.createDataFrame([("x" * 30000,)], "prompt string")
    (row,) = prompts.token_estimate(df, models=("some-model",)).collect()
    assert (row["model_limit"], row["status"], row["estimated_cost"]) == (8192, "Exceeds limit", None)


def test_token_estimate(spark):
    df = spark.createDataFrame([("x" * 30000,)], "prompt string")
    rows = {r["model"]: r for r in prompts.token_estimate(df, system_prompt="y" * 40).collect()}
    assert rows["gpt-4"]["status"] == "Exceeds limit" and rows["gpt-4o"]["status"] == "Within limit"
    assert rows["gpt-4"]["total_tokens"] == 7500 + 10 + 1800
    assert rows["gpt-4o"]["estimated_cost"] == pytest.approx(7510 / 1000 * 0.01 + 1.8 * 0.02, abs=1e-4)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_worked_out_once(spark):
    """The filter on a computed text is not pushed below what computes it."""
    docs = spark.createDataFrame([(1, "a text"), (2, ""), (3, None)], "id int, text string")
    cleaned = docs.select("id", text.clean_text("text").alias("c"))
    got = tokens.with_text(cleaned, "c", "id")
    assert [tuple(r) for r in got.collect()] == [(1, "a text")]
    assert plan_of(got).count("(?:http|www)") == 1 < plan_of(cleaned.filter("length(c) > 0")).count("(?:http|www)")


def test_word_lists_have_a_known_size(spark):
    for table in (lex.word_table(spark), lex.phrase_table(spark, {"of the": 1})):
        assert plan_of(table).startswith("LocalRelation") and dict(table.dtypes)["valence"] == "double"


def test_stems_are_looked_up_by_distinct_token(spark):
    rows = [(1, ["Running", "cats", "relational", "Is"]), (2, []), (3, None), (4, ["cats", "cats"])]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    got = tokens.stem_tokens(df, "id", "t")
    assert {r["id"]: r["stems"] for r in got.collect()} == {1: ["run", "cat", "relat", "Is"], 2: [], 3: [], 4: ["cat", "cat"]}
    # Stemming stands before the join, over distinct tokens: nothing of it is in the plan of the rows.
    assert "ational" not in plan_of(got).split("InMemoryRelation")[0]


def test_a_task_holds_the_nearest_of_all_blocks_it_meets():
    rng = np.random.default_rng(1)
    query, rows = rng.integers(0, 3, (40, 4)).astype(float), rng.integers(0, 3, (3000, 4)).astype(float)
    best = neighbours._Best(pa.array(range(40)), 3)
    for i in range(0, 3000, 100):
        ids = pa.array(np.arange(i, i + 100))
        entries = pa.StructArray.from_arrays([ids], names=["id"])
        best.meet(query, rows[i : i + 100], entries, np.arange(100))
        assert best.rows <= 9 * 40 * 3
    of, entries, score = best.best()
    for q in range(40):
        distance = ((rows - query[q]) ** 2).sum(axis=1)
        first = np.lexsort((np.arange(3000), distance))[:3]
        mine = of == q
        assert entries.field(0).to_numpy()[mine].tolist() == first.tolist() and score[mine].tolist() == distance[first].tolist()


def test_queries_of_an_index_are_not_sent_to_the_driver(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i)]) for i in range(60)], "id int, embedding array<double>")
    path = neighbours.build_index(rows, scratch_path(spark, "merge-index"))
    asked = rows.select(F.col("id").alias("query_id"), "embedding")
    found = neighbours.search_index(spark, path, asked, 3)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert found.count() == 180


CORPUS = [(i, f"word{i % 7} term{i % 3} term{i % 3} rare{i} common") for i in range(40)] + [(40, ""), (41, None)]


def test_count_features_keep_texts_and_no_token_lists(spark):
    df = spark.createDataFrame(CORPUS, "id int, t string")
    features, vocabulary = topics.count_features(df, "id", "t", ["the"])
    held = plan_of(features).split("InMemoryRelation [")[1].split("]")[0]
    assert "tokens" not in held and "StorageLevel(disk, 1 replicas)" in plan_of(features)
    # In all texts is too many, in one too few; by count, then by word.
    assert vocabulary == ["term0", "term1", "term2", *[f"word{i}" for i in range(7)]]
    assert sorted(r["id"] for r in features.collect()) == list(range(40))
    assert {r["id"]: r["features"].toArray().tolist() for r in features.collect()}[8] == [0, 0, 2, 0, 1, 0, 0, 0, 0, 0]


def test_texts_of_a_kept_frame_are_not_kept_again(spark):
    df = spark.createDataFrame(CORPUS, "id int, t string").cache()
    assert tokens.kept_texts(df, "t", "id").storageLevel.useDisk is False
    df.unpersist()
    assert tokens.kept_texts(df, "t", "id").storageLevel.useMemory is False


def test_settled_topics_let_go_of_their_features(spark):
    rows = [(i, "good nice great" if i % 2 else "crash bug broken") for i in range(12)]
    result = topics.lda_topics(spark.createDataFrame(rows, "review_id int, normalized_text string"), k=2)
    assert result.features.storageLevel.useMemory
    result.settled()
    assert not result.features.storageLevel.useMemory and result.assigned.storageLevel.useMemory
    assert result.documents.filter("primary_topic is not null").count() == 12


def test_tokens_are_taken_apart_a_bounded_number_at_a_time(monkeypatch):
    lists = [["a", "b", "a"], ["b"], [], ["c"] * 9, [], ["a", "c"], ["b"]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(7)), pa.array([0] * 7, pa.int32()), pa.array(lists, pa.list_(pa.string()))], names=["id", "grp", "tokens"]
    )
    places = [{"a": (0, 1.0), "b": (1, 1.0), "c": (2, 1.0)}]

    def results():
        found = pa.Table.from_batches(list(blocks.counted(iter([batch.select(["grp", "tokens"])])))).to_pylist()
        rows = []
        for part in blocks.packed(places, unit=False)(iter([batch])):
            for i, (_, lengths, at, weight) in enumerate(blocks.entries(part)):
                ends = np.cumsum(lengths)
                keys = part.column("keys").slice(i, 1).flatten().to_pylist()
                rows += [(k, at[e - n : e].tolist(), weight[e - n : e].tolist()) for k, n, e in zip(keys, lengths, ends)]
        return sorted((r["term"], r["cf"], r["df"]) for r in found), rows

    whole = results()
    assert whole[0] == [("a", 3, 2), ("b", 3, 3), ("c", 10, 2)] and [r[0] for r in whole[1]] == list(range(7))
    monkeypatch.setattr(blocks, "TOKENS_AT_ONCE", 4)
    parts = list(blocks._parts(iter([batch]), 2))
    assert [p.num_rows for p in parts] == [3, 1, 3]
    assert results() == whole


def test_factors_keep_no_token_lists_and_count_rows_that_share_a_key_as_one(spark):
    rows = [(i, "good nice great" if i % 2 else "crash bug broken") for i in range(12)]
    split = [(i, w) for i, t in rows for w in (t.split(" ", 1))] + [(90, "")]
    results = []
    for given in (rows, split):
        result = topics.nmf_topics(spark.createDataFrame(given, "review_id int, normalized_text string"), k=2)
        results.append({r["review_id"]: round(r["topic_confidence"], 6) for r in result.documents.collect() if r["review_id"] != 90})
        held = [part.split("]")[0] for part in plan_of(result.documents).split("InMemoryRelation [")[1:]]
        assert held and not any("tokens" in columns for columns in held)
    assert results[0] == results[1] and len(results[0]) == 12


def test_analysis_keeps_what_several_analyses_read_on_disk_and_once(spark):
    rows = [(i, f"c{i} good app", "good nice great" if i % 2 else "crash bug broken") for i in range(12)]
    df = spark.createDataFrame(rows, "review_id int, cleaned_text string, normalized_text string")
    out = analysis.analyze(df, ("sentiment", "topics", "clusters", "keywords"), n_topics=2, n_clusters=2)
    texts = df.select("review_id", "normalized_text")
    assert texts.storageLevel.useDisk and not texts.storageLevel.useMemory
    assert not df.select("review_id", "cleaned_text", "normalized_text").storageLevel.useDisk
    # Beside it results alone are kept: neither features nor blocks.
    assert "features" not in plan_of(out["reviews"]).split("InMemoryRelation [")[1].split("]")[0]
    got = out["reviews"].collect()
    assert len(got) == 12 and all(r["sentiment"] == "positive" and r["primary_topic"] is not None and r["cluster"] is not None for r in got)
    assert out["keywords"].count() == 6
