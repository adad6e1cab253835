import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from opinio.functions import text
from opinio.operators import cleaning, tokens


def column(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["o"] for r in rows.select("i", fn("t").alias("o")).orderBy("i").collect()]


def test_clean_text(spark):
    given = [
        None,
        "",
        "<b>Hi</b>",
        "see http://x.y/z now",
        "a@b.co mail @home me@",
        "Café №5 — 100%",
        "12345",
        "x \ty\n z",
        "a <b\n> c",
    ]
    assert column(spark, given, text.clean_text) == [
        "",
        "",
        "hi",
        "see now",
        "mail home me",
        "café",
        "",
        "x y z",
        "a b c",
    ]


def test_clean_text_follows_the_plain_rules(spark, sf):
    """The published order of substitutions, applied by hand to whole documents."""
    import re

    def by_hand(t):
        t = t.lower()
        for pattern in (r"<.*?>", r"http\S+|www\S+|https\S+", r"\S+@\S+", r"[^\w\s]", r"\d+"):
            t = re.sub(pattern, "", t)
        return re.sub(r"\s+", " ", t).strip()

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", text.clean_text("text").alias("c"))
    for row in docs.collect():
        assert row["c"] == by_hand(row["text"])


def test_basic_clean_keeps_link_words(spark):
    assert column(spark, ["See http://x.y, A1!"], text.basic_clean) == ["see httpxy a"]


def test_tokenize_splits_contractions(spark):
    assert column(spark, ["you cannot gotta canary", None, " "], text.tokenize) == [
        ["you", "can", "not", "got", "ta", "canary"],
        [],
        [],
    ]


def test_stop_words_for_every_language(spark):
    for language in text.STOP_WORD_LANGUAGES:
        assert len(text.stop_words(language)) > 50
    with pytest.raises(ValueError):
        text.stop_words("klingon")


def test_remove_stopwords_case(spark):
    df = spark.createDataFrame([(["The", "app", "the"],)], "t array<string>")
    loose, exact = df.select(
        text.remove_stopwords("t", ["the"]), text.remove_stopwords("t", ["the"], exact=True)
    ).first()
    assert loose == ["app"] and exact == ["The", "app"]


def test_normalize(spark):
    out = column(
        spark,
        ["the apps crash on it", None],
        lambda c: text.normalize_text(c, ["the", "on", "it"], {"apps": "app"}),
    )
    assert out == ["app crash", ""]


def test_word_measures(spark):
    given = ["one  three", "", None, "  a\n"]
    assert column(spark, given, text.word_count) == [2, 0, 0, 1]
    assert column(spark, given, text.avg_word_length) == [4.0, 0.0, 0.0, 1.0]


@pytest.mark.parametrize(
    "length,name", [(0, "empty"), (1, "very_short"), (50, "short"), (199, "short"), (200, "medium"), (500, "long")]
)
def test_length_category(spark, length, name):
    assert spark.range(1).select(text.length_category(F.lit(length))).first()[0] == name


def test_lemma_join_keeps_order_and_empty_documents(spark):
    docs = spark.createDataFrame([(1, ["mice", "eat", "mice"]), (2, [])], "id int, t array<string>")
    lemmas = spark.createDataFrame([("mice", "mouse")], "form string, lemma string")
    out = {r["id"]: r["lemmas"] for r in tokens.lemmatize_tokens(docs, "id", "t", lemmas).collect()}
    assert out == {1: ["mouse", "eat", "mouse"], 2: []}


def test_preprocess_with_a_lemma_frame_and_stems(spark):
    docs = spark.createDataFrame([(1, "The mice were running!"), (2, None)], "review_id int, text string")
    many = spark.range(1000).select(F.concat(F.lit("form"), "id").alias("form"), F.lit("x").alias("lemma"))
    lemmas = many.unionByName(spark.createDataFrame([("mice", "mouse")], "form string, lemma string"))
    out = cleaning.preprocess(docs, stops=["the"], lemmas=lemmas, stem=True).collect()
    assert {r["review_id"]: r["normalized_text"] for r in out} == {1: "mous were run", 2: ""}
    small = {f"form{i}": "x" for i in range(1000)} | {"mice": "mouse"}
    out = cleaning.preprocess(docs, stops=["the"], lemmas=small).collect()
    assert {r["review_id"]: r["normalized_text"] for r in out} == {1: "mouse were running", 2: ""}


STEMS = {
    "caresses": "caress",
    "ponies": "poni",
    "feed": "feed",
    "agreed": "agre",
    "plastered": "plaster",
    "motoring": "motor",
    "sing": "sing",
    "conflated": "conflat",
    "hopping": "hop",
    "falling": "fall",
    "filing": "file",
    "happy": "happi",
    "sky": "sky",
    "relational": "relat",
    "rational": "ration",
    "vietnamization": "vietnam",
    "hopefulness": "hope",
    "electrical": "electr",
    "adoption": "adopt",
    "replacement": "replac",
    "effective": "effect",
    "probate": "probat",
    "rate": "rate",
    "controll": "control",
    "is": "is",
}


def test_stems(spark):
    docs = spark.createDataFrame([(1, list(STEMS)), (2, [])], "id int, t array<string>")
    out = {r["id"]: r["stems"] for r in tokens.stem_tokens(docs, "id", "t").collect()}
    assert out == {1: list(STEMS.values()), 2: []}


def test_preprocess_fallback_accepts_aliases(spark):
    df = spark.createDataFrame([("The BEST, app 5",)], "content string")
    row = cleaning.preprocess_basic(df).first()
    assert (row["cleaned_text"], row["normalized_text"]) == ("the best app", "best app")


def test_json_recovery(spark):
    from opinio.operators import prompts

    df = spark.createDataFrame([('ok {"a": {"b": 1}} end',), ("none",), ("{bad",), ("{bad}",)], "reply string")
    out = [(r["body"], r["format_error"]) for r in prompts.parse_replies(df).collect()]
    assert out == [
        ('{"a": {"b": 1}}', None),
        (None, "No JSON found in response"),
        (None, "No JSON found in response"),
        (None, "Invalid JSON in response"),
    ]


def test_english_stop_words_are_those_spark_ships(spark):
    assert set(text.stop_words()) == set(StopWordsRemover.loadDefaultStopWords("english"))


def test_lemmas_by_endings_lead_to_dictionary_words(spark):
    words = lambda ws, c: spark.createDataFrame([(w,) for w in ws], f"{c} string")
    forms = words(["dogs", "dog", "ladies", "wolves", "women", "boxes", "glass", "churches", "geese", "xyzs", "s", "has", "", "oxen"], "form")
    dictionary = words(["dog", "lady", "wolf", "woman", "box", "boxe", "glass", "church", "goose", "ha", "ox", "oxen"], "lemma")
    irregular = spark.createDataFrame([("geese", "goose"), ("oxen", "ox"), ("mice", "mouse"), ("dogs", "hound")], "form string, lemma string")
    got = {r["form"]: r["lemma"] for r in tokens.lemmas_by_rule(forms, dictionary).collect()}
    assert got == {"dogs": "dog", "ladies": "lady", "wolves": "wolf", "women": "woman", "boxes": "box", "churches": "church", "has": "ha"}
    with_them = {r["form"]: r["lemma"] for r in tokens.lemmas_by_rule(forms, dictionary, irregular).collect()}
    # An irregular form has its own lemmas only; one the dictionary lacks is none.
    assert with_them == {**{k: v for k, v in got.items() if k != "dogs"}, "geese": "goose", "oxen": "ox"}


def test_preprocessing_with_lemmas_keeps_a_null_key(spark):
    df = spark.createDataFrame([("a", "Big dogs bark"), (None, "Two dogs"), ("c", None)], "review_id string, text string")
    lemmas = spark.createDataFrame([("dogs", "dog")], "form string, lemma string")
    got = {r["review_id"]: r["normalized_text"] for r in cleaning.preprocess(df, stops=(), lemmas=lemmas).collect()}
    assert got == {"a": "big dog bark", None: "two dog", "c": ""}


def test_cleaned_texts_are_not_squeezed_again(spark):
    odd = ["Wanna  go\t\u2028now", " gimme\xa0it \x1c!", "a . b -- cannot", "", None, "\u3000", "x\u200by \x85 Gotta"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "review_id int, text string")
    out = cleaning.preprocess(df, stops=())
    plan = out.select("normalized_text")._jdf.queryExecution().optimizedPlan().toString()
    # Once, by the cleaning itself.
    assert plan.count(text.BLANKS) == 1
    want = text.normalize_text("cleaned_text", ())
    assert out.filter(~F.col("normalized_text").eqNullSafe(want)).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


REPEATED = [(1, ["mice", "eat", "mice"]), (1, ["cats"]), (None, ["eats"]), (None, ["mice", None]), (2, None), (3, [])]


def test_stems_of_documents_never_become_token_rows(spark):
    docs = spark.createDataFrame(REPEATED, "id int, t array<string>")
    got = tokens.stem_tokens(docs, "id", "t")
    assert "Generate" not in plan_of(got) and "InMemoryRelation" not in plan_of(got)
    # Rows that share a key are one document, by place and then by word.
    out = {r["id"]: r["stems"] for r in got.collect()}
    assert out == {1: ["cat", "mice", "eat", "mice"], None: ["eat", "mice", None], 2: [], 3: []}


def test_stem_of_a_word_column(spark):
    words = ["Hopping", "SKY", "Is", None, "", "ponies"]
    out = [r["stem"] for r in tokens.with_stem(spark.createDataFrame([(w,) for w in words], "token string")).collect()]
    assert out == ["hop", "sky", "Is", None, "", "poni"]


def test_lemmas_are_looked_up_as_they_would_be_joined(spark, monkeypatch):
    docs = spark.createDataFrame(REPEATED, "id int, t array<string>")
    lemmas = spark.createDataFrame([("mice", "mouse"), ("eats", "eat"), ("cats", None), (None, "none")], "form string, lemma string")
    looked_up = tokens.lemmatize_tokens(docs, "id", "t", lemmas)
    assert "Generate" not in plan_of(looked_up) and "Join" not in plan_of(looked_up)
    twice = tokens.lemmatize_tokens(docs, "id", "t", lemmas.unionByName(lemmas.filter("form = 'mice'")))
    assert "Join" in plan_of(twice)
    monkeypatch.setattr(tokens, "LOOKED_UP", 1)
    joined = tokens.lemmatize_tokens(docs, "id", "t", lemmas)
    assert "Join" in plan_of(joined)
    out = [{r["id"]: r["lemmas"] for r in df.collect()} for df in (looked_up, joined)]
    assert out[0] == out[1] == {1: ["cats", "mouse", "eat", "mouse"], None: ["eat", "mouse", None], 2: [], 3: []}


@pytest.mark.parametrize("stem", [False, True])
def test_preprocess_with_lemmas_moves_rows_once(spark, monkeypatch, stem):
    rows = [(1, "The mice eats"), (1, "Cats running"), (None, "mice"), (None, "a cat"), (2, None), (3, "eats")]
    docs = spark.createDataFrame(rows, "review_id int, text string")
    lemmas = spark.createDataFrame([("mice", "mouse"), ("eats", "eat")], "form string, lemma string")
    got = cleaning.preprocess(docs, stops=["the"], lemmas=lemmas, stem=stem)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan and "Join" not in plan
    monkeypatch.setattr(tokens, "LOOKED_UP", 1)
    joined = cleaning.preprocess(docs, stops=["the"], lemmas=lemmas, stem=stem)
    assert "Join" in plan_of(joined)
    out = [sorted(map(str, df.select("review_id", "cleaned_text", "normalized_text").collect())) for df in (got, joined)]
    assert out[0] == out[1] and len(out[0]) == 6
    both = {r["normalized_text"] for r in got.filter("review_id = 1").collect()}
    assert both == ({"cat mous eat run"} if stem else {"cats mouse eat running"})
