"""Word counts, TF-IDF, keywords, sentiment, topics and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinio.functions import lexicon as lex
from opinio.functions import rates, text
from opinio.operators import (
    analysis,
    cleaning,
    clusters,
    distributions,
    findings,
    keywords,
    sentiment,
    topics,
)
from opinio.operators import versions as by_version
from opinio.plans.base import (
    clean_sql,
    english_stop_words,
    normalize_sql,
    query,
    review_texts,
    table,
    terms_sql,
    with_views,
    without_sql,
    words_sql,
)

CLEANED = f"select doc_id, {clean_sql('text')} as c from documents"
NORMALIZED = f"select doc_id, {normalize_sql('c', english_stop_words())} as n from ({CLEANED})"


def normalized(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return cleaning.preprocess(docs).select("doc_id", "normalized_text")


def text_reviews(spark, sf):
    rows = cleaning.preprocess(review_texts(spark, sf))
    return rows.withColumns(
        {"sentiment": rates.rating_sentiment("rating"), "has_response": rates.has_response("replied_at")}
    )


def _frequency_sql(k: int, source: str, column: str) -> str:
    return f"""select word, count(*) as n from (select unnest({words_sql(column)}) as word from ({source}))
      group by word order by n desc, word limit {k}"""


@query("A31_word_frequency", _frequency_sql(15, NORMALIZED, "n"))
def word_frequency(spark, sf):
    return keywords.word_frequency(normalized(spark, sf), "normalized_text", 15)


@query("A31_word_cloud", _frequency_sql(100, "select text from documents", "text"))
def word_cloud(spark, sf):
    return keywords.word_frequency(table(spark, sf, "documents"), "text", 100)


def _terms_views(source: str, column: str, limit: int) -> dict[str, str]:
    stops = english_stop_words()
    return {
        "source": source,
        "size": "select count(*) as total from source",
        "tf": f"""select doc_id, term, count(*) as tf from (
          select doc_id, unnest({without_sql(terms_sql(column), stops)}) as term from source) group by doc_id, term""",
        "vocab": f"""select term, count(*) as df, sum(tf) as cf from tf group by term
          having count(*) >= 2 and count(*) <= 0.85 * (select total from size) order by cf desc, term limit {limit}""",
        "raw": """select doc_id, term, tf, df, tf * (ln((1.0 + (select total from size)) / (1 + df)) + 1) as raw
          from tf join vocab using (term)""",
        "weights": "select *, raw / sqrt(sum(raw * raw) over (partition by doc_id)) as weight from raw",
    }


@query(
    "F1_tfidf_features",
    with_views(
        "select doc_id, term, tf, round(weight, 9) as weight from weights",
        **_terms_views(NORMALIZED, "n", 10000),
    ),
)
def tfidf_features(spark, sf):
    rows = keywords.tfidf(normalized(spark, sf), "doc_id", "normalized_text", text.stop_words())
    return rows.select("doc_id", "term", "tf", F.round("weight", 9).alias("weight"))


def _keywords_sql(source: str, column: str) -> str:
    return with_views(
        f"""select s.term as keyword, s.score, coalesce(f.frequency, 0) as frequency, s.df as doc_count,
            100.0 * s.df / (select total from size) as doc_pct
            from (select term, any_value(df) as df, round(sum(weight), 6) as score from weights group by term
                  order by score desc, term limit 20) s
            left join (select term, count(*) as frequency from (
              select unnest({words_sql(column)}) as term from source) group by term) f using (term)""",
        **_terms_views(source, column, 10000),
    )


@query("A32_keywords", _keywords_sql(NORMALIZED, "n"))
def top_keywords(spark, sf):
    rows = keywords.keywords(normalized(spark, sf), "doc_id", "normalized_text", 20, text.stop_words())
    return rows.withColumn("score", F.round("score", 6))


@query("A32_keywords_raw_text", _keywords_sql("select doc_id, text from documents", "text"))
def top_keywords_raw(spark, sf):
    rows = keywords.keywords(table(spark, sf, "documents"), "doc_id", "text", 20, text.stop_words())
    return rows.withColumn("score", F.round("score", 6))


@query("F2_count_features")
def count_features(spark, sf):
    features, vocabulary = topics.count_features(
        normalized(spark, sf), "doc_id", "normalized_text", text.stop_words()
    )
    from pyspark.ml.functions import vector_to_array

    dense = vector_to_array("features")
    return features.select(
        "doc_id",
        F.lit(len(vocabulary)).alias("vocabulary"),
        F.aggregate(dense, F.lit(0.0), lambda acc, x: acc + x).alias("n_terms"),
    )


def _pairs_sql(pairs) -> str:
    return ", ".join(f"('{w}', {v})" for w, v in sorted(pairs.items()))


def _boost_sql(c: str) -> str:
    up = ", ".join(f"'{w}'" for w, s in lex.BOOSTERS.items() if s > 0)
    down = ", ".join(f"'{w}'" for w, s in lex.BOOSTERS.items() if s < 0)
    return f"(case when {c} in ({up}) then {lex.BOOST} when {c} in ({down}) then -{lex.BOOST} else 0.0 end)"


NEGATED = ", ".join(f"'{w}'" for w in lex.NEGATIONS)
EMPHATIC = "in ('so', 'this')"
DAMPENED = ", ".join(f"'{w}'" for w in lex.DAMPENING_PAIRS)

#: Sequences around a word in which a phrase is looked for, in order.
SEQUENCES = (
    "token || ' ' || a1 || ' ' || a2", "token || ' ' || a1", "b1 || ' ' || token", "b2 || ' ' || b1 || ' ' || token",
    "b2 || ' ' || b1", "b3 || ' ' || b2 || ' ' || b1", "b3 || ' ' || b2",
)


def _step_sql(i: int, emphatic: str) -> str:
    token, v = f"b{i}", f"v{i - 1}"
    return f"""select *, case when {token} is null or k{i} then {v} else
          case when {emphatic} then {lex.NEVER_SO[i - 1]} when {token} in ({NEGATED}) then {lex.NEGATION} else 1.0 end
          * ({v} + sign({v}) * {_boost_sql(token)} * {lex.DAMPING[i - 1]}) end as v{i}
          from {'hits' if i == 1 else f's{i - 1}'}"""


def _sentiment_views(source: str, phrases: dict[str, float] = lex.IDIOMS) -> dict[str, str]:
    known = ", ".join(f"coalesce(b{i} in (select token from lexicon), false) as k{i}" for i in (1, 2, 3))
    idiom = ", ".join(f"(select valence from phrases where phrase = {s})" for s in SEQUENCES)
    return {
        "token_lists": f"""select doc_id, list_filter({words_sql('lower(coalesce(c, ' + chr(39) * 2 + '))')},
          lambda w: length(w) >= 2) as w from ({source})""",
        "positions": """select doc_id, len(w) as n, list_position(w, 'but') as but, unnest(w) as token,
          unnest(generate_series(1, len(w))) as pos from token_lists""",
        "context": """select *, lag(token, 1) over d as b1, lag(token, 2) over d as b2, lag(token, 3) over d as b3,
          lead(token, 1) over d as a1, lead(token, 2) over d as a2
          from positions window d as (partition by doc_id order by pos)""",
        "lexicon": f"select * from (values {_pairs_sql(lex.WORDS)}) as v(token, valence)",
        "phrases": f"select phrase, cast(valence as double) as valence from (values {_pairs_sql(phrases)}) as v(phrase, valence)",
        "hits": f"""select c.*, cast(valence as double) as v0, {known} from context c join lexicon using (token)
          where token not in ({", ".join(f"'{w}'" for w in lex.BOOSTERS)})""",
        "s1": _step_sql(1, "false"),
        "s2": _step_sql(2, f"b2 = 'never' and b1 {EMPHATIC}"),
        "s3": _step_sql(3, f"(b3 = 'never' and b2 {EMPHATIC}) or b1 {EMPHATIC}"),
        "phrased": f"""select *, case when b3 is null or k3 then v3 else coalesce({idiom}, v3)
          - case when b3 || ' ' || b2 in ({DAMPENED}) or b2 || ' ' || b1 in ({DAMPENED}) then {lex.BOOST} else 0.0 end
          end as v4 from s3""",
        "s4": f"""select doc_id, case when b1 = 'least' and coalesce(b2, '') not in ('at', 'very')
            then {lex.NEGATION} else 1.0 end
          * case when but > 0 and pos < but then {lex.BUT_BEFORE} when but > 0 and pos > but then {lex.BUT_AFTER}
            else 1.0 end * v4 as v from phrased""",
        "sums": """select doc_id, round(sum(v), 10) as s, round(sum(case when v > 0 then v + 1 else 0 end), 10) as pos,
          round(sum(case when v < 0 then 1 - v else 0 end), 10) as neg, count(*) filter (v <> 0) as hits
          from s4 group by doc_id""",
        "totals": """select doc_id, coalesce(s, 0) as s, coalesce(pos, 0) as pos, coalesce(neg, 0) as neg,
          len(w) - coalesce(hits, 0) as plain from token_lists left join sums using (doc_id)""",
        "scores": """select doc_id,
          case when pos + neg + plain > 0 then round(neg / (pos + neg + plain), 3) else 0.0 end as sentiment_negative,
          case when pos + neg + plain > 0 then round(plain / (pos + neg + plain), 3) else 0.0 end as sentiment_neutral,
          case when pos + neg + plain > 0 then round(pos / (pos + neg + plain), 3) else 0.0 end as sentiment_positive,
          round(s / sqrt(s * s + 15), 4) as sentiment_compound from totals""",
    }


CLASS = """case when sentiment_compound >= 0.05 then 'positive' when sentiment_compound <= -0.05 then 'negative'
  else 'neutral' end"""


@query(
    "F3_lexicon_sentiment",
    with_views(f"select *, {CLASS} as sentiment from scores", **_sentiment_views(CLEANED)),
)
def lexicon_sentiment(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text.clean_text("text").alias("cleaned_text"))
    return sentiment.sentiment_scores(docs, "doc_id")


#: Phrases the documents hold around words of the lexicon, as a user's table might.
PHRASES = {
    **lex.IDIOMS,
    "and stupid": -1.0,
    "idiot the": 1.0,
    "of the": -0.5,
    "stupid and the": 2.0,
    "the disgusting": 1.5,
    "the of the": 0.7,
    "the trash": -3.0,
    "worthless of": 0.4,
}


@query(
    "F3_phrase_sentiment",
    with_views(f"select *, {CLASS} as sentiment from scores", **_sentiment_views(CLEANED, PHRASES)),
)
def phrase_sentiment(spark, sf):
    """Sentiment with a table of phrases beside that of words."""
    docs = table(spark, sf, "documents").select("doc_id", text.clean_text("text").alias("cleaned_text"))
    return sentiment.sentiment_scores(docs, "doc_id", phrases=lex.phrase_table(spark, PHRASES))


@query(
    "F3_sentiment_by_version",
    with_views(
        f"""select version, round(avg(sentiment_compound), 9) as avg_sentiment_compound, count(*) as n
            from texts join scores on doc_id = review_id group by version having count(*) >= 5""",
        **_sentiment_views(CLEANED),
    ),
)
def sentiment_by_version(spark, sf):
    rows = review_texts(spark, sf).withColumn("cleaned_text", text.clean_text("text"))
    scored = sentiment.add_sentiment(rows.select("review_id", "version", "cleaned_text"))
    out = by_version.metric_by_version(scored, "sentiment_compound", 5)
    return out.withColumn("avg_sentiment_compound", F.round("avg_sentiment_compound", 9))


# --- Models: no SQL form, checked by property tests ----------------------------------


def topic_reviews(spark, sf):
    """Text reviews with LDA topics and the topic words."""
    rows = text_reviews(spark, sf)
    result = topics.lda_topics(rows, "review_id", k=5, stops=text.stop_words())
    return rows.join(result.documents, "review_id"), result


@query("ML1_lda_topics")
def lda_topics(spark, sf):
    result = topics.lda_topics(
        normalized(spark, sf), "doc_id", "normalized_text", k=topics.TOPICS, stops=text.stop_words()
    )
    return result.topics.select("topic_id", F.array_join("words", ", ").alias("words"))


@query("ML2_topic_assignment")
def topic_assignment(spark, sf):
    return topics.lda_topics(
        normalized(spark, sf), "doc_id", "normalized_text", k=5, stops=text.stop_words()
    ).documents


@query("ML3_nmf_topics")
def nmf_topics(spark, sf):
    result = topics.nmf_topics(
        normalized(spark, sf), "doc_id", "normalized_text", k=5, stops=text.stop_words()
    )
    return result.documents


@query("ML4_kmeans_clusters")
def kmeans_clusters(spark, sf):
    return clusters.cluster_reviews(
        normalized(spark, sf), "doc_id", "normalized_text", stops=text.stop_words()
    )


@query("ML5_cluster_keywords")
def cluster_keywords(spark, sf):
    rows = clusters.cluster_reviews(
        normalized(spark, sf), "doc_id", "normalized_text", stops=text.stop_words(), include_keywords=True
    )
    return rows.select("doc_id", "cluster", F.array_join("cluster_keywords", ", ").alias("keywords"))


@query("ML6_combined_analysis")
def combined_analysis(spark, sf):
    rows = text_reviews(spark, sf).drop("sentiment")
    result = analysis.analyze(rows, analysis.TYPES, stops=text.stop_words(), n_topics=5)
    return result["reviews"].select(
        "review_id", "rating", "sentiment", "sentiment_compound", "primary_topic", "topic_confidence", "cluster"
    )


@query("ML6_other_frames")
def combined_frames(spark, sf):
    """Trend, keyword and topic-word frames of the combined analysis, one line each."""
    rows = text_reviews(spark, sf).drop("sentiment")
    result = analysis.analyze(rows, ("topics", "trends", "keywords"), stops=text.stop_words(), n_topics=5)
    lines = [
        result[name].select(F.lit(name).alias("frame"), F.to_json(F.struct(*result[name].columns)).alias("line"))
        for name in ("topic_words", "trends", "keywords")
    ]
    return lines[0].unionByName(lines[1]).unionByName(lines[2])


@query("A9_topic_by_version")
def topic_by_version(spark, sf):
    rows, _ = topic_reviews(spark, sf)
    return by_version.topic_by_version(rows)


@query("W4_top_topics_per_version")
def top_topics_per_version(spark, sf):
    rows, _ = topic_reviews(spark, sf)
    return by_version.top_topics_per_version(rows)


@query("A29_topic_findings")
def topic_findings(spark, sf):
    rows, _ = topic_reviews(spark, sf)
    return findings.key_findings(rows)


@query("A30_topic_distribution")
def topic_distribution(spark, sf):
    rows, result = topic_reviews(spark, sf)
    return distributions.topic_distribution(rows, result.labels())


# --- The same tables over a given topic ----------------------------------------------


def given_topics(spark, sf):
    """Text reviews whose topic is given: the length of the text, modulo five."""
    return review_texts(spark, sf).withColumn("primary_topic", (F.col("n_chars") % 5).cast("int"))


TOPIC_VERSIONS = {
    "pairs": "select version, cast(n_chars % 5 as int) as primary_topic, count(*) as n from texts where version is not null group by 1, 2",
    "sums": "select version, cast(sum(n) as bigint) as review_count from pairs group by 1 order by 2 desc, 1 limit 10",
    "shares": "select version, primary_topic, n, review_count, round(n * 100.0 / review_count, 1) as pct from pairs join sums using (version)",
}


@query("A9_given_topics", with_views("select * from shares", **TOPIC_VERSIONS))
def given_topic_by_version(spark, sf):
    return by_version.topic_by_version(given_topics(spark, sf))


@query(
    "W4_given_topics",
    with_views(
        """select * from (select *, cast(row_number() over (partition by version order by n desc, primary_topic) as int) as rank
             from shares) where rank <= 3""",
        **TOPIC_VERSIONS,
    ),
)
def given_top_topics(spark, sf):
    return by_version.top_topics_per_version(given_topics(spark, sf))
