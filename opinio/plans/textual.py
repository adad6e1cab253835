"""Text functions over whole documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinio.functions import rates, text, versions
from opinio.operators import cleaning, keywords, prompts, tokens
from opinio.plans.base import (
    basic_sql,
    clean_sql,
    english_stop_words,
    literals,
    normalize_sql,
    query,
    review_texts,
    reviews,
    squeeze_sql,
    table,
    terms_sql,
    tokens_sql,
    with_views,
    without_sql,
    words_sql,
)
from opinio.plans.rows import CODE
from opinio.session import keep


def documents(spark, sf):
    return table(spark, sf, "documents")


@query("T1_clean_text", f"select doc_id, {clean_sql('text')} as cleaned_text from documents")
def clean_text(spark, sf):
    return documents(spark, sf).select("doc_id", text.clean_text("text").alias("cleaned_text"))


@query("T1_clean_html", f"select page_id, {clean_sql('html')} as cleaned_text from pages")
def clean_html(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", text.clean_text("html").alias("cleaned_text"))


@query("T2_basic_clean", f"select doc_id, {basic_sql('text')} as cleaned_text from documents")
def basic_clean(spark, sf):
    return documents(spark, sf).select("doc_id", text.basic_clean("text").alias("cleaned_text"))


@query("T3_squeeze_whitespace", f"select doc_id, {squeeze_sql('text')} as squeezed from documents")
def squeeze_whitespace(spark, sf):
    return documents(spark, sf).select("doc_id", text.squeeze("text").alias("squeezed"))


@query(
    "T4_tokenize",
    f"""select doc_id, len(t) as n_tokens, array_to_string(t, '|') as tokens
        from (select doc_id, {tokens_sql('c')} as t from (select doc_id, {clean_sql('text')} as c from documents))""",
)
def tokenize(spark, sf):
    rows = documents(spark, sf).select("doc_id", text.tokenize(text.clean_text("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", "|").alias("tokens"))


@query(
    "T5_remove_stopwords",
    f"""select doc_id, array_to_string(list_filter({words_sql('text')},
          lambda t: lower(t) not in ({literals(english_stop_words())})), ' ') as kept from documents""",
)
def remove_stopwords(spark, sf):
    kept = text.remove_stopwords(text.words("text"), text.stop_words("english"))
    return documents(spark, sf).select("doc_id", F.array_join(kept, " ").alias("kept"))


def lemma_rule(column):
    """Lemma table derived from the corpus: plural forms in -s map to their base."""
    return F.when(
        (F.length(column) > 3) & F.col(column).endswith("s") & ~F.col(column).endswith("ss"),
        F.expr(f"substring({column}, 1, length({column}) - 1)"),
    ).otherwise(F.col(column))


@query(
    "T6_lemmatize",
    f"""select doc_id, array_to_string(list_transform({words_sql(clean_sql('text'))}, lambda w:
          case when length(w) > 3 and w like '%s' and w not like '%ss' then substr(w, 1, length(w) - 1) else w end),
          ' ') as lemmas from documents""",
)
def lemmatize(spark, sf):
    docs = keep(documents(spark, sf).select("doc_id", text.words(text.clean_text("text")).alias("tokens")))
    forms = tokens.one_per_row(docs, "tokens", "form").distinct()
    table_ = keep(forms.select("form", lemma_rule("form").alias("lemma")).filter("form <> lemma"))
    table_.count()
    rows = tokens.lemmatize_tokens(docs, "doc_id", "tokens", table_)
    return rows.select("doc_id", F.array_join("lemmas", " ").alias("lemmas"))


def dictionary(spark, sf):
    """The words of the documents as a dictionary of base words."""
    docs = documents(spark, sf).select(text.words(text.clean_text("text")).alias("tokens"))
    return tokens.one_per_row(docs, "tokens", "lemma").distinct()


def rule_lemmas(spark, sf):
    # Each text is taken apart once; forms and dictionary are both read from these words.
    words = keep(dictionary(spark, sf))
    words.count()
    irregular = spark.createDataFrame(sorted(IRREGULAR.items()), "form string, lemma string")
    return tokens.lemmas_by_rule(words.withColumnRenamed("lemma", "form"), words, irregular)


#: Irregular forms among the words of the documents, as a user's table might hold them.
IRREGULAR = {"is": "be", "was": "be", "stupid": "idiot", "these": "the"}

LEMMA_VIEWS = {
    "forms": f"select distinct unnest({words_sql(clean_sql('text'))}) as form from documents",
    "irregular": "select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in sorted(IRREGULAR.items())) + ") as v(form, lemma)",
    "tried": " union all ".join(
        ["select form, form as lemma, 0 as rule from forms", "select form, lemma, 1 from irregular where form in (select form from forms)"]
        + [
            f"select form, left(form, length(form) - {len(end)}) || '{by}', {i} from forms where form like '%{end}'"
            " and form not in (select form from irregular)"
            for i, (end, by) in enumerate(tokens.ENDINGS, 1)
        ]
    ),
    "lemmas": """select form, lemma from (select *, row_number() over (partition by form order by length(lemma), rule, lemma) as n
        from tried where lemma in (select form from forms)) where n = 1 and form <> lemma""",
}


@query("T6_rule_lemmas", with_views("select form, lemma from lemmas", **LEMMA_VIEWS))
def lemmas_by_rule(spark, sf):
    """Lemmas of all words of the documents by endings that lead to another of their words."""
    return rule_lemmas(spark, sf)


@query("T7_porter_stems")
def porter_stems(spark, sf):
    # Texts are laid out before they are taken apart: they are smaller than their words.
    docs = keywords.laid_out(documents(spark, sf), "doc_id", "text")
    docs = docs.select("doc_id", text.words(text.clean_text("text")).alias("tokens"))
    rows = tokens.stem_tokens(docs, "doc_id", "tokens")
    return rows.select("doc_id", F.array_join("stems", " ").alias("stems"))


@query(
    "T8_drop_short_tokens",
    f"""select doc_id, array_to_string(list_filter({words_sql(clean_sql('text'))}, lambda t: length(t) >= 3), ' ')
        as kept from documents""",
)
def drop_short_tokens(spark, sf):
    kept = text.drop_short(text.words(text.clean_text("text")))
    return documents(spark, sf).select("doc_id", F.array_join(kept, " ").alias("kept"))


@query(
    "T9_normalize_text",
    f"""select doc_id, {normalize_sql('c', english_stop_words())} as normalized_text
        from (select doc_id, {clean_sql('text')} as c from documents)""",
)
def normalize_text(spark, sf):
    normalized = text.normalize_text(text.clean_text("text"), text.stop_words())
    return documents(spark, sf).select("doc_id", normalized.alias("normalized_text"))


def _lemmatized_sql(key: str, source: str) -> dict[str, str]:
    """Views of the normalised texts of ``source`` ``(key, c)`` with lemmas."""
    return {
        **LEMMA_VIEWS,
        "kept": f"select {key} as k, c, {without_sql(tokens_sql('c'), english_stop_words())} as t from ({source})",
        "each": "select k, unnest(t) as form, unnest(range(len(t))) as pos from kept",
        "turned": "select k, pos, coalesce(lemma, form) as w from each left join lemmas using (form)",
        "normal": """select kept.k, kept.c, coalesce(n, '') as n from kept left join (
          select k, string_agg(w, ' ' order by pos) filter (length(w) >= 3) as n from turned group by k) using (k)""",
    }


@query(
    "T10_preprocess_lemmas",
    with_views(
        f"select k as review_id, c as cleaned_text, n as normalized_text, len({tokens_sql('n')}) as n_tokens from normal",
        **_lemmatized_sql("review_id", f"select review_id, {clean_sql('text')} as c from texts"),
    ),
)
def preprocess_lemmas(spark, sf):
    """The chain with lemmas, as it runs by default where a table of them is given."""
    rows = cleaning.preprocess(review_texts(spark, sf), lemmas=rule_lemmas(spark, sf), include_tokens=True)
    return rows.select("review_id", "cleaned_text", "normalized_text", F.size("tokens").cast("long").alias("n_tokens"))


@query(
    "T10_preprocess",
    with_views(
        f"""select review_id, c as cleaned_text, n as normalized_text, len({tokens_sql('n')}) as n_tokens from (
              select review_id, c, {normalize_sql('c', english_stop_words())} as n
              from (select review_id, {clean_sql('text')} as c from texts))"""
    ),
)
def preprocess(spark, sf):
    rows = cleaning.preprocess(review_texts(spark, sf), include_tokens=True)
    return rows.select("review_id", "cleaned_text", "normalized_text", F.size("tokens").alias("n_tokens"))


@query(
    "T10_preprocess_basic",
    f"""select doc_id, c as cleaned_text, array_to_string({without_sql(words_sql('c'), text.BASIC_STOP_WORDS)}, ' ')
        as normalized_text from (select doc_id, {basic_sql('text')} as c from documents)""",
)
def preprocess_basic(spark, sf):
    rows = cleaning.preprocess_basic(documents(spark, sf))
    return rows.select("doc_id", "cleaned_text", "normalized_text")


@query("T11_text_length", "select doc_id, length(coalesce(text, '')) as text_length from documents")
def text_length(spark, sf):
    return documents(spark, sf).select("doc_id", text.text_length("text").alias("text_length"))


@query(
    "T12_word_counts",
    f"""select doc_id, len(w) as word_count, case when len(w) > 0 then
          list_sum(list_transform(w, lambda x: length(x))) / len(w) else 0.0 end as avg_word_length
        from (select doc_id, {words_sql('text')} as w from documents)""",
)
def word_counts(spark, sf):
    return documents(spark, sf).select(
        "doc_id",
        text.word_count("text").alias("word_count"),
        text.avg_word_length("text").alias("avg_word_length"),
    )


@query(
    "T13_length_category",
    """select doc_id, case when n = 0 then 'empty' when n < 50 then 'very_short' when n < 200 then 'short'
         when n < 500 then 'medium' else 'long' end as length_category
       from (select doc_id, length(coalesce(text, '')) as n from documents)""",
)
def length_category(spark, sf):
    category = text.length_category(text.text_length("text"))
    return documents(spark, sf).select("doc_id", category.alias("length_category"))


@query(
    "T14_version_parts",
    with_views(
        """select review_id, major_version, minor_version,
           case when version <> 'Unknown' then try_cast(split_part(version, '.', 3) as int) end as patch_version,
           case when version like '%.%' then split_part(version, '.', 1) else 'Unknown' end as major_label
           from rated"""
    ),
)
def version_parts(spark, sf):
    return (
        reviews(spark, sf)
        .withColumns({**versions.version_parts("version"), "major_label": versions.major_label("version")})
        .select("review_id", "major_version", "minor_version", "patch_version", "major_label")
    )


@query("T15_version_code", with_views(f"select review_id, {CODE} as code from reviews"))
def version_code(spark, sf):
    return reviews(spark, sf).select("review_id", versions.version_code("version").alias("code"))


@query(
    "T16_review_lines",
    with_views(
        """select review_id,
           concat('Review ', review_id, ': Rating: ', rating, '/5 Date: ', strftime(date, '%Y-%m-%d %H:%M:%S'),
             chr(10), coalesce(text, ''), chr(10)) as plain,
           concat('Review #', review_id, ': ', rating, '/5 stars on ', strftime(date, '%Y-%m-%d %H:%M:%S'),
             ' (Version: ', version, ')', chr(10), coalesce(text, 'No text provided'), chr(10)) as detailed
           from texts"""
    ),
)
def review_lines(spark, sf):
    return review_texts(spark, sf).select(
        "review_id",
        prompts.plain_line("review_id").alias("plain"),
        prompts.detailed_line("review_id").alias("detailed"),
    )


@query(
    "T17_topic_labels",
    f"""select doc_id, case when len(w) > 0 then concat('Topic ', doc_id % 10, ': ', array_to_string(w[1:3], ', '))
          else concat('Topic ', doc_id % 10) end as label
        from (select doc_id, {terms_sql('text')} as w from documents)""",
)
def topic_labels(spark, sf):
    return documents(spark, sf).select(
        "doc_id", text.topic_label(F.col("doc_id") % 10, text.terms("text")).alias("label")
    )


@query("T18_rating_sentiment", with_views("select review_id, sentiment from rated"))
def rating_sentiment(spark, sf):
    return reviews(spark, sf).select("review_id", rates.rating_sentiment("rating").alias("sentiment"))


@query(
    "T19_word_rows",
    f"select doc_id, w as word, count(*) as n from (select doc_id, unnest({words_sql('text')}) as w from documents) group by 1, 2",
)
def word_rows(spark, sf):
    rows = tokens.one_per_row(documents(spark, sf), text.words("text"), "word", "doc_id")
    return rows.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


REPLIES = """select event_id, case event_type when 'error' then concat('no object, ', event_type)
  when 'click' then concat('broken {"k": ', user_id) when 'view' then concat('Sure: ', props, ' - done')
  when 'purchase' then concat('bad {', event_type, '} end') else props end as reply from events"""


@query(
    "T20_json_recovery",
    f"""select event_id, case when json_valid(body) then body end as body, case when body is null then
          'No JSON found in response' when not json_valid(body) then 'Invalid JSON in response' end as format_error
        from (select event_id, nullif(regexp_extract(reply, '(?s)\\{{.*\\}}'), '') as body from ({REPLIES}))""",
)
def json_recovery(spark, sf):
    kind, props = F.col("event_type"), F.col("props")
    reply = (
        F.when(kind == "error", F.concat(F.lit("no object, "), kind))
        .when(kind == "click", F.concat(F.lit('broken {"k": '), "user_id"))
        .when(kind == "view", F.concat(F.lit("Sure: "), props, F.lit(" - done")))
        .when(kind == "purchase", F.concat(F.lit("bad {"), kind, F.lit("} end")))
        .otherwise(props)
    )
    replies = table(spark, sf, "events").select("event_id", reply.alias("reply"))
    return prompts.parse_replies(replies).select("event_id", "body", "format_error")


@query(
    "T21_hash_embedding",
    """select doc_id, least(1.0, length(text) / 1000.0) as d1, code / 1000.0 as d2,
         (code * 7919 + 101) % 10007 / 10007.0 as d3, (code * 7919 + 211) % 10007 / 10007.0 as d4,
         (code * 7919 + 307) % 10007 / 10007.0 as d5
       from (select doc_id, text, list_sum(list_transform(string_split(substr(text, 1, 100), ''),
               lambda c: unicode(c))) % 1000 as code from documents where length(text) > 0)""",
)
def hash_embedding(spark, sf):
    rows = documents(spark, sf).filter(F.length("text") > 0)
    rows = rows.select("doc_id", text.hash_embedding("text").alias("v"))
    return rows.select("doc_id", *[F.col("v")[i].alias(f"d{i + 1}") for i in range(5)])
