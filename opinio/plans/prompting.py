"""Samples, prompts and token estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinio.functions import text
from opinio.operators import prompts, sampling
from opinio.plans.base import query, review_texts, reviews, table, with_views

HASH = "md5(concat('42|', review_id))"
STRATIFIED = f"""select * from (select * from (select *, row_number() over (partition by rating
  order by {HASH}, review_id) as rn from {{src}}) where rn <= 20) order by {HASH}, review_id limit 100"""


@query(
    "X1_stratified_sample",
    with_views("select review_id, rating from sample", sample=STRATIFIED.format(src="reviews")),
)
def stratified_sample(spark, sf):
    rows = reviews(spark, sf).select("review_id", "rating")
    return sampling.stratified_sample(rows)


def _quota_sql(size: int, focus: str) -> str:
    quotas = ", ".join(str(q) for q in sampling.rating_quotas(size, focus).values())
    return with_views(
        f"""select review_id, rating from (select review_id, rating, row_number() over (partition by rating
              order by {HASH}, review_id) as rn from reviews) where rn <= ([{quotas}])[rating]"""
    )


@query("X2_quota_balanced", _quota_sql(150, "balanced"))
def quota_balanced(spark, sf):
    return sampling.quota_sample(reviews(spark, sf).select("review_id", "rating"), 150, "balanced")


@query("X2_quota_negative", _quota_sql(97, "negative"))
def quota_negative(spark, sf):
    return sampling.quota_sample(reviews(spark, sf).select("review_id", "rating"), 97, "negative")


@query("X3_cluster_sample")
def cluster_sample(spark, sf):
    rows = review_texts(spark, sf).select("review_id", "rating", "text")
    return sampling.cluster_sample(rows, 60, "balanced", stops=text.stop_words()).select("review_id", "rating")


@query(
    "X4_one_reply_per_rating",
    with_views(
        f"""select review_id, rating, reply_content from (select *, row_number() over (partition by rating
              order by {HASH}, review_id) as rn from reviews where reply_content is not null) where rn = 1
            order by rating limit 3"""
    ),
)
def one_reply_per_rating(spark, sf):
    return sampling.one_reply_per_rating(reviews(spark, sf).select("review_id", "rating", "reply_content"))


LINES = """select position, concat('Review ', position, ': Rating: ', rating, '/5 Date: ',
  strftime(date, '%Y-%m-%d %H:%M:%S'), chr(10), coalesce(text, ''), chr(10)) as line from (
    select *, row_number() over (order by rating desc, date desc, review_id) as position from sample)"""
HEADS = ", ".join("('{}', '{}')".format(t, i.replace("'", "''")) for t, i in prompts.INSTRUCTIONS.items())
PROMPTS = f"""select analysis_type, concat(instruction, '{prompts.STYLES["markdown"].replace(chr(10), "' || chr(10) || '")}',
    chr(10), chr(10), body) as prompt, prompt_no
  from (values {HEADS}) as v(analysis_type, instruction), (
    select cast((position - 1) // 100 as int) + 1 as prompt_no, string_agg(line, '' order by position) as body
    from lines group by 1)"""
PROMPT_VIEWS = {"sample": STRATIFIED.format(src="texts"), "lines": LINES, "prompts": PROMPTS}


def sample_prompts(spark, sf):
    sample = sampling.stratified_sample(review_texts(spark, sf).select("review_id", "rating", "date", "text"))
    rows = prompts.numbered(sample, F.desc("rating"), F.desc("date"), F.asc("review_id"))
    return prompts.prompt_table(rows, style="markdown")


@query("L1_prompt_table", with_views("select analysis_type, prompt_no, prompt from prompts", **PROMPT_VIEWS))
def prompt_table(spark, sf):
    return sample_prompts(spark, sf)


MODELS = ", ".join(f"('{m}', {limit}, {a / 1000:.8f}, {b / 1000:.8f})" for m, (limit, a, b) in prompts.MODELS.items())


def _estimate_sql(source: str, key: str) -> str:
    return f"""select {key}, prompt_tokens, model, model_limit, total_tokens,
        round(100.0 * total_tokens / model_limit, 1) as pct_of_limit,
        case when total_tokens > model_limit then 'Exceeds limit' else 'Within limit' end as status,
        cast(round(prompt_tokens * cost_in + 1800 * cost_out, 4) as double) as estimated_cost
      from (select *, prompt_tokens + 1800 as total_tokens from (
        select {key}, length(prompt) // 4 as prompt_tokens from {source}),
        (select model, model_limit, cast(a as decimal(12,8)) as cost_in, cast(b as decimal(12,8)) as cost_out
         from (values {MODELS}) as m(model, model_limit, a, b)))"""


@query("L2_token_estimate", with_views(_estimate_sql("prompts", "analysis_type, prompt_no"), **PROMPT_VIEWS))
def token_estimate(spark, sf):
    return prompts.token_estimate(sample_prompts(spark, sf))


@query(
    "L2_document_tokens",
    _estimate_sql("(select doc_id, text as prompt from documents)", "doc_id"),
)
def document_tokens(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    return prompts.token_estimate(docs)


@query(
    "L3_parse_replies",
    """select event_id, kind, cast(json_extract(body, '$.k') as int) as k from (
         select event_id, event_type as kind, regexp_extract(concat('Result: ', props, ' end.'), '(?s)\\{.*\\}') as body
         from events)""",
)
def parse_replies(spark, sf):
    replies = table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("kind"),
        F.concat(F.lit("Result: "), "props", F.lit(" end.")).alias("reply"),
    )
    parsed = prompts.parse_replies(replies)
    return parsed.select("event_id", "kind", F.from_json("body", "k int")["k"].alias("k"))
