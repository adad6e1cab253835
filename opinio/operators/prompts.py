"""Prompt tables over a bounded sample, token estimates and reply parsing."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.functions import text

#: Kinds of analysis; their instructions are an input, a plain task line the default.
TYPES = ("general", "sentiment", "issues", "suggestions", "themes", "trends")
INSTRUCTIONS = {t: f"Task: {t}." for t in TYPES}

STYLES = {
    "default": "",
    "json": "\n\nAnswer in JSON.",
    "bullets": "\n\nAnswer in concise bullet points.",
    "markdown": "\n\nAnswer in Markdown with headers.",
}

# Token limits and prices per thousand tokens (input, output).
MODELS = {
    "gpt-3.5-turbo": (16385, 0.0015, 0.002),
    "gpt-3.5-turbo-16k": (16385, 0.003, 0.004),
    "gpt-4": (8192, 0.03, 0.06),
    "gpt-4o": (128000, 0.01, 0.02),
    "gpt-4-turbo": (128000, 0.01, 0.03),
}
DEFAULT_LIMIT = 8192
RESPONSE_TOKENS = 1800
CHARACTERS_PER_TOKEN = 4

#: Reviews in one prompt; a larger sample gives several prompts of each kind.
REVIEWS_PER_PROMPT = 100


def numbered(sample: DataFrame, *order: Column) -> DataFrame:
    """Number the rows of a sample (bounded by the sampling operators) from 1."""
    return sample.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def plain_line(position: str = "position") -> Column:
    """``Review i: Rating: r/5 Date: d`` and the text below it."""
    rating = F.when(F.col("rating").isNotNull(), F.format_string(" Rating: %d/5", "rating"))
    date = F.when(
        F.col("date").isNotNull(),
        F.concat(F.lit(" Date: "), F.date_format("date", "yyyy-MM-dd HH:mm:ss")),
    )
    return F.concat(
        F.format_string("Review %d:", position),
        F.coalesce(rating, F.lit("")),
        F.coalesce(date, F.lit("")),
        F.lit("\n"),
        F.coalesce("text", F.lit("")),
        F.lit("\n"),
    )


def detailed_line(position: str = "position") -> Column:
    """``Review #i: r/5 stars on d (Version: v)`` and the text below it."""
    version = F.when(
        F.col("version").isNotNull(), F.concat(F.lit(" (Version: "), F.col("version"), F.lit(")"))
    )
    return F.concat(
        F.format_string("Review #%d: ", position),
        F.coalesce(F.col("rating").cast("string"), F.lit("No rating")),
        F.lit("/5 stars on "),
        F.coalesce(F.date_format("date", "yyyy-MM-dd HH:mm:ss"), F.lit("Unknown date")),
        F.coalesce(version, F.lit("")),
        F.lit("\n"),
        F.coalesce("text", F.lit("No text provided")),
        F.lit("\n"),
    )


def prompt_table(
    sample: DataFrame,
    types: Sequence[str] = TYPES,
    context: str = "",
    style: str = "default",
    line: Column | None = None,
    instructions: dict[str, str] | None = None,
    closing: str = "",
    per_prompt: int = REVIEWS_PER_PROMPT,
) -> DataFrame:
    """Prompts over a numbered sample: ``(analysis_type, prompt_no, prompt)``.

    Every prompt holds ``per_prompt`` reviews, so a sample of any size is taken whole and
    no task gathers more than one prompt.
    """
    texts = instructions or INSTRUCTIONS
    number = F.floor((F.col("position") - 1) / per_prompt).cast("int") + 1
    lines = sample.select(
        number.alias("prompt_no"), "position", (plain_line() if line is None else line).alias("line")
    )
    ordered = F.sort_array(F.collect_list(F.struct("position", "line")))
    bodies = lines.groupBy("prompt_no").agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "").alias("body"))
    heads = [
        F.struct(
            F.lit(t).alias("analysis_type"),
            F.lit((f"{context}\n\n" if context else "") + texts.get(t, INSTRUCTIONS["general"]) + STYLES[style]).alias(
                "instruction"
            ),
        )
        for t in types
    ]
    end = f"\n\n{closing}" if closing else ""
    return bodies.select("prompt_no", "body", F.inline(F.array(*heads))).select(
        "analysis_type", "prompt_no", F.concat("instruction", F.lit("\n\n"), "body", F.lit(end)).alias("prompt")
    )


def _per_token(per_thousand: float | None) -> Column:
    """Exact price of one token, so that rounding the cost never meets a binary tie."""
    if per_thousand is None:
        return F.lit(None).cast("decimal(12,8)")
    return F.lit(Decimal(str(per_thousand)) / 1000).cast("decimal(12,8)")


def token_estimate(
    df: DataFrame,
    prompt: str = "prompt",
    system_prompt: str = "",
    response_tokens: int = RESPONSE_TOKENS,
    models: Sequence[str] = tuple(MODELS),
) -> DataFrame:
    """Token count and cost of every prompt for every model.

    A model without a price has the default limit and no cost.
    """
    table = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                F.lit(limit).alias("model_limit"),
                _per_token(cost_in).alias("cost_in"),
                _per_token(cost_out).alias("cost_out"),
            )
            for m in models
            for limit, cost_in, cost_out in [MODELS.get(m, (DEFAULT_LIMIT, None, None))]
        ]
    )
    tokens = F.floor(F.length(prompt) / CHARACTERS_PER_TOKEN).cast("int")
    system = len(system_prompt) // CHARACTERS_PER_TOKEN
    total = F.col("prompt_tokens") + system + response_tokens
    cost = (F.col("prompt_tokens") + system) * F.col("cost_in") + F.lit(response_tokens) * F.col("cost_out")
    return (
        df.withColumn("prompt_tokens", tokens)
        .select("*", F.inline(table))
        .withColumn("total_tokens", total)
        .withColumn("pct_of_limit", F.round(F.lit(100.0) * F.col("total_tokens") / F.col("model_limit"), 1))
        .withColumn(
            "status",
            F.when(F.col("total_tokens") > F.col("model_limit"), "Exceeds limit").otherwise("Within limit"),
        )
        .withColumn("estimated_cost", F.round(cost, 4).cast("double"))
        .drop("cost_in", "cost_out", prompt)
    )


def parse_replies(df: DataFrame, column: str = "reply") -> DataFrame:
    """Recovered JSON body of each reply, or why there is none."""
    parsed = text.parse_json_reply(column, "No JSON found in response", "Invalid JSON in response")
    return df.withColumn("_p", parsed).select(
        *df.columns, F.col("_p.body").alias("body"), F.col("_p.error").alias("format_error")
    )
