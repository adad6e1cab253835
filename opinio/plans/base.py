"""Query registry, input tables and the SQL fragments the checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.functions import rates, text
from opinio.session import configure, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a plan under a name, with its check where SQL can express it."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


#: Tables of long texts, whose rows cost far more to process than to move.
TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders seen as reviews, one row per order."""
    day = F.col("o_orderdate")
    closed = F.col("o_orderstatus") == "F"
    customer = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("review_id"),
        F.when(customer % 50 != 0, F.concat(F.lit("user_"), customer)).alias("author"),
        day.alias("date"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"),
        F.when(customer % 10 == 0, "Unknown")
        .otherwise(
            F.concat(
                5 + customer % 8, F.lit("."), F.col("o_orderkey") % 4, F.lit("."), F.col("o_orderkey") % 3
            )
        )
        .alias("version"),
        (customer % 151).cast("int").alias("thumbs_up"),
        F.when(closed, day + F.expr("interval 3 days")).alias("replied_at"),
        F.when(closed, "Thank you for your feedback").alias("reply_content"),
    )


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with rating-derived sentiment and the reply flag."""
    return reviews(spark, sf_dir).withColumns(
        {"sentiment": rates.rating_sentiment("rating"), "has_response": rates.has_response("replied_at")}
    )


def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined with the review of the same number."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("review_id"), "text", "lang", "source", "n_chars"
    )
    return reviews(spark, sf_dir).join(docs, "review_id")


REVIEWS = """select o_orderkey as review_id,
  case when o_custkey % 50 = 0 then null else concat('user_', o_custkey) end as author,
  o_orderdate as date, cast(substr(o_orderpriority, 1, 1) as int) as rating,
  case when o_custkey % 10 = 0 then 'Unknown'
       else concat(5 + o_custkey % 8, '.', o_orderkey % 4, '.', o_orderkey % 3) end as version,
  cast(o_custkey % 151 as int) as thumbs_up,
  case when o_orderstatus = 'F' then o_orderdate + interval 3 days end as replied_at,
  case when o_orderstatus = 'F' then 'Thank you for your feedback' end as reply_content
  from orders"""

RATED = """select *, case when rating >= 4 then 'positive' when rating <= 2 then 'negative'
  else 'neutral' end as sentiment, replied_at is not null as has_response,
  case when version <> 'Unknown' then try_cast(split_part(version, '.', 1) as int) end as major_version,
  case when version <> 'Unknown' then try_cast(split_part(version, '.', 2) as int) end as minor_version
  from reviews"""

TEXTS = """select r.*, d.text, d.lang, d.source, d.n_chars
  from rated r join documents d on d.doc_id = r.review_id"""


def with_views(body: str, **views: str) -> str:
    """``body`` over the review views and any further named ones."""
    named = {"reviews": REVIEWS, "rated": RATED, "texts": TEXTS, **views}
    return "with " + ", ".join(f"{n} as ({q})" for n, q in named.items()) + " " + body


# --- SQL spellings of the text functions ---------------------------------------------


def literals(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def english_stop_words() -> tuple[str, ...]:
    """The English list, as both the plans and their SQL use it."""
    return text.stop_words("english")


# The same character classes in the checker's dialect, code point by code point.
WHITE_SQL = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
BLANKS_SQL = rf"[{WHITE_SQL}]+"
NOT_PLAIN_SQL = rf"[^{text.WORD}{WHITE_SQL}]|\p{{Nd}}"


def replace_sql(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, '{pattern}', '{by}', 'g')"


def squeeze_sql(c: str) -> str:
    return f"trim({replace_sql(c, BLANKS_SQL, ' ')})"


def basic_sql(c: str) -> str:
    return squeeze_sql(replace_sql(f"lower(coalesce({c}, ''))", NOT_PLAIN_SQL))


def clean_sql(c: str) -> str:
    out = f"lower(coalesce({c}, ''))"
    for pattern in (text.TAG, rf"(?:http|www)[^{WHITE_SQL}]+", rf"[^{WHITE_SQL}]+@[^{WHITE_SQL}]+"):
        out = replace_sql(out, pattern)
    return squeeze_sql(replace_sql(out, NOT_PLAIN_SQL))


def words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '{BLANKS_SQL}'), lambda w: length(w) > 0)"


def tokens_sql(c: str) -> str:
    for a, b in text.CONTRACTIONS:
        c = replace_sql(c, rf"\b{a}{b}\b", f"{a} {b}")
    return words_sql(c)


def terms_sql(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '{text.TERM}')"


def without_sql(tokens: str, stops) -> str:
    return f"list_filter({tokens}, lambda t: t not in ({literals(stops)}))"


def normalize_sql(c: str, stops, shortest: int = 3) -> str:
    kept = without_sql(tokens_sql(c), stops)
    return f"array_to_string(list_filter({kept}, lambda t: length(t) >= {shortest}), ' ')"
