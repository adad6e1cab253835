"""The corpus pipeline: from raw documents to packed training sequences.

``STAGES`` are applied one after another. Each takes the documents the stage before has
kept, written as Parquet and read again, so that a lost executor costs no earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.llm import mixing, packing, privacy, simhash, toxicity
from opinio.llm.catalog import QUERIES, SQL
from opinio.llm.common import prepare, table, work_table

#: Not expressible in SQL: trained models and greedy packing decide.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half."""
    prepare(spark)
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_whole"))
    scored = toxicity.scores(whole, table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 0").select("_whole.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest id.

    Linked are documents whose SimHash fingerprints differ in four bits at most, and such as
    share four fifths of their shingles, most of which four bits cannot tell.
    """
    prepare(spark)
    return simhash.one_of_near_copies(docs, bits=4)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` follows the text."""
    prepare(spark)
    return privacy.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    prepare(spark)
    return mixing.mixed_documents(docs, mixing.mix(docs, seed=mixing.SEED))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and places in sequences."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("privacy", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    *before, (_, last) = STAGES
    for name, stage in before:
        docs = work_table(stage(spark, docs, sf_dir), f"corpus-{name}")
    return last(spark, docs, sf_dir)


QUERIES["pipeline"] = run

__all__ = ["ORACLE_SQL", "QUERIES", "SQL", "STAGES", "run"]
