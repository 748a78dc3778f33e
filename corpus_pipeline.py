"""Training corpus from raw documents: stages, each from documents to documents.

A stage gets what its predecessor kept, as Parquet that was written and is read again. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from threadmine.llm import mixing, packing, repeats, simhash, toxicity
from threadmine.llm.queries import TOKENIZER, table
from threadmine.session import fresh_path

#: The stages train a model, hash and pack by a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic; it learns from the labelled ones."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that with the least id."""
    return simhash.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated windows; ``n_chars`` follows the text."""
    return repeats.without_repeats(docs).selectExpr(
        *[c if c != "n_chars" else "CAST(length(text) AS BIGINT) AS n_chars" for c in docs.columns]
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights. The budget is the least at which no document is left out,
    so smaller sources are repeated instead of larger ones being cut."""
    return mixing.mixed_documents(docs, budget="cover")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and the training sequence each stands in."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_duplicates),
    ("repeated windows", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
