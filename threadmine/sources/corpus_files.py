"""Corpus tables at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadmine.functions.text import join_tokens


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Replace the parquet table at ``path``."""
    # A corpus keeps few of the posts: rebalanced, or every task of the scan writes its own file.
    corpus.hint("rebalance").write.mode("overwrite").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_corpus_csv(corpus: DataFrame, path: str) -> None:
    """Replace the CSV folder at ``path`` with ``id,doc`` lines, tokens joined by spaces; a
    corpus with parts has ``id,part,doc``."""
    keys = [c for c in ("id", "part") if c in corpus.columns]
    corpus.select(*keys, join_tokens("document").alias("doc")).write.mode("overwrite").csv(path)
