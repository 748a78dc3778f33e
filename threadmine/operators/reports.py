"""Readable reports: top terms and top documents of every topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmine.functions.weights import topic_rows
from threadmine.operators.corpus import corpus_heads


def top_documents(distributions: DataFrame, n: int = 10) -> DataFrame:
    """``(topic, rank, id, weight)``: the ``n`` documents that weigh most in each topic.

    The rank filter sits on the window, so every task cuts its rows to ``n`` per topic
    before anything is shuffled.
    """
    heaviest = W.partitionBy("topic").orderBy(F.desc("weight"), "id")
    ranked = topic_rows(distributions).withColumn("rank", F.row_number().over(heaviest))
    return ranked.filter(F.col("rank") <= n).select("topic", "rank", "id", "weight")


def with_titles(top: DataFrame, corpus: DataFrame) -> DataFrame:
    """Add ``title``. Spark itself chooses to broadcast the ids of ``top`` if they are few."""
    wanted = top.select("id").distinct()
    titles = corpus_heads(corpus).select("id", "title").join(wanted, "id", "left_semi")
    return top.join(titles, "id", "left").select("topic", "rank", "id", "title", "weight")


def report_rows(terms: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``(topic, kind, rank, label)``: labelled terms and, if given, titled documents.

    A document's label has the order of the report across topics; ``detail`` has that of
    the report topic by topic.
    """
    term_label = F.format_string("%s (%.3f)", "term", "weight")
    rows = terms.select(
        "topic", F.lit("term").alias("kind"), "rank",
        term_label.alias("label"), term_label.alias("detail"),
    )
    if documents is None:
        return rows
    title = F.coalesce("title", F.lit(""))
    return rows.unionByName(
        documents.select(
            "topic", F.lit("document").alias("kind"), "rank",
            F.format_string("%d : %s : %.4f", "id", title, "weight").alias("label"),
            F.format_string("%.4f : %d : %s", "weight", "id", title).alias("detail"),
        )
    )


def horizontal_report(rows: DataFrame, k: int) -> DataFrame:
    """A column per topic (``TOPIC 1`` …); first the term rows, then the document rows."""
    wide = (
        rows.groupBy("kind", "rank")
        .pivot("topic", list(range(1, k + 1)))
        .agg(F.first("label"))
        .orderBy(F.desc("kind"), "rank")
    )
    return wide.select("kind", "rank", *[F.col(str(i)).alias(f"TOPIC {i}") for i in range(1, k + 1)])


def vertical_report(rows: DataFrame) -> DataFrame:
    """Topic after topic: its terms, then its documents."""
    return rows.select("topic", "kind", "rank", F.col("detail").alias("line")).orderBy(
        "topic", F.desc("kind"), "rank"
    )


def run_statistics(
    spark: SparkSession, corpus_id: str, documents: int, terms: int, k: int, alpha: float,
    beta: float, iterations: int, seconds: float,
) -> DataFrame:
    """One row about one fit."""
    return spark.createDataFrame(
        [(corpus_id, documents, terms, k, alpha, beta, iterations, seconds)],
        "corpus STRING, documents BIGINT, terms BIGINT, k INT, alpha DOUBLE, beta DOUBLE, "
        "iterations INT, seconds DOUBLE",
    )
