"""Term statistics of a corpus. ``words`` names the ``array<string>`` column to use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmine.functions.counts import counted_words
from threadmine.functions.text import word_rows
from threadmine.operators.corpus import corpus_heads

MIN_DOCUMENTS = 3


def corpus_size(corpus: DataFrame) -> DataFrame:
    """One row: the number of documents."""
    return corpus_heads(corpus).agg(F.count(F.lit(1)).alias("documents"))


def term_frequency(corpus: DataFrame, words: str = "removed") -> DataFrame:
    """``(term, count)`` over the whole corpus."""
    return word_rows(corpus, words).groupBy("term").count()


def top_terms(corpus: DataFrame, n: int = 20, words: str = "removed") -> DataFrame:
    """The ``n`` most frequent terms, ties in term order."""
    return term_frequency(corpus, words).orderBy(F.desc("count"), "term").limit(n)


def counted_rows(corpus: DataFrame, words: str, *keep: str) -> DataFrame:
    """``(term, count)`` of every row, next to the ``keep`` columns. The outer form for the
    reason given in :func:`word_rows`."""
    rows = corpus.select(*keep, F.inline_outer(counted_words(words)))
    return rows.filter(F.col("term").isNotNull())


def term_counts(corpus: DataFrame, words: str = "removed") -> DataFrame:
    """``(id, term, count)``: how often a document has a term."""
    return word_rows(corpus, words, "id").groupBy("id", "term").count()


def document_frequency(
    corpus: DataFrame, min_documents: int = 1, words: str = "removed"
) -> DataFrame:
    """``(term, documents)`` for terms found in at least ``min_documents`` documents."""
    distinct = F.array_distinct(words)
    if "part" in corpus.columns:
        # the terms of a spread document are made distinct across its parts
        one_row = word_rows(corpus.filter(F.col("part").isNull()), distinct)
        parts = corpus.filter(F.col("part").isNotNull())
        spread = word_rows(parts, distinct, "id").distinct()
        found = one_row.unionByName(spread.select("term"))
    else:
        found = word_rows(corpus, distinct)
    counted = found.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))
    return counted.filter(F.col("documents") >= min_documents)


def term_statistics(corpus: DataFrame, words: str = "removed") -> DataFrame:
    """``(term, count, documents)`` in one pass over the corpus and one shuffle.

    A document's words are counted inside its row, so documents need no grouping; only spread
    documents are counted by id before.
    """
    one_row = corpus
    if "part" in corpus.columns:
        one_row = corpus.filter(F.col("part").isNull())
    occurrences = counted_rows(one_row, words).withColumn("documents", F.lit(1).cast("bigint"))
    if "part" in corpus.columns:
        spread = term_counts(corpus.filter(F.col("part").isNotNull()), words)
        occurrences = occurrences.unionByName(
            spread.select("term", "count", F.lit(1).cast("bigint").alias("documents"))
        )
    return occurrences.groupBy("term").agg(
        F.sum("count").alias("count"), F.sum("documents").alias("documents")
    )


def vocabulary(
    corpus: DataFrame, min_documents: int = MIN_DOCUMENTS, limit: int | None = None,
    words: str = "removed",
) -> DataFrame:
    """``(term, count)``, most frequent first: all terms that are common enough to model, or
    the first ``limit`` of them."""
    common = term_statistics(corpus, words).filter(F.col("documents") >= min_documents)
    ordered = common.select("term", "count").orderBy(F.desc("count"), "term")
    return ordered if limit is None else ordered.limit(limit)


def vocabulary_size(
    corpus: DataFrame, min_documents: int = MIN_DOCUMENTS, words: str = "removed"
) -> DataFrame:
    """One row: the number of vocabulary terms."""
    common = document_frequency(corpus, min_documents, words)
    return common.agg(F.count(F.lit(1)).alias("terms"))
