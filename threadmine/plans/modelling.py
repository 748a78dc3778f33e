"""Job 2: topic models of a corpus for a range of topic counts."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from threadmine.functions.text import DOMAIN_STOP_WORDS
from threadmine.operators import reports
from threadmine.operators.corpus import without_domain_words
from threadmine.operators.terms import MIN_DOCUMENTS, corpus_size
from threadmine.operators.topics import (
    TopicModel,
    distributions,
    fit_topics,
    fit_vectorizer,
    fix_rows,
    heaviest_terms,
    save_model,
    save_vectorizer,
    term_shares,
    vectorize,
    vocabulary_table,
)


@dataclass(frozen=True)
class ModelRun:
    fitted: TopicModel
    path: str
    distributions: DataFrame
    report: DataFrame
    statistics: DataFrame


def model_corpus(
    corpus: DataFrame, corpus_id: str, base: str, topic_counts: Iterable[int] = (20,),
    optimizer: str = "em", iterations: int = 100, alpha: float = -1, beta: float = -1,
    min_documents: int = MIN_DOCUMENTS, terms_per_topic: int = 20, documents_per_topic: int = 10,
    domain_words: Iterable[str] = DOMAIN_STOP_WORDS, seed: int | None = None,
) -> Iterator[ModelRun]:
    """Vectorize once, then fit, save and describe one model per topic count.

    ``corpus`` is best read from a table at rest. ``report`` is the long form that
    ``horizontal_report`` and ``vertical_report`` lay out.
    """
    spark = corpus.sparkSession
    removed = without_domain_words(corpus, domain_words)
    started = time.monotonic()
    vectorizer = fit_vectorizer(removed, min_documents, as_table=True)
    fixed = fix_rows(vectorize(vectorizer, removed))
    if optimizer != "em":
        # every iteration of every fit reads the vectors; lost cache blocks come back from the
        # checkpoint. An em fit reads them at its start only, and needs the memory for its graph.
        fixed = fixed.persist(StorageLevel.MEMORY_AND_DISK)
    prepared = time.monotonic() - started
    documents = corpus_size(corpus).first()[0]
    terms = vocabulary_table(spark, vectorizer)
    size = terms.count()
    try:
        for k in topic_counts:
            started = time.monotonic()
            save_vectorizer(vectorizer, base, corpus_id, k)
            fitted = fit_topics(fixed, k, optimizer, iterations, alpha, beta, seed)
            path = save_model(fitted, base, corpus_id)
            weights = distributions(fitted, path)
            top = reports.top_documents(weights, documents_per_topic)
            report = reports.report_rows(
                heaviest_terms(term_shares(fitted, terms, path), terms_per_topic),
                reports.with_titles(top, corpus) if documents_per_topic > 0 else None,
            ).checkpoint()  # made here, so that the time of the run has it
            seconds = prepared + time.monotonic() - started
            statistics = reports.run_statistics(
                spark, corpus_id, documents, size, k, fitted.alpha,
                fitted.beta, iterations, seconds,
            )
            yield ModelRun(fitted, path, weights, report, statistics)
    finally:
        fixed.unpersist()
