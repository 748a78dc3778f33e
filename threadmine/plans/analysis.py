"""Job 3: topic metrics of saved models."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmine.functions.weights import THRESHOLD
from threadmine.operators.metrics import topic_metrics
from threadmine.operators.topics import (
    load_vectorizer,
    model_path,
    saved_distributions,
    vectorize,
)


def sweep_metrics(
    corpus: DataFrame, corpus_id: str, base: str, topic_counts: Iterable[int],
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``(corpus, k, topic, …)``: all metrics of every em model saved for the corpus.

    The distributions of all models are one table with a column ``k``, so the corpus is joined
    and added up once, and there is one aggregation by ``(k, topic)``.
    """
    spark = corpus.sparkSession

    def of(k: int) -> DataFrame:
        def vectors() -> DataFrame:
            # words of the document that the model's vocabulary lacks do not count
            fitted = load_vectorizer(base, corpus_id, k)
            return vectorize(fitted.setInputCol("document"), corpus)

        weights = saved_distributions(spark, model_path(base, corpus_id, k), vectors)
        return weights.withColumn("k", F.lit(k))

    every = reduce(DataFrame.unionByName, [of(k) for k in topic_counts])
    found = topic_metrics(every, corpus, threshold, by=("k",))
    return found.select(F.lit(corpus_id).alias("corpus"), "*")
