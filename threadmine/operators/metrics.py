"""Topic metrics from ``(id, weights)`` and a corpus.

A document keeps its topic weights in one array, so joining the corpus costs one row per
document and the row maximum needs no shuffle. All metrics come out of a single
aggregation by topic, pre-aggregated before its only shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmine.functions.weights import THRESHOLD
from threadmine.operators.corpus import corpus_heads

# Metric name -> (corpus column, name of the corpus total)
ENGAGEMENT = {
    "view": ("viewCount", "Views"),
    "answer": ("answerCount", "Answers"),
    "comment": ("commentCount", "Comments"),
    "favorite": ("favoriteCount", "Favorites"),
    "score": ("score", "Scores"),
}
# Metric -> column name pattern of the one-row presentation
WIDE_NAMES = {
    "nddt": "sum(Topic {})",
    "impact": "sum(Topic {})",
    "pddt": "D(T{})",
    "share": "Share(T{})",
    "view_share": "ViewShare(T{})",
    "answer_share": "AnswerShare(T{})",
    "comment_share": "CommentShare(T{})",
    "favorite_share": "FavoriteShare(T{})",
    "score_share": "ScoreShare(T{})",
    "entropy": "TE(T{})",
}


def lean_corpus(corpus: DataFrame) -> DataFrame:
    """One row per document with its id and engagement numbers only."""
    return corpus_heads(corpus).select("id", *[c for c, _ in ENGAGEMENT.values()])


def corpus_totals(corpus: DataFrame, dataset: str = "Spark") -> DataFrame:
    """One row per dataset: number of questions and sums of the engagement numbers."""
    renamed = lean_corpus(corpus).withColumnsRenamed(dict(ENGAGEMENT.values()))
    counted = renamed.withColumn("Dataset", F.lit(dataset)).withColumn("Questions", F.lit(1))
    summed = ("Questions", "Answers", "Comments", "Views", "Favorites", "Scores")
    return counted.groupBy("Dataset").agg(*[F.sum(c).alias(c) for c in summed])


def _topic_weights(distributions: DataFrame, keep: list[str], single_winner: bool) -> DataFrame:
    weights = F.col("weights")
    top = F.array_max(weights)
    winner = F.array_position(weights, top) if single_winner else F.lit(None).cast("bigint")
    measured = distributions.withColumn("top", top).withColumn("winner", winner)
    # outer, so that no copy of the weights' expression is put into a not-empty filter below
    rows = measured.select(
        "top", "winner", *keep, F.posexplode_outer("weights").alias("at", "weight")
    ).filter(F.col("at").isNotNull())
    dominant = F.col("weight") == F.col("top")
    if single_winner:
        dominant = F.col("at") + 1 == F.col("winner")
    return rows.select(
        (F.col("at") + 1).alias("topic"), "weight", dominant.alias("dominant"), *keep
    )


def _model_aggregates(threshold: float) -> list[Column]:
    w = F.col("weight")
    reached = w >= threshold
    return [
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.col("dominant").cast("bigint")).alias("nddt"),
        F.sum(F.when(reached, w).otherwise(0.0)).alias("impact"),
        F.sum(F.when(reached, -w * F.log10(w)).otherwise(0.0)).alias("entropy"),
    ]


def _model_ratios() -> list[Column]:
    return [
        F.try_divide("nddt", "documents").alias("pddt"),
        F.try_divide("impact", "documents").alias("share"),
    ]


def model_metrics(
    distributions: DataFrame, threshold: float = THRESHOLD, single_winner: bool = False
) -> DataFrame:
    """Metrics that need no corpus, one row per topic.

    ``documents`` in the model, ``nddt`` (documents dominated by the topic) and its
    proportion ``pddt``, ``impact`` and its proportion ``share``, and ``entropy``.
    """
    rows = _topic_weights(distributions, [], single_winner)
    by_topic = rows.groupBy("topic").agg(*_model_aggregates(threshold))
    return by_topic.select("topic", "documents", "nddt", "impact", "entropy", *_model_ratios())


def topic_metrics(
    distributions: DataFrame, corpus: DataFrame, threshold: float = THRESHOLD,
    single_winner: bool = False, by: Sequence[str] = (),
) -> DataFrame:
    """All metrics of every topic, one row per topic (and value of the columns ``by``, which
    tell the distributions of several models apart).

    Adds to :func:`model_metrics` the sums ``view_sum`` … ``score_sum`` of weight times
    engagement and the shares ``view_share`` … ``score_share`` they have in the totals of
    the whole corpus. Documents the corpus does not have count in the model metrics only.
    """
    lean = lean_corpus(corpus)
    columns = [c for c, _ in ENGAGEMENT.values()]
    joined = distributions.join(lean, "id", "left")
    rows = _topic_weights(joined, [*by, *columns], single_winner)
    reached = F.col("weight") >= threshold
    sums = [
        F.sum(
            F.when(reached, F.col("weight") * F.coalesce(F.col(c), F.lit(0))).otherwise(0.0)
        ).alias(f"{name}_sum")
        for name, (c, _) in ENGAGEMENT.items()
    ]
    by_topic = rows.groupBy(*by, "topic").agg(*_model_aggregates(threshold), *sums)
    totals = corpus_totals(corpus)
    total = totals.select(F.struct(*[t for _, t in ENGAGEMENT.values()])).scalar()
    shares = [
        F.try_divide(f"{name}_sum", total[t]).alias(f"{name}_share")
        for name, (_, t) in ENGAGEMENT.items()
    ]
    return by_topic.select(
        *by, "topic", "documents", "nddt", "impact", "entropy", *_model_ratios(),
        *[f"{name}_sum" for name in ENGAGEMENT], *shares,
    )


def wide_metric(metrics: DataFrame, metric: str, k: int) -> DataFrame:
    """One metric as a single row with a column per topic."""
    pattern = WIDE_NAMES[metric]
    return metrics.agg(
        *[
            F.max(F.when(F.col("topic") == i, F.col(metric))).alias(pattern.format(i))
            for i in range(1, k + 1)
        ]
    )
