"""Expressions over the topic weights of a document (``array<double>``, one per topic)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.1


def _with_top(weights: Column, body: Callable[[Column], Column]) -> Column:
    """``body(row maximum)``, with the maximum computed once per document."""
    return F.transform(F.array(F.array_max(weights)), body)[0]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dominant_weights(weights: str | Column) -> Column:
    """The largest weight where it stands, 0 elsewhere; ties all stay."""
    w = _col(weights)
    return _with_top(w, lambda top: F.transform(w, lambda x: F.when(x == top, x).otherwise(0.0)))


def dominant_flags(weights: str | Column) -> Column:
    """1 where the largest weight stands, 0 elsewhere; ties are all 1."""
    w = _col(weights)
    return _with_top(w, lambda top: F.transform(w, lambda x: (x == top).cast("int")))


def weights_from(weights: str | Column, threshold: float = THRESHOLD) -> Column:
    """Weights of at least the threshold, 0 for the others."""
    return F.transform(_col(weights), lambda x: F.when(x >= threshold, x).otherwise(0.0))


def weighted_metric(
    weights: str | Column, metric: str | Column, threshold: float = THRESHOLD
) -> Column:
    """Weight times metric where the weight reaches the threshold; a null metric is 0."""
    m = F.coalesce(_col(metric), F.lit(0))
    return F.transform(_col(weights), lambda x: F.when(x >= threshold, x * m).otherwise(0.0))


def entropy_terms(weights: str | Column, threshold: float = THRESHOLD) -> Column:
    """``w * log10(w)`` where the weight reaches the threshold, 0 elsewhere."""
    return F.transform(
        _col(weights), lambda x: F.when(x >= threshold, x * F.log10(x)).otherwise(0.0)
    )


def spread_topics(df: DataFrame, values: str, k: int, name: str = "Topic {}") -> DataFrame:
    """``id`` and one column per topic, taken from an array column. No shuffle."""
    return df.select("id", *[F.col(values)[i].alias(name.format(i + 1)) for i in range(k)])


def topic_rows(df: DataFrame, values: str = "weights", into: str = "weight") -> DataFrame:
    """Long form ``(id, topic, weight)``; topics count from 1."""
    rows = df.select("id", F.posexplode_outer(values).alias("_at", into))
    return rows.filter(F.col("_at").isNotNull()).select(
        "id", (F.col("_at") + 1).alias("topic"), into
    )


def topic_arrays(rows: DataFrame) -> DataFrame:
    """``(id, weights)`` from the long form; a document has at most one row per topic."""
    in_order = F.array_sort(F.collect_list(F.struct("topic", "weight")))
    return rows.groupBy("id").agg(in_order.alias("pairs")).select(
        "id", F.transform("pairs", lambda p: p["weight"]).alias("weights")
    )
