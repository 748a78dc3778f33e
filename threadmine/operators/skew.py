"""Helpers for keys that hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmine.session import ensure_checkpoints

SPAN = 1 << 16
INLINE_KEYS = 1_000


def spread_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, order: str, span: int = SPAN
) -> DataFrame:
    """Equi-join whose tasks get at most ``span`` consecutive values of ``order`` per key.

    ``order`` is a whole number that differs within a left key, such as a post id. The
    ranges a key really has are found by a pre-aggregated distinct; the right side, one
    narrow row per key, is repeated for those only. So the number of pieces follows the
    size of the key, and nothing has to be known about it. ``how`` is any type that keeps
    left rows (``inner``, ``left``, ``left_semi``, ``left_anti``).
    """
    ranged = left.withColumn("_range", F.floor(F.col(order) / F.lit(span)))
    repeated = ranged.select(*on, "_range").distinct().join(right, list(on))
    return ranged.join(repeated, [*on, "_range"], how).drop("_range")


@dataclass(frozen=True)
class KeySet:
    """A set of keys: literals while they are few, otherwise a checkpointed table."""

    keys: DataFrame
    inline: tuple | None

    @property
    def empty(self) -> bool:
        return self.inline == ()

    def keep(self, df: DataFrame, column: str, order: str) -> DataFrame:
        if self.inline is not None:
            return df.filter(F.col(column).isin(list(self.inline)))
        return self._join(df, column, order, "left_semi")

    def drop(self, df: DataFrame, column: str, order: str) -> DataFrame:
        if self.inline is not None:
            return df if self.empty else df.filter(~F.col(column).isin(list(self.inline)))
        return self._join(df, column, order, "left_anti")

    def _join(self, df: DataFrame, column: str, order: str, how: str) -> DataFrame:
        keyed = df.withColumn("_key", F.col(column))
        return spread_join(keyed, self.keys, ["_key"], how, order).drop("_key")


def heavy_keys(df: DataFrame, key: str, max_rows: int, inline: int = INLINE_KEYS) -> KeySet:
    """Keys with more than ``max_rows`` rows.

    One partially aggregated count over the key column alone; at most ``inline`` keys come
    to the driver. Beyond that the set stays a table (it has fewer than rows / ``max_rows``
    entries) and is joined instead.
    """
    counted = df.groupBy(F.col(key).alias("_key")).count().filter(F.col("count") > max_rows)
    keys = counted.select("_key")
    first = keys.limit(inline + 1).collect()
    if len(first) <= inline:
        return KeySet(keys, tuple(sorted(r[0] for r in first if r[0] is not None)))
    ensure_checkpoints(df.sparkSession)
    return KeySet(keys.checkpoint(), None)


def carry_last(
    df: DataFrame, key: str, order: Sequence[str], value: str, into: str, span: int = SPAN
) -> DataFrame:
    """Add ``into``: the last non-null ``value`` among the earlier rows of the same key.

    ``order[0]`` is a whole number. Rows are grouped into ranges of ``span`` of it, so no
    task sees a whole key: a window inside each range, and one over a summary row per
    range for what comes from before it.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order[0]) / F.lit(span)))
    position = F.struct(*order)
    summary = ranged.groupBy(key, "_range").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), position)).alias("_range_last")
    )
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    entering = summary.select(
        key, "_range", F.last("_range_last", ignorenulls=True).over(before).alias("_entering")
    )
    inside = (
        W.partitionBy(key, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        ranged.join(entering, [key, "_range"], "left")
        .withColumn(
            into,
            F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_entering")),
        )
        .drop("_range", "_entering")
    )
