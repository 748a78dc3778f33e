"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmine.session import ensure_checkpoints

#: Edges left, of 16 bytes each, from which one task finishes what the rounds began.
FEW = 1 << 20


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (long columns ``a``, ``b``).

    ``component`` is one of the component's nodes, the same for all of them. Every round gives
    each node the first, in an order drawn anew by hash, among itself and its neighbours and
    draws the edges between those instead, until none is left; the rounds are then followed
    back. The drawn order makes long paths shrink by a share of their length in each round. A
    hub with any number of edges is pre-aggregated before each shuffle. Once no more than
    ``FEW`` edges are left, one task joins them up instead of many more short rounds. Null ends
    and loops are ignored; the order and number of equal edges do not matter.
    """
    ensure_checkpoints(edges.sparkSession)
    left = (
        edges.filter("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
        .checkpoint()
    )
    rounds = []
    while (edges_left := left.count()) > FEW:
        ends = F.explode(
            F.array(
                F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
                F.struct(F.col("b").alias("node"), F.col("a").alias("other")),
            )
        )

        def ranked(node: str, drawn: int = len(rounds)) -> Column:
            return F.struct(F.xxhash64(node, F.lit(drawn)).alias("rank"), F.col(node).alias("id"))

        least = (
            left.select(ends.alias("end"))
            .select(
                F.col("end.node").alias("node"),
                ranked("end.other").alias("first"),
            )
            .groupBy("node")
            .agg(F.min("first").alias("first"))
            .select("node", F.least("first", ranked("node")).getField("id").alias("up"))
            .checkpoint()
        )
        rounds.append(least)
        left = (
            left.join(least.withColumnsRenamed({"node": "a", "up": "up_a"}), "a")
            .join(least.withColumnsRenamed({"node": "b", "up": "up_b"}), "b")
            .filter("up_a <> up_b")
            .select(
                F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")
            )
            .distinct()
            .checkpoint()
        )
    if edges_left:
        joined = left.repartition(1).mapInArrow(_joined_up, "node long, up long")
        rounds.append(joined.checkpoint())
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds.pop().withColumnRenamed("up", "component")
    while rounds:
        # A node with no edge left after this round stands for its component.
        higher = found.withColumnRenamed("node", "up")
        found = (
            rounds.pop()
            .join(higher, "up", "left")
            .select("node", F.coalesce("component", "up").alias("component"))
            .checkpoint()
        )
    return found


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of the edges and one node of its component, the same for all of them."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    ends = [np.concatenate([b.column(i).to_numpy() for b in found]) for i in range(2)]
    nodes, places = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = places.reshape(2, -1)
    up = np.arange(len(nodes))
    while len(a):
        # Of two roots the higher one goes below the lower one; then all paths are cut short.
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up, higher := up[up]):
            up = higher
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[up])], ["node", "up"])
