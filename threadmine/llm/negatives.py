"""Hard negatives by exact integer products of anchor and candidate tiles.

Vectors become whole numbers, ``floor(scale * x)``. Anchors, the stated query set, are dealt to
groups and all rows to shelves by a hash of their place, both of bounded size; every group meets
every shelf in one tile, so work is anchors times rows and no tile depends on labels, ids or
equal vectors. A tile's scores are a matrix product by Strassen's recursion on int64 with zero
padding to even sizes: seven products of half the size instead of eight, exact as whole numbers.

Two sweeps go over the tiles. The first keeps for each anchor a heap of its best rows of the
same label, the positives. The second keeps for each anchor and positive a window heap: the best
rows of other labels with a score from ``least`` percent of the positive's up to all of it.
Heaps are cut to their size tile by tile; a task merges those of its tiles and Spark those of
its tasks, cut before and after the shuffle, so no step holds all scores of an anchor.

Defined results: rows with a null label, a null vector or a null or non-finite component take
no part; shorter vectors end in zeros, and an empty one is all zeros; rows without an id are no
anchors, and come after all others among equal scores; rows that share an id are different rows
(an anchor may have its own id as a positive, and is searched once for each of its rows); equal
scores go by id, then by place in the table; anchors without positives have no result, positives
without negatives no row; an empty table gives an empty result; other columns are ignored. A
scaled component of 2^62 or more, and a score that is no long, are errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmine.session import ensure_checkpoints

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score in percent of its positive's, at least.
LEAST = 80

#: Anchors of a group and rows of a shelf, on average.
GROUP, SHELF = 4096, 1024
#: Anchors and rows whose scores are held at a time.
TILE = (512, 1024)
#: A side at or below which products are taken directly.
LEAF = 32

LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


# --- products --------------------------------------------------------------------------


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` for whole numbers, by seven half-sized products at every step."""
    rows, inner, columns = *a.shape, b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return a @ b
    if rows % 2 or inner % 2:
        a = np.pad(a, ((0, rows % 2), (0, inner % 2)))
    if inner % 2 or columns % 2:
        b = np.pad(b, ((0, inner % 2), (0, columns % 2)))
    i, j, k = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * k), p1.dtype)
    out[:i, :k] = p1 + p4 - p5 + p7
    out[:i, k:] = p3 + p5
    out[i:, :k] = p2 + p4
    out[i:, k:] = p1 - p2 + p3 + p6
    return out[:rows, :columns]


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two int64 matrices, or an error if one is no long.

    Sums may wrap around inside the recursion: what comes out is right if it fits. Where sizes
    do not show that it does, Python's whole numbers are used.
    """
    most = [max(-int(x.min(initial=0)), int(x.max(initial=0))) for x in (anchors, rows)]
    if max(most) >= 1 << 62:
        raise ValueError("scaled components of 2^62 and more are not taken")
    if anchors.shape[1] * most[0] * most[1] < 1 << 63:
        return strassen(anchors, rows.T)
    exact = strassen(anchors.astype(object), rows.T.astype(object))
    if exact.size and (int(exact.max()) > HIGH or int(exact.min()) < LOW):
        raise ValueError("a score does not fit a long")
    return exact.astype(np.int64)


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of ``width`` numbers, shorter ones filled up with zeros."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


# --- heaps -----------------------------------------------------------------------------


class Heaps:
    """The best ``size`` entries (score, then id, nulls last, then place) of every key."""

    def __init__(self, keys: int, size: int) -> None:
        self.size = size
        self.columns = [np.empty(0, np.int64) for _ in range(5)]
        #: Scores below this cannot enter; it rises once a key's heap is full.
        self.floors = np.full(keys, LOW)

    def merge(self, key, score, unnamed, ids, place) -> None:
        new = zip(self.columns, (key, score, unnamed, ids, place), strict=True)
        key, score, unnamed, ids, place = (np.concatenate(x) for x in new)
        # ~score falls as the score rises, and exists for every long
        order = np.lexsort((place, ids, unnamed, ~score, key))
        key = key[order]
        first = np.searchsorted(key, key)
        rank = np.arange(len(key)) - first
        kept = order[rank < self.size]
        self.columns = [x[kept] for x in (key[np.argsort(order)], score, unnamed, ids, place)]
        full = rank == self.size - 1
        self.floors[key[full]] = np.maximum(self.floors[key[full]], score[order][full])


class Side:
    """The anchors, or the rows, of one tile as arrays."""

    def __init__(self, table: pa.Table, width: int) -> None:
        def numbers(name: str) -> np.ndarray:
            return table.column(name).to_numpy()

        ids = table.column("id").combine_chunks()
        self.unnamed = pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids = pc.fill_null(ids, 0).to_numpy()
        self.place, self.label = numbers("place"), numbers("label")
        self.vectors = matrix(table.column("vector").combine_chunks(), width)
        self.positives = table.column("positives").to_pylist()

    def __len__(self) -> int:
        return len(self.ids)


def _tiles(anchors: Side, rows: Side) -> Iterator[tuple[slice, slice, np.ndarray]]:
    for i in range(0, len(anchors), TILE[0]):
        own = slice(i, i + TILE[0])
        for j in range(0, len(rows), TILE[1]):
            other = slice(j, j + TILE[1])
            yield own, other, scores(anchors.vectors[own], rows.vectors[other])


def _enter(heaps: Heaps, key, rows: Side, at, score) -> None:
    heaps.merge(key, score, rows.unnamed[at], rows.ids[at], rows.place[at])


def add_positives(heaps: Heaps, anchors: Side, rows: Side) -> None:
    """Heaps by anchor: rows of the anchor's label, but for the anchor itself."""
    for own, other, found in _tiles(anchors, rows):
        hit = (
            (anchors.label[own, None] == rows.label[None, other])
            & (anchors.place[own, None] != rows.place[None, other])
            & (found >= heaps.floors[own, None])
        )
        i, j = np.nonzero(hit)
        if len(i):
            _enter(heaps, i + own.start, rows, j + other.start, found[i, j])


def windows(anchors: Side, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of a negative for each anchor and positive."""
    low = np.full((len(anchors), size), HIGH)
    high = np.full((len(anchors), size), LOW)
    for i, own in enumerate(anchors.positives):
        for slot, score in enumerate(own or []):
            # least * score <= 100 * x, as the least whole x
            low[i, slot], high[i, slot] = -((-least * score) // 100), score
    return low, high


def add_negatives(heaps: Heaps, anchors: Side, rows: Side, size: int, least: int) -> None:
    """Heaps by anchor and positive: rows of other labels with a score in the window."""
    low, high = windows(anchors, size, least)
    for own, other, found in _tiles(anchors, rows):
        floor = np.maximum(low[own], heaps.floors.reshape(-1, size)[own])
        hit = (
            (anchors.label[own, None] != rows.label[None, other])
            & (found >= floor.min(axis=1)[:, None])
            & (found <= high[own].max(axis=1)[:, None])
        )
        i, j = np.nonzero(hit)
        score = found[i, j]
        for slot in range(size):
            inside = (score >= floor[i, slot]) & (score <= high[own][i, slot])
            if inside.any():
                key = (i[inside] + own.start) * size + slot
                _enter(heaps, key, rows, j[inside] + other.start, score[inside])


# --- sweeps ----------------------------------------------------------------------------


def scaled(embeddings: DataFrame, scale: int = SCALE, identifier: str = "vec_id") -> DataFrame:
    """``place``, ``id``, ``label`` and the whole-number ``vector`` of the rows that take part."""
    finite = F.forall(
        "embedding",
        lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x),
    )
    return embeddings.filter(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.monotonically_increasing_id().alias("place"),
        F.col(identifier).cast("long").alias("id"),
        F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vector"),
    )


def _dealt(anchors: DataFrame, rows: DataFrame, groups: int, shelves: int) -> DataFrame:
    """Every group of anchors next to every shelf of rows, anchors first."""
    columns = ("place", "id", "label", "vector", "positives")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def one(n: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("place", F.lit(seed)), F.lit(n)).cast("int")

    left = anchors.select(
        one(groups, 1).alias("group"), every(shelves).alias("shelf"), F.lit(0).alias("side"), *columns
    )
    right = rows.withColumn("positives", F.lit(None).cast("array<long>")).select(
        every(groups).alias("group"), one(shelves, 2).alias("shelf"), F.lit(1).alias("side"), *columns
    )
    return (
        left.unionByName(right)
        .repartition("group", "shelf")
        .sortWithinPartitions("group", "shelf", "side", "place")
    )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The sorted rows of each group and shelf, which may lie across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        starts = [0, *cuts.tolist()] if len(key) else []
        for start, end in zip(starts, [*starts[1:], len(key)], strict=False):
            own = tuple(key[start].tolist())
            if held and own != last:
                yield last[0], pa.Table.from_batches(held)
                held = []
            last = own
            held.append(batch.slice(start, end - start))
    if held:
        yield last[0], pa.Table.from_batches(held)


def _sweep(dealt: DataFrame, slots: int, size: int, least: int | None) -> DataFrame:
    """``anchor`` (its place), ``slot`` and the entries of the heaps of every task."""
    names = ["anchor", "slot", "score", "id", "place"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, current, places = None, None, None

        def entries() -> pa.RecordBatch:
            key, score, unnamed, ids, place = heaps.columns
            columns = [
                pa.array(places[key // slots]),
                pa.array((key % slots).astype(np.int32)),
                pa.array(score),
                pa.array(ids, mask=unnamed.astype(bool)),
                pa.array(place),
            ]
            return pa.record_batch(columns, names)

        for group, table in _groups(batches):
            side = table.column("side").to_numpy()
            n = int((side == 0).sum())
            if n in (0, len(side)):
                continue
            width = pc.max(pc.list_value_length(table.column("vector"))).as_py()
            anchors, rows = Side(table.slice(0, n), width), Side(table.slice(n), width)
            if group != current:
                if heaps is not None:
                    yield entries()
                # all tiles of a group have the same anchors in the same order
                heaps, current, places = Heaps(n * slots, size), group, anchors.place
            if least is None:
                add_positives(heaps, anchors, rows)
            else:
                add_negatives(heaps, anchors, rows, slots, least)
        if heaps is not None:
            yield entries()

    return dealt.mapInArrow(work, "anchor long, slot int, score long, id long, place long")


def _first(entries: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Heaps of all tasks merged; ``rank`` counts from 1."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "place")
    return entries.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def hard_negatives(
    embeddings: DataFrame, is_anchor: Column, positives: int = POSITIVES,
    negatives: int = NEGATIVES, least: int = LEAST, scale: int = SCALE,
    identifier: str = "vec_id", group: int = GROUP, shelf: int = SHELF,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``is_anchor`` is a condition on the column ``id``, which holds the identifier.
    """
    ensure_checkpoints(embeddings.sparkSession)
    rows = scaled(embeddings, scale, identifier).checkpoint()
    chosen = rows.filter(is_anchor & F.col("id").isNotNull())
    groups = max(1, -(-chosen.count() // group))
    shelves = max(1, -(-rows.count() // shelf))

    plain = chosen.withColumn("positives", F.lit(None).cast("array<long>"))
    best = _first(
        _sweep(_dealt(plain, rows, groups, shelves), 1, positives, None), ["anchor"], positives
    )
    # at most ``positives`` entries for each anchor
    listed = best.groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("own")
    )
    named = (
        chosen.join(listed, F.col("place") == F.col("anchor"))
        .withColumn("positives", F.transform("own", lambda p: p["score"]))
        .drop("anchor")
        .checkpoint()
    )
    swept = _sweep(
        _dealt(named.drop("own"), rows, groups, shelves), positives, negatives, least
    )
    windowed = _first(swept, ["anchor", "slot"], negatives)
    sources = named.select(
        F.col("place").alias("anchor"),
        F.col("id").alias("anchor_id"),
        F.posexplode("own").alias("slot", "positive"),
    )
    return windowed.join(sources, ["anchor", "slot"]).select(
        "anchor_id",
        F.col("positive.id").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
