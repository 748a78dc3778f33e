"""LDA by expectation maximisation on term counts that stay where they are.

The method is that of Spark's ``em`` optimizer: every document and every term has a count of each
topic; in an iteration each (document, term) count is shared among the topics in proportion to
``(term's + topic prior - 1) * (document's + document prior - 1) / (topic's + size * (topic prior - 1))``,
and the shares are added up by document and by term. Spark makes its graph again in every iteration.
Here a partition of the documents is one set of arrays, its counts, which an iteration only reads.
What moves between tasks are the counts of a partition's distinct terms: to the blocks of terms, where
they are added up, and back. The driver sees one number a topic and partition.

The first shares are drawn as Spark draws them, so that a fit comes to the model of Spark's own but for
rounding. The result is written as Spark writes the model, graph included, and read by Spark.
"""

from __future__ import annotations

import json
import math
import sys
import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext, cloudpickle
from pyspark.ml.clustering import LDA, DistributedLDAModel
from pyspark.mllib.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadmine.session import ensure_checkpoints, fresh_path

# The functions travel with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of counts that a block of terms gets from all partitions, about and at most.
BLOCK_BYTES = 1 << 26
#: Blocks of terms, if that bound leaves so few, up to the number of partitions.
BLOCKS = 64
#: Of the generator of ``java.util.Random``.
_MULTIPLY, _ADD, _MASK = 0x5DEECE66D, 0xB, (1 << 48) - 1
#: The shape of the gamma distribution that Spark's models infer with.
GAMMA_SHAPE = 100.0


# --- the counts of a partition -----------------------------------------------------------


def _indices(vector: str) -> Column:
    """Of a sparse vector, or all places of a dense one."""
    return F.coalesce(f"{vector}.indices", F.transform(f"{vector}.values", lambda _, at: at))


def _cells(fixed: DataFrame, blocks: int) -> RDD:
    """``(part, (ids, sizes, codes, counts, terms))`` of every partition of the rows.

    ``ids`` are the row numbers of documents with counts and ``sizes`` how many each has;
    ``codes`` are places in ``terms``, which are in order of their blocks.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, indices, values = ([np.empty(0, t)] for t in ("<i8", "<i4", "<i4", "<f8"))
        for batch in batches:
            ends = np.append(0, np.cumsum(batch.column(2).value_lengths().to_numpy()))
            own, number = batch.column(2).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
            before = np.append(0, np.cumsum(own != 0))
            ids.append(batch.column(0).to_numpy())
            sizes.append(np.diff(before[ends]))
            indices.append(number[own != 0])
            values.append(own[own != 0])
        row, size, index, count = map(np.concatenate, (ids, sizes, indices, values))
        terms, codes = np.unique(index, return_inverse=True)
        order = np.lexsort((terms, terms % blocks))
        place = np.empty(len(terms), np.int64)
        place[order] = np.arange(len(terms))
        short = count.astype("<f4")
        if np.array_equal(short, count):
            count = short
        arrays = (row[size > 0].astype("<i8"), size[size > 0].astype("<i4"), place[codes].astype("<i4"))
        columns = [
            pa.array([x.tobytes()], pa.binary()) for x in (*arrays, count, terms[order].astype("<i4"))
        ]
        part = pa.array([TaskContext.get().partitionId()], pa.int64())
        narrow = pa.array([count.dtype == np.float32])
        yield pa.record_batch([part, narrow, *columns], ["part", "narrow", *"abcde"])

    rows = fixed.select(
        F.monotonically_increasing_id().alias("row"), F.unwrap_udt("features").alias("v")
    ).select("row", _indices("v").alias("indices"), F.col("v.values").alias("values"))
    packed = rows.mapInArrow(
        work, "part long, narrow boolean, a binary, b binary, c binary, d binary, e binary"
    )
    return packed.rdd.map(_unpacked)


def _unpacked(row) -> tuple:
    kinds = ("<i8", "<i4", "<i4", "<f4" if row.narrow else "<f8", "<i4")
    return row.part, tuple(np.frombuffer(x, t) for x, t in zip(row[2:], kinds, strict=True))


# --- one iteration -----------------------------------------------------------------------


def shared_out(cells: tuple, k: int, part_of: Callable[[int], np.ndarray]) -> tuple:
    """``(ids, by document, terms, by term)``: every count shared among the topics in proportion
    to ``part_of`` each topic, which is asked twice, so that one topic is held at a time."""
    ids, sizes, codes, counts, terms = cells
    rows = np.repeat(np.arange(len(ids)), sizes)
    whole = np.zeros(len(codes))
    for topic in range(k):
        whole += part_of(topic)
    with np.errstate(invalid="ignore", divide="ignore"):
        scale = counts / whole
    documents, words = np.empty((len(ids), k)), np.empty((len(terms), k))
    for topic in range(k):
        share = part_of(topic) * scale
        documents[:, topic] = np.bincount(rows, share, len(ids))
        words[:, topic] = np.bincount(codes, share, len(terms))
    return ids, documents, terms, words


def drawn(seed: int, n: int, k: int, topic: int) -> np.ndarray:
    """Every ``k``-th number from place ``topic`` on of those that Java's generator draws."""
    state, jump, step = (seed ^ _MULTIPLY) & _MASK, 1, 0
    for _ in range(2 * topic + 1):  # two states a number
        state = (state * _MULTIPLY + _ADD) & _MASK
    for _ in range(2 * k):
        jump, step = jump * _MULTIPLY & _MASK, (step * _MULTIPLY + _ADD) & _MASK
    # The state i jumps on is mult[i] * state + plus[i].
    mult, plus = np.ones(1, np.uint64), np.zeros(1, np.uint64)
    while len(mult) < n:
        plus = np.append(plus, mult * np.uint64(step) + plus)
        mult = np.append(mult, mult * np.uint64(jump))
        jump, step = jump * jump & _MASK, (jump * step + step) & _MASK
    mask = np.uint64(_MASK)
    upper = (mult[:n] * np.uint64(state) + plus[:n]) & mask
    lower = (upper * np.uint64(_MULTIPLY) + np.uint64(_ADD)) & mask
    bits = ((upper >> np.uint64(22)) << np.uint64(27)) + (lower >> np.uint64(21))
    return bits.astype(np.float64) * 2.0**-53


def first_shares(part: int, cells: tuple, k: int, seed: int) -> tuple:
    """Counts shared out at random, by the numbers that Spark draws for the same partition."""
    return shared_out(cells, k, lambda topic: drawn(part + seed, len(cells[2]), k, topic))


def next_shares(
    cells: tuple, documents: np.ndarray, words: np.ndarray, totals: np.ndarray,
    size: int, alpha: float, beta: float,
) -> tuple:
    """Counts shared out by the counts of their documents, terms and all topics."""
    rows, codes = np.repeat(np.arange(len(cells[0])), cells[1]), cells[2]

    def part_of(topic: int) -> np.ndarray:
        word = (words[:, topic] + (beta - 1)) / (totals[topic] + size * (beta - 1))
        return word[codes] * (documents[:, topic] + (alpha - 1))[rows]

    with np.errstate(invalid="ignore", divide="ignore"):
        return shared_out(cells, len(totals), part_of)


def _place(key: int) -> int:
    return key


def _sent(blocks: int) -> Callable:
    """A partition's counts by term, to the blocks."""

    def work(row: tuple) -> Iterator[tuple]:
        part, (_, _, terms, words) = row
        bounds = np.searchsorted(terms % blocks, np.arange(blocks + 1))
        for block in np.unique(terms % blocks).tolist():
            own = slice(bounds[block], bounds[block + 1])
            yield block, (part, terms[own], words[own])

    return work


def _added_up(rows: Iterator[tuple], size: int, blocks: int, k: int) -> Iterator[tuple]:
    """``(block, parts, their terms' places, sums, whether a place has a term)``. Parts are added
    in order, so that the sums do not depend on when a part arrives."""
    held = defaultdict(list)
    for block, own in rows:
        held[block].append(own)
    for block in sorted(held):
        sums = np.zeros((size // blocks + 1, k))
        known = np.zeros(len(sums), bool)
        asked = []
        for part, terms, words in sorted(held.pop(block), key=lambda own: own[0]):
            at = terms // blocks
            sums[at] += words  # a part has a term once
            known[at] = True
            asked.append((part, at))
        yield block, asked, sums, known


def _answered(size: int, blocks: int, k: int) -> Callable:
    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for block, asked, sums, _ in _added_up(rows, size, blocks, k):
            for part, at in asked:
                yield part, (block, sums[at])

    return work


def _terms(size: int, blocks: int, k: int) -> Callable:
    """Vertices of the terms: numbers and counts."""

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for block, _, sums, known in _added_up(rows, size, blocks, k):
            at = np.flatnonzero(known)
            yield (-(at * blocks + block) - 1).astype("<i8").tobytes(), sums[at].tobytes()

    return work


def _together(kinds: list[RDD], parts: int) -> RDD:
    """All rows with their kind's number. They are dealt by part already, and stay where they are."""
    tagged = [rows.mapValues(lambda own, kind=kind: (kind, own)) for kind, rows in enumerate(kinds)]
    every = tagged[0]
    for rows in tagged[1:]:
        every = every.union(rows)
    return every.partitionBy(parts, _place)


def _stepped(totals: np.ndarray, size: int, alpha: float, beta: float) -> Callable:
    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = defaultdict(lambda: ({}, {}, {}))
        for part, (kind, own) in rows:
            if kind == 2:
                held[part][2][own[0]] = own[1]
            else:
                held[part][kind][0] = own
        for part, (cells, state, answers) in held.items():
            words = np.concatenate([np.empty((0, len(totals))), *(answers[b] for b in sorted(answers))])
            yield part, next_shares(cells[0], state[0][1], words, totals, size, alpha, beta)

    return work


# --- the fit -----------------------------------------------------------------------------


@dataclass(frozen=True)
class EmFit:
    """A fitted model at rest: ``vertices`` is the path of its documents' and terms' counts."""

    lda: LDA
    fixed: DataFrame
    vertices: str
    totals: tuple[float, ...]
    size: int
    alpha: float
    beta: float
    seconds: tuple[float, ...]

    def counts(self) -> DataFrame:
        """``(id, topicWeights)``: documents have row numbers, term t has the id -t - 1."""
        schema = StructType().add("id", "long").add("topicWeights", VectorUDT())
        return self.fixed.sparkSession.read.schema(schema).parquet(self.vertices)

    def save(self, folder: str) -> None:
        """Write the model to a new folder as Spark does."""
        spark = self.fixed.sparkSession
        draft = fresh_path(spark, "lda")
        self.lda.save(draft)
        settings = json.loads(spark.read.text(f"{draft}/metadata").first().value)
        settings["class"] = "org.apache.spark.ml.clustering.DistributedLDAModel"
        graph = {
            "class": "org.apache.spark.mllib.clustering.DistributedLDAModel", "version": "1.0",
            "k": len(self.totals), "vocabSize": self.size,
            "docConcentration": [self.alpha] * len(self.totals), "topicConcentration": self.beta,
            "iterationTimes": list(self.seconds), "gammaShape": GAMMA_SHAPE,
        }
        for path, said in ((folder, settings), (f"{folder}/oldModel", graph)):
            line = spark.createDataFrame([(json.dumps(said),)], "value STRING")
            line.coalesce(1).write.text(f"{path}/metadata")
        data = f"{folder}/oldModel/data"
        totals = StructType().add("globalTopicTotals", VectorUDT())
        one = spark.createDataFrame([(Vectors.dense(self.totals),)], totals)
        one.coalesce(1).write.parquet(f"{data}/globalTopicTotals")
        self.counts().write.parquet(f"{data}/topicCounts")
        cells = self.fixed.select(
            F.monotonically_increasing_id().alias("srcId"), F.unwrap_udt("features").alias("v")
        ).select("srcId", F.inline(F.arrays_zip(_indices("v").alias("term"), F.col("v.values").alias("n"))))
        edges = cells.filter("n <> 0").select(
            "srcId", (-F.col("term").cast("long") - 1).alias("dstId"), F.col("n").alias("tokenCounts")
        )
        edges.write.parquet(f"{data}/tokenCounts")

    @cached_property
    def model(self) -> DistributedLDAModel:
        path = fresh_path(self.fixed.sparkSession, "em")
        self.save(path)
        return DistributedLDAModel.load(path)


def _vector_rows(k: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, counts = np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<f8")
                ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * k)
                lists = pa.ListArray.from_arrays(ends, pa.array(counts))
                yield pa.record_batch([pa.array(ids), lists], ["id", "counts"])

    return work


def fit_em(
    fixed: DataFrame, lda: LDA, k: int, iterations: int, alpha: float, beta: float, interval: int
) -> EmFit:
    """Fit on the output of ``fix_rows``. ``lda`` has the settings that are saved with the model;
    the counts are checkpointed every ``interval`` iterations."""
    spark = fixed.sparkSession
    ensure_checkpoints(spark)
    some = fixed.first()
    if some is None:
        raise ValueError("no documents to fit topics on")
    size, parts, seed = int(some.features.size), max(1, fixed.rdd.getNumPartitions()), lda.getSeed()
    blocks = max(math.ceil(parts * size * k * 8 / BLOCK_BYTES), min(parts, BLOCKS))
    kept = StorageLevel.MEMORY_AND_DISK
    cells = _cells(fixed, blocks).partitionBy(parts, _place).persist(kept)

    def summed(state: RDD) -> np.ndarray:
        """The counts of the topics: a number a topic and partition reach the driver."""
        return np.sum([np.zeros(k), *state.map(lambda row: row[1][3].sum(axis=0)).collect()], axis=0)

    def sent(state: RDD) -> RDD:
        return state.flatMap(_sent(blocks)).partitionBy(blocks, _place)

    state = cells.map(lambda row: (row[0], first_shares(row[0], row[1], k, seed)), True).persist(kept)
    totals, seconds = summed(state), []
    for number in range(1, iterations + 1):
        started = time.monotonic()
        answers = sent(state).mapPartitions(_answered(size, blocks, k)).partitionBy(parts, _place)
        work = _stepped(totals, size, alpha, beta)
        following = _together([cells, state, answers], parts).mapPartitions(work, True).persist(kept)
        if interval > 0 and number % interval == 0:
            following.checkpoint()
        totals = summed(following)
        state.unpersist()
        state = following
        seconds.append(time.monotonic() - started)
    documents = state.map(lambda row: (row[1][0].astype("<i8").tobytes(), row[1][1].tobytes()))
    terms = sent(state).mapPartitions(_terms(size, blocks, k))
    rows = spark.createDataFrame(documents.union(terms), "ids binary, counts binary", verifySchema=False)
    vectors = rows.mapInArrow(_vector_rows(k), "id long, counts array<double>").select(
        "id",
        F.struct(
            F.lit(1).cast("tinyint").alias("type"), F.lit(None).cast("int").alias("size"),
            F.lit(None).cast("array<int>").alias("indices"), F.col("counts").alias("values"),
        ).alias("topicWeights"),
    )
    path = fresh_path(spark, "counts")
    vectors.write.parquet(path)
    state.unpersist()
    cells.unpersist()
    return EmFit(lda, fixed, path, tuple(totals.tolist()), size, alpha, beta, tuple(seconds))
