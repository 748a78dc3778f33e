"""SimHash near-duplicates, found with pigeonring filtering.

A fingerprint has 64 bits on a ring of five segments. If two fingerprints differ in at most
four bits, some chain of consecutive segments stays within its proportional budget at every
length: no difference in its first segment, at most one in the first two, two in the first
three, three in the first four. So a pair that may be linked agrees in one whole segment and
in either half of the next one. Distinct fingerprints are brought together by these two keys
for each of the five starts; the rest of the chain is then tested, and only what passes all
its budgets gets the full Hamming check.

Equal fingerprints are one node, so copies cost nothing. Fingerprints under one key are
linked along the branches of a forest, never as all pairs; a key with very many of them is
dealt out as pairs of blocks.

Defined results: a null text is treated as an empty one, whose fingerprint is zero; zero is
linked like any other; repeated rows all come back; a component with only null ids has a null
``component_id``; an empty table gives an empty result; columns other than the id and the
text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmine.llm.components import connected_components
from threadmine.llm.memory import released
from threadmine.session import ensure_checkpoints

WORDS = 4
DISTANCE = 4
SEED = 42
#: First bits and sizes of the segments, from the low end: one more than ``DISTANCE``.
STARTS = (0, 13, 26, 39, 52)
SIZES = (13, 13, 13, 13, 12)
#: Fingerprints of one key that are compared at a time.
BLOCK = 2048

ROUND = 1 << 13  # shingles that are counted at a time


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 bits: one is set if it is set in over half of the shingles' hashes."""
    import xxhash

    # Only A-Z change, and bytes split at exactly space and 9 to 13.
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(found))
    starts, ends = starts[: len(found) - width + 1], ends[width - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), ROUND):
        spans = zip(starts[at : at + ROUND].tolist(), ends[at : at + ROUND].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    more = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(more.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id``, ``bits`` (the fingerprint as a signed long) and ``text_key`` (a hash of the
    text) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            bits = np.array(found, np.uint64).view(np.int64)
            columns = [batch.column(0), pa.array(bits), batch.column(2)]
            yield pa.record_batch(columns, ["doc_id", "bits", "text_key"])

    wanted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(text),
        F.xxhash64(text).alias("text_key"),
    )
    return wanted.mapInArrow(released(work), "doc_id long, bits long, text_key long")


def _segment(i: int) -> Column:
    low = F.shiftrightunsigned("bits", STARTS[i])
    return low.bitwiseAND(F.lit((1 << SIZES[i]) - 1))


def _keys() -> Column:
    """Ten keys: a segment, and the low or the high half of the next one."""
    keys = []
    for i in range(len(STARTS)):
        following = _segment((i + 1) % len(STARTS))
        for half, part in ((0, following % 64), (1, F.floor(following / 64))):
            keys.append(((_segment(i) * 128 + part) * 5 + i) * 2 + half)
    return F.array(*keys)


def within_budgets(differing: np.ndarray, start: int) -> np.ndarray:
    """Which differences (as xor) keep every chain from ``start`` within its budget."""
    passed, spent = np.ones(differing.shape, bool), np.zeros(differing.shape, np.int64)
    for step in range(len(STARTS)):
        i = (start + step) % len(STARTS)
        part = (differing >> np.uint64(STARTS[i])) & np.uint64((1 << SIZES[i]) - 1)
        spent = spent + np.bitwise_count(part)
        passed &= spent <= (step + 1) * DISTANCE // len(STARTS)
    return passed


def _linked(left: np.ndarray, right: np.ndarray, start: int) -> np.ndarray:
    """Which of ``right`` a chain from ``start`` and the full check link to ``left``."""
    differing = left ^ right
    hit = np.flatnonzero(within_budgets(differing, start))
    return hit[np.bitwise_count(differing[hit]) <= DISTANCE]


def forest(bits: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Edges that link what is linked among ``bits``, at most one per fingerprint.

    What has not been reached yet is compared with one reached fingerprint after the other,
    so a dense group costs little more than its size.
    """
    edges, open_, waiting = [], bits, []
    while len(open_):
        if not waiting:
            waiting.append(open_[0])
            open_ = open_[1:]
            continue
        one = waiting.pop()
        hit = _linked(one, open_, start)
        if len(hit):
            reached = open_[hit]
            edges += [(int(one), int(x)) for x in reached]
            waiting += list(reached)
            open_ = np.delete(open_, hit)
    return edges


def _pairs_of_small_keys(
    key: np.ndarray, bits: np.ndarray, starts: np.ndarray
) -> list[np.ndarray]:
    """Linked pairs among rows sorted by key, by comparing each row with the k-th after it."""
    found, step = [], 1
    rows = np.arange(len(key))
    while True:
        rows = rows[rows + step < len(key)]
        rows = rows[key[rows] == key[rows + step]]
        if not len(rows):
            return found
        for start in range(len(STARTS)):
            own = rows[starts[rows] == start]
            differing = bits[own] ^ bits[own + step]
            hit = own[within_budgets(differing, start)]
            hit = hit[np.bitwise_count(bits[hit] ^ bits[hit + step]) <= DISTANCE]
            if len(hit):
                found.append(np.stack([bits[hit], bits[hit + step]]))
        step += 1


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges ``a``, ``b`` that join up all ``bits`` within the distance of one another."""
    keyed = distinct.select("bits", F.explode(_keys()).alias("key"))
    # At most one in ``block`` rows, so it follows the data only as a small part of them.
    sizes = keyed.groupBy("key").count()
    large = sizes.filter(F.col("count") > block).select(
        "key", F.ceil(F.col("count") / block).cast("int").alias("blocks")
    )
    own = F.pmod(F.xxhash64("bits"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = keyed.join(large, "key", "left").select(
        "bits",
        "key",
        F.explode(
            F.when(F.col("blocks").isNull(), F.array(F.lit(0)))
            # the pair of its own block with each other one, as one number
            .otherwise(
                F.transform(
                    every,
                    lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other),
                )
            )
        ).alias("pair"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def compare(rows: np.ndarray) -> pa.RecordBatch:
            key, pair, bits = rows[0], rows[1], rows[2].view(np.uint64)
            new = np.flatnonzero((np.diff(key) != 0) | (np.diff(pair) != 0)) + 1
            run = np.zeros(len(key), np.int64)
            run[new] = 1
            run = np.cumsum(run)
            sizes = np.bincount(run)
            small = sizes[run] <= 64
            starts = (key >> 1) % 5
            found = _pairs_of_small_keys(run[small], bits[small], starts[small])
            firsts = np.concatenate(([0], new))
            for r in np.flatnonzero(sizes > 64):
                at = firsts[r]
                edges = forest(bits[at : at + sizes[r]], int(starts[at]))
                if edges:
                    found.append(np.array(edges, np.uint64).T)
            pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.uint64)
            return pa.record_batch([pa.array(x.view(np.int64)) for x in pairs], schema=kind)

        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(3)]
            rest.append(np.stack(columns))
            rows = np.concatenate(rest, axis=1)
            # Rows of the last key and pair may go on in the next batch.
            last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            if not last.all():
                yield compare(rows[:, ~last])
            rest = [rows[:, last]]
        if rest and rest[0].shape[1]:
            yield compare(rest[0])

    rows = dealt.select("key", F.col("pair").cast("long").alias("pair"), "bits")
    sorted_rows = rows.repartition("key", "pair").sortWithinPartitions("key", "pair", "bits")
    return sorted_rows.mapInArrow(released(work), "a long, b long")


def _components(docs: DataFrame, text: str) -> DataFrame:
    """Rows of :func:`fingerprints` with the least id reachable over linked fingerprints."""
    ensure_checkpoints(docs.sparkSession)
    marked = fingerprints(docs, text).checkpoint()
    nodes = marked.groupBy("bits").agg(F.min("doc_id").alias("least_id")).checkpoint()
    found = connected_components(links(nodes.select("bits")))
    classes = nodes.join(found.withColumnRenamed("node", "bits"), "bits", "left").select(
        "bits", "least_id", F.coalesce("component", "bits").alias("component")
    )
    least = classes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = classes.join(least, "component").select("bits", "component", "component_id")
    return marked.join(named, "bits")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row's ``fingerprint`` and the least id reachable over linked fingerprints."""
    return _components(docs, text).select(
        "doc_id",
        F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def without_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` with one document of each component: that with the least id.

    Rows without an id are no documents to choose among: they all stay. Of rows that share the
    least id, one stays: rows with one text are interchangeable, of several texts that with the
    least hash stays.
    """
    found = _components(docs.select("doc_id", text), text)
    keep = (
        found.filter(F.col("doc_id") == F.col("component_id"))
        .groupBy("component")
        .agg(F.min(F.struct("component_id", "text_key")).alias("first"))
        .select(
            F.col("first.component_id").alias("kept_id"), F.col("first.text_key").alias("kept_key")
        )
    )
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("kept_id"),
        F.xxhash64(text).alias("kept_key"),
    )
    named = whole.filter(F.col("kept_id").isNotNull()).dropDuplicates(["kept_id", "kept_key"])
    kept = named.join(keep, ["kept_id", "kept_key"], "left_semi")
    return kept.select("row.*").unionByName(docs.filter(F.col("doc_id").isNull()))
