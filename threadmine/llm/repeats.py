"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

A suffix is a window of ``WINDOW`` bytes. Suffixes are ordered by most-significant-digit
passes of eight bytes, through the window's length and no further; after each pass a suffix
alone in its group leaves, and the groups that are left at the end are exactly the repeated
windows.

Sorting every byte position of a corpus would move many times its size. So the first digit is
drawn from inside the window: its anchor, the 64-byte gram with the least hash in it, which
equal windows share at the same place. A run of windows with one anchor travels as one row of
fixed size. Runs whose anchor occurs once have no repeated window. Runs that agree in all
their bytes are repeated as a whole. Only the others fetch their bytes for the digit passes,
and only windows with the same anchor at the same place meet there.

An anchor of a widespread passage may hold any share of all runs. Hot anchors, found by a sample
that decides on the way only and not on the result, are dealt by all the window's bytes instead:
equal runs, then equal windows, are counted in every task before they are shuffled, and only
counts above one are joined back to the runs, where adaptive execution splits a skewed key.

Texts are known by their digest, so it does not matter how ids or rows repeat.

Defined results: a null text is empty; a text shorter than the window has nothing removed;
overlapping occurrences within a text count; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmine.llm.memory import released
from threadmine.llm.naming import exact, free_prefix
from threadmine.session import ensure_checkpoints, fresh_path

WINDOW = 200
GRAM = 64  # a power of two, at most WINDOW
#: Window starts that are hashed at a time; below 2 ** 20, as an anchor's place is kept in the
#: last 20 bits of its rank.
BLOCK = 1 << 16
#: Bytes of contexts whose windows are sorted at a time, unless one anchor has more.
SORTED = 1 << 20
#: One in so many runs is drawn to find hot anchors. Hot is one of over ``HOT_RUNS`` runs and over
#: a ``HOT_ANCHORS``-th of all, by the sample. So there are fewer than ``HOT_ANCHORS``, at 8 bytes
#: each, whatever the input: this bounds what is broadcast.
DRAWN = 32
HOT_RUNS = 1 << 14
HOT_ANCHORS = 1 << 20

_rng = np.random.default_rng(2024)
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1, 1 << 62)) * 8 + 5
_MASK = (1 << 64) - 1
_PLACE = np.uint64((1 << 20) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, BLOCK + 2 * WINDOW)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), BLOCK + 2 * WINDOW)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def runs(raw: bytes, window: int = WINDOW) -> np.ndarray:
    """Runs of window starts with one anchor: rows of anchor hash, hash of all the run's bytes,
    first start, number of starts, and the anchor's distance from the first start."""
    found = [np.empty((5, 0), np.int64)]
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, len(data) - window + 1, BLOCK):
        values = _VALUES[data[at : at + BLOCK + window - 1]]
        grams, size = values, 1
        while size < GRAM:
            grams = grams[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + grams[size:]
            size *= 2
        grams = _mixed(grams)
        rank = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        width, least = window - GRAM + 1, rank
        size = 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: size - width], least[width - size :])
        anchor = (least & _PLACE).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        count = np.diff(np.append(first, len(anchor)))
        total = np.concatenate(([0], np.cumsum(values * _UP[: len(values)], dtype=np.uint64)))
        total = total.astype(np.uint64)
        whole = (total[first + count + window - 1] - total[first]) * _DOWN[first]
        place = anchor[first] - first
        # Runs of other lengths or with the anchor elsewhere are other runs.
        whole = _mixed(whole + _mixed((count * 4096 + place).astype(np.uint64)))
        found.append(
            np.stack(
                [
                    grams[anchor[first]].view(np.int64),
                    whole.view(np.int64),
                    at + first,
                    count,
                    place,
                ]
            )
        )
    return np.concatenate(found, axis=1)


def _several(alive: np.ndarray, parted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is not alone in its group, and numbers of the groups, which ``parted`` tells apart."""
    new = np.ones(len(alive) + 1, bool)
    new[1:-1] = parted
    several = ~(new[:-1] & new[1:])
    return alive[several], np.cumsum(new[:-1])[several]


def repeated_windows(
    contexts: list[bytes], keys: np.ndarray, counts: np.ndarray, window: int = WINDOW
) -> np.ndarray:
    """Which windows occur more than once under their key: one flag per window, in order.

    ``contexts[i]`` holds ``counts[i]`` windows; ``keys[i]`` is the key of its first one, and
    the keys of the others follow it.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    buffer = np.frombuffer(b"".join(contexts) + b"\0" * 8, np.uint8)
    digits = np.lib.stride_tricks.sliding_window_view(buffer, 8)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    shift = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    position = np.repeat(begins, counts) + shift
    key = np.repeat(keys, counts) + shift
    alive = np.argsort(key, kind="stable")
    alive, group = _several(alive, np.diff(key[alive]) != 0)
    for depth in range(0, window, 8):
        if not len(alive):
            break
        own = digits[position[alive] + depth].view(">u8").ravel().astype(np.uint64)
        if depth + 8 > window:
            own >>= np.uint64(8 * (depth + 8 - window))
        # A group with one digit stays as it is.
        parted = (own[1:] != own[:-1]) & (group[1:] == group[:-1])
        if not parted.any():
            continue
        split = np.zeros(group[-1] + 1, bool)
        split[group[1:][parted]] = True
        at = np.flatnonzero(split[group])
        order = at[np.lexsort((own[at], group[at]))]
        alive[at], own[at] = alive[order], own[order]
        alive, group = _several(alive, (own[1:] != own[:-1]) | (group[1:] != group[:-1]))
    flags = np.zeros(len(position), bool)
    flags[alive] = True
    return flags


def _text_rows(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _digest(body).alias("digest"),
        body.cast("binary").alias("raw"),
    )


def _digest(body: Column) -> Column:
    """128 bits that stand for a text."""
    # Never null, which spares the joins a filter and lets them share one shuffle.
    return F.coalesce(F.unhex(F.substring(F.sha2(body, 256), 1, 32)), F.lit(b""))


_RUN = "digest binary, anchor long, whole long, start long, count long, place long"


def _all_runs(rows: DataFrame, window: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = [runs(raw, window) for raw in some.column(1).to_pylist()]
                owner = np.repeat(np.arange(len(found)), [x.shape[1] for x in found])
                yield pa.record_batch(
                    [
                        some.column(0).take(pa.array(owner)),
                        *(pa.array(x) for x in np.concatenate(found, axis=1)),
                    ],
                    ["digest", "anchor", "whole", "start", "count", "place"],
                )

    return rows.select("digest", "raw").mapInArrow(released(work), _RUN)


def _sorted_runs(found: DataFrame) -> DataFrame:
    """Runs whose anchor occurs again, as ``kind``: 0, repeated as a whole; 1, to be sorted;
    2, one of the repeated ones, to be sorted with those. Kinds 3 and 4 are 1 and 2 where the
    anchor is hot."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        anchor, whole = rows["anchor"].to_numpy(), rows["whole"].to_numpy()
        new_anchor = np.ones(len(anchor), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_whole = new_anchor.copy()
        new_whole[1:] |= whole[1:] != whole[:-1]
        of_anchor, of_whole = np.cumsum(new_anchor) - 1, np.cumsum(new_whole) - 1
        again = np.bincount(of_anchor)[of_anchor] > 1
        copied = np.bincount(of_whole)[of_whole] > 1
        asking = again & ~copied
        asked = np.bincount(of_anchor, asking)[of_anchor] > 0
        standing = asked & copied & new_whole
        pick = np.concatenate([np.flatnonzero(x) for x in (copied, asking, standing)])
        kind = np.repeat([0, 1, 2], [copied.sum(), asking.sum(), standing.sum()])
        out = rows.take(pa.array(pick)).append_column("kind", pa.array(kind.astype(np.int32)))
        return out.combine_chunks().to_batches(max_chunksize=None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            # The last anchor of a batch may go on in the next one.
            last = int(np.searchsorted(anchor, anchor[-1]))
            if last == 0 and rest and rest[-1].column("anchor")[-1].as_py() == anchor[-1]:
                rest.append(batch)
                continue
            if last or rest:
                yield from settle(pa.Table.from_batches([*rest, batch.slice(0, last)]))
            rest = [batch.slice(last)]
        if rest:
            yield from settle(pa.Table.from_batches(rest))

    dealt = found.repartition("anchor").sortWithinPartitions("anchor", "whole")
    return dealt.mapInArrow(released(work), f"{_RUN}, kind int")


def _hot_anchors(found: DataFrame) -> DataFrame:
    """Column ``anchor``: fewer than ``HOT_ANCHORS`` rows."""
    drawn = found.sample(1 / DRAWN, seed=11).groupBy("anchor").count().checkpoint()
    total = drawn.agg(F.sum("count")).first()[0] or 0
    hot = F.col("count") > max(HOT_RUNS / DRAWN, total / HOT_ANCHORS)
    return drawn.filter(hot).select("anchor")


def _hot_runs(found: DataFrame) -> DataFrame:
    """As ``_sorted_runs``, for hot anchors: equal runs are counted before they are shuffled."""
    wholes = found.groupBy("anchor", "whole").agg(
        F.count("*").alias("n"), F.min(F.struct("digest", "start", "count", "place")).alias("run")
    )
    several = wholes.filter("n > 1").select("anchor", "whole")
    copied = found.join(several, ["anchor", "whole"], "left_semi")
    others = wholes.select(
        "run.*", "anchor", "whole", F.when(F.col("n") > 1, 4).otherwise(3).alias("kind")
    )
    return copied.withColumn("kind", F.lit(0)).unionByName(others)


def window_hashes(context: bytes, count: int, place: int, window: int = WINDOW) -> np.ndarray:
    """Hashes of the ``count`` windows of a run, each of its bytes and its anchor's place."""
    values = _VALUES[np.frombuffer(context, np.uint8)]
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _UP[: len(values)], out=total[1:])
    first = np.arange(count)
    whole = (total[first + window] - total[first]) * _DOWN[:count]
    return _mixed(whole + _mixed((place - first).astype(np.uint64))).view(np.int64)


def _hot_out(contexts: DataFrame, window: int) -> DataFrame:
    """As ``_sorted_out``, for hot anchors: equal windows are counted before they are shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                counts = some.column("count").to_numpy()
                runs_of = zip(
                    some.column("context").to_pylist(),
                    counts.tolist(),
                    some.column("place").to_pylist(),
                    strict=True,
                )
                hashes = [window_hashes(c, n, p, window) for c, n, p in runs_of]
                owner = np.repeat(np.arange(len(counts)), counts)
                shift = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
                held = some.select(["digest", "anchor", "start", "kind"]).take(pa.array(owner))
                yield pa.record_batch(
                    [
                        *held.columns,
                        pa.array(np.concatenate(hashes)),
                        pa.array(held.column("start").to_numpy() + shift),
                    ],
                    ["digest", "anchor", "run", "kind", "whole", "start"],
                )

    windows = contexts.mapInArrow(
        released(work), "digest binary, anchor long, run long, kind int, whole long, start long"
    )
    repeated = windows.groupBy("anchor", "whole").count().filter("count > 1")
    several = repeated.select("anchor", "whole")
    hits = windows.filter("kind = 3").join(several, ["anchor", "whole"], "left_semi")
    # Windows of one run share their anchor, so they cover one stretch.
    return (
        hits.groupBy("digest", "run")
        .agg(F.min("start").alias("start"), (F.max("start") + window).alias("end"))
        .drop("run")
    )


def _contexts(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Runs with their bytes."""
    lists = (
        wanted.groupBy("digest")
        .agg(F.collect_list(F.struct("anchor", "start", "count", "place", "kind")).alias("runs"))
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", "anchor", "start", "count", "place", "kind", "context"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for _, digest, raw, own in zip(
                    *(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True
                ):
                    for r in own:
                        end = r["start"] + r["count"] + window - 1
                        fixed = (r["anchor"], r["start"], r["count"], r["place"], r["kind"])
                        out.append((digest, *fixed, raw[r["start"] : end]))
                kinds = [pa.binary(), *[pa.int64()] * 4, pa.int32(), pa.binary()]
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds)], names
                )

    # All columns of ``rows``, so that this and the last join read the same shuffle of texts.
    joined = rows.join(lists, "digest").dropDuplicates(["digest"])
    return joined.select("doc_id", "digest", "raw", "runs").mapInArrow(
        released(work),
        "digest binary, anchor long, start long, count long, place long, kind int,"
        " context binary",
    )


def _sorted_out(contexts: DataFrame, window: int) -> DataFrame:
    """Stretches ``digest``, ``start``, ``end`` of repeated windows among those to be sorted."""
    names = ["digest", "start", "end"]

    def settle(rows: pa.Table) -> pa.RecordBatch:
        anchor, place = rows["anchor"].to_numpy(), rows["place"].to_numpy()
        counts, start = rows["count"].to_numpy(), rows["start"].to_numpy()
        numbers = np.unique(anchor, return_inverse=True)[1].astype(np.int64)
        # Windows meet under the same anchor at the same distance: place falls along a run.
        keys = numbers * (4 * window) + 2 * window - place
        flags = repeated_windows(rows["context"].to_pylist(), keys, counts, window)
        owner = np.repeat(np.arange(len(counts)), counts)
        flags &= (rows["kind"].to_numpy() == 1)[owner]
        starts = start[owner] + np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
        hit = np.flatnonzero(flags)
        begins = np.ones(len(hit), bool)
        begins[1:] = (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(hit)) - 1
        return pa.record_batch(
            [
                rows["digest"].combine_chunks().take(pa.array(owner[hit[first]])),
                pa.array(starts[hit[first]]),
                pa.array(starts[hit[last]] + window) if len(hit) else pa.array([], pa.int64()),
            ],
            names,
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                rest.append(some)
                if sum(b.nbytes for b in rest) < SORTED:
                    continue
                rows = pa.Table.from_batches(rest)
                anchor = rows["anchor"].to_numpy()
                last = int(np.searchsorted(anchor, anchor[-1]))
                if last:
                    yield settle(rows.slice(0, last))
                rest = rows.slice(last).to_batches()
        if rest:
            yield settle(pa.Table.from_batches(rest))

    dealt = contexts.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(released(work), "digest binary, start long, end long")


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches as maximal runs: those that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(stretches):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _at_rest(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder, which takes less room than a checkpoint."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def repeated_stretches(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``digest`` and ``stretches``: per text, the byte ranges that repeated windows cover."""
    ensure_checkpoints(rows.sparkSession)
    found = _at_rest(_all_runs(rows, window), "runs")
    hot = F.broadcast(_hot_anchors(found))  # bounded, see HOT_ANCHORS
    usual = found.join(hot, "anchor", "left_anti").select(*found.columns)
    kinds = _sorted_runs(usual).unionByName(_hot_runs(found.join(hot, "anchor", "left_semi")))
    # What is repeated as a whole needs its anchor no longer.
    settled = _at_rest(
        kinds.select(
            "digest",
            "start",
            "count",
            "kind",
            *[F.when(F.col("kind") > 0, F.col(c)).alias(c) for c in ("anchor", "place")],
        ),
        "settled",
    )
    whole = settled.filter("kind = 0").select(
        "digest", "start", (F.col("start") + F.col("count") + window - 1).alias("end")
    )
    sorted_out = _sorted_out(_contexts(rows, settled.filter("kind IN (1, 2)"), window), window)
    # No checkpoint: in one query with the others it reads the same shuffle of texts.
    of_hot = _contexts(rows, settled.filter("kind IN (3, 4)"), window)
    covered = whole.distinct().unionByName(sorted_out).unionByName(_hot_out(of_hot, window))
    return covered.groupBy("digest").agg(
        F.collect_list(F.struct("start", "end")).alias("stretches")
    )


def removal_report(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: ``n_bytes``, ``n_removed``, ``n_spans`` and the digest of the bytes kept."""
    rows = _text_rows(docs, text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for batch in batches:
            out = []
            for raw, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans, kept, at = merged(_pairs(own)), hashlib.sha256(), 0
                for start, end in spans:
                    kept.update(raw[at:start])
                    at = end
                kept.update(raw[at:])
                removed = sum(end - start for start, end in spans)
                out.append((len(raw), removed, len(spans), kept.hexdigest()))
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.record_batch(
                [batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names
            )

    joined = rows.join(repeated_stretches(rows, window), "digest", "left")
    return joined.select("doc_id", "raw", "stretches").mapInArrow(
        released(work), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def _pairs(stretches: list[dict] | None) -> list[tuple[int, int]]:
    return [(s["start"], s["end"]) for s in stretches or ()]


def without_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated bytes taken out of the text.

    Bytes of a character that is cut in the middle go as well. A null text stays null.
    """
    own = _digest(F.coalesce(F.col(text), F.lit("")))
    prefix = free_prefix("repeats_", docs.columns)
    key, found = f"{prefix}digest", f"{prefix}stretches"
    stretches = repeated_stretches(_text_rows(docs, text), window).select(
        F.col("digest").alias(key), F.col("stretches").alias(found)
    )
    joined = docs.withColumn(key, own).join(stretches, key, "left")
    joined = joined.select(*exact(docs.columns), found)
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for whole, parts in zip(
                batch.column(at).to_pylist(), batch.column(len(docs_names)).to_pylist(), strict=True
            ):
                if parts:
                    raw, kept, begin = whole.encode(), [], 0
                    for start, end in merged(_pairs(parts)):
                        kept.append(raw[begin:start].decode(errors="ignore"))
                        begin = end
                    whole = "".join([*kept, raw[begin:].decode(errors="ignore")])
                texts.append(whole)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, docs_names)

    docs_names = list(docs.columns)
    return joined.mapInArrow(released(work), docs.schema)
