"""Conversation structure repair by rank-convergence parallel Viterbi.

A conversation is brought to the role order ``(s?(ua)+)?`` (an optional system message, then
user and assistant in turn, or nothing) by the cheapest edits: Keep a row for 0, Rerole it to
user or assistant for 1, Delete it for 2, Insert an empty user or assistant message for 5. Blank
rows (no character but ASCII white space) and rows whose role and text were seen earlier in the
conversation have to be deleted; a row whose last such character is not ``.``, ``!`` or ``?`` is
truncated and costs 5 more unless it is deleted. Of equally cheap edits the sequence of initials
that is least in ASCII order is taken.

The costs of finishing from each of the four states of the role order are a vector, and a row
maps the vector behind it to the one before it (a Viterbi step from the end). Rows are sorted by
conversation and turn over all partitions and cut into chunks, so a conversation of any length
is spread over many tasks. A chunk starts from speculative vectors: four that generate every
vector that can stand there. Where its results differ only by constants, its vector is known
whatever comes behind it; otherwise it is fixed up with the chunks behind it, over spans that
double in each pass, until the vectors differ only by constants. The vectors stitched together in
this way drive the tracing: each chunk is traced from all four states, states are passed on over
doubling spans, and the least edits are read off in order.

What is left for one task is what the result asks for: one stream over the rows of a conversation
for the digest of all its repaired text. It holds the edits, not the texts.

Defined results: rows go by turn, nulls first; rows that share a turn by a hash of role and text,
so equal rows stand together; a null role or text counts as one space; rows without conversation
are one conversation; an empty table gives an empty result; a conversation is never too long;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmine.session import ensure_checkpoints

#: Rows of a chunk, as a power of two.
CHUNK_BITS = 12
#: Positions whose cost vectors a task holds at a time, about.
CELLS = 1 << 20

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# States: nothing yet, after system, after user, after assistant; roles by initial: s, u, a, other.
# NEVER is a state that cannot be left.
NEVER = 4
#: The state after keeping a row, by its role and the state before.
KEPT = np.array([[1, NEVER, NEVER, NEVER], [2, 2, NEVER, 2], [NEVER, NEVER, 3, NEVER], [NEVER] * 4])
#: The state after a row that is made to fit, by the state before.
FITTED = np.array([2, 2, 3, 2])
ROLE_OF = {2: "user", 3: "assistant"}
ROLES = {"s": 0, "u": 1, "a": 2}
LEGAL = {"su", "ua", "au"}
SOUND, CUT_OFF, BLANK, DUPLICATE = range(4)
INFINITE = 1 << 40

#: Costs of finishing behind the last row: with inserted messages only.
END = (0, 10, 5, 0)


def _generators() -> np.ndarray:
    """Four vectors whose shifted minima are all cost vectors that can occur.

    Every such vector keeps these differences (a row keeps them too): from a later state the
    edits of another one can be imitated for so much more.
    """
    most = np.full((4, 4), INFINITE)
    np.fill_diagonal(most, 0)
    for state, other, cost in (
        (3, 0, 2), (3, 1, 0), (0, 1, 0), (0, 3, 0), (2, 3, 5), (3, 2, 5), (0, 2, 5), (1, 2, 5),
    ):
        most[state, other] = cost
    for via in range(4):
        most = np.minimum(most, most[:, via, None] + most[None, via, :])
    return most.T.copy()


GENERATORS = _generators()


# --- cost vectors ----------------------------------------------------------------------


def step_back(vectors: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Cost vectors before one row each (``fault`` * 4 + role), from those behind it.

    ``vectors`` has the chunk first and the state last.
    """
    shape = (-1, *[1] * (vectors.ndim - 2), 4)
    role, fault = codes % 4, codes // 4
    more = np.where(fault == CUT_OFF, TRUNCATED, np.where(fault >= BLANK, INFINITE, 0))
    more = more.reshape(-1, *[1] * (vectors.ndim - 1))
    padded = np.concatenate([vectors, np.full((*vectors.shape[:-1], 1), INFINITE)], axis=-1)
    kept = np.broadcast_to(KEPT[role].reshape(shape), vectors.shape)
    out = np.minimum(vectors + DELETE, np.take_along_axis(padded, kept, axis=-1) + more)
    out = np.minimum(out, vectors[..., FITTED] + REROLE + more)
    # messages may be inserted before the row
    user = np.minimum(out[..., 2], out[..., 3] + INSERT)
    assistant = np.minimum(out[..., 3], out[..., 2] + INSERT)
    first = np.minimum(out[..., 0], user + INSERT)
    system = np.minimum(out[..., 1], user + INSERT)
    return np.stack([first, system, user, assistant], axis=-1)


def _blocks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Chunks by falling length, so many at a time that their vectors fit ``CELLS``."""
    order, at = np.argsort(-lengths, kind="stable"), 0
    while at < len(order):
        size = max(1, CELLS // max(1, int(lengths[order[at]])))
        yield order[at : at + size]
        at += size


def _right_aligned(codes: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    width = len(codes[own[0]])
    out = np.zeros((len(own), width), np.int64)
    for i, c in enumerate(own):
        out[i, width - len(codes[c]) :] = codes[c]
    return out


def heads(codes: list[np.ndarray], last: np.ndarray) -> np.ndarray:
    """For each chunk the vectors before it, from the four speculative ones behind it; behind
    the last chunk of a conversation stands the true one."""
    lengths = np.array([len(c) for c in codes])
    out = np.empty((len(codes), 4, 4), np.int64)
    for own in _blocks(lengths):
        rows = _right_aligned(codes, own)
        vectors = np.where(last[own, None, None], np.array(END), GENERATORS)
        for back in range(1, rows.shape[1] + 1):
            active = int((lengths[own] >= back).sum())
            vectors[:active] = step_back(vectors[:active], rows[:active, -back])
        out[own] = vectors
    return out


def traces(codes: list[np.ndarray], tails: np.ndarray, last: np.ndarray):
    """The least edits of each chunk from each state, and the states they end in.

    A row takes three places: up to two inserted messages and its own edit.
    """
    lengths = np.array([len(c) for c in codes])
    edits: list = [None] * len(codes)
    ends = np.empty((len(codes), 4), np.int64)
    for own in _blocks(lengths):
        rows = _right_aligned(codes, own)
        n, width = rows.shape
        costs = np.empty((width + 1, n, 4), np.int64)
        costs[width] = tails[own]
        for back in range(1, width + 1):
            active = int((lengths[own] >= back).sum())
            costs[width - back] = costs[width - back + 1]
            costs[width - back, :active] = step_back(
                costs[width - back + 1, :active], rows[:active, -back]
            )
        state = np.tile(np.arange(4), (n, 1))
        written = np.zeros((n, 4, 3 * width + 2), np.uint8)
        for at in range(width):
            active = int((lengths[own] >= width - at).sum())
            here = slice(0, active)
            done, behind = costs[at, here], costs[at + 1, here]
            now = state[here]
            for place in range(2):
                cost = np.take_along_axis(done, now, 1)
                deletes = np.take_along_axis(behind, now, 1) + DELETE == cost
                inserts = ~deletes & (np.take_along_axis(done, FITTED[now], 1) + INSERT == cost)
                written[here, :, 3 * at + place] = np.where(inserts, ord("I"), 0)
                now = np.where(inserts, FITTED[now], now)
            cost = np.take_along_axis(done, now, 1)
            deletes = np.take_along_axis(behind, now, 1) + DELETE == cost
            code = rows[here, at]
            more = np.where(code // 4 == CUT_OFF, TRUNCATED, 0)[:, None]
            after = KEPT[code % 4][np.arange(active)[:, None], now]
            padded = np.concatenate([behind, np.full((active, 1), INFINITE)], axis=1)
            keeps = ~deletes & (np.take_along_axis(padded, after, 1) + more == cost)
            written[here, :, 3 * at + 2] = np.where(
                deletes, ord("D"), np.where(keeps, ord("K"), ord("R"))
            )
            state[here] = np.where(deletes, now, np.where(keeps, after, FITTED[now]))
        for place in range(2):
            open_ = last[own, None] & ((state == 2) | (state == 1))
            written[:, :, 3 * width + place] = np.where(open_, ord("I"), 0)
            state = np.where(open_, FITTED[state], state)
        for i, c in enumerate(own):
            edits[c] = [x.tobytes().translate(None, b"\0").decode() for x in written[i]]
        ends[own] = state
    return edits, ends


# --- chunks ----------------------------------------------------------------------------

CONVERSATION = ["unnamed", "conversation"]


def _solid(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def ordered_rows(conversations: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Rows sorted by conversation and turn, with their ``position`` and ``chunk``, fixed."""
    ensure_checkpoints(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        F.isnull("conv_id").alias("unnamed"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conversation"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
    ).withColumns(
        {
            "digest": F.unhex(
                F.sha2(F.concat(F.octet_length("role"), F.lit(":"), F.col("role"), F.col("text")), 256)
            ),
            "tie": F.monotonically_increasing_id(),
        }
    )
    order = [*CONVERSATION, "turn", "digest", "tie"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return (
        placed.withColumn("position", F.monotonically_increasing_id())
        .withColumn("chunk", F.shiftright("position", chunk_bits))
        .drop("tie")
        .checkpoint()
    )


def chunks(rows: DataFrame) -> DataFrame:
    """One row per chunk of a conversation: ``codes`` of its rows in order, its number ``at``
    in the conversation, from 1, and whether it is the ``last``."""
    firsts = rows.groupBy(*CONVERSATION, "digest").agg(F.min("position").alias("position"))
    text = F.col("text")
    sound = text.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    role = F.substring("role", 1, 1)
    narrow = rows.select(
        *CONVERSATION,
        "chunk",
        "position",
        F.when(~_solid(text), BLANK).when(~sound, CUT_OFF).otherwise(SOUND).alias("fault"),
        F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3).alias("role"),
    ).join(firsts.select("position", F.lit(True).alias("first")), "position", "left")
    fault = F.when(
        F.col("first").isNull() & (F.col("fault") != BLANK), F.lit(DUPLICATE)
    ).otherwise(F.col("fault"))
    listed = narrow.groupBy(*CONVERSATION, "chunk").agg(
        F.array_sort(
            F.collect_list(F.struct("position", (fault * 4 + F.col("role")).alias("code")))
        ).alias("own")
    )
    number = W.partitionBy(*CONVERSATION).orderBy("chunk")
    return listed.select(
        *CONVERSATION,
        "chunk",
        F.transform("own", lambda r: r["code"].cast("tinyint")).alias("codes"),
        F.row_number().over(number).alias("at"),
        F.lead("chunk").over(number).isNull().alias("last"),
    ).checkpoint()


def _settled(
    table: DataFrame, done: Callable[[Column], Column],
    combine: Callable[[Column, Column], Column], toward: int,
) -> DataFrame:
    """``value`` of every chunk combined with those further on until it is ``done``.

    Spans double: a value that is not done takes in that of the chunk behind its span, which
    covers a span of its own. The outermost chunk of a conversation is done from the start.
    """
    table = table.withColumn("span", F.lit(1)).checkpoint()
    while True:
        open_ = table.filter(~done(F.col("value")))
        if open_.isEmpty():
            return table
        other = table.select(
            *CONVERSATION,
            F.col("at").alias("next"),
            F.col("value").alias("next_value"),
            F.col("span").alias("next_span"),
        )
        longer = (
            open_.withColumn("next", F.col("at") + F.lit(toward) * F.col("span"))
            .join(other, [*CONVERSATION, "next"])
            .select(
                *CONVERSATION,
                "at",
                combine(F.col("value"), F.col("next_value")).alias("value"),
                (F.col("span") + F.col("next_span")).alias("span"),
            )
        )
        table = table.filter(done(F.col("value"))).unionByName(longer).checkpoint()


def _vector(heads_: Column, start: int | Column) -> Column:
    return F.slice(heads_, F.lit(start) * 4 + 1 if isinstance(start, int) else start * 4 + 1, 4)


def _parallel(value: Column) -> Column:
    """Whether the four vectors differ only by constants."""
    return F.forall(
        F.sequence(F.lit(0), F.lit(15)),
        lambda i: F.get(value, i) - F.get(value, i - i % 4)
        == F.get(value, i % 4) - F.get(value, F.lit(0)),
    )


def _behind(value: Column, other: Column) -> Column:
    """Vectors before a span from those before the span that follows it."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda i: F.array_min(
            F.transform(
                F.sequence(F.lit(0), F.lit(3)),
                lambda via: F.get(other, i - i % 4 + via) + F.get(value, via * 4 + i % 4),
            )
        ),
    )


def _codes(column: pa.ListArray) -> list[np.ndarray]:
    flat = column.flatten().to_numpy().astype(np.int64)
    ends = np.cumsum([0, *column.value_lengths().to_pylist()])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _with_tails(cut: DataFrame) -> DataFrame:
    """Chunks with ``tail``, the costs of finishing behind them, up to a constant."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = heads(_codes(batch.column("codes")), batch.column("last").to_numpy(False))
            values = pa.array(found.reshape(len(found), 16).tolist(), pa.list_(pa.int64()))
            kept = [batch.column(c) for c in (*CONVERSATION, "at")]
            yield pa.record_batch([*kept, values], [*CONVERSATION, "at", "value"])

    several = cut.filter(~(F.col("last") & (F.col("at") == 1))).select(
        *CONVERSATION, "at", "codes", "last"
    )
    known = _settled(
        several.mapInArrow(work, "unnamed boolean, conversation long, at int, value array<long>"),
        _parallel, _behind, 1,
    )
    tails = known.filter("at > 1").select(
        *CONVERSATION, (F.col("at") - 1).alias("at"), _vector(F.col("value"), 0).alias("tail")
    )
    end = F.array(*[F.lit(x).cast("long") for x in END])
    inner = cut.filter(~F.col("last")).join(tails, [*CONVERSATION, "at"])
    return inner.unionByName(cut.filter("last").withColumn("tail", end))


def _with_edits(cut: DataFrame) -> DataFrame:
    """Chunks with their ``edits``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = np.array(batch.column("tail").to_pylist(), np.int64).reshape(-1, 4)
            tails -= tails.min(axis=1, keepdims=True)
            edits, ends = traces(
                _codes(batch.column("codes")), tails, batch.column("last").to_numpy(False)
            )
            columns = [batch.column(c) for c in (*CONVERSATION, "chunk", "codes", "at", "last")]
            columns += [pa.array(edits, pa.list_(pa.string())), pa.array(ends.tolist(), pa.list_(pa.int64()))]
            yield pa.record_batch(
                columns, [*CONVERSATION, "chunk", "codes", "at", "last", "edits", "ends"]
            )

    traced = cut.mapInArrow(
        work,
        "unnamed boolean, conversation long, chunk long, codes array<tinyint>, at int,"
        " last boolean, edits array<string>, ends array<long>",
    ).checkpoint()

    # The state a chunk begins in: a map of states passed on from chunk to chunk.
    passed = traced.filter(~F.col("last")).select(
        *CONVERSATION, (F.col("at") + 1).alias("at"), F.col("ends").alias("value")
    )
    start = F.array(*[F.lit(0).cast("long")] * 4)
    firsts = traced.filter("at = 1 AND NOT last").select(*CONVERSATION, "at", start.alias("value"))
    known = _settled(
        firsts.unionByName(passed),
        lambda value: F.array_min(value) == F.array_max(value),
        lambda value, before: F.transform(before, lambda x: F.get(value, x.cast("int"))),
        -1,
    ).select(*CONVERSATION, "at", F.get("value", F.lit(0)).cast("int").alias("begins"))
    alone = traced.filter("at = 1").withColumn("begins", F.lit(0))
    return (
        traced.filter("at > 1")
        .join(known, [*CONVERSATION, "at"])
        .unionByName(alone)
        .select(*CONVERSATION, "chunk", "codes", F.get("edits", F.col("begins")).alias("edits"))
    )


# --- reading the edits off -------------------------------------------------------------


class Event(NamedTuple):
    """One edit. An inserted message has no row: its code is -1."""

    conversation: tuple
    edit: str
    role: str
    text: str
    code: int
    turn: int | None
    initial: str


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[Event]:
    """Edits in order, from each chunk's decisions followed by its rows."""
    key, state, edits, codes, at, row = None, 0, "", [], 0, 0

    def inserted() -> Iterator[Event]:
        nonlocal state, at
        while at < len(edits) and edits[at] == "I":
            state = int(FITTED[state])
            at += 1
            yield Event(key, "I", ROLE_OF[state], "", -1, None, "")

    for batch in batches:
        for unnamed, conversation, own_edits, own_codes, turn, role, text in zip(
            *[batch.column(c).to_pylist() for c in (
                *CONVERSATION, "edits", "codes", "turn", "role", "text")],
            strict=True,
        ):
            if own_edits is not None:
                yield from inserted()  # those that end the conversation before
                if key != (unnamed, conversation):
                    key, state = (unnamed, conversation), 0
                edits, codes, at, row = own_edits, own_codes, 0, 0
                continue
            yield from inserted()
            edit, code, initial = edits[at], codes[row], role[:1]
            at, row = at + 1, row + 1
            if edit == "K":
                state = int(KEPT[code % 4][state])
            elif edit == "R":
                state = int(FITTED[state])
                role = ROLE_OF[state]
            yield Event(key, edit, role, text, code, turn, initial)
    yield from inserted()


def _decided(conversations: DataFrame, chunk_bits: int) -> DataFrame:
    """The edits of each chunk followed by its rows, conversation by conversation."""
    rows = ordered_rows(conversations, chunk_bits)
    decisions = _with_edits(_with_tails(chunks(rows))).withColumn(
        "position", F.lit(-1).cast("long")
    )
    both = decisions.unionByName(
        rows.select(*CONVERSATION, "chunk", "position", "turn", "role", "text"),
        allowMissingColumns=True,
    )
    return both.repartition(*CONVERSATION).sortWithinPartitions(*CONVERSATION, "chunk", "position")


def repaired_messages(conversations: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """``(conv_id, place, edit, role, text)``: the messages that stand in each repaired
    conversation, ``place`` counting from 1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, place, held = None, 0, []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["conv_id", "place", "edit", "role", "text"],
            )

        for event in _events(batches):
            if event.conversation != key:
                key, place = event.conversation, 0
            if event.edit != "D":
                place += 1
                conv = None if key[0] else key[1]
                held.append((conv, place, event.edit, event.role, event.text))
            if len(held) >= 4096:
                yield flushed()
                held = []
        if held:
            yield flushed()

    return _decided(conversations, chunk_bits).mapInArrow(
        work, "conv_id long, place long, edit string, role string, text string"
    )


REPORT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long,"
    " audit string, repaired_sha256 string"
)


class _Report:
    def __init__(self, key: tuple) -> None:
        self.key, self.audit, self.cost, self.illegal = key, [], 0, 0
        self.faults, self.turns, self.low, self.high = [0] * 4, 0, None, None
        self.initial, self.digest, self.empty = None, hashlib.sha256(), True

    def add(self, event: Event) -> None:
        self.audit.append(event.edit)
        fault = event.code // 4 if event.code >= 0 else SOUND
        self.cost += {"I": INSERT, "D": DELETE, "R": REROLE, "K": 0}[event.edit]
        if event.code >= 0:
            self.faults[fault] += 1
            if event.turn is not None and event.turn != self.high:
                self.turns, self.high = self.turns + 1, event.turn
                self.low = event.turn if self.low is None else self.low
            if self.initial is not None:
                self.illegal += self.initial + event.initial not in LEGAL
            self.initial = event.initial
        if event.edit == "D":
            return
        self.cost += TRUNCATED * (fault == CUT_OFF)
        self.digest.update(f"{'' if self.empty else chr(10)}{event.role}:{event.text}".encode())
        self.empty = False

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (
            *self.key, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT_OFF],
            self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest(),
        )


def repair_report(conversations: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """``conv_id`` and the faults, cost, edits and repaired digest of each conversation."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*CONVERSATION, *[c.split()[0] for c in REPORT.split(", ")]]
        kinds = [pa.bool_(), *[pa.int64()] * 7, pa.string(), pa.string()]
        report, held = None, []

        def flushed() -> pa.RecordBatch:
            columns = zip(zip(*held, strict=True), kinds, strict=True)
            return pa.record_batch([pa.array(c, k) for c, k in columns], names)

        for event in _events(batches):
            if report is None or event.conversation != report.key:
                if report is not None:
                    held.append(report.row())
                report = _Report(event.conversation)
            report.add(event)
            if len(held) >= 1024:
                yield flushed()
                held = []
        if report is not None:
            held.append(report.row())
            yield flushed()

    found = _decided(conversations, chunk_bits).mapInArrow(
        work, f"unnamed boolean, conversation long, {REPORT}"
    )
    return found.withColumn("conv_id", F.when(~F.col("unnamed"), F.col("conversation"))).select(
        "conv_id", *[c.split()[0] for c in REPORT.split(", ")]
    )


def with_empty(report: DataFrame, conversations: DataFrame) -> DataFrame:
    """The report with a row for every ``conv_id`` of ``conversations``, of which some have no
    rows any more."""
    named = report.withColumnRenamed("conv_id", "found_id").withColumn("found", F.lit(True))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(named, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
