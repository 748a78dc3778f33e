"""Best-fit packing of token pieces into training sequences.

Documents become token ids, longer ones are cut at the sequence length, and the pieces are
packed by best-fit decreasing: the longest piece first, each into the tightest sequence that
still has room. A segment tree over remaining capacities finds that sequence in
logarithmic time.

Packing runs in groups of about ``GROUP`` pieces, dealt by a hash of the piece and its row's
number, so no task holds more than that whatever the size of the corpus or of a document, and
however many rows are equal. A group leaves some sequences partly filled; these are packed
again, as whole items, in as many groups of that size as there are of them, and dealt anew as
long as a round saves a sequence in ``WORTHWHILE``.

Defined results: a null or empty text is one piece with the end id alone; a null ``doc_id``
is kept; repeated rows are packed once each; an empty table gives an empty result; columns
other than ``doc_id`` and the text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmine.llm.memory import released
from threadmine.session import ensure_checkpoints

MAX_TOKENS = 2048
END_ID = 0
GROUP = 2048
#: A sequence less full than this is packed again with those of other groups.
FULL_ENOUGH = 0.98
#: A round that saves fewer sequences than one in this many is the last one.
WORTHWHILE = 50
#: Words a worker remembers the ids of; all are forgotten at the next text when there are more.
REMEMBERED = 1 << 19

_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)


class CapacityTree:
    """Segment tree over capacities 0..``capacity``: how many open bins have each one."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        node = capacity + self.leaves
        while node:
            self.counts[node] += n
            node >>= 1

    def tightest(self, size: int) -> int:
        """Smallest capacity of an open bin that is at least ``size``; -1 if none is."""
        counts, node = self.counts, size + self.leaves
        while not counts[node]:
            while node & 1:  # a right child, or the root: nothing larger below its parent
                node >>= 1
            if not node:
                return -1
            node += 1
        while node < self.leaves:
            node = 2 * node if counts[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. ``sizes`` fall, and lie between 1 and ``capacity``."""
    tree = CapacityTree(capacity)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, size in enumerate(sizes.tolist()):
        room = tree.tightest(size)
        if room < 0:
            room, chosen, used = capacity, used, used + 1
        else:
            chosen = open_bins[room].pop()
            tree.add(room, -1)
        bins[i], offsets[i] = chosen, capacity - room
        if room > size:
            open_bins[room - size].append(chosen)
            tree.add(room - size, 1)
    return bins, offsets


class Remembered(dict):
    """Values by key, made by ``make`` where a key is new."""

    def __init__(self, make: Callable[[bytes], bytes]) -> None:
        self.make = make

    def __missing__(self, key: bytes) -> bytes:
        self[key] = made = self.make(key)
        return made


class WordIds:
    """Token ids of texts, word by word.

    The tokenizer must drop white space and let no token cross it (checked on a probe), so a
    text's ids are those of its words in a row. Each word is tokenized once per worker while
    it is remembered. Plain words, which the tokenizer's splitting leaves whole, go straight
    to its merging model; a full stop or comma after one is a token of its own.
    """

    PLAIN = re.compile("[a-zß-öø-ÿ]+")
    PROBE = "Two wörds, and more\n of them. It's 3"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Remembered(self._new)
        # Byte-level models name a byte by its character if that is printable, and else by
        # the next free one from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_names = {b: 256 + i for i, b in enumerate(hidden)}
        if b"".join(self([self.PROBE])) != self._packed(self._encode([self.PROBE])[0]):
            raise ValueError(f"the tokenizer {path} does not work word by word")

    def _encode(self, texts: list[str]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [one.ids for one in found]

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _new(self, word: bytes) -> bytes:
        core = word.lower()
        mark = core[-1:] if core.endswith((b".", b",")) else b""
        core = core.removesuffix(mark)
        text = core.decode()
        if not core.isalpha():  # ASCII letters are plain and name themselves
            text = text.lower()
            if not self.PLAIN.fullmatch(text):
                return self._packed(self._encode([word.decode()])[0])
            text = text.encode().decode("latin-1").translate(self.byte_names)
        if core != word:
            return self.known[core] + self.known[mark] if mark else self.known[core]
        return self._packed([t.id for t in self.tokenizer.model.tokenize(text)])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known, found = self.known, []
        for text in texts:
            if len(known) > REMEMBERED:
                known.clear()
            found.append(b"".join(map(known.__getitem__, text.encode().split())))
        return found


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This worker's tokenizer for the file at ``path``."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def token_pieces(
    docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, text: str = "text"
) -> DataFrame:
    """Pieces of at most ``max_tokens`` ids of every document, its ids followed by ``END_ID``.

    ``start`` counts the document's ids before the piece; ``ids_crc32`` is taken over the ids
    as little-endian unsigned 32-bit numbers.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = word_ids(tokenizer_path), END_ID.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                keys = some.column(0).to_pylist()
                rows = []
                for key, ids in zip(keys, ids_of(some.column(1).to_pylist()), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * max_tokens)):
                        part = ids[start : start + 4 * max_tokens]
                        rows.append(
                            (key, piece, start // 4, len(part) // 4, zlib.crc32(part))
                        )
                yield pa.record_batch(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES)],
                    schema=_PIECES,
                )

    wanted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit(""))
    )
    return wanted.mapInArrow(
        released(cut), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, group: int = GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of ``token_pieces``.

    Offsets have no gaps: a sequence's pieces stand one after the other from 0.
    """
    ensure_checkpoints(pieces.sparkSession)
    # The number is stored with the row, so that a lost task is repeated with the same one.
    numbered = pieces.select(*_PIECES.names).withColumn("number", F.monotonically_increasing_id())
    staged = numbered.checkpoint()
    groups = max(1, math.ceil(staged.count() / group))
    dealt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "number"), F.lit(groups))
    first = _pack_groups(
        staged.withColumn("group", dealt).drop("number"), max_tokens
    ).checkpoint()
    opened = first.filter("offset = 0").select("bin", "used")
    merged = _merge_loose(opened, max_tokens, group)
    return first.join(merged, "bin", "left").select(
        *_PIECES.names,
        F.coalesce("merged_bin", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )


def _merge_loose(opened: DataFrame, max_tokens: int, group: int) -> DataFrame:
    """Pack sequences that are not ``FULL_ENOUGH`` as whole items, in rounds: each such ``bin``
    with its ``merged_bin`` and the place ``base`` there. ``opened`` has (``bin``, ``used``)."""
    room_left = F.col("used") < F.lit(int(max_tokens * FULL_ENOUGH))
    merged, turn = None, 0
    while True:
        loose = opened.filter(room_left)
        n = loose.count()
        groups = max(1, math.ceil(n / group))
        packed = (
            _pack_groups(
                loose.select(
                    F.col("bin").alias("doc_id"),
                    F.lit(0).alias("piece"),
                    F.lit(0).cast("long").alias("start"),
                    F.col("used").alias("length"),
                    F.lit(0).cast("long").alias("ids_crc32"),
                    F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups)).alias("group"),
                ),
                max_tokens,
            )
            .select(
                F.col("doc_id").alias("bin"),
                F.col("leader").alias("merged_bin"),
                F.col("offset").alias("base"),
                "used",
            )
            .checkpoint()
        )
        moves = packed.select("bin", "merged_bin", "base")
        if merged is None:
            merged = moves
        else:
            further = moves.toDF("merged_bin", "last_bin", "more")
            merged = merged.join(further, "merged_bin", "left").select(
                "bin",
                F.coalesce("last_bin", "merged_bin").alias("merged_bin"),
                (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"),
            )
        opened = packed.filter("base = 0").select("bin", "used")
        if groups == 1 or (n - opened.count()) * WORTHWHILE < n:
            return merged
        turn += 1


def _pack_groups(grouped: DataFrame, max_tokens: int) -> DataFrame:
    """Best-fit decreasing in every ``group``: each item's ``bin`` and ``offset``, what its bin
    holds in all (``used``) and the ``doc_id`` of the bin's first item (``leader``)."""

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(
            [("length", "descending")]
            + [(c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32")]
        )
        lengths = rows["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, max_tokens)
        first = np.flatnonzero(offsets == 0)  # bins open one after the other
        used = np.bincount(bins, lengths, len(first)).astype(np.int64)[bins]
        number = rows["group"][0].as_py() << 32
        return (
            rows.drop_columns(["group"])
            .append_column("offset", pa.array(offsets))
            .append_column("bin", pa.array(number + bins))
            .append_column("used", pa.array(used))
            .append_column("leader", rows["doc_id"].take(pa.array(first[bins])))
        )

    return grouped.groupBy("group").applyInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long,"
        " offset long, bin long, used long, leader long",
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, text: str = "text"
) -> DataFrame:
    """Tokenize, cut and pack: one row per piece, with its sequence and place."""
    return pack(token_pieces(docs, tokenizer_path, max_tokens, text), max_tokens)
