"""Exact duplicates by a tree-merge of sorted digest runs.

Texts are equal when they are identical after all ASCII white space (``[\\x20\\x09-\\x0D]``) is
deleted. Every partition of the table is a run: its rows sorted by digest and merged, so that
a digest stands in it once, with the smallest identifier and the number of its rows. In binomial
rounds runs exchange their entries and are merged, first two and two, then sixteen at a time,
until one run is left. Each round is one shuffle, a sort and a sorted aggregation; an entry is
the SHA-256 digest with the length and a second hash of the normalised text, and entries are
only taken for one group where all three agree, at every level. Texts themselves never travel.
On the way back each run takes what the run above found, so no step puts together more than
the rows of two runs or sixteen entries: a group with any share of all rows never meets in
one task. Built-in functions only.

The smallest identifier of a group is that of the row with the most code points in its original
text, then the smallest doc_id, then the first in the table.

Defined results: a null text counts as an empty one, and all texts without any other character
are one group; rows without an id come after those with one; of rows that agree in text and id
exactly one is kept; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmine.session import ensure_checkpoints

#: Rows of a partition that make up a run.
RUN_ROWS = 1 << 16
#: Runs merged in the first round and in later ones, as powers of two.
FIRST_BITS, NEXT_BITS = 1, 4
#: White space that does not count.
SPACE = r"[\x20\x09-\x0D]"

KEY = ["digest", "check", "length"]
#: Bits of ``monotonically_increasing_id`` below the partition's number.
ROW_BITS = 33


def normalised(text: str | Column) -> Column:
    body = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(body, F.lit("")), SPACE + "+", "")


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, code points and the digest of the normalised text, and the row's place."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.length(text), F.lit(0)).alias("n_chars"),
        normalised(text).alias("normal"),
    ).select(
        "doc_id",
        "n_chars",
        F.unhex(F.sha2(F.col("normal"), 256)).alias("digest"),
        F.xxhash64("normal").alias("check"),
        F.octet_length("normal").alias("length"),
        F.monotonically_increasing_id().alias("place"),
    )


def _run_numbers(rows: DataFrame, run_rows: int) -> tuple[Column, int]:
    """The number of a row's run, dense but for the last runs of a partition, and their count."""
    partition = F.shiftright("place", ROW_BITS)
    within = F.col("place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    last = rows.agg(F.max(partition), F.max(within)).first()
    per_partition = (last[1] or 0) // run_rows + 1
    number = partition * per_partition + F.floor(within / F.lit(run_rows))
    return number, ((last[0] or 0) + 1) * per_partition


def _merged(runs: DataFrame, bits: int) -> DataFrame:
    """Every 2^``bits`` neighbouring runs as one. The aggregation over a struct works on sorted
    input, before the exchange (a run) and after it (the merge of sorted runs)."""
    return (
        runs.withColumn("run", F.shiftright("run", bits))
        .groupBy("run", *KEY)
        .agg(F.min("best").alias("best"), F.sum("size").alias("size"))
    )


def grouped(docs: DataFrame, text: str = "text", run_rows: int = RUN_ROWS) -> DataFrame:
    """Every row's ``doc_id``, digest columns, ``keep_id``, ``group_size`` and ``kept``."""
    ensure_checkpoints(docs.sparkSession)
    rows = digests(docs, text).checkpoint()
    number, count = _run_numbers(rows, run_rows)
    # First the row with the most code points, then the smallest id, null ids last.
    best = F.struct((-F.col("n_chars")).alias("short"), F.isnull("doc_id").alias("unnamed"),
                    F.col("doc_id"), F.col("place"))
    numbered = rows.withColumn("run", number)
    runs = numbered.select("run", *KEY, best.alias("best"), F.lit(1).cast("long").alias("size"))

    levels, bits = [], FIRST_BITS
    while not levels or count > 1:
        runs = _merged(runs, bits).checkpoint()
        count = -(-count >> bits)
        levels.append((runs, bits))
        bits = NEXT_BITS

    found, bits = levels.pop()
    while levels:
        below, next_bits = levels.pop()
        found = _taken(below.select("run", *KEY), found, bits).checkpoint()
        bits = next_bits
    whole = _taken(numbered, found, bits)
    return whole.select(
        "doc_id",
        "n_chars",
        *KEY,
        F.col("best.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("place") == F.col("best.place")).alias("kept"),
    )


def _taken(below: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """Rows of ``below`` with what the merged run above says about their digest."""
    up = above.withColumnRenamed("run", "up")
    return below.withColumn("up", F.shiftright("run", bits)).join(up, ["up", *KEY]).drop("up")


def duplicate_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: which document of its group stays, and whether it is that one."""
    return grouped(docs, text).select(
        "doc_id",
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are found again by id, digest and number of code points. Several rows that agree in
    these are interchangeable copies of one document under one id; one of them stays.
    """
    keys = ["kept_id", "kept_digest", "kept_chars"]
    keep = grouped(docs.select("doc_id", text), text).filter("kept").select(
        F.struct("doc_id").alias("kept_id"),
        F.col("digest").alias("kept_digest"),
        F.col("n_chars").alias("kept_chars"),
    )
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("kept_id"),
        F.unhex(F.sha2(normalised(text), 256)).alias("kept_digest"),
        F.coalesce(F.length(text), F.lit(0)).alias("kept_chars"),
    )
    return whole.dropDuplicates(keys).join(keep, keys, "left_semi").select("row.*")
