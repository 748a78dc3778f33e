"""Shards of nearly equal bytes by sampled splitters.

Records are ordered by a key, here the hash of the text and then the id, so that equal texts
stand together. A size-weighted sample of keys gives quantiles; they cut the key space into
fine ranges, and a range that turns out overfull is cut again at quantiles of its own sample.
Exact byte totals of the ranges then say where each shard ends, to the record.

A cut that would fall into a group of equal texts moves to the nearer end of the group if
that shifts it by no more than ``SLACK`` of a shard. Larger groups are cut through.

Everything is a DataFrame expression. The driver sees the splitters and one total per range,
both bounded by ``RANGES`` times ``SUBRANGES``; every window runs within one range.

Defined results: a null text has no bytes and size 1, like an empty one; null ids come before
others; rows that agree in every column are put in any order (they are interchangeable);
fewer rows than shards leave shards empty; an empty table gives an empty result; columns
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmine.session import ensure_checkpoints

SHARDS = 16
RANGES = 256
SUBRANGES = 8
#: Keys drawn per range, on average.
DRAWS = 24
#: A range with more than so many times the mean of bytes or rows is cut again.
OVERFULL = 2.0
#: Part of a shard by which a cut may move to spare a group of equal texts.
SLACK = 0.01

SEED = 17


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes plus 1), ``text_crc32`` and the sort key."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("text_key"),
    )


def _key() -> Column:
    return F.struct("text_key", "doc_id")


def _splitters(drawn: DataFrame, by: list[str], parts: int) -> DataFrame:
    """``parts`` - 1 quantiles of the drawn keys of each group, as an array ``cuts``."""
    keys = F.array_sort(F.collect_list(_key()))
    at = F.transform(
        F.sequence(F.lit(1), F.lit(parts - 1)),
        lambda i: F.element_at(
            F.col("keys"), F.greatest(F.lit(1), F.floor(i * F.size("keys") / parts).cast("int"))
        ),
    )
    # An empty table still has one group when there is nothing to group by.
    drawn = drawn.groupBy(*by).agg(keys.alias("keys")).filter(F.size("keys") > 0)
    return drawn.select(*by, F.array_distinct(at).alias("cuts"))


def _draw(records: DataFrame, total: Column, wanted: int, salt: int) -> DataFrame:
    """A record is drawn if its hash falls below its share of ``total``, times ``wanted``."""
    u = F.pmod(F.xxhash64("text_key", "doc_id", F.lit(salt)), F.lit(1 << 40)) / F.lit(1 << 40)
    return records.filter(u * total < F.col("size") * wanted)


def _literal(cuts: list) -> Column:
    """Splitters as a constant array."""
    kind = "array<struct<text_key:bigint,doc_id:bigint>>"
    return F.array(
        *[F.struct(F.lit(c["text_key"]), F.lit(c["doc_id"])) for c in cuts]
    ).cast(kind)


def _below(cuts: Column) -> Column:
    """How many splitters are at or below the record's key."""
    key = _key()
    return F.aggregate(cuts, F.lit(0), lambda n, cut: n + (cut <= key).cast("int"))


def _range_of(cuts: list) -> Column:
    """Number of splitters at or below the key: first among every sixteenth of them, then
    among the fifteen that follow the last one found."""
    blocks = F.array(*[_literal(cuts[at : at + 15]) for at in range(0, len(cuts) + 1, 16)])
    coarse = _below(_literal(cuts[15::16]))
    return coarse * 16 + _below(F.element_at(blocks, coarse + 1))


def ranged(records: DataFrame, ranges: int = RANGES, subranges: int = SUBRANGES) -> DataFrame:
    """Add ``range`` and ``subrange``, which together rise with the key."""
    total = records.agg(F.sum("size")).first()[0] or 1
    drawn = _draw(records, F.lit(float(total)), ranges * DRAWS, SEED)
    cuts = [c for row in _splitters(drawn, [], ranges).collect() for c in row["cuts"]]
    first = records.withColumn("range", _range_of(cuts))

    totals = first.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    totals = totals.collect()
    most = [OVERFULL * sum(t[c] for t in totals) / max(1, len(totals)) for c in ("bytes", "n")]
    full = {t["range"]: t["bytes"] for t in totals if t["bytes"] > most[0] or t["n"] > most[1]}
    if not full:
        return first.withColumn("subrange", F.lit(0))
    own_total = F.create_map(*[F.lit(x) for r, b in full.items() for x in (r, float(b))])
    again = _draw(
        first.filter(F.col("range").isin(list(full))),
        F.element_at(own_total, F.col("range")),
        subranges * DRAWS,
        SEED + 1,
    )
    inner = _splitters(again, ["range"], subranges).collect()
    nothing = [F.lit(-1), _literal([])]
    by_range = F.create_map(
        *nothing, *[x for r in inner for x in (F.lit(r["range"]), _literal(r["cuts"]))]
    )
    below = _below(F.element_at(by_range, F.col("range")))
    return first.withColumn("subrange", F.coalesce(below, F.lit(0)))


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES, text: str = "text"
) -> DataFrame:
    """One row per record with its ``shard`` and its ``slot`` there, gapless from 0."""
    ensure_checkpoints(docs.sparkSession)
    placed = ranged(sized(docs, text).checkpoint(), ranges)

    # Where every record stands: what lies before its range, and before it in the range.
    in_range = W.partitionBy("range", "subrange").orderBy("text_key", "doc_id")
    totals = placed.groupBy("range", "subrange").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows")
    )
    before = W.orderBy("range", "subrange").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(
        "range",
        "subrange",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base_bytes"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base_rows"),
    )
    upto = in_range.rowsBetween(W.unboundedPreceding, W.currentRow)
    standing = (
        placed.withColumns(
            {
                "end": F.sum("size").over(upto),
                "row": F.row_number().over(in_range) - 1,
            }
        )
        .join(F.broadcast(bases), ["range", "subrange"])  # at most ranges x SUBRANGES rows
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "text_key",
            (F.col("base_bytes") + F.col("end") - F.col("size")).alias("begin"),
            (F.col("base_rows") + F.col("row")).alias("row"),
        )
        .checkpoint()
    )
    cuts = _shard_cuts(standing, shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("begin") >= F.lit(cut)).cast("int")
    sharded = standing.withColumn("shard", shard)
    firsts = sharded.groupBy("shard").agg(F.min("row").alias("first_row"))
    return sharded.join(F.broadcast(firsts), "shard").select(  # one row per shard
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _shard_cuts(standing: DataFrame, shards: int) -> list[int]:
    """Byte positions at which shards 1, 2, … begin."""
    total = standing.agg(F.max(F.col("begin") + F.col("size"))).first()[0]
    if not total:
        return []
    wanted = [total * i // shards for i in range(1, shards)]
    crossed = F.lit(False)
    for cut in wanted:
        crossed = crossed | ((F.col("begin") < cut) & (F.col("begin") + F.col("size") >= cut))
    keys = [r[0] for r in standing.filter(crossed).select("text_key").distinct().collect()]
    groups = (
        standing.filter(F.col("text_key").isin(keys))
        .groupBy("text_key")
        .agg(F.min("begin").alias("begin"), F.max(F.col("begin") + F.col("size")).alias("end"))
        .collect()
    )
    slack, cuts = SLACK * total / shards, []
    for cut in wanted:
        edges = [e for g in groups if g["begin"] < cut <= g["end"] for e in (g["begin"], g["end"])]
        nearest = min(edges, key=lambda e: abs(e - cut), default=cut)
        cuts.append(nearest if abs(nearest - cut) <= slack else cut)
    return cuts
