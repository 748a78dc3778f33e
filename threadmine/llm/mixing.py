"""Mixing of sources to target weights.

Temperature mixing: a source's weight is its share of all tokens to the power of an exponent,
made to add up to one. At exponent 1 the mix is the corpus, at 0 all sources weigh the same.
The exponent is bisected until the weights meet a target entropy, or until no source is read
more often than a repetition limit allows.

Weights become rows by budgeted block permutations. A source's budget is its weight times the
mix's; it is spent on whole passes over the source, and what is left on a part of one more.
Every pass puts the source's ``BLOCKS`` blocks of rows, dealt by hash, in an order drawn for
that pass, and the rows of a block in one of their own; the last pass ends where the budget
does. So a source of any size is never sorted as one: sums run over blocks, and over the rows
of the one block in which the budget ends.

Tokens are words, parted by white space. Nothing of a source's rows comes to the driver, and
of the sources only sums over all of them.

Defined results: a null source is a source of its own; null or empty texts have no tokens and
go along with their blocks; a source without any token is read once; rows that agree in all
columns are drawn together; an empty table gives an empty result; columns of ``docs`` are kept
as they are, whatever their names: if one begins with ``mixing_``, the new ones begin with
``mixing_mixing_``, and so on until none of the table's does.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmine.llm.naming import exact, free_prefix
from threadmine.session import ensure_checkpoints

BLOCKS = 256
SEED = 29
#: How often a source may be read, on average over its rows, in the registered mixes.
REPETITIONS = 1.25
#: Exponents tried at a time, and how often: each round narrows the range by ``TRIED`` + 1.
TRIED, ROUNDS = 15, 9

PREFIX = "mixing_"


def _sums(totals: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For every exponent: the sum of the powers of the shares, the entropy of the weights,
    and the most that a weight exceeds its source's share."""
    share = F.log(F.col("tokens") / F.col("all"))
    columns = []
    for i, x in enumerate(exponents):
        power = F.exp(share * x)
        columns += [
            F.sum(power).alias(f"z{i}"),
            F.sum(power * share * x).alias(f"e{i}"),
            F.max(power / F.exp(share)).alias(f"m{i}"),
        ]
    row = totals.filter("tokens > 0").agg(*columns).first()
    return [
        (row[f"z{i}"], math.log(row[f"z{i}"]) - row[f"e{i}"] / row[f"z{i}"], row[f"m{i}"] / row[f"z{i}"])
        for i in range(len(exponents))
    ]


def bisect_exponent(
    totals: DataFrame, entropy: float | None = None, repetitions: float | None = None
) -> float:
    """Exponent in [0, 1] at which the weights have the target ``entropy`` (in nats), or the
    least one at which no source's weight is more than ``repetitions`` times its share.

    Both fall as the exponent rises. A target out of reach gives the nearer end.
    """
    if (entropy is None) == (repetitions is None):
        raise ValueError("give either a target entropy or a repetition limit")
    low, high = 0.0, 1.0

    def too_flat(sums: tuple[float, float, float]) -> bool:
        return sums[1] > entropy if entropy is not None else sums[2] > repetitions

    if not too_flat(_sums(totals, [low])[0]):
        return low
    for _ in range(ROUNDS):
        step = (high - low) / (TRIED + 1)
        tried = [low + step * i for i in range(1, TRIED + 1)]
        flat = [x for x, sums in zip(tried, _sums(totals, tried), strict=True) if too_flat(sums)]
        low = max(flat, default=low)
        high = min(high, low + step)
    return high


def mix(
    docs: DataFrame,
    budget: float | str = "corpus",
    entropy: float | None = None,
    repetitions: float | None = REPETITIONS,
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """``docs``, each row as often as it is drawn, with its place in the mix.

    ``mixing_pass`` numbers the passes over a source, ``mixing_block`` is the block's rank in
    its pass and ``mixing_rank`` orders the rows of a block; sorted by these, a source is read
    in its permuted order. ``mixing_weight`` is the source's weight.

    ``budget`` is in tokens, or ``corpus`` for as many as there are, or ``cover`` for the least
    at which every row of every source is in the mix.
    """
    spark = docs.sparkSession
    ensure_checkpoints(spark)
    prefix, kept = free_prefix(PREFIX, docs.columns), exact(docs.columns)
    src, tokens, block = (f"{prefix}{c}" for c in ("source", "tokens", "block"))
    row_key = F.xxhash64(*kept)
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    rows = docs.withColumns(
        {
            src: F.concat(F.lit("="), F.col(source).cast("string")),
            tokens: words.cast("long"),
            f"{prefix}row": row_key,
            block: F.pmod(F.xxhash64(F.lit(SEED), row_key), F.lit(BLOCKS)),
        }
    ).withColumn(src, F.coalesce(src, F.lit("")))

    thin = rows.select(src, block, f"{prefix}row", tokens).checkpoint()
    blocks = thin.groupBy(src, block).agg(F.sum(tokens).alias("tokens")).checkpoint()
    totals = blocks.groupBy(src).agg(F.sum("tokens").alias("tokens"))
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    totals = totals.withColumn("all", F.lit(float(max(1, total))))
    if total:
        exponent = bisect_exponent(totals, entropy, repetitions)
        (z, _, most), = _sums(totals, [exponent])
        least = totals.filter("tokens > 0").agg(
            F.min(F.pow(F.col("tokens") / F.col("all"), F.lit(exponent - 1)))
        ).first()[0] / z
    else:
        exponent, z, least = 1.0, 1.0, 1.0
    size = {"corpus": float(total), "cover": total / least}.get(budget, budget)
    weight = F.when(
        F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("all"), F.lit(exponent)) / F.lit(z)
    ).otherwise(F.lit(0.0))
    quota = F.col("weight") * F.lit(float(size))
    # A hair is added so that a budget meant to be whole passes is not rounded below them.
    passes = F.when(
        F.col("tokens") > 0, F.floor(quota / F.col("tokens") + F.lit(1e-9))
    ).otherwise(F.lit(1))
    plans = totals.withColumn("weight", weight).select(
        src,
        "weight",
        passes.cast("int").alias("passes"),
        F.greatest(quota - passes * F.col("tokens"), F.lit(0.0)).alias("rest"),
    )

    # The part of one more pass, block by block in that pass's order.
    ordered = W.partitionBy(src).orderBy(F.xxhash64(block, "passes", F.lit(SEED)), block)
    spent = F.sum("tokens").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))
    parts = (
        blocks.join(plans, src)
        .withColumn("end", spent)
        .select(
            src,
            block,
            F.col("weight").alias(f"{prefix}weight"),
            F.col("passes").alias(f"{prefix}passes"),
            ((F.col("end") <= F.col("rest")) & (F.col("rest") >= 1)).alias(f"{prefix}whole"),
            # What the block in which the budget ends may still spend; others: nothing.
            F.greatest(F.col("rest") - (F.col("end") - F.col("tokens")), F.lit(0.0)).alias(
                f"{prefix}left"
            ),
        )
        .checkpoint()
    )
    whole, left, passes = (F.col(f"{prefix}{c}") for c in ("whole", "left", "passes"))
    edge = parts.filter(~whole & (left > 0)).drop(f"{prefix}weight")
    key = [src, block, f"{prefix}row"]
    in_block = W.partitionBy(src, block).orderBy(
        F.xxhash64(f"{prefix}row", passes), f"{prefix}row"
    )
    drawn = (
        thin.join(edge, [src, block])
        .withColumn("end", F.sum(tokens).over(in_block))
        .filter(F.col("end") <= left)
        .select(*key)
        .distinct()
        .withColumn(f"{prefix}drawn", F.lit(True))
    )
    placed = rows.join(parts, [src, block]).join(drawn, key, "left")
    last = whole | F.coalesce(f"{prefix}drawn", F.lit(False))
    number = passes + last.cast("int")
    return (
        placed.filter(number > 0)
        .withColumn(f"{prefix}pass", F.explode(F.sequence(F.lit(0), number - 1)))
        .select(
            *kept,
            f"{prefix}weight",
            f"{prefix}pass",
            F.xxhash64(block, f"{prefix}pass", F.lit(SEED)).alias(f"{prefix}block"),
            F.xxhash64(f"{prefix}row", f"{prefix}pass").alias(f"{prefix}rank"),
        )
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix with the columns of ``docs`` alone."""
    return mix(docs, **settings).select(exact(docs.columns))
