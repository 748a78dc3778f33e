"""Removal of stop words by lists of any length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmine.operators.selection import maybe_among


def remove_listed_words(
    df: DataFrame, tokens: str, words: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """``df`` without the tokens that stand in the first column of ``words``, in any case.

    The list stays a table. A bitmap of fixed size drops nearly all other tokens where they are
    read; what may be listed is joined as single words and comes back as the positions to
    leave out, so that a document costs no more than its length. ``keys`` tell the rows of
    ``df`` apart and are not null. A null array stays null. ``df`` is read twice: stage it
    where that is dear.
    """
    word = F.lower(F.trim(F.col(words.columns[0])))
    listed = words.select(word.alias("_word")).filter("_word != ''").distinct()
    single = df.select(*keys, F.posexplode_outer(tokens).alias("_at", "_word"))
    single = single.select(*keys, "_at", F.lower("_word").alias("_word"))
    positions = (
        maybe_among(single, listed, "_word")
        .join(listed, "_word", "left_semi")
        .groupBy(*keys)
        .agg(F.collect_list("_at").alias("_listed"))
    )
    every = F.sequence(F.lit(0), F.size(tokens) - 1)
    kept = F.transform(
        F.array_except(every, F.col("_listed")), lambda i: F.get(F.col(tokens), i)
    )
    return (
        df.join(positions, list(keys), "left")
        .withColumn(tokens, F.when(F.col("_listed").isNull(), F.col(tokens)).otherwise(kept))
        .select(*df.columns)
    )
