"""Which posts take part."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmine.functions.text import SPARK_TAGS, has_tag
from threadmine.sources.posts import ANSWER, QUESTION

FIRST_YEAR = 2013
#: Bits of the filter in front of a join on question ids: 4 MB.
FILTER_BITS = 1 << 25


def since_year(posts: DataFrame, first_year: int = FIRST_YEAR) -> DataFrame:
    """Posts created in ``first_year`` or later, as a range that parquet can prune on.

    Staged posts lie in folders by year, of which earlier ones are not read. The folder's year
    may have been taken in another time zone, so one year more is.
    """
    if "creationYear" in posts.columns:
        posts = posts.filter(F.col("creationYear") >= first_year - 1)
    return posts.filter(
        F.col("creationDate") >= F.lit(f"{first_year:04d}-01-01").cast("timestamp")
    )


def questions(posts: DataFrame) -> DataFrame:
    return posts.filter(F.col("postTypeId") == QUESTION)


def answers(posts: DataFrame) -> DataFrame:
    return posts.filter(F.col("postTypeId") == ANSWER)


def tagged_questions(posts: DataFrame, needles: Iterable[str] = SPARK_TAGS) -> DataFrame:
    """Questions whose tag string contains any of the needles."""
    return questions(posts).filter(has_tag("tags", needles))


def answers_of(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers whose parent is among the questions.

    Nearly all answers of an archive belong to other questions. A bitmap of the questions' ids,
    of fixed size, drops them where they are read, so the exact join shuffles the texts of
    the answers it keeps and few others.
    """
    asked = questions.select(F.col("id").alias("parentId"))
    return maybe_among(answers, asked, "parentId").join(asked, "parentId", "left_semi")


def maybe_among(df: DataFrame, keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``keys``: all that are, and of the others a share
    as large as that of the bits that are set. Null keys are dropped.

    The bitmap is a table of 4 KB pieces, ``bits`` / 32,768 of them at most, so it may be
    broadcast whatever the size of the input.
    """

    def bit(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(bits)) + 1

    pieces = (
        keys.filter(F.col(key).isNotNull())
        .groupBy(F.bitmap_bucket_number(bit(key)).alias("_piece"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit(key))).alias("_bits"))
    )
    at = F.bitmap_bit_position(bit(key))
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (at % 8).cast("int")) == 1
    return df.join(
        F.broadcast(pieces), (F.bitmap_bucket_number(bit(key)) == F.col("_piece")) & is_set, "left_semi"
    )
