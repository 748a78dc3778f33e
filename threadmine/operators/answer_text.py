"""The answers of a question as one cleaned text, for ordinary and for huge questions.

The text is cleaned after all answers are put together, so a code block or a tag may open
in one answer and close in a later one. :func:`cleaned_whole` does just that. A question
with too many answers for one task goes through :func:`cleaned_in_parts`, which gives every
answer its share of the very same cleaned text without ever putting them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmine.functions.text import (
    clean_document,
    drop_code_blocks,
    drop_markup,
    fold,
    strip_symbols,
)
from threadmine.operators.skew import SPAN, carry_last, spread_join
from threadmine.session import ensure_checkpoints

# Line ends that survive the removal of control characters. "." does not match them, so a
# code block never reaches across one.
_LINE_END = r"[\x{85}\x{2028}\x{2029}]"
#: Ids whose answers to one question are put together at a time.
CONCATENATED = 1 << 12
_OPEN, _CLOSE = "<pre>", "</pre>"


def concatenated(answers: DataFrame, span: int = CONCATENATED) -> DataFrame:
    """``(id, text)``: bodies of a question's answers in id order, separated by spaces.

    First the answers in each span of ids are put together, then the texts of the spans, so
    the answers of a question with very many of them are gathered by many tasks, and no list
    has more entries than ids in a span, or spans.
    """

    def in_order(at: str, text: str) -> Column:
        parts = F.array_sort(F.collect_list(F.struct(at, F.col(text).alias("text"))))
        texts = F.concat_ws(" ", F.transform(parts, lambda p: p["text"]))
        # null bodies leave no space
        return F.when(F.count(text) > 0, texts).alias("text")

    spans = answers.groupBy(
        F.col("parentId").alias("question"), F.floor(F.col("id") / F.lit(span)).alias("span")
    ).agg(in_order("id", "body"))
    whole = spans.groupBy(F.col("question").alias("id")).agg(in_order("span", "text"))
    return whole.withColumn("text", F.coalesce("text", F.lit("")))


def cleaned_whole(answers: DataFrame, control_to_space: bool = False) -> DataFrame:
    """``(id, cleaned)`` per question; for questions with a bounded number of answers."""
    return concatenated(answers).select(
        "id", clean_document("text", control_to_space).alias("cleaned")
    )


def cleaned_each(answers: DataFrame, control_to_space: bool = False) -> DataFrame:
    """``(id, cleaned)`` per question with every answer cleaned on its own."""
    own = answers.withColumn("body", clean_document("body", control_to_space))
    return concatenated(own).withColumnRenamed("text", "cleaned")


def cleaned_in_parts(
    answers: DataFrame, control_to_space: bool = False, span: int = SPAN
) -> DataFrame:
    """``(id, part, cleaned)`` per answer: its share of the cleaned concatenation.

    ``id`` is the question and ``part`` the answer. Only single answers are ever held
    together; what crosses answers travels as flags and positions. The two tables that
    several later steps read are checkpointed, so nothing before them is computed again.
    """
    ensure_checkpoints(answers.sparkSession)
    folded = answers.select(
        "parentId", "id", F.split(fold("body", control_to_space), _LINE_END).alias("pieces")
    )
    pieces = folded.select(
        "parentId", "id", F.posexplode_outer("pieces").alias("piece", "text")
    )
    order = ["id", "piece"]

    # 1. The line a piece belongs to: named after the piece that begins it, "" for the first.
    begins = F.when(F.col("piece") > 0, F.concat_ws(":", "id", "piece"))
    carried = carry_last(
        pieces.withColumn("begins", begins), "parentId", order, "begins", "running", span
    )
    line = F.coalesce("begins", "running", F.lit("")).alias("line")
    lined = carried.select("parentId", "id", "piece", line, "text").checkpoint()
    lined = lined.withColumn("at", F.struct("id", "piece"))

    # 2. Code: everything between the first opening and the last closing mark of a line.
    marks = lined.groupBy("parentId", "line").agg(
        F.min(F.when(F.col("text").contains(_OPEN), F.col("at"))).alias("opened"),
        F.max(F.when(F.col("text").contains(_CLOSE), F.col("at"))).alias("closed"),
    )
    bounded = spread_join(
        lined, marks.filter(F.col("opened") <= F.col("closed")), ["parentId", "line"], "left",
        "id", span,
    )
    at, opened, closed = F.col("at"), F.col("opened"), F.col("closed")
    without_code = (
        F.when(opened.isNull(), F.col("text"))
        .when(opened == closed, F.when(at == opened, drop_code_blocks("text")).otherwise(F.col("text")))
        .when(at == opened, F.substring_index("text", _OPEN, 1))
        .when(at == closed, F.substring_index("text", _CLOSE, -1))
        .when((at > opened) & (at < closed), F.lit(""))
        .otherwise(F.col("text"))
    )
    plain = bounded.select("parentId", "id", "piece", without_code.alias("text")).checkpoint()
    plain = plain.withColumn("at", F.struct("id", "piece"))

    # 3. Tags: a piece may start inside one that an earlier piece opened, and may leave one
    #    open for a later piece, provided some later piece has a ">" at all.
    left_open = F.when(F.col("text").rlike("<[^>]*$"), True).when(
        F.col("text").contains(">"), False
    )
    carried = carry_last(
        plain.withColumn("left_open", left_open), "parentId", order, "left_open", "inside", span
    )
    last_end = plain.filter(F.col("text").contains(">")).groupBy("parentId").agg(
        F.max("at").alias("last_end")
    )
    placed = spread_join(carried, last_end, ["parentId"], "left", "id", span)
    inside = F.coalesce("inside", F.lit(False))
    more_ends = F.coalesce(F.col("at") < F.col("last_end"), F.lit(False))
    opened_before = (
        F.when(inside & F.col("text").contains(">"), F.regexp_replace("text", "^[^>]*>", " "))
        .when(inside & more_ends, F.lit(" "))
        .otherwise(F.col("text"))
    )
    within = drop_markup(opened_before)
    without_tags = F.when(more_ends, F.regexp_replace(within, "<[^>]*$", " ")).otherwise(within)

    # 4. Numbers and punctuation never reach across pieces.
    done = placed.select("parentId", "id", "piece", strip_symbols(without_tags).alias("text"))
    joined = F.array_sort(F.collect_list(F.struct("piece", "text")))
    return (
        done.groupBy("parentId", "id")
        .agg(joined.alias("texts"))
        .select(
            F.col("parentId").alias("id"),
            F.col("id").alias("part"),
            F.concat_ws(" ", F.transform("texts", lambda t: t["text"])).alias("cleaned"),
        )
    )
