"""Conversations in reply order, with quotations linked to what they quote.

A line's quote level is the number of its leading ``>`` marks. Lines in a row with the same
level are a passage. A quoted passage is looked up, normalised (lower case, white space as
single spaces) and hashed, among what other messages of the conversation wrote themselves, at
level 0: whole passages, paragraphs parted by blank lines, and lines. What is not found as a
whole is looked up by its paragraphs, and those that are not found by their lines; runs of lines
that are neither are found line by line. The message that a unit comes from is the latest
earlier one that has it. A message answers the one that it quotes most characters of, at the
outermost level that was found, and without any link the message before it. What is left of a message without its quoted lines is
its text; messages are put in reply order, parents before their answers.

Everything is a DataFrame expression. Work is linear in a text: passages and paragraphs are
hashed before they become lines, and a line carries the hashes only. Units are cut in
conversations that quote anything, and by the rare bits of a bitmap in others. Joins and
windows run over a hash and a span, or a conversation and spans of ``SPAN`` turns, so no
conversation of any length is one group; rows without a turn are parted by a hash.

Defined results: a null text has no passages and stays null; a message of quotations alone has
an empty text; blank passages are never looked up; rows with a null conversation or turn have
no links and no parent; rows that repeat a turn each keep their text, share their links, and
stand in the order of a hash of role and text; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmine.operators.selection import maybe_among
from threadmine.operators.skew import carry_last

SPAN = 4096
#: Parts of the rows of a conversation that have no turn.
PARTS = 256
LEAST = -(1 << 63)

#: Marks with blanks between them. Possessive, so that a line of many marks needs no stack.
_MARKS = "^((?:[ \\t]*+>)*+)"


def _level(line: Column) -> Column:
    """Leading quote marks of a line, blanks between them allowed."""
    marks = F.regexp_extract(line, _MARKS, 1)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def _bare(line: Column) -> Column:
    """A line without its quote marks and the one space after them."""
    return F.regexp_replace(line, "^(?:[ \\t]*+>)++ ?", "")


def normalised(passage: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(passage), "\\s+", " "))


def quoting(text: Column) -> Column:
    """Whether any line may have a quote mark: true for all that do."""
    return F.coalesce(text.rlike("(?m)^[ \\t]*+>"), F.lit(False))


def lines_of(text: Column) -> Column:
    """Array of (``level``, ``line``)."""
    return F.transform(
        F.split(text, "\\r\\n|\\n|\\r"),
        lambda line: F.struct(_level(line).alias("level"), _bare(line).alias("line")),
    )


def passages_of(text: Column) -> Column:
    """Lines in a row with the same level, put together: array of ``level``, a line feed and the
    passage.

    Lines have no carriage return, so it can stand before every line that begins a passage;
    the text is put together once and split there.
    """
    lines = lines_of(text)
    before = F.concat(F.array(F.lit(-1)), F.transform(lines, lambda x: x["level"]))
    # ``before`` is longer by one: its last level meets no line, and the null is not joined.
    marked = F.zip_with(
        lines,
        before,
        lambda x, level: F.when(x["level"] == level, F.concat(F.lit("\n"), x["line"])).otherwise(
            F.concat(F.lit("\r"), x["level"].cast("string"), F.lit("\n"), x["line"])
        ),
    )
    joined = F.array_join(marked, "")
    return F.split(F.substring(joined, F.lit(2), F.length(joined)), "\r")


def _units(messages: DataFrame) -> DataFrame:
    """What passages can be linked by: ``conv_id``, ``turn``, ``level``, ``kind`` (the whole run
    0, its paragraphs 1, their lines 2), the hashes ``run``, ``para`` and ``unit``, and ``chars``.
    Blank units are left out, and paragraphs and lines that are the whole of what they stand in.
    """
    # The conversation is part of the hash, so that a unit is one key.
    mark = lambda words: F.unhex(
        F.sha2(F.concat_ws("\n", F.col("conv_id").cast("string"), words), 256)
    )
    at = F.instr("p", "\n")
    passages = (
        messages.select("conv_id", "turn", F.explode(passages_of(F.col("text"))).alias("p"))
        .select(
            "conv_id",
            "turn",
            F.substring("p", F.lit(1), at - 1).cast("int").alias("level"),
            F.substring(F.col("p"), at + 1, F.length("p")).alias("passage"),
        )
        .withColumn("run_words", normalised(F.col("passage")))
        .filter("run_words != ''")
        .withColumn("run", mark(F.col("run_words")))
        .withColumn("run_chars", F.length("run_words"))
    )
    paragraphs = (
        passages.select(
            "conv_id", "turn", "level", "run", "run_chars",
            F.posexplode(F.split("passage", "\\n\\s*\\n")).alias("at", "para_text"),
        )
        .withColumn("para_words", normalised(F.col("para_text")))
        .withColumn("para", mark(F.col("para_words")))
        .withColumn("para_chars", F.length("para_words"))
    )
    line = lambda x: F.struct(F.lit(2).alias("kind"), normalised(x).alias("words"))
    whole = lambda kind: F.struct(F.lit(kind).alias("kind"), F.lit("").alias("words"))
    # A run stands with its first paragraph.
    larger = F.filter(
        F.array(whole(0), whole(1)),
        lambda x: F.when(x["kind"] == 0, F.col("at") == 0).otherwise(
            (F.col("para_chars") > 0) & (F.col("para") != F.col("run"))
        ),
    )
    own_lines = F.filter(
        F.transform(F.split("para_text", "\n"), line), lambda x: x["words"] != ""
    )
    kind = F.col("u.kind")
    return (
        paragraphs.select(
            "conv_id", "turn", "level", "run", "run_chars", "para", "para_chars",
            F.explode(F.concat(larger, own_lines)).alias("u"),
        )
        .select(
            "conv_id",
            "turn",
            "level",
            kind.alias("kind"),
            "run",
            F.when(kind == 0, F.col("run")).otherwise(F.col("para")).alias("para"),
            F.when(kind == 0, F.col("run"))
            .when(kind == 1, F.col("para"))
            .otherwise(mark(F.col("u.words")))
            .alias("unit"),
            F.when(kind == 0, F.col("run_chars"))
            .when(kind == 1, F.col("para_chars"))
            .otherwise(F.length("u.words"))
            .alias("chars"),
        )
        .filter("kind < 2 or unit != para")
    )


def _sources(messages: DataFrame, span: int) -> DataFrame:
    """Units of quoted passages with the turn they were last written in before, as far as it is
    found: ``conv_id``, ``turn``, ``level``, ``run``, ``unit``, ``chars``, ``source``. A unit
    inside a linked one has no row."""
    keyed = messages.filter("conv_id is not null and turn is not null")
    asking = keyed.filter(quoting(F.col("text"))).select("conv_id")
    quoted = F.col("level") > 0
    units = _units(maybe_among(keyed, asking, "conv_id")).select(
        "conv_id",
        "turn",
        "level",
        F.when(quoted, F.col("kind")).alias("kind"),
        F.when(quoted, F.col("run")).alias("run"),
        F.when(quoted, F.col("para")).alias("para"),
        "unit",
        "chars",
        # Within a turn quotations come first: a message does not quote itself.
        (~quoted).cast("int").alias("own"),
        F.when(~quoted, F.col("turn")).alias("written"),
    )
    looked_up = carry_last(units.distinct(), "unit", ["turn", "own"], "written", "source", span)
    inside_run = W.partitionBy("conv_id", "turn", "level", "run")
    inside_para = W.partitionBy("conv_id", "turn", "level", "run", "para")
    linked = F.col("source").isNotNull()
    return (
        looked_up.filter("own = 0")
        .withColumn("in_run", F.max(linked & (F.col("kind") == 0)).over(inside_run))
        .withColumn("in_para", F.max(linked & (F.col("kind") == 1)).over(inside_para))
        .filter("kind = 0 or not in_run and (kind = 1 or not in_para)")
        .select("conv_id", "turn", "level", "run", "unit", "chars", "source")
        .distinct()
    )


def _positions(placed: DataFrame, span: int) -> DataFrame:
    """Add ``position``: the place in the conversation by parent, turn and a hash of the rest.

    Rows are ranked in cells of one parent and a span of turns, after the counted rows of the
    cells before it in a span of parents, and of the spans of parents before that.
    """
    tie = F.xxhash64("role", "text")
    cells = ["no_conv", "conv", "parent_span", "parent", "turn_span", "part"]
    celled = placed.withColumns(
        {
            "tie": tie,
            "no_conv": F.col("conv_id").isNull(),
            "conv": F.coalesce("conv_id", F.lit(0)),
            "parent_span": F.coalesce(F.floor(F.col("parent_turn") / span), F.lit(LEAST)),
            "parent": F.coalesce("parent_turn", F.lit(LEAST)),
            "turn_span": F.coalesce(F.floor(F.col("turn") / span), F.lit(LEAST)),
            "part": F.when(
                F.col("turn").isNull(), F.floor(tie / F.lit((1 << 64) // PARTS))
            ).otherwise(0),
        }
    )
    counts = celled.groupBy(cells).count()
    before = lambda by, order: (
        W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    )
    spans = (
        counts.groupBy(cells[:3])
        .agg(F.sum("count").alias("count"))
        .select(*cells[:3], F.sum("count").over(before(cells[:2], cells[2:3])).alias("span_base"))
    )
    bases = (
        counts.withColumn("base", F.sum("count").over(before(cells[:3], cells[3:])))
        .join(spans, cells[:3])
        .select(
            *cells,
            (F.coalesce("base", F.lit(0)) + F.coalesce("span_base", F.lit(0))).alias("base"),
        )
    )
    inside = W.partitionBy(cells).orderBy("parent_turn", "turn", "tie")
    return (
        celled.withColumn("rank", F.row_number().over(inside) - 1)
        .join(bases, cells)
        .select(*placed.columns, (F.col("base") + F.col("rank")).alias("position"))
    )


def reply_order(conversations: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per message: its text without quotations, ``parent_turn`` (what it answers),
    ``n_quotes`` and ``n_linked`` (different quoted passages, and those of which the whole or
    a part was found), and ``position``: from 0 in its conversation, by parent and then by turn, so that
    the answers to a message stand together and after it.
    """
    messages = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        "role",
        "text",
    )
    found = _sources(messages, span)
    # One row per passage: whether it is linked, and its linked units.
    runs = found.groupBy("conv_id", "turn", "level", "run").agg(
        F.max(F.col("source").isNotNull()).cast("int").alias("linked")
    )
    counts = runs.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quotes"), F.sum("linked").alias("n_linked")
    )
    sums = (
        found.filter("source is not null")
        .select("conv_id", "turn", "level", "unit", "chars", "source")
        .distinct()
        .groupBy("conv_id", "turn", "level", "source")
        .agg(F.sum("chars").alias("chars"))
    )
    best = F.struct(-F.col("level"), F.col("chars"), F.col("source"))
    quoted = sums.groupBy("conv_id", "turn").agg(F.max_by("source", best).alias("quoted_turn"))
    links = counts.join(quoted, ["conv_id", "turn"], "left")
    turns = messages.filter("conv_id is not null and turn is not null").select("conv_id", "turn")
    turns = carry_last(turns.distinct(), "conv_id", ["turn"], "turn", "previous_turn", span)
    parents = turns.join(links, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        F.coalesce("quoted_turn", "previous_turn").alias("parent_turn"),
        "n_quotes",
        "n_linked",
    )
    own = F.filter(lines_of(F.col("text")), lambda x: x["level"] == 0)
    text = F.when(
        quoting(F.col("text")), F.array_join(F.transform(own, lambda x: x["line"]), "\n")
    ).otherwise(F.regexp_replace("text", "\\r\\n|\\r", "\n"))
    placed = messages.withColumn("text", text).join(parents, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "role",
        "text",
        "parent_turn",
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )
    return _positions(placed, span)
