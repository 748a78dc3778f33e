"""Text expressions: cleaning, tokenizing, word removal, tag matching.

Everything here is a ``Column`` built from Spark's own functions, so it stays on the
JVM, is visible to Catalyst and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The tag substrings that select a question, and the patterns of the
# cleaning steps in the order they are applied.
SPARK_TAGS = (
    "apache-spark",
    "pyspark",
    "sparklyr",
    "sparkr",
    "spark-dataframe",
    "spark-streaming",
    "spark-cassandra-connector",
    "spark-graphx",
    "spark-submit",
    "spark-structured-streaming",
    "spark-observer",
    "spark-csv",
    "spark-avro",
    "spark-hive",
)
CODE_BLOCK = "<pre>.+</pre>"
MARKUP_TAG = "<[^>]+>"
NUMBER = r"\d+(?:\.\d+)*+"  # possessive: matched in a loop, so long ones cannot exhaust the stack
PUNCTUATION = r"[!@#$%^&*()_=+.,<>:;?/{}`~'\"\[\]\-]"
TOKEN_GAP = r"[\W_]+"

# Words dropped after stemming because every document of the domain has them.
DOMAIN_STOP_WORDS = (
    "http", "https", "github", "html", "apach", "class", "code", "data", "didnt", "didn",
    "doesn", "don", "give", "good", "implement", "main", "make", "need", "object", "org",
    "program", "solut", "spark", "understand", "util", "want", "wasn", "way", "work",
)

CONTROL_CHARACTERS = "".join(chr(c) for c in range(32))
STOP_WORD_LIMIT = 100_000


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def drop_control_characters(text: str | Column, to_space: bool = False) -> Column:
    """Delete characters below U+0020 (or, on request, turn each into a space)."""
    return F.translate(_col(text), CONTROL_CHARACTERS, " " * 32 if to_space else "")


def drop_code_blocks(text: str | Column) -> Column:
    """Replace the stretch from the first ``<pre>`` to the last ``</pre>`` by a space."""
    return F.regexp_replace(_col(text), CODE_BLOCK, " ")


def drop_markup(text: str | Column) -> Column:
    return F.regexp_replace(_col(text), MARKUP_TAG, " ")


def drop_numbers(text: str | Column) -> Column:
    """Replace numbers and dotted versions by a space each."""
    return F.regexp_replace(_col(text), NUMBER, " ")


def drop_punctuation(text: str | Column) -> Column:
    return F.regexp_replace(_col(text), PUNCTUATION, " ")


def fold(text: str | Column, control_to_space: bool = False) -> Column:
    """First half of the cleaning: no control characters, lower case."""
    return F.lower(drop_control_characters(text, control_to_space))


def strip_symbols(text: str | Column) -> Column:
    """Last half of the cleaning, for text without markup: numbers, then punctuation."""
    return drop_punctuation(drop_numbers(text))


def clean_document(text: str | Column, control_to_space: bool = False) -> Column:
    """All six cleaning steps. Null stays null."""
    return strip_symbols(drop_markup(drop_code_blocks(fold(text, control_to_space))))


def tokenize(text: str | Column, min_length: int = 2) -> Column:
    """Lower-cased ASCII word tokens of at least ``min_length`` characters."""
    floor = max(min_length, 1)
    return F.filter(F.split(F.lower(_col(text)), TOKEN_GAP), lambda t: F.length(t) >= floor)


def word_rows(df: DataFrame, words: str | Column, *keep: str, into: str = "term") -> DataFrame:
    """One row per word of an array column, next to the ``keep`` columns.

    An inner ``explode`` makes the optimizer add a not-empty filter on its input, which
    repeats the whole expression behind ``words`` (cleaning, stemming) below it. The outer
    form with the filter on the result computes it once.
    """
    rows = df.select(*keep, F.explode_outer(_col(words)).alias(into))
    return rows.filter(F.col(into).isNotNull())


def word_list(words: Iterable[str] | DataFrame) -> list[str]:
    """Trimmed, lower-cased, distinct words, in order; a DataFrame is read up to a limit."""
    if isinstance(words, DataFrame):
        column = F.lower(F.trim(F.col(words.columns[0])))
        rows = words.select(column.alias("w")).distinct().limit(STOP_WORD_LIMIT + 1).collect()
        words = sorted(r.w for r in rows if r.w)
    out = list(dict.fromkeys(w.strip().lower() for w in words if w.strip()))
    if len(out) > STOP_WORD_LIMIT:
        raise ValueError(
            f"more than {STOP_WORD_LIMIT} stop words: use a table of them (TextPrep, "
            "remove_listed_words, remove_words_by_join)"
        )
    return out


def remove_words(tokens: str | Column, words: Iterable[str] | DataFrame) -> Column:
    """Tokens that are not in the list, compared without regard to case.

    The list becomes a hashed ``IN`` set inside the expression; see
    :func:`remove_words_by_join` for lists beyond :data:`STOP_WORD_LIMIT`.
    """
    listed = word_list(words)
    if not listed:
        return _col(tokens)
    return F.filter(_col(tokens), lambda t: ~F.lower(t).isin(listed))


def remove_words_by_join(terms: DataFrame, words: DataFrame, term: str = "term") -> DataFrame:
    """Long-form removal for word lists of any size: a left-anti join on the word."""
    listed = words.select(F.lower(F.trim(F.col(words.columns[0]))).alias("_word")).distinct()
    return terms.join(listed, F.lower(F.col(term)) == F.col("_word"), "left_anti")


def has_tag(tags: str | Column, needles: Iterable[str] = SPARK_TAGS) -> Column:
    """True when the tag string contains any needle as a substring; null tags are false.

    Written as plain conjuncts, which the parquet scan takes as pushed filters.
    """
    tags = _col(tags)
    return tags.isNotNull() & reduce(or_, [tags.contains(n) for n in needles])


def join_tokens(tokens: str | Column) -> Column:
    return F.concat_ws(" ", _col(tokens))


def _sql_text(value: str) -> str:
    return "r'" + value.replace("'", r"\x27") + "'"


def register_sql_functions(spark: SparkSession) -> None:
    """Register ``cleanDocument`` and ``sparkRelated`` as SQL functions.

    They are SQL bodies, not UDFs: Catalyst inlines them into the calling query.
    """
    controls = "concat(" + ", ".join(f"chr({c})" for c in range(1, 32)) + ")"
    body = f"lower(regexp_replace(translate(document, {controls}, ''), r'\\x00', ''))"
    for pattern in (CODE_BLOCK, MARKUP_TAG, NUMBER, PUNCTUATION):
        body = f"regexp_replace({body}, {_sql_text(pattern)}, ' ')"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cleanDocument(document STRING) "
        f"RETURNS STRING RETURN {body}"
    )
    needles = " OR ".join(f"contains(tags, '{n}')" for n in SPARK_TAGS)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION sparkRelated(tags STRING) "
        f"RETURNS BOOLEAN RETURN tags IS NOT NULL AND ({needles})"
    )
