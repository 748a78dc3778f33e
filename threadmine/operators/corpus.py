"""Corpora: one document of stemmed words per question."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmine.functions.stem import stem_words
from threadmine.functions.text import (
    DOMAIN_STOP_WORDS,
    clean_document,
    remove_words,
    tokenize,
)
from threadmine.operators.answer_text import cleaned_each, cleaned_in_parts, cleaned_whole
from threadmine.operators.selection import answers_of
from threadmine.operators.skew import heavy_keys, spread_join
from threadmine.operators.stop_words import remove_listed_words

# The columns of a corpus.
CORPUS_COLUMNS = (
    "id", "creationDate", "score", "viewCount", "title", "document", "tags",
    "answerCount", "commentCount", "favoriteCount",
)
MAX_ANSWERS = 2_000


@dataclass(frozen=True)
class TextPrep:
    """How cleaned text becomes a document.

    Stop words are a tuple, which becomes part of the expressions, or a table of any length
    with the words in its first column, which is joined.
    """

    stop_words: tuple[str, ...] | DataFrame = ()
    min_length: int = 2
    stem: bool = True
    control_to_space: bool = False

    def clean(self, text: str | Column) -> Column:
        return clean_document(text, self.control_to_space)

    def document(self, cleaned: str | Column) -> Column:
        """Tokens of already cleaned text, without stop words, stemmed. For a tuple of them."""
        if isinstance(self.stop_words, DataFrame):
            raise TypeError("stop words in a table need with_document")
        words = remove_words(tokenize(cleaned, self.min_length), self.stop_words)
        return stem_words(words) if self.stem else words

    def with_document(self, df: DataFrame, cleaned: str | Column, *keys: str) -> DataFrame:
        """Add ``document``, made of already cleaned text; ``keys`` tell the rows apart."""
        if not isinstance(self.stop_words, DataFrame):
            return df.withColumn("document", self.document(cleaned))
        tokens = df.withColumn("document", tokenize(cleaned, self.min_length))
        left = remove_listed_words(tokens, "document", self.stop_words, keys)
        return left.withColumn("document", stem_words("document")) if self.stem else left


def title_and_body() -> Column:
    return F.concat("title", F.lit(" "), "body")


def _as_corpus(questions: DataFrame, cleaned: Column, prep: TextPrep) -> DataFrame:
    return prep.with_document(questions, cleaned, "id").select(*CORPUS_COLUMNS)


def title_corpus(questions: DataFrame, prep: TextPrep = TextPrep()) -> DataFrame:
    """QT: the document is the question's title."""
    return _as_corpus(questions, prep.clean("title"), prep)


def question_corpus(questions: DataFrame, prep: TextPrep = TextPrep()) -> DataFrame:
    """Q: the document is title and body of the question."""
    return _as_corpus(questions, prep.clean(title_and_body()), prep)


def _answer_texts(
    questions: DataFrame, answers: DataFrame, prep: TextPrep, max_answers: int | None,
    per_answer: bool,
):
    """Cleaned answer texts: whole ones, those in parts (or None), and the heavy questions."""
    answers = answers.select("id", "parentId", "body")
    clean = cleaned_each if per_answer else cleaned_whole
    if max_answers is None:
        return clean(answers_of(answers, questions), prep.control_to_space), None, None
    heavy = heavy_keys(answers, "parentId", max_answers)
    ordinary = answers_of(heavy.drop(answers, "parentId", "id"), questions)
    whole = clean(ordinary, prep.control_to_space)
    if heavy.empty:
        return whole, None, heavy
    asked = heavy.keep(questions.select("id"), "id", "id").withColumnRenamed("id", "parentId")
    large = spread_join(
        heavy.keep(answers, "parentId", "id"), asked, ["parentId"], "left_semi", "id"
    )
    if per_answer:
        parts = large.select(
            F.col("parentId").alias("id"), F.col("id").alias("part"),
            prep.clean("body").alias("cleaned"),
        )
    else:
        parts = cleaned_in_parts(large, prep.control_to_space)
    return whole, parts, heavy


def answer_corpus(
    questions: DataFrame, answers: DataFrame, prep: TextPrep = TextPrep(),
    max_answers: int | None = None, per_answer: bool = False,
) -> DataFrame:
    """A: ``(id, title, cleaned)``, the cleaned answers of every answered question.

    One row per question, however many answers it has. With ``max_answers`` the result is that
    of :func:`spread_answer_corpus`, which has ``part`` as well.
    """
    whole, parts, heavy = _answer_texts(questions, answers, prep, max_answers, per_answer)
    titles = questions.select("id", "title")
    columns = ("id", "part", "title", "cleaned")
    one_row = whole.join(titles, "id", "left")
    if max_answers is None:
        return one_row.select("id", "title", "cleaned")
    one_row = one_row.withColumn("part", F.lit(None).cast("bigint"))
    if parts is None:
        return one_row.select(*columns)
    titled = spread_join(parts, heavy.keep(titles, "id", "id"), ["id"], "left", "part")
    return one_row.select(*columns).unionByName(titled.select(*columns))


def question_answer_corpus(
    questions: DataFrame, answers: DataFrame, prep: TextPrep = TextPrep(),
    max_answers: int | None = None, per_answer: bool = False,
) -> DataFrame:
    """QA: the document is the question followed by all its answers.

    Columns as in the other corpora: one row per question, however many answers it has. With ``max_answers`` the result is that of
    :func:`spread_question_answer_corpus`.
    """
    whole, parts, heavy = _answer_texts(questions, answers, prep, max_answers, per_answer)
    asked = questions.withColumn("question_text", prep.clean(title_and_body()))
    together = F.concat("question_text", F.lit(" "), F.coalesce("cleaned", F.lit("")))
    light = asked if heavy is None else heavy.drop(asked, "id", "id")
    one_row = prep.with_document(light.join(whole, "id", "left"), together, "id")
    one_row = one_row.select(*CORPUS_COLUMNS)
    if heavy is None:
        return one_row
    one_row = one_row.withColumn("part", F.lit(None).cast("bigint"))
    if parts is None:
        return one_row
    first = heavy.keep(asked, "id", "id").withColumn("part", F.lit(0).cast("bigint"))
    heads = prep.with_document(first, "question_text", "id").select(*CORPUS_COLUMNS, "part")
    rest = prep.with_document(parts, "cleaned", "id", "part").select("id", "part", "document")
    return one_row.unionByName(heads).unionByName(rest, allowMissingColumns=True)


def spread_answer_corpus(
    questions: DataFrame, answers: DataFrame, prep: TextPrep = TextPrep(),
    max_answers: int = MAX_ANSWERS, per_answer: bool = False,
) -> DataFrame:
    """As :func:`answer_corpus`, but a question with more than ``max_answers`` answers has one
    row per answer, ``part`` being the answer's id; ``part`` is null in other rows."""
    return answer_corpus(questions, answers, prep, max_answers, per_answer)


def spread_question_answer_corpus(
    questions: DataFrame, answers: DataFrame, prep: TextPrep = TextPrep(),
    max_answers: int = MAX_ANSWERS, per_answer: bool = False,
) -> DataFrame:
    """As :func:`question_answer_corpus`, but a question with more than ``max_answers`` answers
    is spread over rows: part 0 is the question with all its columns, every other part is the
    answer of that id and has only ``id``, ``part`` and ``document``. Term counts, vectors and
    models add the parts of a document up again."""
    return question_answer_corpus(questions, answers, prep, max_answers, per_answer)


def corpus_heads(corpus: DataFrame) -> DataFrame:
    """One row per document: leaves out the further parts of spread documents."""
    if "part" not in corpus.columns:
        return corpus
    return corpus.filter(F.col("part").isNull() | (F.col("part") == 0))


def without_domain_words(
    corpus: DataFrame, words: Iterable[str] = DOMAIN_STOP_WORDS
) -> DataFrame:
    """Add ``removed``: the document without the words of the domain."""
    return corpus.withColumn("removed", remove_words("document", words))
