"""Job 1: from posts to corpora at rest."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from threadmine.functions.text import SPARK_TAGS
from threadmine.operators.corpus import (
    TextPrep,
    question_answer_corpus,
    question_corpus,
    title_corpus,
)
from threadmine.operators.selection import FIRST_YEAR, answers, since_year, tagged_questions
from threadmine.session import fresh_path
from threadmine.sources.corpus_files import write_corpus, write_corpus_csv

KINDS = ("QT", "Q", "QA")


def corpora(
    posts: DataFrame, prep: TextPrep = TextPrep(), kinds: Iterable[str] = KINDS,
    needles: Iterable[str] = SPARK_TAGS, first_year: int = FIRST_YEAR,
    max_answers: int | None = None, per_answer: bool = False,
) -> dict[str, DataFrame]:
    """The requested corpora as DataFrames, each independent of the others. With ``max_answers``
    QA is spread: see ``spread_question_answer_corpus``.

    The selected questions, a small part of the posts, are staged first: posts are scanned once
    for them and, for QA, once for the answers, whatever the number of corpora.
    """
    recent = since_year(posts, first_year)
    path = fresh_path(posts.sparkSession, "questions")
    tagged_questions(recent, tuple(needles)).hint("rebalance").write.parquet(path)
    asked = posts.sparkSession.read.parquet(path)
    out = {}
    for kind in kinds:
        if kind == "QT":
            out[kind] = title_corpus(asked, prep)
        elif kind == "Q":
            out[kind] = question_corpus(asked, prep)
        elif kind == "QA":
            out[kind] = question_answer_corpus(
                asked, answers(recent), prep, max_answers, per_answer
            )
        else:
            raise ValueError(f"unknown corpus: {kind}")
    return out


def build_corpora(
    posts: DataFrame, base: str, csv: bool = False, **settings
) -> dict[str, str]:
    """Write the corpora as parquet (and CSV) under ``base``; returns the parquet paths.

    ``posts`` is best the parquet of ``stage_posts``: it is scanned for questions and answers.
    """
    paths = {}
    for kind, corpus in corpora(posts, **settings).items():
        paths[kind] = f"{base.rstrip('/')}/Corpus{kind}.parquet"
        write_corpus(corpus, paths[kind])
        if csv:
            written = posts.sparkSession.read.parquet(paths[kind])
            write_corpus_csv(written, f"{base.rstrip('/')}/Corpus{kind}.csv")
    return paths
