"""English stemming of word columns as an Arrow-batched Spark function."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmine.functions import batches, porter2
from threadmine.functions.batches import PIECE_WORDS, offsets_of, pieces
from threadmine.functions.porter2 import stem_word
from threadmine.functions.text import word_rows

# The functions travel with the query, so executors need no copy of this package.
for _module in (batches, porter2, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

#: Words a task remembers the stems of; all are forgotten when there are more.
MEMO_WORDS = 1 << 18
#: Bytes of them, for long words.
MEMO_BYTES = 1 << 25


class _Memo:
    """Words and their stems as Arrow strings, a fraction of what a dictionary of them takes."""

    def __init__(self) -> None:
        self.words = self.stems = pa.array([], pa.string())

    def __len__(self) -> int:
        return len(self.words)

    def stems_of(self, words: pa.Array) -> pa.Array:
        """Stems of distinct words; the rules run for those that are not remembered."""
        if len(self) > MEMO_WORDS or self.words.nbytes > MEMO_BYTES:
            self.__init__()
        at = pc.index_in(words, self.words).fill_null(-1).to_numpy(zero_copy_only=False).copy()
        missing = at < 0
        at[missing] = np.arange(len(self), len(self) + missing.sum())
        new = words.filter(pa.array(missing))
        stems = pa.array([stem_word(w) for w in new.to_pylist()], pa.string())
        self.words = pa.concat_arrays([self.words, new])
        self.stems = pa.concat_arrays([self.stems, stems])
        return self.stems.take(pa.array(at))


def _stem_distinct(words: pa.Array, memo: _Memo) -> pa.Array:
    """Stem an Arrow string array, running the rules once per distinct word."""
    coded = words.dictionary_encode()
    return memo.stems_of(coded.dictionary.cast(pa.string())).take(coded.indices)


@F.arrow_udf(T.StringType())
def _stem_string(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    memo = _Memo()
    for words in arrays:
        for at in range(0, len(words), PIECE_WORDS):
            yield _stem_distinct(words.slice(at, PIECE_WORDS), memo)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stem_array(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    memo = _Memo()
    for whole in arrays:
        for lists in pieces(whole):
            stems = _stem_distinct(lists.flatten(), memo)
            yield pa.ListArray.from_arrays(offsets_of(lists), stems, mask=lists.is_null())


def stem_words(words: str | Column) -> Column:
    """Stems of an ``array<string>`` column, in place and in order.

    Row-local: no shuffle and no dictionary to ship, so a term that makes up a third of
    all tokens costs no more than any other. Inside each piece of an Arrow batch the tokens are
    dictionary-encoded and only distinct words a task does not remember reach the Python rules.
    A worker holds one batch, one piece and ``MEMO_WORDS`` words (``MEMO_BYTES`` of them at most),
    however long its task is.
    """
    return _stem_array(F.col(words) if isinstance(words, str) else words)


def stem_term(term: str | Column) -> Column:
    """Stem of a plain string column (the long-form twin of :func:`stem_words`)."""
    return _stem_string(F.col(term) if isinstance(term, str) else term)


def stem_dictionary(df: DataFrame, words: str) -> DataFrame:
    """``(term, stem)`` for every distinct word of the array column ``words``."""
    terms = word_rows(df, F.array_distinct(words)).distinct()
    return terms.withColumn("stem", stem_term("term"))
