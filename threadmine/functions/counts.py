"""Word counts inside a row, as Arrow-batched Spark functions."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmine.functions import batches
from threadmine.functions.batches import offsets_of, pieces

# The functions travel with the query, so executors need no copy of this package.
for _module in (batches, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)


#: Bits of a block's number below its task's.
BLOCK_BITS = 33


def _coded(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words, and row, word's place among them and count of every cell, by row."""
    offsets = offsets_of(lists).to_numpy()
    coded = lists.flatten().dictionary_encode()
    size = max(1, len(coded.dictionary))
    rows = np.repeat(np.arange(len(lists)), np.diff(offsets))
    codes = coded.indices.fill_null(-1).to_numpy()
    found, counts = np.unique((rows * size + codes)[codes >= 0], return_counts=True)
    return coded.dictionary, *np.divmod(found, size), counts


def _count(lists: pa.Array) -> pa.Array:
    terms, rows, codes, counts = _coded(lists)
    cells = pa.StructArray.from_arrays(
        [terms.take(pa.array(codes)), pa.array(counts, pa.int64())], ["term", "count"]
    )
    ends = np.searchsorted(rows, np.arange(len(lists) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), cells, mask=lists.is_null())


@F.arrow_udf(T.ArrayType(T.StructType().add("term", "string").add("count", "long")))
def _count_array(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for lists in arrays:
        for some in pieces(lists):
            yield _count(some)


def counted_words(words: str | Column) -> Column:
    """Distinct words of an ``array<string>`` column with their counts, in no certain order.

    Row-local: what is grouped by document costs no shuffle. Null words are left out, a null
    array stays null.
    """
    return _count_array(F.col(words) if isinstance(words, str) else words)


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << BLOCK_BITS
    for batch in batches:
        ids, lists, at = batch.column(0), batch.column(1), 0
        for some in pieces(lists):
            terms, rows, codes, counts = _coded(some)
            sizes = np.bincount(rows, minlength=len(some))
            columns = {
                "ids": ids.slice(at, len(some)), "sizes": pa.array(sizes, pa.int32()),
                "codes": pa.array(codes, pa.int32()), "counts": pa.array(counts, pa.int32()),
                "terms": terms,
            }
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array([block]), **{n: _one_list(c) for n, c in columns.items()}}
            )
            block, at = block + 1, at + len(some)


def word_blocks(rows: DataFrame, words: str) -> DataFrame:
    """``(block, ids, sizes, codes, counts, terms)``: the rows of ``(id, words)``, some thousand
    of them a block, with their words counted and each distinct word of a block spelled once.

    ``ids`` and ``sizes`` have an entry a row, the latter how many of ``codes`` (places in
    ``terms``) and ``counts`` are its own. A block has the words of a piece of an Arrow batch.
    """
    ints = T.ArrayType(T.IntegerType())
    schema = (
        T.StructType().add("block", "long").add("ids", T.ArrayType(rows.schema["id"].dataType))
        .add("sizes", ints).add("codes", ints).add("counts", ints)
        .add("terms", T.ArrayType(T.StringType()))
    )
    return rows.select("id", words).mapInArrow(_blocks, schema)


def _rows_of_block(block: dict[str, pa.Array | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where its rows end, and number and count of their cells, by row and number."""
    codes, counts = block["codes"].to_numpy(), block["counts"].to_numpy()
    sizes = block["sizes"].to_numpy()
    rows = np.repeat(np.arange(len(sizes)), sizes)
    number = np.full(int(codes.max()) + 1 if len(codes) else 0, -1, np.int64)
    if block["known"] is not None:
        number[block["known"].to_numpy()] = block["numbers"].to_numpy()
    found = number[codes]
    kept = found >= 0
    rows, found, counts = rows[kept], found[kept], counts[kept]
    order = np.argsort(rows * (int(number.max(initial=0)) + 1) + found)
    ends = np.searchsorted(rows, np.arange(len(sizes) + 1))
    return ends.astype(np.int32), found[order], counts[order]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("ids", "sizes", "codes", "counts", "known", "numbers")
    for batch in batches:
        for at in range(batch.num_rows):
            block = {n: batch.column(n)[at].values for n in names}
            ends, numbers, counts = _rows_of_block(block)
            ends = pa.array(ends)
            yield pa.RecordBatch.from_pydict({
                "id": block["ids"],
                "indices": pa.ListArray.from_arrays(ends, pa.array(numbers, pa.int32())),
                "values": pa.ListArray.from_arrays(ends, pa.array(counts, pa.float64())),
            })


def numbered_rows(blocks: DataFrame) -> DataFrame:
    """``(id, indices, values)``, a row for every row of the blocks: the numbers of its words in
    order, and their counts. ``known`` and ``numbers`` have places in a block's ``terms`` and
    their words' numbers; words without a number are left out."""
    kind = blocks.schema["ids"].dataType.elementType
    ints, doubles = T.ArrayType(T.IntegerType()), T.ArrayType(T.DoubleType())
    schema = T.StructType().add("id", kind).add("indices", ints).add("values", doubles)
    listed = blocks.select("ids", "sizes", "codes", "counts", "known", "numbers")
    return listed.mapInArrow(_numbered, schema)
