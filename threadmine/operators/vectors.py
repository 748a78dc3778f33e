"""Term numbers and sparse count vectors for a vocabulary of any size, none of it on the driver."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadmine.functions.counts import numbered_rows, word_blocks
from threadmine.operators.corpus import corpus_heads
from threadmine.operators.terms import MIN_DOCUMENTS, term_counts, vocabulary
from threadmine.session import ensure_checkpoints, fresh_path

#: Bits of ``monotonically_increasing_id`` below the partition's number.
ROW_BITS = 33


def numbered(ordered: DataFrame, into: str) -> DataFrame:
    """Rows of a sorted DataFrame with their gapless number from 0.

    A sorted DataFrame is partitioned by range. Its partitions are counted, and a row's number is
    what the partitions before its own hold plus its place there. The counts are one row per
    partition of the sort, so they are broadcast.
    """
    ensure_checkpoints(ordered.sparkSession)
    placed = ordered.withColumn("_place", F.monotonically_increasing_id()).checkpoint()
    partition = F.shiftright("_place", ROW_BITS)
    counts = placed.groupBy(partition.alias("_partition")).count()
    before = W.orderBy("_partition").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "_partition", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")
    )
    within = F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        placed.withColumn("_partition", partition)
        .join(F.broadcast(offsets), "_partition")
        .withColumn(into, (F.col("_offset") + within).cast("int"))
        .drop("_partition", "_place", "_offset")
    )


def numbered_vocabulary(
    corpus: DataFrame, min_documents: int = MIN_DOCUMENTS, limit: int | None = None,
    words: str = "removed",
) -> DataFrame:
    """``(termIndex, term, count)``: the vocabulary, most frequent first, ties in term order."""
    found = numbered(vocabulary(corpus, min_documents, limit, words), "termIndex")
    return found.select("termIndex", "term", "count")


def count_vectors(
    corpus: DataFrame, terms: DataFrame, words: str = "removed", path: str | None = None
) -> DataFrame:
    """``(id, features)``: sparse term counts of every document, at rest.

    ``terms`` has ``(termIndex, term)``. Parts of a spread document are added up as counts, so
    no step holds more of a document than its distinct terms; rows that share an id are too. A
    document without any of the terms, or without an id, has an empty vector. The vectors are
    written once in the layout of the vector type and read back as such; every iteration of a
    fit reads them there.
    """
    known = terms.select("termIndex", "term")
    if "part" not in corpus.columns:
        blocks = _coded_blocks(corpus, words)
        return _at_rest(_added_up(_row_cells(blocks, known), blocks), known, path)
    counts = term_counts(corpus, words).join(known, "term")
    cells = counts.groupBy("id").agg(_cells(F.col("count").cast("double")).alias("cells"))
    rows = corpus_heads(corpus).select("id").join(cells, "id", "left")
    return _at_rest(rows.select("id", *_split_cells()), known, path)


def row_vectors(
    corpus: DataFrame, terms: DataFrame, words: str = "removed", path: str | None = None
) -> DataFrame:
    """As :func:`count_vectors`, but every row of ``corpus`` is a document of its own, also if
    its id is null or repeated."""
    known = terms.select("termIndex", "term")
    return _at_rest(_row_cells(_coded_blocks(corpus, words), known), known, path)


def _coded_blocks(corpus: DataFrame, words: str) -> DataFrame:
    ensure_checkpoints(corpus.sparkSession)
    return word_blocks(corpus, words).checkpoint()


def _row_cells(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """``(id, indices, values)`` of every row of the blocks, in term order.

    Only the distinct terms of the blocks are exploded, joined and grouped; the cells of the
    documents stay inside their block's row.
    """
    spelled = blocks.select("block", F.posexplode("terms").alias("code", "term"))
    pair = F.sort_array(F.collect_list(F.struct("code", "termIndex")))
    pairs = spelled.join(known, "term").groupBy("block").agg(pair.alias("pairs"))
    numbers = pairs.select(
        "block", F.col("pairs.code").alias("known"), F.col("pairs.termIndex").alias("numbers")
    )
    return numbered_rows(blocks.join(numbers, "block", "left"))


def _added_up(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows of :func:`_row_cells`; those that share an id all have the sum of their counts,
    and those without an id have none."""
    rows = rows.withColumns({n: F.when(F.col("id").isNotNull(), F.col(n)) for n in ("indices", "values")})
    ids = blocks.select(F.explode("ids").alias("id"))
    repeated = ids.groupBy("id").count().filter("count > 1 AND id IS NOT NULL").select("id").checkpoint()
    if repeated.isEmpty():
        return rows
    single = rows.join(repeated, "id", "left_semi").select(
        "id", F.inline(F.arrays_zip(F.col("indices").alias("termIndex"), F.col("values").alias("value")))
    )
    counts = single.groupBy("id", "termIndex").agg(F.sum("value").alias("value"))
    cells = counts.groupBy("id").agg(_cells(F.col("value")).alias("cells"))
    summed = ids.join(repeated, "id", "left_semi").join(cells, "id", "left")
    return rows.join(repeated, "id", "left_anti").unionByName(summed.select("id", *_split_cells()))


def _cells(count: Column) -> Column:
    """Terms with their counts, in term order."""
    return F.sort_array(F.collect_list(F.struct("termIndex", count.alias("count"))))


def _split_cells() -> list[Column]:
    return [F.col("cells.termIndex").alias("indices"), F.col("cells.count").alias("values")]


def _at_rest(rows: DataFrame, known: DataFrame, path: str | None) -> DataFrame:
    """``(id, features)`` of ``(id, indices, values)``, written and read back as vectors."""
    spark = rows.sparkSession
    size = known.agg(F.coalesce(F.max("termIndex") + 1, F.lit(0)).cast("int").alias("n")).scalar()
    vectors = rows.select(
        "id",
        F.struct(
            F.lit(0).cast("tinyint").alias("type"),
            size.alias("size"),
            F.coalesce("indices", F.array().cast("array<int>")).alias("indices"),
            F.coalesce("values", F.array().cast("array<double>")).alias("values"),
        ).alias("features"),
    )
    path = path or fresh_path(spark, "vectors")
    vectors.write.parquet(path)
    schema = StructType().add(vectors.schema["id"]).add("features", VectorUDT())
    return spark.read.schema(schema).parquet(path)


def vector_counts(vectors: DataFrame, terms: DataFrame) -> DataFrame:
    """``(id, term, count)`` from sparse vectors: the reverse of :func:`count_vectors`."""
    cells = vectors.select("id", F.unwrap_udt("features").alias("v")).select(
        "id", F.inline(F.arrays_zip("v.indices", "v.values"))
    )
    return (
        cells.withColumnRenamed("indices", "termIndex")
        .join(terms.select("termIndex", "term"), "termIndex")
        .select("id", "term", F.col("values").cast("bigint").alias("count"))
    )
