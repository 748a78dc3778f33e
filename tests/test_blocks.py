"""Vectors made of coded blocks: what is exploded are a block's distinct terms, not its cells."""

import pytest
from pyspark.sql import functions as F

from threadmine.functions import batches
from threadmine.functions.counts import word_blocks
from threadmine.operators import vectors

SCHEMA = "id BIGINT, removed ARRAY<STRING>"


@pytest.fixture
def small_pieces(monkeypatch):
    monkeypatch.setattr(batches, "PIECE_WORDS", 7)


def test_a_block_spells_a_word_once(spark):
    """Before, every cell was a row that was joined by its term and grouped by its document."""
    corpus = spark.range(0, 400, numPartitions=2).select(
        "id", F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.concat(F.lit("t"), (F.col("id") + i) % 40)).alias("removed")
    )
    blocks = word_blocks(corpus, "removed")
    rows = blocks.select(F.size("ids").alias("rows"), F.size("terms").alias("terms"), F.size("codes").alias("cells"))
    assert [tuple(r) for r in rows.collect()] == [(200, 40, 6000)] * 2
    known = vectors.numbered_vocabulary(corpus, 1)
    plan = vectors._row_cells(blocks, known)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Generate posexplode(terms" in plan
    assert vectors.count_vectors(corpus, known).count() == 400


def test_rows_of_many_small_blocks(spark, small_pieces):
    rows = [(i, [f"w{(i * j) % 11}" for j in range(i % 9)]) for i in range(60)]
    rows += [(None, ["w1"]), (None, None), (100, None), (101, []), (102, [None, "w3", None, "w3"]), (103, ["zz"])]
    corpus = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    assert word_blocks(corpus, "removed").count() > 20
    known = spark.createDataFrame([(i, f"w{10 - i}") for i in range(11)], "termIndex INT, term STRING")

    def dense(words):
        return [float(sum(w == f"w{10 - i}" for w in words or [])) for i in range(11)]

    got = sorted((str(r.id), r.features.toArray().tolist()) for r in vectors.row_vectors(corpus, known).collect())
    assert got == sorted((str(i), dense(words)) for i, words in rows)
    got = sorted((str(r.id), r.features.toArray().tolist()) for r in vectors.count_vectors(corpus, known).collect())
    assert got == sorted((str(i), dense(words if i is not None else [])) for i, words in rows)
    made = vectors.count_vectors(corpus, known).select(F.unwrap_udt("features").alias("v"))
    assert made.filter(F.col("v.indices") != F.array_sort("v.indices")).isEmpty()


def test_rows_of_one_id_in_several_blocks(spark, small_pieces):
    rows = [(i % 4 if i < 30 else i, ["a", "b", f"c{i % 3}"]) for i in range(40)] + [(2, None), (7, [])]
    corpus = spark.createDataFrame(rows, SCHEMA).repartition(3)
    known = spark.createDataFrame([(0, "b"), (1, "c0"), (2, "c1")], "termIndex INT, term STRING")
    sums = {}
    for i, words in rows:
        held = sums.setdefault(i, [0.0] * 3)
        for at, term in enumerate(("b", "c0", "c1")):
            held[at] += (words or []).count(term)
    got = sorted((r.id, r.features.toArray().tolist()) for r in vectors.count_vectors(corpus, known).collect())
    assert got == sorted((i, sums[i]) for i, _ in rows)


def test_no_rows_and_ids_of_text(spark):
    known = spark.createDataFrame([(0, "a")], "termIndex INT, term STRING")
    corpus = spark.createDataFrame([("x", ["a"]), ("y", ["b"])], "id STRING, removed ARRAY<STRING>")
    assert {(r.id, r.features.toArray()[0]) for r in vectors.count_vectors(corpus, known).collect()} == {("x", 1), ("y", 0)}
    assert vectors.count_vectors(corpus.limit(0), known).count() == 0
    assert vectors.count_vectors(corpus, known.limit(0)).count() == 2
