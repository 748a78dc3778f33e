import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from threadmine.operators import topics, vectors

SCHEMA = "id BIGINT, part BIGINT, removed ARRAY<STRING>"


def test_numbers_follow_the_order_over_many_partitions(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(13)
    got = vectors.numbered(rows.orderBy(F.desc("v")), "n").collect()
    assert sorted((r.n, r.v) for r in got) == [(i, 4999 - i) for i in range(5000)]
    assert vectors.numbered(rows.filter("v < 0").orderBy("v"), "n").count() == 0


def test_same_vectors_as_the_vectorizer(spark):
    rows = [(i, None, [f"w{j % 7}" for j in range(i)] + ["rare"] * (i == 3)) for i in range(12)]
    corpus = spark.createDataFrame(rows, SCHEMA).drop("part").repartition(3)
    known = vectors.numbered_vocabulary(corpus, 2)
    fitted = topics.fit_vectorizer(corpus, 2)
    assert [r.term for r in known.orderBy("termIndex").collect()] == fitted.vocabulary
    mine = {r.id: r.features for r in vectors.count_vectors(corpus, known).collect()}
    theirs = {r.id: r.features for r in fitted.transform(corpus).collect()}
    assert mine == theirs and isinstance(mine[0], SparseVector)
    counts = {(r.id, r.term): r["count"] for r in vectors.vector_counts(
        vectors.count_vectors(corpus, known), known).collect()}
    assert counts[(11, "w0")] == 2 and (3, "rare") not in counts


def test_parts_are_added_up(spark):
    rows = [(1, 0, ["a", "b"]), (1, 5, ["b"]), (1, 9, ["c", "b"]), (2, None, ["a"]), (3, None, []), (4, None, None)]
    corpus = spark.createDataFrame(rows, SCHEMA)
    known = vectors.numbered_vocabulary(corpus, 1)
    assert [r.term for r in known.orderBy("termIndex").collect()] == ["b", "a", "c"]
    got = {r.id: r.features.toArray().tolist() for r in vectors.count_vectors(corpus, known).collect()}
    assert got == {1: [3, 1, 1], 2: [0, 1, 0], 3: [0, 0, 0], 4: [0, 0, 0]}
    by_vectorizer = topics.vectorize(topics.fit_vectorizer(corpus, 1), corpus).collect()
    assert {r.id: r.features.toArray().tolist() for r in by_vectorizer} == got


def test_more_terms_than_one_model_holds(spark):
    """Above the limit of a vocabulary on the driver."""
    corpus = spark.range(3000).select(
        "id", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("t"), F.col("id") * 100 + i)).alias("removed")
    )
    known = vectors.numbered_vocabulary(corpus, 1).checkpoint()
    assert known.count() == 300_000 > topics.MODEL_TERMS
    assert known.agg(F.max("termIndex"), F.count_distinct("termIndex")).first() == (299_999, 300_000)
    made = vectors.count_vectors(corpus, known)
    one = made.filter("id = 77").first().features
    assert one.size == 300_000 and one.numNonzeros() == 100
    assert vectors.vector_counts(made, known).count() == 300_000
    with pytest.raises(ValueError):
        topics.fit_vectorizer(corpus, 1)
