"""Vocabularies that are tables: longer than what one model holds on the driver."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadmine.functions import batches, stem
from threadmine.functions.counts import counted_words
from threadmine.operators import terms, topics, vectors
from threadmine.plans.analysis import sweep_metrics
from threadmine.plans.modelling import model_corpus

SCHEMA = (
    "id BIGINT, document ARRAY<STRING>, title STRING, score INT, viewCount INT,"
    " answerCount INT, commentCount INT, favoriteCount INT"
)


@pytest.fixture
def corpus(spark):
    subjects = [["cat", "dog", "bird"], ["join", "table", "row"]]
    rows = [(i, subjects[i % 2] * 3, f"title {i}", 0, i, 1, 2, 0) for i in range(20)]
    return spark.createDataFrame([*rows, (99, ["once"], "rare", 0, 0, 0, 0, 0)], SCHEMA)


@pytest.mark.parametrize("optimizer", ["em", "online"])
def test_models_and_saved_vectorizers_know_no_limit(spark, corpus, tmp_path, monkeypatch, optimizer):
    monkeypatch.setattr(topics, "MODEL_TERMS", 3)
    with pytest.raises(ValueError):
        topics.fit_vectorizer(corpus, 3, words="document")
    fitted = topics.fit_vectorizer(corpus, 3, words="document", as_table=True)
    for _ in range(2):  # the second one replaces the first
        topics.save_vectorizer(fitted, str(tmp_path), "V", 4)
    loaded = topics.load_vectorizer(str(tmp_path), "V", 4)
    listed = {tuple(r) for r in topics.vocabulary_table(spark, loaded).collect()}
    assert listed == set(enumerate(["bird", "cat", "dog", "join", "row", "table"]))
    assert loaded.getInputCol() == "document"
    fixed = topics.fix_rows(topics.vectorize(loaded, corpus))
    found = topics.distributions(topics.fit_topics(fixed, 2, optimizer, iterations=3, seed=1))
    assert {r.id for r in found.collect()} == set(range(20))


def test_sweep_of_a_long_vocabulary(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(topics, "MODEL_TERMS", 3)
    runs = list(
        model_corpus(corpus, "L", str(tmp_path), (2,), iterations=3, terms_per_topic=4,
                     documents_per_topic=2, domain_words=(), seed=1)
    )
    assert runs[0].statistics.first().terms == 6
    assert runs[0].report.count() == 2 * (4 + 2)
    assert sweep_metrics(corpus, "L", str(tmp_path), (2,)).count() == 2


def test_every_row_is_a_document(spark):
    """Null and repeated ids, rows without words, and terms that look like row numbers."""
    rows = [(1, ["0", "1", "0"]), (1, ["1"]), (None, ["2", "x"]), (None, None), (4, []), (5, ["y"])]
    corpus = spark.createDataFrame(rows, "id BIGINT, removed ARRAY<STRING>").coalesce(1)
    known = spark.createDataFrame([(0, "0"), (1, "1"), (2, "2"), (3, "4")], "termIndex INT, term STRING")
    made = vectors.row_vectors(corpus, known).collect()
    got = sorted((str(r.id), r.features.toArray().tolist()) for r in made)
    none = [0.0] * 4
    assert got == sorted([
        ("1", [2.0, 1.0, 0.0, 0.0]), ("1", [0.0, 1.0, 0.0, 0.0]), ("None", [0.0, 0.0, 1.0, 0.0]),
        ("None", none), ("4", none), ("5", none),
    ])


def test_repeated_ids_are_added_up_by_count_vectors(spark):
    corpus = spark.createDataFrame([(1, ["a", "b"]), (1, ["b"]), (2, ["z"])], "id BIGINT, removed ARRAY<STRING>")
    known = spark.createDataFrame([(0, "a"), (1, "b")], "termIndex INT, term STRING")
    made = vectors.count_vectors(corpus, known).collect()
    assert sorted((r.id, r.features.toArray().tolist()) for r in made) == [
        (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0]),
    ]


def test_words_are_counted_inside_the_row(spark):
    rows = [(1, ["b", "a", "b", None]), (2, []), (3, None), (4, ["a"])]
    df = spark.createDataFrame(rows, "id INT, w ARRAY<STRING>").coalesce(1)
    got = {r.id: r.c and {x.term: x["count"] for x in r.c} for r in df.select("id", counted_words("w").alias("c")).collect()}
    assert got == {1: {"a": 1, "b": 2}, 2: [], 3: None, 4: {"a": 1}}
    found = terms.term_statistics(df, "w").collect()
    assert {tuple(r) for r in found} == {("a", 2, 2), ("b", 2, 1)}


def test_vectors_shuffle_counts_and_not_words(spark, tmp_path):
    """Documents are counted in their rows: nothing is grouped by document and term before the join."""
    spark.createDataFrame([(1, ["a"])], "id BIGINT, removed ARRAY<STRING>").write.parquet(str(tmp_path / "c"))
    corpus = spark.read.parquet(str(tmp_path / "c"))
    plan = terms.term_statistics(corpus)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "array_sort" not in plan and plan.count("Exchange") == 1


def test_a_long_task_remembers_few_words(monkeypatch):
    """Before, one batch was stemmed as a whole, and up to 2^20 words were remembered."""
    monkeypatch.setattr(batches, "PIECE_WORDS", 100)
    monkeypatch.setattr(stem, "MEMO_WORDS", 300)
    seen, real = [], stem._stem_distinct

    def watched(words, memo):
        out = real(words, memo)
        seen.append((len(words), len(memo)))
        return out

    monkeypatch.setattr(stem, "_stem_distinct", watched)
    # no names that stem to one another: every word is new
    lists = pa.array([[f"w{i}x{j}" for j in range(30)] for i in range(100)] + [None, []], pa.list_(pa.string()))
    made = pa.concat_arrays(stem._stem_array.func(iter([lists])))
    assert made.to_pylist() == lists.to_pylist()
    assert max(n for n, _ in seen) <= 100 and max(m for _, m in seen) <= 400
