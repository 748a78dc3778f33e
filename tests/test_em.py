"""The em fit: the same steps as Spark's own, without a graph that is made again."""

import numpy as np
import pytest
from pyspark.ml.clustering import LDA
from pyspark.ml.linalg import Vectors

from threadmine.operators import em, topics

TERMS = 12


@pytest.fixture(scope="module")
def fixed(spark):
    """Subjects of three terms, dense and empty vectors, stored zeros, repeated and null ids."""
    rows = [
        (i, Vectors.sparse(TERMS, {(i % 3) * 3 + j: 1.0 + (i * j) % 4 for j in range(3)})) for i in range(30)
    ]
    rows += [
        (100, Vectors.dense([0.0, 2.5] * 5 + [0.0, 0.0])), (100, Vectors.sparse(TERMS, [2, 9], [0.0, 3.0])),
        (None, Vectors.sparse(TERMS, [4], [1.0])), (101, Vectors.sparse(TERMS, [], [])),
        (102, Vectors.sparse(TERMS, [5], [0.0])),
    ]
    return topics.fix_rows(spark.createDataFrame(rows, ["id", "features"]).repartition(3))


def counts_of(spark, path):
    data = spark.read.parquet(f"{path}/oldModel/data/topicCounts").collect()
    return {r.id: r.topicWeights.toArray() for r in data}


def test_a_step_is_that_of_spark(spark, fixed, tmp_path):
    alpha, beta, k = 3.5, 1.01, 3
    for n in (2, 3):
        lda = LDA(k=k, optimizer="em", maxIter=n, docConcentration=[alpha], topicConcentration=beta, seed=5)
        lda.fit(fixed).write().save(str(tmp_path / str(n)))
    before, after = (counts_of(spark, tmp_path / str(n)) for n in (2, 3))
    totals = sum(c for i, c in before.items() if i < 0)
    found = {}
    for _, cells in em._cells(fixed, 2).collect():
        ids, terms = cells[0], cells[4]
        documents = np.array([before[i] for i in ids.tolist()]).reshape(-1, k)
        words = np.array([before[-t - 1] for t in terms.tolist()]).reshape(-1, k)
        ids, documents, terms, words = em.next_shares(cells, documents, words, totals, TERMS, alpha, beta)
        for i, c in [*zip(ids.tolist(), documents), *zip((-terms - 1).tolist(), words)]:
            found[i] = found.get(i, 0) + c
    assert found.keys() == after.keys()
    assert all(np.allclose(found[i], after[i], rtol=1e-9) for i in after)


@pytest.mark.parametrize("blocks", [1, 64])
def test_iterations_add_up(fixed, monkeypatch, blocks):
    """A fit over partitions and blocks of terms, against the same steps over all of them."""
    monkeypatch.setattr(em, "BLOCKS", blocks)
    k, alpha, beta = 3, 3.5, 1.01
    fitted = topics.fit_topics(fixed, k, "em", iterations=4, alpha=alpha, beta=beta, seed=5)
    got = {r.id: r.topicWeights.toArray() for r in fitted.fit.counts().collect()}
    parts = em._cells(fixed, max(1, min(fixed.rdd.getNumPartitions(), blocks))).collect()
    state = [em.first_shares(part, cells, k, 5) for part, cells in parts]
    for _ in range(4):
        words = np.zeros((TERMS, k))
        for _, _, terms, own in state:
            words[terms] += own
        totals = words.sum(axis=0)
        state = [
            em.next_shares(cells, own[1], words[own[2]], totals, TERMS, alpha, beta)
            for (_, cells), own in zip(parts, state, strict=True)
        ]
    want, words = {}, np.zeros((TERMS, k))
    for ids, documents, terms, own in state:
        want |= dict(zip(ids.tolist(), documents))
        words[terms] += own
    want |= {-t - 1: words[t] for t in range(TERMS) if words[t].any()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[i], want[i], rtol=1e-9) for i in want)
    assert np.allclose(fitted.fit.totals, words.sum(axis=0))


def test_spark_reads_the_model(spark, fixed, tmp_path):
    k = 3
    fitted = topics.fit_topics(fixed, k, "em", iterations=15, seed=5)
    path = topics.save_model(fitted, str(tmp_path), "M")
    own = LDA(k=k, optimizer="em", maxIter=15, docConcentration=[fitted.alpha],
              topicConcentration=fitted.beta, seed=5).fit(fixed)
    for model in (fitted.model, topics.read_model(spark, path)):
        assert model.isDistributed() and model.vocabSize() == TERMS and model.getK() == k
        assert model.estimatedDocConcentration() == own.estimatedDocConcentration()
        assert model.trainingLogLikelihood() == pytest.approx(own.trainingLogLikelihood(), rel=1e-9)
        assert np.allclose(model.topicsMatrix().toArray(), own.topicsMatrix().toArray(), rtol=1e-6)
    edges = spark.read.parquet(f"{topics.current_version(spark, path)}/model/oldModel/data/tokenCounts")
    own.write().save(str(tmp_path / "own"))
    theirs = spark.read.parquet(str(tmp_path / "own/oldModel/data/tokenCounts"))
    assert edges.schema == theirs.schema
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, theirs.collect()))
    ids = [r.id for r in topics.distributions(fitted).collect()]
    assert sorted(map(str, ids)) == sorted([*map(str, range(30)), "100", "100", "None"])
    mine, others = (counts_of(spark, p) for p in (f"{topics.current_version(spark, path)}/model", tmp_path / "own"))
    assert mine.keys() == others.keys()
    assert all(np.allclose(mine[i], others[i], rtol=1e-6) for i in mine)


@pytest.mark.parametrize("seed", [0, 7, -9, (1 << 63) - 1, 3 - (1 << 63)])
def test_numbers_are_those_that_java_draws(spark, seed):
    random = spark._jvm.java.util.Random(spark._jvm.java.lang.Long(str(seed)))
    want = np.array([random.nextDouble() for _ in range(60)])
    for k in (1, 3, 5):
        for topic in range(k):
            assert np.array_equal(em.drawn(seed, 60 // k, k, topic), want[topic::k])
    assert len(em.drawn(seed, 0, 2, 1)) == 0


def test_no_graph_is_made_in_an_iteration(spark, fixed):
    context = spark.sparkContext
    context.setJobGroup("em-fit", "")
    try:
        fitted = topics.fit_topics(fixed, 2, "em", iterations=3, seed=1)
        assert topics.distributions(fitted).count() == 33
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("em-fit") for s in tracker.getJobInfo(j).stageIds]
    names = [found.name for found in map(tracker.getStageInfo, stages) if found]
    assert names and not [n for n in names if "LDA" in n or "VertexRDD" in n or "Graph" in n]


def test_checkpoints_and_negative_seeds(fixed, monkeypatch):
    monkeypatch.setattr(topics, "CHECKPOINT_INTERVAL", 2)
    one, two = (topics.fit_topics(fixed, 2, "em", iterations=5, seed=-9).fit for _ in range(2))
    assert one.totals == two.totals and len(one.seconds) == 5
    assert {tuple(r.topicWeights) for r in one.counts().collect()} == {
        tuple(r.topicWeights) for r in two.counts().collect()
    }


def test_without_rows_or_counts(spark):
    empty = spark.createDataFrame([(1, Vectors.sparse(3, [], []))], ["id", "features"])
    fitted = topics.fit_topics(topics.fix_rows(empty), 2, "em", iterations=2, seed=1)
    assert fitted.fit.counts().count() == topics.distributions(fitted).count() == 0
    with pytest.raises(ValueError):
        topics.fit_topics(topics.fix_rows(empty.limit(0)), 2, "em", iterations=1)
