from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threadmine.operators import topics
from threadmine.plans.analysis import sweep_metrics
from threadmine.plans.modelling import model_corpus


@pytest.fixture(scope="module")
def corpus(spark):
    """Two plain subjects, and one document without any word of the vocabulary."""
    first, second = ["cat", "dog", "bird"], ["join", "table", "row"]
    rows = [
        (i * 10, (first if i % 2 else second) * 4, f"title {i}", i % 5, i, 1, 2, None)
        for i in range(40)
    ]
    rows.append((7, ["once"], "rare", 0, 0, 0, 0, 0))
    return spark.createDataFrame(
        rows,
        "id BIGINT, document ARRAY<STRING>, title STRING, score INT, viewCount INT,"
        " answerCount INT, commentCount INT, favoriteCount INT",
    ).repartition(3)


def test_prior_defaults():
    assert topics.prior_defaults("em", 20) == (3.5, 1.01)
    assert topics.prior_defaults("online", 20) == (0.05, 0.05)
    assert topics.prior_defaults("em", 20, 2.0, 3.0) == (2.0, 3.0)
    with pytest.raises(ValueError):
        topics.prior_defaults("other", 20)


@pytest.mark.parametrize("optimizer", ["em", "online"])
def test_distributions_carry_the_right_ids(corpus, optimizer):
    vectorizer = topics.fit_vectorizer(corpus, 3, words="document")
    assert vectorizer.vocabulary == ["bird", "cat", "dog", "join", "row", "table"]
    fixed = topics.fix_rows(topics.vectorize(vectorizer, corpus))
    fitted = topics.fit_topics(fixed, 2, optimizer, iterations=30, seed=3)
    rows = topics.distributions(fitted).collect()
    assert {r.id for r in rows} == {i * 10 for i in range(40)}
    assert all(abs(sum(r.weights) - 1) < 1e-6 for r in rows)
    if optimizer == "em":
        winner = {r.id: max(range(2), key=lambda t: r.weights[t]) for r in rows}
        assert len({winner[i * 10] for i in range(0, 40, 2)}) == 1
        assert len({winner[i * 10] for i in range(1, 40, 2)}) == 1
        assert winner[0] != winner[10]
    named = topics.topic_terms(fitted.model, vectorizer, 3)
    assert named.count() == 6 and set(named.columns) == {"topic", "rank", "term", "weight"}


def test_sweep_saves_reports_and_measures(spark, corpus, tmp_path):
    base = str(tmp_path)
    runs = list(
        model_corpus(corpus, "T", base, range(2, 4), iterations=5, terms_per_topic=3,
                     documents_per_topic=2, domain_words=("row",), seed=1)
    )
    assert [r.fitted.k for r in runs] == [2, 3]
    assert sorted(p.name for p in tmp_path.iterdir()) == [
        "ldaModel-T-2", "ldaModel-T-3", "vectorizer-T-2", "vectorizer-T-3",
    ]
    for run in runs:
        stats = run.statistics.first()
        assert (stats.corpus, stats.documents, stats.terms) == ("T", 41, 5)
        assert stats.alpha == pytest.approx(50 / stats.k + 1) and stats.beta == 1.01
        kinds = run.report.groupBy("kind").count().collect()
        assert {r.kind: r["count"] for r in kinds} == {"term": 3 * stats.k, "document": 2 * stats.k}
        model = topics.load_model(base, "T", stats.k)
        assert model.describeTopics(3).count() == stats.k
    assert topics.load_vectorizer(base, "T", 2).vocabulary == ["bird", "cat", "dog", "join", "table"]
    found = sweep_metrics(corpus, "T", base, (2, 3))
    assert found.count() == 5
    assert {r.documents for r in found.collect()} == {40}
    assert found.filter(F.col("view_share").isNull()).count() == 0
    assert found.filter(F.col("favorite_share").isNotNull()).count() == 0


def test_sweep_of_topic_counts(corpus):
    vectorizer = topics.fit_vectorizer(corpus, 3, words="document")
    fixed = topics.fix_rows(topics.vectorize(vectorizer, corpus))
    ks = [m.k for m in topics.topic_sweep(fixed, 2, 4, 1, optimizer="online", iterations=1)]
    assert ks == [2, 3, 4]


def fitted_on(corpus, optimizer="em", k=2):
    vectorizer = topics.fit_vectorizer(corpus, 3, words="document")
    fixed = topics.fix_rows(topics.vectorize(vectorizer, corpus))
    return vectorizer, topics.fit_topics(fixed, k, optimizer, iterations=20, seed=3)


def test_foreign_model_layout_infers_weights(spark, corpus, tmp_path):
    """A model whose graph is not where it is looked for, or looks different."""
    _, fitted = fitted_on(corpus)
    path = topics.save_model(fitted, str(tmp_path), "F")
    saved = {r.id: r.weights for r in topics.saved_distributions(spark, path).collect()}
    data = Path(topics.current_version(spark, path)) / "model/oldModel/data"
    spark.read.parquet(str(data / "topicCounts")).withColumnRenamed("id", "vertex").write.parquet(
        str(data / "other")
    )
    # the model itself is read from its own files, so only the graph's columns are changed here
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(topics, "_vertices", lambda *_: None)
        with pytest.raises(ValueError):
            topics.saved_distributions(spark, path)
        found = topics.saved_distributions(spark, path, lambda: fitted.vectors).collect()
    assert {r.id for r in found} == set(saved)
    assert all(abs(sum(r.weights) - 1) < 1e-6 for r in found)
    agree = [
        max(range(2), key=lambda t: r.weights[t]) == max(range(2), key=lambda t: saved[r.id][t]) for r in found
    ]
    assert all(agree)


def test_layout_is_checked(spark, tmp_path):
    assert topics._vertices(spark, str(tmp_path / "none")) is None
    spark.range(3).write.parquet(str(tmp_path / "model/oldModel/data/topicCounts"))
    assert topics._vertices(spark, str(tmp_path)) is None


@pytest.mark.parametrize("optimizer", ["em", "online"])
def test_heaviest_terms_are_those_the_model_describes(corpus, optimizer):
    vectorizer, fitted = fitted_on(corpus, optimizer)
    terms = topics.vocabulary_table(corpus.sparkSession, vectorizer)
    shares = topics.term_shares(fitted, terms)
    assert shares.count() == 6
    sums = shares.select(F.posexplode("shares")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    assert len(sums) == 2 and all(abs(r.s - 1) < 1e-9 for r in sums)

    def listed(rows):
        return {(r.topic, r.rank): r.weight for r in rows.collect()}

    mine, theirs = listed(topics.heaviest_terms(shares, 4)), listed(topics.topic_terms(fitted.model, vectorizer, 4))
    assert mine.keys() == theirs.keys() and len(mine) == 8
    assert all(abs(mine[x] - theirs[x]) < 1e-9 for x in mine)


def test_heaviest_terms_are_cut_before_the_shuffle(spark):
    shares = spark.createDataFrame([(0, "a", [0.1, 0.9])], "termIndex INT, term STRING, shares ARRAY<DOUBLE>")
    plan = topics.heaviest_terms(shares, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_online_over_em_leaves_no_row_table(spark, corpus, tmp_path):
    _, em = fitted_on(corpus)
    _, online = fitted_on(corpus, "online")
    path = topics.save_model(em, str(tmp_path), "R")
    assert (Path(topics.current_version(spark, path)) / "documents").exists()
    assert topics.save_model(online, str(tmp_path), "R") == path
    assert not (Path(topics.current_version(spark, path)) / "documents").exists()
    assert topics.load_model(str(tmp_path), "R", 2, "online").vocabSize() == 6


def test_failure_between_model_and_rows_keeps_the_old_model(spark, corpus, tmp_path):
    _, first = fitted_on(corpus)
    path = topics.save_model(first, str(tmp_path), "S")
    before = {r.id: r.weights for r in topics.saved_distributions(spark, path).collect()}
    lost = corpus.select(F.col("id").alias("row"), F.raise_error(F.lit("lost")).alias("id"))
    broken = replace(first, documents=lost)
    with pytest.raises(Exception, match="lost"):
        topics.save_model(broken, str(tmp_path), "S")
    after = {r.id: r.weights for r in topics.saved_distributions(spark, path).collect()}
    assert after == before


def test_sweep_joins_and_reads_the_corpus_once(spark, corpus, tmp_path):
    at_rest = str(tmp_path / "corpus")
    corpus.write.parquet(at_rest)
    corpus = spark.read.parquet(at_rest)
    for k in (2, 3, 4):
        _, fitted = fitted_on(corpus, k=k)
        topics.save_model(fitted, str(tmp_path), "W")
    found = sweep_metrics(corpus, "W", str(tmp_path), (2, 3, 4))
    assert found.count() == 9
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # one join with the corpus, and one aggregation by k and topic
    assert plan.count("Join LeftOuter") == 1
    assert sum("Aggregate [k#" in line for line in plan.splitlines()) == 1
    one = sweep_metrics(corpus, "W", str(tmp_path), (3,)).collect()
    assert {tuple(r) for r in one} <= {tuple(r) for r in found.collect()}
