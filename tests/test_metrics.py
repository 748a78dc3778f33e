import math

import pytest
from pyspark.sql import functions as F

from threadmine.functions import weights
from threadmine.operators import metrics, reports

TD = [(1, [0.4, 0.4, 0.2]), (2, [0.1, 0.9, 0.0]), (3, [0.0, 0.0, 0.0])]
CORPUS = [
    (1, -2, 100, "one", 1, None, 5), (2, 4, None, "two", 2, 3, None), (9, 8, 900, "nine", 1, 1, 1),
]


@pytest.fixture(scope="module")
def td(spark):
    return spark.createDataFrame(TD, "id BIGINT, weights ARRAY<DOUBLE>")


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(
        CORPUS,
        "id BIGINT, score INT, viewCount INT, title STRING, answerCount INT, commentCount INT,"
        " favoriteCount INT",
    )


def by_topic(df):
    return {r.topic: r for r in df.collect()}


def values(df, column):
    return [r.v for r in df.select(column.alias("v"), "id").orderBy("id").collect()]


def test_matrices(td):
    assert values(td, weights.dominant_weights("weights")) == [
        [0.4, 0.4, 0.0], [0.0, 0.9, 0.0], [0.0, 0.0, 0.0],
    ]
    assert values(td, weights.dominant_flags("weights")) == [[1, 1, 0], [0, 1, 0], [1, 1, 1]]
    assert values(td, weights.weights_from("weights"))[1] == [0.1, 0.9, 0.0]
    assert values(td, weights.weights_from("weights", 0.3))[0] == [0.4, 0.4, 0.0]
    assert values(td, weights.weighted_metric("weights", F.lit(10)))[1] == [1.0, 9.0, 0.0]
    assert values(td, weights.weighted_metric("weights", F.lit(None).cast("int")))[1] == [0.0] * 3
    assert values(td, weights.entropy_terms("weights"))[1] == pytest.approx(
        [-0.1, 0.9 * math.log10(0.9), 0.0]
    )


def test_spread_and_rows(td):
    wide = weights.spread_topics(td, "weights", 3)
    assert wide.columns == ["id", "Topic 1", "Topic 2", "Topic 3"]
    rows = weights.topic_rows(td)
    assert rows.count() == 9
    back = weights.topic_arrays(rows)
    assert back.exceptAll(td).count() == 0


def test_model_metrics_with_ties(td):
    got = by_topic(metrics.model_metrics(td))
    assert [got[t].nddt for t in (1, 2, 3)] == [2, 3, 1]
    assert [got[t].impact for t in (1, 2, 3)] == pytest.approx([0.5, 1.3, 0.2])
    assert got[2].pddt == pytest.approx(1.0) and got[1].share == pytest.approx(0.5 / 3)
    assert got[3].entropy == pytest.approx(-0.2 * math.log10(0.2))
    single = by_topic(metrics.model_metrics(td, single_winner=True))
    assert [single[t].nddt for t in (1, 2, 3)] == [2, 1, 0]


def test_engagement_shares(td, corpus):
    got = by_topic(metrics.topic_metrics(td, corpus))
    assert got[1].documents == 3
    assert got[1].view_share == pytest.approx(0.4 * 100 / 1000)
    assert got[2].score_share == pytest.approx((0.4 * -2 + 0.9 * 4) / 10)
    assert got[2].comment_share == pytest.approx(0.9 * 3 / 4)
    assert got[2].favorite_share == pytest.approx(0.4 * 5 / 6)
    assert got[3].answer_sum == pytest.approx(0.2)


def test_zero_totals_give_null(td, corpus):
    none = corpus.withColumn("viewCount", F.lit(None).cast("int")).withColumn("score", F.lit(0))
    got = by_topic(metrics.topic_metrics(td, none))
    assert got[1].view_share is None and got[1].score_share is None


def test_totals_and_wide(td, corpus):
    assert tuple(metrics.corpus_totals(corpus).first()) == ("Spark", 3, 4, 4, 1000, 6, 10)
    found = metrics.topic_metrics(td, corpus)
    row = metrics.wide_metric(found, "pddt", 3).first()
    assert row.asDict() == pytest.approx({"D(T1)": 2 / 3, "D(T2)": 1.0, "D(T3)": 1 / 3})


def test_order_and_partitions_do_not_matter(spark):
    rows = spark.range(500).select(
        "id", F.transform(F.sequence(F.lit(1), F.lit(6)),
                          lambda t: F.abs(F.hash("id", t)) % 1000 + 1.0).alias("w"))
    td = rows.select("id", F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda a, b: a + b)).alias("weights"))
    one = by_topic(metrics.model_metrics(td.coalesce(1)))
    many = by_topic(metrics.model_metrics(td.repartitionByRange(7, F.desc("id"))))
    assert sum(r.nddt for r in one.values()) >= 500
    for t, r in one.items():
        assert r.nddt == many[t].nddt and r.impact == pytest.approx(many[t].impact)
        assert r.impact <= r.documents and r.pddt == r.nddt / r.documents


def test_one_shuffle_of_pre_aggregated_rows(td, corpus):
    plan = metrics.model_metrics(td)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2


def test_top_documents_are_cut_before_the_shuffle(td):
    top = reports.top_documents(td, 1)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert {(r.topic, r.id) for r in top.collect()} == {(1, 1), (2, 2), (3, 1)}


def test_reports(spark, td, corpus):
    top = reports.with_titles(reports.top_documents(td, 2), corpus)
    assert top.count() == 6
    terms = spark.createDataFrame(
        [(t, r, f"w{t}{r}", 0.1234 / r) for t in (1, 2, 3) for r in (1, 2)],
        "topic INT, rank INT, term STRING, weight DOUBLE",
    )
    rows = reports.report_rows(terms, top)
    wide = reports.horizontal_report(rows, 3).collect()
    assert [(r.kind, r["rank"]) for r in wide] == [
        ("term", 1), ("term", 2), ("document", 1), ("document", 2),
    ]
    assert wide[0]["TOPIC 1"] == "w11 (0.123)"
    assert wide[2]["TOPIC 2"] == "2 : two : 0.9000"
    lines = [r.line for r in reports.vertical_report(rows).collect()]
    assert lines[:4] == ["w11 (0.123)", "w12 (0.062)", "0.4000 : 1 : one", "0.1000 : 2 : two"]
    assert reports.report_rows(terms).count() == 6
