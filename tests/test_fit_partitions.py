import pytest
from pyspark.ml.linalg import Vectors

from threadmine.operators import topics


@pytest.fixture
def fixed(spark, monkeypatch):
    monkeypatch.setattr(topics, "PART_CELLS", 20)
    rows = [(i, Vectors.sparse(30, sorted([i % 30, (i + 7) % 30]), [1.0, 2.0])) for i in range(90)]
    rows += [(None, Vectors.sparse(30, [], [])), (91, Vectors.dense([1.0] * 30)), (91, Vectors.dense([1.0] * 30))]
    return topics.fix_rows(spark.createDataFrame(rows, ["id", "features"]).coalesce(1))


def test_rows_of_one_file_are_cut_by_their_cells(fixed):
    parts = fixed.rdd.glom().collect()
    assert len(parts) == 12  # 240 cells
    assert max(len(p) for p in parts) <= 10
    ids = [r.id for p in parts for r in p]
    assert sorted(i for i in ids if i is not None) == [*range(90), 91, 91] and ids.count(None) == 1


def test_rows_without_cells(spark):
    empty = spark.createDataFrame([(1, Vectors.sparse(3, [], []))], ["id", "features"])
    assert topics.fix_rows(empty).count() == 1
    assert topics.fix_rows(empty.limit(0)).count() == 0


def test_saved_graph_is_read_in_small_splits(spark, fixed, tmp_path, monkeypatch):
    fitted = topics.fit_topics(fixed, 3, "em", iterations=2, seed=1)
    path = topics.save_model(fitted, str(tmp_path), "x")
    name, context = "spark.sql.files.maxPartitionBytes", spark.sparkContext
    before = spark.conf.get(name)
    monkeypatch.setattr(topics, "PART_BYTES", 1000)
    read = topics.read_model(spark, path)
    assert spark.conf.get(name) == before
    context.setJobGroup("described", "")
    try:
        assert read.describeTopics(2).count() == 3
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("described") for s in tracker.getJobInfo(j).stageIds]
    tasks = [found.numTasks for found in map(tracker.getStageInfo, stages) if found]
    assert max(tasks) >= 12  # one for each file of the graph at least
