from types import SimpleNamespace

import pytest

from checks.folders import own_folder
from threadmine import session


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def stub(master, **settings):
    conf = SimpleNamespace(get=lambda key, default: settings.get("folder", default))
    return SimpleNamespace(conf=conf, sparkContext=Context(master))


def test_configured_folder_is_used():
    spark = stub("yarn", folder="hdfs://shared/tmp/")
    assert session.shared_dir(spark) == "hdfs://shared/tmp/"
    first, second = (session.fresh_path(spark, "x") for _ in range(2))
    assert first != second and first.startswith("hdfs://shared/tmp/x-")
    session.ensure_checkpoints(spark)
    assert spark.sparkContext.folder == "hdfs://shared/tmp/"


def test_no_folder_is_an_error():
    for master in ("local[2]", "yarn"):
        with pytest.raises(ValueError):
            session.shared_dir(stub(master))


def test_checks_make_a_folder_for_local_sessions_only():
    spark = stub("local[2]")
    own_folder(spark)
    folder = session.shared_dir(spark)
    own_folder(spark)
    assert folder and session.shared_dir(spark) == folder
    cluster = stub("yarn")
    own_folder(cluster)
    assert cluster.sparkContext.folder is None


def test_checkpoints_work(spark):
    session.ensure_checkpoints(spark)
    assert spark.range(3).checkpoint().count() == 3
