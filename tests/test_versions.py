import pytest

from threadmine.sources.versions import current_version, save_version


def write(spark, value):
    return lambda folder: spark.range(value).write.parquet(f"{folder}/data")


def rows(spark, path):
    return spark.read.parquet(f"{current_version(spark, path)}/data").count()


def test_the_last_complete_version_is_current(spark, tmp_path):
    path = str(tmp_path / "thing")
    assert current_version(spark, path) == path
    save_version(spark, path, write(spark, 3))
    assert rows(spark, path) == 3
    old = current_version(spark, path)

    def broken(folder):
        write(spark, 9)(folder)
        raise OSError("lost")

    with pytest.raises(OSError):
        save_version(spark, path, broken)
    assert current_version(spark, path) == old and rows(spark, path) == 3
    save_version(spark, path, write(spark, 5))
    assert rows(spark, path) == 5
    # a reader that has the version before open still finds it; older ones go
    assert spark.read.parquet(f"{old}/data").count() == 3
    save_version(spark, path, write(spark, 6))
    assert rows(spark, path) == 6 and not (tmp_path / "thing" / old.rsplit("/", 1)[1]).exists()
