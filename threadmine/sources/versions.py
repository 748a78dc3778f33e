"""Folders that are replaced as a whole: a reader sees the old content or the new one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

VERSIONS = "versions"


def _listed(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    try:
        rows = spark.read.schema("number BIGINT, folder STRING").parquet(f"{path}/{VERSIONS}")
        return sorted((r.number, r.folder) for r in rows.collect())  # one row per save
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def current_version(spark: SparkSession, path: str) -> str:
    """Folder of the version that was completed last; ``path`` itself if it has no versions."""
    found = _listed(spark, path)
    return f"{path}/{found[-1][1]}" if found else path


def save_version(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a new folder, then make it the current version; returns the folder.

    The list of versions is appended to last, by one file that appears as a whole, so a failure
    in between leaves the version before it current. Then all versions but this one and the one
    before, which readers may have open, are deleted. For one writer at a time.
    """
    found = _listed(spark, path)
    folder = f"v-{uuid.uuid4().hex}"
    write(f"{path}/{folder}")
    number = found[-1][0] + 1 if found else 1
    entry = spark.createDataFrame([(number, folder)], "number BIGINT, folder STRING")
    entry.coalesce(1).write.mode("append").parquet(f"{path}/{VERSIONS}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for _, old in found[:-1]:
        gone = hadoop(f"{path}/{old}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return f"{path}/{folder}"
