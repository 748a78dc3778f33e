"""Shared folders of a session: checkpoints and staged tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` decides, or else the checkpoint folder the session was given.
    Without either there is no folder that all executors are known to share: an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        return configured
    if context.getCheckpointDir() is None:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return context.getCheckpointDir()


def ensure_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` and checkpointed model fits usable."""
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
