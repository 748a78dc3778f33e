"""The shared folder of sessions that were given none: tests, a laptop."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def own_folder(spark: SparkSession) -> None:
    """Give a local session without ``spark.checkpoint.dir`` a checkpoint folder of its own."""
    context = spark.sparkContext
    unset = not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir()
    if unset and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="threadmine-"))
