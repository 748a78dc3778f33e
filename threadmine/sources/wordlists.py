"""Stop-word lists: one word per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed words of a text file as a ``word`` column; blank lines are dropped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("word"))
    return lines.filter(F.length("word") > 0).distinct()
