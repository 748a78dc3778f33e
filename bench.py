"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

from checks.folders import own_folder
from checks.queries import REGISTERED
from threadmine.session import fresh_path

HEADLINE = (
    "top_question_terms",
    "posts_from_dump",
    "clean_documents",
    "document_tokens",
    "stems_of_terms",
    "question_corpus",
    "question_answer_corpus",
    "question_answer_terms_of_spread_documents",
    "top_terms",
    "document_frequency",
    "term_counts",
    "topic_metrics",
    "top_documents_with_titles",
    "horizontal_report",
    "em_topics",
    "online_topics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = tuple(filter(None, os.environ.get("BENCH_QUERIES", "").split(","))) or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("threadmine-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    own_folder(spark)
    # Not counted: the given tables have one row group each, so one task would read and do all
    # the work on it. Large tables have many.
    tables = fresh_path(spark, "bench")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        spark.read.parquet(str(path)).repartition(int(cpus)).write.parquet(f"{tables}/{path.name}")
    # One pass that is not counted: the first query would hold all of the warm-up.
    REGISTERED[names[0]](spark, tables).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.monotonic()
        REGISTERED[name](spark, tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.monotonic() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
