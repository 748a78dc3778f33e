"""Run queries next to their oracle SQL and compare the rows. ``python -m checks.compare DIR [NAME…]``"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.folders import own_folder
from checks.oracles import ORACLES
from checks.queries import REGISTERED


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(spark: SparkSession, sf_dir: str, name: str) -> str | None:
    """None when query and oracle agree on column names and rows."""
    df = REGISTERED[name](spark, sf_dir)
    mine = _rows(df.columns, df.collect())
    with duckdb.connect() as db:
        for path in Path(sf_dir).glob("*.parquet"):
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        found = db.execute(ORACLES[name])
        columns = [d[0] for d in found.description]
        theirs = _rows(columns, found.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} rows differ, first: {wrong[0]}"
    return None if mine else "no rows"


def main(sf_dir: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    own_folder(spark)
    bad = 0
    for name in names or REGISTERED:
        started = time.monotonic()
        if name in ORACLES:
            result = difference(spark, sf_dir, name)
        else:
            result = f"{REGISTERED[name](spark, sf_dir).count()} rows, no oracle"
        bad += name in ORACLES and result is not None
        print(f"{name}: {result or 'ok'} ({time.monotonic() - started:.1f} s)"[:600], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
