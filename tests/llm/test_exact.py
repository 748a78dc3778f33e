import hashlib
import re

import pytest

from threadmine.llm import exact


def by_brute_force(rows):
    groups = {}
    for place, (key, text) in enumerate(rows):
        normal = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(normal, []).append((-len(text or ""), key is None, key or 0, key, place))
    want = []
    for normal, own in groups.items():
        best = min(own, key=lambda r: r[:3])
        taken = False
        for r in own:
            kept = not taken and r[:3] == best[:3]
            taken |= kept
            want.append((r[3], best[3], len(own), kept, hashlib.sha256(normal.encode()).hexdigest()))
    return want


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


ROWS = (
    [(1000 - i, "hot text\n" if i % 3 else "hot  text") for i in range(300)]
    + [(2000 + i, f"text {i % 40} \té 😀") for i in range(200)]
    + [(5, None), (4, ""), (6, " \t\n\x0b\x0c\r"), (None, "x y"), (None, "xy"), (7, "x  y")]
    + [(8, "same"), (8, "same"), (8, "sa me"), (None, "lone"), (None, "lone")]
    + [(9, "long " * 30_000), (10, "long" * 30_000), (11, " a"), (12, "a")]
)


@pytest.mark.parametrize("run_rows, parts", [(7, 3), (1 << 16, 40), (1 << 16, 1)])
def test_equals_brute_force(spark, run_rows, parts):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(parts)
    got = exact.grouped(docs, run_rows=run_rows).selectExpr(
        "doc_id", "keep_id", "group_size", "kept", "lower(hex(digest)) AS sha"
    )
    assert in_order(got.collect()) == in_order(by_brute_force(ROWS))


def test_rows_that_stay_with_clashing_columns(spark):
    rows = [(1, "a b", "p", 1), (2, "ab", "q", 2), (3, "c", "r", 3), (3, "c", "r", 3), (None, None, "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, best int")
    kept = exact.without_copies(docs)
    assert kept.columns == docs.columns
    assert in_order(kept.collect()) == in_order([rows[0], rows[2], rows[4]])


def test_empty_table_and_schema(spark):
    got = exact.duplicate_report(spark.createDataFrame([], "text string, doc_id int"))
    assert got.count() == 0
    assert dict(got.dtypes) == {
        "doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean",
        "text_sha256": "string",
    }


def test_no_merge_takes_a_group_together(spark):
    """With all texts equal a task of the first round gets at most two entries a digest, and
    rows find their group next to those of one other run only."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "'same' AS text").repartition(20)
    rows = exact.digests(docs)
    number, count = exact._run_numbers(rows, 100)
    assert count >= 40
    per_key = rows.withColumn("run", number).selectExpr("run div 2 AS up").groupBy("up").count()
    assert per_key.agg({"count": "max"}).first()[0] <= 2 * 100


def test_built_in_functions_only(spark):
    docs = spark.createDataFrame(ROWS[:50], "doc_id long, text string")
    plan = exact.duplicate_report(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
