import zlib
from collections import defaultdict

from threadmine.llm import sharding


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, size string, shard int")


def check(rows, got, shards, largest):
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(
        (k is None, k or 0) for k, *_ in rows
    )
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    total = sum(len((t or "").encode()) + 1 for _, t, *_ in rows)
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        held = sum(r.size for r in own)
        assert abs(held - total / shards) <= 2 * sharding.SLACK * total / shards + 2 * largest


def test_even_bytes_with_a_hot_text(spark):
    rows = [(i, "copy " * 40, None, 1) for i in range(700)]
    rows += [(1000 + i, f"text {i} " + "é" * (i % 50), "x", 2) for i in range(1400)]
    rows += [(None, None, None, None)] * 3 + [(5000, "", None, None)]
    got = sharding.shard_documents(documents(spark, rows), ranges=64).collect()
    check(rows, got, 16, 201)
    sizes = {k: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, *_ in rows}
    assert all((r.size, r.text_crc32) == sizes[r.doc_id] for r in got)


def test_small_groups_stay_together(spark):
    rows = [(i, f"passage {i % 400} " * 9, None, None) for i in range(8000)]
    got = sharding.shard_documents(documents(spark, rows)).collect()
    check(rows, got, 16, 150)
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32].add(r.shard)
    split = sum(len(s) > 1 for s in homes.values())
    # a group is 1/25 of a shard: only those at a cut, and not all of them, are split
    assert split <= 15


def test_one_long_text_few_rows_none(spark):
    rows = [(1, "x" * 100_000, None, None), (2, "y", None, None)]
    got = sharding.shard_documents(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == [1, 2]
    empty = sharding.shard_documents(documents(spark, []))
    assert empty.count() == 0 and "grown_shard" in empty.columns


def test_same_rows_again(spark):
    rows = [(7, "same", None, None)] * 300
    got = sharding.shard_documents(documents(spark, rows)).collect()
    check(rows, got, 16, 5)
