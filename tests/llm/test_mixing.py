import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threadmine.llm import mixing


def corpus():
    rows = []
    for source, n in (("big", 900), ("mid", 150), ("small", 40), (None, 25)):
        for i in range(n):
            rows.append((len(rows), "word " * (1 + i * 7 % 30), source, "x"))
    rows += [(9000, None, "empty", "x"), (9001, "", "empty", None), (9002, " \n", "empty", "y")]
    rows += [(42_000, "same words", "mid", "z")] * 3
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, weight string")


def tokens(rows):
    out = Counter()
    for _, text, source, _ in rows:
        out[source] += len((text or "").split())
    return out


def brute_exponent(totals, repetitions):
    total = sum(totals.values())
    shares = [t / total for t in totals.values() if t]
    low, high = 0.0, 1.0
    for _ in range(60):
        x = (low + high) / 2
        z = sum(p**x for p in shares)
        low, high = (x, high) if max(p ** (x - 1) for p in shares) / z > repetitions else (low, x)
    return high


def test_weights_budget_and_passes(spark):
    rows = corpus()
    got = mixing.mix(frame(spark, rows), repetitions=1.5).collect()
    totals, total = tokens(rows), sum(tokens(rows).values())
    x = brute_exponent(totals, 1.5)
    z = sum((t / total) ** x for t in totals.values() if t)
    read, times = Counter(), defaultdict(set)
    for r in got:
        read[r.source] += len((r.text or "").split())
        times[r.doc_id].add(r.mixing_pass)
        want = (totals[r.source] / total) ** x / z if totals[r.source] else 0.0
        assert abs(r.mixing_weight - want) < 1e-6
    for source, t in totals.items():
        if t:
            quota = (t / total) ** x / z * total
            assert quota - 35 <= read[source] <= quota + 1
    assert all(sorted(p) == list(range(len(p))) for p in times.values())
    assert times[9000] == times[9001] == times[9002] == {0}
    assert len({len(times[r[0]]) for r in rows if r[2] == "small"}) <= 2
    # the same rows are drawn together
    assert len({n for k, n in Counter(r.doc_id for r in got).items() if k == 42_000}) == 1


def test_the_last_pass_is_a_prefix_of_its_permutation(spark):
    docs = frame(spark, corpus())
    got = mixing.mix(docs, repetitions=1.5).collect()
    totals = tokens(corpus())
    x, total = brute_exponent(totals, 1.5), sum(totals.values())
    z = sum((t / total) ** x for t in totals.values() if t)
    # Every row's place in the second pass, drawn or not.
    row = F.xxhash64(*docs.columns)
    block = F.pmod(F.xxhash64(F.lit(mixing.SEED), row), F.lit(mixing.BLOCKS))
    order = [F.xxhash64(block, F.lit(1), F.lit(mixing.SEED)), block, F.xxhash64(row, F.lit(1)), row]
    for source in ("small", "mid"):
        second = Counter(r.doc_id for r in got if r.source == source and r.mixing_pass == 1)
        rest = (totals[source] / total) ** x / z * total - totals[source]
        assert 0 < rest < totals[source]
        spent, taken = 0, Counter()
        rows = docs.filter(F.col("source") == source).select("doc_id", "text", row.alias("row"), *[
            o.alias(f"o{i}") for i, o in enumerate(order)
        ]).orderBy("o0", "o1", "o2", "o3").collect()
        for key in dict.fromkeys(r.row for r in rows):
            same = [r for r in rows if r.row == key]
            spent += sum(len((r.text or "").split()) for r in same)
            if spent > rest:
                break
            taken.update(r.doc_id for r in same)
        assert second == taken


def test_columns_with_the_names_of_the_new_ones(spark):
    docs = frame(spark, corpus()).selectExpr(
        "*", "1 as mixing_weight", "source as Mixing_source", "2 as mixing_row", "3 as `a.b`"
    )
    out = mixing.mix(docs, repetitions=1.5)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert out.columns[-1] == "mixing_mixing_rank" and len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert {(r.mixing_weight, r.mixing_row, r["a.b"]) for r in rows} == {(1, 2, 3)}
    assert all(r.Mixing_source == r.source for r in rows)
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_cover_keeps_every_row(spark):
    rows = corpus()
    docs = frame(spark, rows)
    out = mixing.mixed_documents(docs, budget="cover")
    assert out.schema == docs.schema
    counts = Counter(r.doc_id for r in out.collect())
    assert set(counts) == {r[0] for r in rows}
    assert counts[0] == 1


def test_target_entropy(spark):
    totals = spark.createDataFrame([("a", 900, 1000.0), ("b", 90, 1000.0), ("c", 10, 1000.0)], "mixing_source string, tokens long, all double")
    x = mixing.bisect_exponent(totals, entropy=0.8)
    powers = [p**x for p in (0.9, 0.09, 0.01)]
    entropy = -sum(p / sum(powers) * math.log(p / sum(powers)) for p in powers)
    assert abs(entropy - 0.8) < 1e-5
    assert mixing.bisect_exponent(totals, entropy=9.0) == 0.0
    assert mixing.bisect_exponent(totals, entropy=0.0) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        mixing.bisect_exponent(totals)


def test_empty_table(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [(1, None, None, None)])).count() == 1
