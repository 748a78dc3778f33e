import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadmine.llm import negatives


def by_brute_force(rows, scale=256, positives=5, wanted=5, least=80):
    own = []
    for place, (key, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own.append((key, [math.floor(scale * x) for x in vector], label, place))

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for key, vector, label, place in own:
        if key is None or key % 100:
            continue
        scored = [(-dot(vector, v), k is None, k or 0, k, m) for k, v, m, p in own if p != place]
        best = sorted((x for x in scored if x[4] == label), key=lambda x: x[:3])[:positives]
        for p in best:
            inside = [x for x in scored if x[4] != label and least * -p[0] <= 100 * -x[0] <= 100 * -p[0]]
            for rank, n in enumerate(sorted(inside, key=lambda x: x[:3])[:wanted], 1):
                out.append((key, p[3], rank, n[3], -p[0], -n[0]))
    return sorted(out, key=repr)


def found(spark, rows, **settings):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = negatives.hard_negatives(table, F.col("id") % 100 == 0, **settings)
    assert got.columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    ]
    return sorted(map(tuple, got.collect()), key=repr)


def vectors(n, width, seed):
    rng = random.Random(seed)
    return [
        (i, [round(rng.uniform(-1, 1), 2) for _ in range(width)], rng.randrange(3)) for i in range(n)
    ]


@pytest.mark.parametrize("group, shelf", [(2, 40), (4096, 1024)])
def test_equals_brute_force(spark, monkeypatch, group, shelf):
    monkeypatch.setattr(negatives, "TILE", (3, 17))
    # scores in steps, so that there are many ties
    rows = [(k, [round(x) / 256 for x in v], m) for k, v, m in vectors(900, 7, 4)]
    rows += [(1000 + i, [0.5] * 7, i % 3) for i in range(30)]
    want = by_brute_force(rows)
    assert len(want) > 100
    assert found(spark, rows, group=group, shelf=shelf) == want


def test_rows_that_take_no_part_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 1.0], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.9], 2), (3, [1.0], 2), (4, [], 1),
        (5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 2), (8, [inf, 1.0], 2),
        (9, [1.0, 1.0], None), (None, [1.0, 0.5], 1), (None, [0.5, 0.5], 2),
        (100, [-1.0, -1.0], 1), (200, [0.0, 0.0], 2), (200, [0.0, 0.0], 2), (300, None, 1),
        (2, [1.0, 0.9], 2), (-100, [0.3, 0.1, 4.0], 2),
    ]
    rows = [(k, v and [np.float32(x).item() if x is not None else None for x in v], m) for k, v, m in rows]
    want = by_brute_force([(k, None if v is None else v + [0.0] * (3 - len(v)), m) for k, v, m in rows])
    assert want and found(spark, rows) == want


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert found(spark, [(0, [1.0], 1)]) == []


def test_clashing_columns(spark):
    rows = vectors(200, 4, 1)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    more = table.withColumns({c: F.lit("x") for c in ("place", "id", "vector", "score", "rank")})
    got = negatives.hard_negatives(more.drop("id"), F.col("id") % 100 == 0)
    assert sorted(map(tuple, got.collect()), key=repr) == found(spark, rows)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 70), st.integers(1, 70), st.integers(1, 70), st.integers(0, 2**31))
def test_strassen_is_exact(rows, inner, columns, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(-(1 << 40), 1 << 40, (rows, inner))
    b = rng.integers(-(1 << 15), 1 << 15, (inner, columns))
    assert (negatives.strassen(a, b, leaf=4) == a.astype(object) @ b.astype(object)).all()


def test_large_numbers_and_errors():
    a, b = np.array([[1 << 40, 3]] * 40), np.array([[1 << 40, 1], [1 << 20, -5]] * 20)
    with pytest.raises(ValueError):
        negatives.scores(a, b)
    small = b.copy()
    small[:, 0] = 1 << 20
    assert (negatives.scores(a, small) == a.astype(object) @ small.T.astype(object)).all()
    with pytest.raises(ValueError):
        negatives.scores(np.array([[1 << 62]]), np.array([[1]]))


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(5)
    n = 400
    entries = [rng.integers(0, 6, n), rng.integers(-4, 4, n), rng.integers(0, 2, n), rng.integers(0, 9, n),
               rng.permutation(n)]
    want = None
    for parts in (1, 2, 7):
        heaps = negatives.Heaps(6, 5)
        for own in np.array_split(rng.permutation(n), parts):
            heaps.merge(*[x[own] for x in entries])
        got = sorted(zip(*[x.tolist() for x in heaps.columns]))
        want = want or got
        assert got == want and len(got) == 30
