import random

import pytest

from threadmine.llm import components


def brute_force(edges):
    up = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        if a in up and b in up:
            up[root(a)] = root(b)
    groups = {}
    for n in up:
        groups.setdefault(root(n), set()).add(n)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("few", [0, 40, 1 << 20])
def test_components_equal_brute_force_however_they_end(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(few)
    edges = [(i, i + 1) for i in range(1000, 1060)]  # a path
    edges += [(5, i) for i in range(2000, 2100)]  # a hub
    edges += [(rng.randrange(300), rng.randrange(300)) for _ in range(120)]
    edges += [(7, 7), (None, 3), (9, None), (-4, 2**62), (2**62, -4), (1000, 1001)]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.component, set()).add(r.node)
    assert len({r.node for r in found}) == len(found)
    assert all(c in nodes for c, nodes in groups.items())
    assert sorted(map(sorted, groups.values())) == brute_force(edges)


def test_no_edges_no_components(spark):
    empty = spark.createDataFrame([(3, 3)], "a long, b long")
    assert components.connected_components(empty).count() == 0
