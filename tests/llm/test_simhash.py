import random
import re

import numpy as np
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from threadmine.llm import simhash
from threadmine.llm.components import connected_components


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows):
    marks = [(k, plain_fingerprint(t)) for k, t in rows]
    up = list(range(len(marks)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i][1] ^ marks[j][1]).bit_count() <= 4:
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(marks):
        least[root(i)] = min(least.get(root(i), k), k)
    return {(k, f"{m:016x}", least[root(i)]) for i, (k, m) in enumerate(marks)}


def texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "ΓAMMA", "delta,", "x", "y\x1cz", "é"]
    out = ["", " \t\n", "one", "ONE", "one two", "a b c d", "A B C D", "a  b\nc\td"]
    base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(400)]
    for i in range(60):
        own = list(base)
        for _ in range(i % 7):
            own[rng.randrange(400)] = "changed"
        out.append(" ".join(own))
    out += [" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(80)]
    return out + out[:20]


def test_components_of_texts(spark):
    rows = [(100 - i if i % 2 else 1000 + i, t) for i, t in enumerate(texts())]
    rows = list(dict(rows).items())
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, bits int, key string")
    got = {tuple(r) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_links_join_all_that_are_close(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    bits = set()
    for s in seeds:
        for _ in range(150):
            x = s
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            bits.add(x)
    bits = sorted(bits)
    signed = np.array(bits, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(b,) for b in signed], "bits long")
    index = {b: i for i, b in enumerate(signed)}

    def classes(pairs):
        up = list(range(len(bits)))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for i, j in pairs:
            up[root(i)] = root(j)
        return [root(i) for i in range(len(bits))]

    def same(a, b):
        return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))

    close = [(i, j) for i in range(len(bits)) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 4]
    want = classes(close)
    for block in (16, 2048):
        edges = [(index[r.a], index[r.b]) for r in simhash.links(frame, block).collect()]
        assert all((bits[i] ^ bits[j]).bit_count() <= 4 for i, j in edges)
        assert same(classes(edges), want)


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_some_chain_keeps_its_budgets(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    differing = np.array([x ^ y], np.uint64)
    assert any(simhash.within_budgets(differing, s)[0] for s in range(5))


def test_one_of_each_group_stays(spark):
    rows = [(3, "same text here", 1), (2, "same text here", 2), (2, "same text here", 2),
            (9, "quite another thing to read", 3), (None, "same text here", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 9]


def test_empty_and_null(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = simhash.near_duplicates(spark.createDataFrame([(None, None), (None, "")], schema)).collect()
    assert [tuple(r) for r in got] == [(None, "0" * 16, None)] * 2


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(5, 5), (8, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert set(got) == {*range(100, 141), *range(7, 60)}
    assert len({got[i] for i in range(100, 141)}) == len({got[i] for i in range(7, 60)}) == 1
    assert got[100] in range(100, 141) and got[7] in range(7, 60)


def test_one_id_with_several_texts(spark):
    rows = [(5, "alpha beta gamma delta"), (5, "other words stand here now"), (6, "alpha beta gamma delta"),
            (7, "other words stand here now"), (5, "alpha beta gamma delta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.without_near_duplicates(docs).collect()
    assert sorted(tuple(r) for r in kept) == sorted({rows[0], rows[1]})
