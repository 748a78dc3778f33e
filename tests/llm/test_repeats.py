import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadmine.llm import repeats


def brute(rows, window):
    raws = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(r[i : i + window] for _, r in raws for i in range(len(r) - window + 1))
    out = []
    for key, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - window + 1):
            if seen[raw[i : i + window]] > 1:
                gone[i : i + window] = True
        gone = gone[: len(raw)]
        spans = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((key, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def corpus():
    rng = random.Random(4)

    def prose(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    shared = [prose(n) for n in (150, 199, 200, 201, 260, 400, 900)]
    rows = [(i, prose(rng.randrange(0, 900))) for i in range(25)]
    for i in range(60):
        parts = [prose(rng.randrange(0, 200)), rng.choice(shared), prose(rng.randrange(0, 150))]
        if i % 3 == 0:
            parts.append(rng.choice(shared)[rng.randrange(60) :])
        rows.append((100 + i, "".join(parts)))
    base = prose(3000)
    for i in range(8):
        at = rng.randrange(2900)
        rows.append((300 + i, base[:at] + "#" + base[at + 1 :]))
    rows += [(400, "a" * 199), (401, "z" * 200), (402, "y" * 201), (403, "y" * 150), (404, None)]
    rows += [(405, ""), (406, "ab" * 300), (None, prose(300)), (407, shared[4]), (407, shared[4])]
    rows += [(500, prose(70_000) + shared[5]), (501, ("xyz" * 30_000))]
    return rows


def test_report_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, start int, digest string")
    got = Counter(tuple(r) for r in repeats.removal_report(docs).collect())
    assert got == brute(rows, 200)


@pytest.mark.parametrize("least", [0, 8])
def test_hot_anchors_change_nothing(spark, monkeypatch, least):
    monkeypatch.setattr(repeats, "DRAWN", 1)
    monkeypatch.setattr(repeats, "HOT_RUNS", least)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in repeats.removal_report(docs).collect()) == brute(rows, 200)


def test_texts_without_repeats(spark):
    rows = [(1, "é" * 150 + "tail one"), (2, "head" + "é" * 150), (3, "short"), (4, None)]
    docs = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, digest int")
    out = repeats.without_repeats(docs)
    assert out.schema == docs.schema
    assert {r.doc_id: r.text for r in out.collect()} == {1: "tail one", 2: "head", 3: "short", 4: None}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.removal_report(docs).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", min_size=30, max_size=60), min_size=1, max_size=6))
def test_radix_groups_are_the_repeated_windows(texts):
    contexts = [t.encode() for t in texts]
    counts = np.array([len(c) - 29 for c in contexts])
    # one key for all windows, whatever their place
    flags = np.concatenate(
        [
            repeats.repeated_windows(
                [c[i : i + 30] for c in contexts for i in range(len(c) - 29)],
                np.zeros(counts.sum(), np.int64), np.ones(counts.sum(), np.int64), 30,
            )
        ]
    )
    windows = [c[i : i + 30] for c in contexts for i in range(len(c) - 29)]
    seen = Counter(windows)
    assert flags.tolist() == [seen[w] > 1 for w in windows]
