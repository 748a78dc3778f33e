"""The five stages over planted toxic texts, copies and shared passages, held against plain Python."""

import random

import pytest

import corpus_pipeline
from threadmine.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    words = [f"word{i}" for i in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows, toxic = [], set()
    for key in range(400):
        own = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        if key % 8 == 3:
            toxic.add(key)
            own[::6] = ["vile"] * len(own[::6])
        if key % 40 in (5, 6):
            own[10:10] = passage.split()
        rows.append([key, " ".join(own), "en", f"s{key % 3}"])
    for copy in range(20):
        rows.append([1000 + copy, rows[copy * 8][1], "en", "s0"])
    rows += [[2000, None, "en", "s1"], [2001, "", None, None]]
    return [(k, t, lang, s, len(t or "")) for k, t, lang, s in rows], toxic, passage


def classes(texts):
    prints = {k: simhash.fingerprint(t) for k, t in texts.items()}
    up = {k: k for k in prints}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {root(k) for k in keys}


def without_windows(texts, window=200):
    seen = {}
    for key, text in texts.items():
        raw = (text or "").encode()
        for at in range(len(raw) - window + 1):
            seen.setdefault(raw[at : at + window], []).append((key, at))
    cut = {key: bytearray(len((t or "").encode())) for key, t in texts.items()}
    for places in seen.values():
        if len(places) > 1:
            for key, at in places:
                cut[key][at : at + window] = b"\1" * window
    return {
        key: bytes(b for b, gone in zip((t or "").encode(), cut[key]) if not gone)
        for key, t in texts.items()
    }


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rows, toxic, passage = corpus()
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(
        [(r[0], 1, int(r[0] in toxic)) for r in rows if r[0] % 2 or r[0] < 200],
        "doc_id long, quality int, toxic int",
    ).write.parquet(str(folder / "labels.parquet"))
    docs, kept = spark.read.parquet(str(folder / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name.replace(" ", "-"))
        stage(spark, docs, str(folder)).write.parquet(path)
        docs = kept[name] = spark.read.parquet(path)
    return rows, toxic, passage, kept, str(folder)


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_every_stage(spark, stages):
    rows, toxic, passage, kept, _ = stages
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "SimHash near-dedup", "repeated windows", "mixing", "packing"]
    for name in names[:-1]:
        assert kept[name].columns == SCHEMA.replace(",", "").split()[::2], name

    first = texts_of(kept[names[0]])
    assert len(set(first) & toxic) <= 2
    clean = {r[0] for r in rows} - toxic
    assert len(clean - set(first)) <= 0.02 * len(clean)
    assert all(first[r[0]] == r[1] for r in rows if r[0] in first)

    second = texts_of(kept[names[1]])
    assert set(second) == classes(first)
    assert not any(1000 <= k < 1020 and (k - 1000) * 8 in first for k in second)

    third = kept[names[2]].collect()
    want = without_windows(second)
    assert {r.doc_id: (r.text or "").encode() for r in third} == want
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in third)
    assert sum(passage in (t or "") for t in second.values()) > 5
    assert not any(passage[40:-40] in (r.text or "") for r in third)

    fourth = kept[names[3]]
    by_id = {r.doc_id: r.text for r in third}
    mixed = [(r.doc_id, r.text) for r in fourth.collect()]
    assert all(by_id[k] == t for k, t in mixed) and {k for k, _ in mixed} == set(by_id)

    last = kept[names[4]].collect()
    assert len({(r.doc_id, r.piece) for r in last}) > 0
    by_sequence = {}
    for r in last:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    whole = [r for r in last if r.piece == 0]
    assert len(whole) == len(mixed)


def test_run_is_the_stages_in_a_row(spark, stages):
    *_, kept, folder = stages
    made = corpus_pipeline.run(spark, folder)
    assert made.columns == kept["packing"].columns
    assert made.count() == kept["packing"].count()
