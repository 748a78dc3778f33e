import random
import zlib

import numpy as np

from threadmine.llm import language

WORDS = {
    "en": ["the", "and", "of", "with", "thing", "water", "where"],
    "de": ["der", "und", "ßig", "über", "nicht", "schön", "auch"],
    "fr": ["le", "été", "vous", "être", "où", "çela", "aux"],
}


def corpus(n=450):
    rng = random.Random(2)
    rows = []
    for key in range(n):
        name = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[name]) for _ in range(rng.randrange(3, 60)))
        rows.append((key, text, name, 1))
    rows += [(9000, None, "en", 1), (9001, "", "en", 1), (9002, "12 34 !!", "de", 1)]
    rows += [(9003, "und der " * 5000, None, 1), (None, "the and", "fr", 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_held_out_accuracy_and_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(language, "EPOCHS", 12)
    monkeypatch.setattr(language, "BATCH", 64)
    rows = corpus()
    got = {r.doc_id: r for r in language.predict_languages(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if r[0] is not None and r[0] < 9000 and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[k].held_out for k, *_ in held)
    assert sum(got[k].lang_pred == name for k, _, name, _ in held) >= 0.9 * len(held)
    for key in (9000, 9001, 9002):
        assert (got[key].lang_pred, got[key].score) == ("und", 0.0)
    assert got[9003].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn_from(spark):
    got = language.predict_languages(frame(spark, [(1, "abc", None, 1)] * 2)).collect()
    assert [r.lang_pred for r in got] == ["und", "und"]
    assert language.predict_languages(frame(spark, [])).count() == 0


def test_gradients_match_differences():
    network = language.Network.new(["a", "b"], hidden=3)
    for name in ("inputs", "gates", "candidate", "output", "bias"):
        setattr(network, name, getattr(network, name).astype(np.float64))
    bytes_, lengths = language.matrix([b"hello", b"ab", b"xyzzy!"])
    bytes_ = bytes_[:, :6]
    target = np.array([0, 1, 1])
    _, grads = network.gradients(bytes_, lengths, target)
    rng = np.random.default_rng(1)
    for x, g in zip(network.parameters(), grads, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in x.shape)
            if x is network.inputs:
                at = (at[0], int(rng.choice(list(b"helo"))), at[2])
            kept = x[at]
            x[at] = kept + 1e-3
            up, _ = network.gradients(bytes_, lengths, target)
            x[at] = kept - 1e-3
            down, _ = network.gradients(bytes_, lengths, target)
            x[at] = kept
            assert abs((up - down) / 2e-3 - g[at]) < 2e-3


def test_pooling_covers_every_position():
    network = language.Network.new(["a", "b"])
    text = "çx" * 3000
    segments = language.cut(text)
    total = sum(
        network.probabilities(*language.matrix([s]))[: len(s), 0].sum(axis=0) for s in segments
    )
    assert np.allclose(language.pooled(network, [text, "y"])[0], total / len(text.encode()), atol=1e-4)
