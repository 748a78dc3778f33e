import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threadmine.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "One text, isn't it?", "", None, "word " * 500, "one text, isn't it?", "a\x1cb  c",
    " xy ", "élan élan", "don't 's <|endoftext|> 12 3", " \t\n\r",
]


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, bin int")


def brute_pieces(rows, most):
    tokenizer = Tokenizer.from_file(PATH)
    for key, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), most)):
            part = ids[start : start + most]
            yield key, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())


def test_pieces_and_places(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "none", None, None)] * 2
    got = packing.pack_documents(documents(spark, rows), PATH, max_tokens=64).collect()
    assert Counter(tuple(r[:5]) for r in got) == Counter(brute_pieces(rows, 64))
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= -(-sum(r.length for r in got) // 64) + 1


def test_empty_table(spark):
    out = packing.pack_documents(documents(spark, []), PATH)
    assert out.count() == 0 and out.columns[-2:] == ["sequence_id", "offset"]


def test_many_groups_fill_as_one(spark):
    rows = [(i, "word " * (1 + i * 7919 % 60), None, None) for i in range(900)]
    pieces = packing.token_pieces(documents(spark, rows), PATH, 100)
    got = packing.pack(pieces, 100, group=50).toPandas()
    least = -(-got["length"].sum() // 100)
    assert got["sequence_id"].nunique() <= least * 1.02 + 1
    fill = got.groupby("sequence_id").agg(used=("length", "sum"), n=("offset", "nunique"))
    assert fill["used"].max() <= 100 and fill["n"].sum() == len(got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_tightest_open_bin(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, offsets = packing.best_fit_decreasing(np.array(sizes, np.int64), 40)
    room: list[int] = []
    for size, where, offset in zip(sizes, bins.tolist(), offsets.tolist(), strict=True):
        fits = [r for r in room if r >= size]
        if fits:
            assert room[where] == min(fits)
        else:
            assert where == len(room)
            room.append(40)
        assert offset == 40 - room[where]
        room[where] -= size


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_word_by_word_equals_whole(texts):
    whole = Tokenizer.from_file(PATH)
    texts = [t.encode(errors="ignore").decode() for t in texts]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    got = packing.word_ids(PATH)(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    whole, by_word = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    for text in ("some words are here, and more.", "others are here", "some words, then"):
        want = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(by_word([text])[0], "<u4").tolist() == want


def largest_groups(monkeypatch):
    seen, pack_groups = [], packing._pack_groups

    def watched(grouped, most):
        seen.append(max((r["count"] for r in grouped.groupBy("group").count().collect()), default=0))
        return pack_groups(grouped, most)

    monkeypatch.setattr(packing, "_pack_groups", watched)
    return seen


def synthetic(spark, n, doc_id, length):
    return spark.range(0, n, 1, 8).selectExpr(
        f"cast({doc_id} as long) as doc_id", "0 as piece", "0L as start",
        f"cast({length} as long) as length", "7L as ids_crc32",
    )


def check_places(got, most):
    own = got.sort_values(["sequence_id", "offset"])
    before = own.groupby("sequence_id")["length"].cumsum() - own["length"]
    assert (before == own["offset"]).all()
    assert own.groupby("sequence_id")["length"].sum().max() <= most


def test_equal_rows_are_no_hot_group(spark, monkeypatch):
    seen = largest_groups(monkeypatch)
    got = packing.pack(synthetic(spark, 60_000, "null", "50"), 100, group=2048).toPandas()
    check_places(got, 100)
    assert len(got) == 60_000 and got["sequence_id"].nunique() == 30_000
    assert max(seen) < 2 * 2048


def test_half_full_sequences_are_no_hot_group(spark, monkeypatch):
    seen = largest_groups(monkeypatch)
    pieces = synthetic(spark, 30_000, "id", "900 + pmod(xxhash64(id), 1148)")
    got = packing.pack(pieces, 2048, group=1024).toPandas()
    check_places(got, 2048)
    assert len(got) == 30_000 and max(seen) < 2 * 1024 and len(seen) >= 2
    lengths = got["length"].sort_values(ascending=False).to_numpy()
    whole = packing.best_fit_decreasing(lengths, 2048)[0].max() + 1
    assert got["sequence_id"].nunique() <= whole * 1.01


def test_one_text_at_a_time_is_remembered(monkeypatch):
    """More texts in a call do not make a worker remember more words."""
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    by_word, whole = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"Word{a}{b}. {a}{b}, {b}{a} É{a}{b}. x!{a}. it's. ... A," for a in letters for b in letters]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(g, "<u4").tolist() for g in by_word(texts)] == want
    assert len(by_word.known) < 100
