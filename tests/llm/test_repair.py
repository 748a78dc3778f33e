import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from threadmine.llm import repair
from threadmine.llm.queries import damaged

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
WORD = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        pick = zlib.crc32(":".join(shown).encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if pick == 1:
            text = ""
        if pick == 2:
            text = re.sub("[.!?]", "", text)
        if pick == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(pick, 1)
    return out


def cheapest(rows):
    """Least (cost, initials) over all edits, by a best-first search over (row, state)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, kept = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit, kept
        fit = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 5, audit + "I", at, fit, (*kept, f"{WORD[fit]}:")))
        if at == len(rows):
            continue
        role, text, fault = rows[at]
        heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, kept))
        if fault in ("blank", "duplicate"):
            continue
        more = 5 * (fault == "truncated")
        if role[:1] in NEXT[state]:
            heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*kept, f"{role}:{text}")))
        heapq.heappush(
            heap, (cost + 1 + more, audit + "R", at + 1, fit, (*kept, f"{WORD[fit]}:{text}"))
        )


def by_brute_force(rows, original=None):
    out = []
    for conv in {r[0] for r in original or rows}:
        own = [(t, r or " " if r is None else r, x if x is not None else " ") for c, t, r, x in rows if c == conv]

        def digest(role, text):
            return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()

        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))
        seen, marked = set(), []
        for _, role, text in own:
            solid = text.strip(SPACE)
            fault = (
                "blank" if not solid else "duplicate" if (role, text) in seen
                else "truncated" if solid[-1] not in ".!?" else ""
            )
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for t, *_ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, kept = cheapest(marked)
        count = [sum(f == x for *_, f in marked) for x in ("blank", "duplicate", "truncated")]
        sha = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((conv, gaps, *count, illegal, cost, audit, sha))
    return sorted(out, key=repr)


def random_rows(seed, conversations, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        kind = rng.choice(["any", "blank", "cut", "good", "same"])
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["system", "user", "assistant", "tool", "", "ux", None, "user", "assistant"])
            if kind == "good":
                role = ("user", "assistant")[turn % 2]
            text = rng.choice([f"t{turn}.", f"t{turn}", "same!", "", " \n", None, f"x{turn}? ", "é "])
            text = {"blank": "\t", "cut": f"no end {turn}", "good": f"g{turn}!", "same": "one."}.get(kind, text)
            rows.append((conv if conv else None, rng.choice([turn, turn, turn // 2, turn * 3, None]), role, text))
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_equals_brute_force(spark, bits):
    rows = random_rows(bits, 50, 24)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = repair.repair_report(table, chunk_bits=bits)
    assert sorted(map(tuple, got.collect()), key=repr) == by_brute_force(rows)


def test_query_over_damaged_rows(spark):
    rows = random_rows(9, 60, 9) + [(1000 + i, 0, "user", "only one.") for i in range(60)]
    table = spark.createDataFrame(rows, SCHEMA)
    hurt = damage(rows)
    assert sorted(map(tuple, damaged(table).collect()), key=repr) == sorted(hurt, key=repr)
    got = repair.with_empty(repair.repair_report(damaged(table)), table)
    want = by_brute_force(hurt, rows)
    assert sum(w[7] == "" for w in want) > 2
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_one_long_conversation_over_many_chunks(spark):
    rng = random.Random(3)
    kinds = [lambda i: ("user", f"cut {i}"), lambda i: ("tool", ""), lambda i: ("assistant", f"ok {i}.")]
    rows = []
    for run in range(30):  # runs of rows that leave cost vectors as they are, and others
        kind = rng.choice(kinds)
        rows += [(7, len(rows) + i, *kind(len(rows) + i)) for i in range(rng.randint(1, 40))]
    got = repair.repair_report(spark.createDataFrame(rows, SCHEMA).repartition(4), chunk_bits=3)
    assert sorted(map(tuple, got.collect())) == by_brute_force(rows)
    sizes = repair.chunks(repair.ordered_rows(spark.createDataFrame(rows, SCHEMA), 3)).selectExpr("size(codes) AS n")
    assert sizes.agg({"n": "max"}).first()[0] <= 8


def test_messages(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "Lone!")]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS place", "1 AS edit", "2 AS position")
    got = repair.repaired_messages(table).orderBy("conv_id", "place").collect()
    assert [tuple(r)[0::4] + tuple(r)[2:4] for r in got] == [
        (1, "Again?", "K", "user"), (1, "Yes.", "K", "assistant"),
    ]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair_report(empty).count() == 0
    assert repair.with_empty(repair.repair_report(empty), empty).count() == 0
    assert repair.repaired_messages(empty).count() == 0


def test_rows_keep_what_the_generators_generate():
    """A row maps each generator to a vector that the generators give again."""
    for code in range(16):
        out = repair.step_back(repair.GENERATORS[:, None, :], np.full(4, code))[:, 0]
        for vector in [*out, np.array(repair.END)]:
            again = (vector[:, None] + repair.GENERATORS).min(axis=0)
            assert (again == vector).all()
