"""Cleaning a question's answers in parts must give exactly the cleaned concatenation."""

import random
import re

from pyspark.sql import functions as F

from threadmine.functions.text import tokenize
from threadmine.operators.answer_text import cleaned_each, cleaned_in_parts, cleaned_whole

PIECES = ["<pre>", "</pre>", "<", ">", "<>", "<b>", "</b>", "x", "yy ", " zz", "12", "1.5", ".",
          " ", chr(0x85), chr(0x2028), "\n", "A", "<pre>q</pre>"]
LINE_BREAK = "\n\r" + "".join(map(chr, (0x85, 0x2028, 0x2029)))


def model(text):
    """The cleaning of one text, by plain regular expressions."""
    text = "".join(c for c in text if c >= " ").lower()
    text = re.sub(f"<pre>[^{LINE_BREAK}]+</pre>", " ", text)
    text = re.sub("<[^>]+>", " ", text)
    text = re.sub(r"\d+(?:\.\d+)*", " ", text)
    return re.sub(r"[!@#$%^&*()_=+.,<>:;?/{}`~'\"\[\]\-]", " ", text)


def words(text):
    return [t for t in re.split(r"[^a-z0-9]+", text) if len(t) >= 1]


def some_answers(seed, questions=300):
    rng = random.Random(seed)
    rows = []
    for question in range(questions):
        start = rng.randrange(0, 1000)
        weights = [rng.choice([0, 1, 4]) for _ in PIECES]
        if not any(weights):
            weights[7] = 1
        for n in range(rng.randrange(1, 9)):
            body = "".join(rng.choices(PIECES, weights, k=rng.randrange(0, 7)))
            rows.append((start + n * rng.choice([1, 3]) * 10 + n, question, body))
    unique = {(q, i): (i, q, b) for i, q, b in rows}
    return list(unique.values())


def test_whole_and_parts_equal_the_model(spark):
    rows = some_answers(1) + [(i, q + 1000, b) for i, q, b in some_answers(2)]
    answers = spark.createDataFrame(rows, "id BIGINT, parentId BIGINT, body STRING")
    expected = {}
    for i, q, b in sorted(rows):
        expected.setdefault(q, []).append(b)
    expected = {q: model(" ".join(bodies)) for q, bodies in expected.items()}

    whole = {r.id: r.cleaned for r in cleaned_whole(answers).collect()}
    assert whole == expected

    parts = cleaned_in_parts(answers, span=16)
    listed = parts.select("id", "part", tokenize("cleaned", 1).alias("t")).collect()
    assert len(listed) == len(rows)
    got = {}
    for r in sorted(listed, key=lambda r: (r.id, r.part)):
        got.setdefault(r.id, []).extend(r.t)
    wrong = {q: (got[q], words(expected[q])) for q in expected if got[q] != words(expected[q])}
    assert not wrong, list(wrong.items())[:3]


def test_per_answer_cleaning_keeps_code_apart(spark):
    rows = [(2, 1, "<pre>b</pre> two"), (1, 1, "<pre>a</pre> one")]
    answers = spark.createDataFrame(rows, "id BIGINT, parentId BIGINT, body STRING")
    assert cleaned_each(answers).first().cleaned.split() == ["one", "two"]
    assert cleaned_whole(answers).first().cleaned.split() == ["two"]


def test_no_window_or_group_by_question_alone(spark):
    """The parts of a question are dealt over tasks by ranges."""
    answers = spark.range(4000).select(
        "id", F.lit(1).cast("bigint").alias("parentId"), F.lit("<b>x").alias("body")
    )
    parts = cleaned_in_parts(answers, span=256)
    assert parts.count() == 4000
    assert parts.select(F.explode(tokenize("cleaned", 1))).count() == 4000
