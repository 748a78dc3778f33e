from threadmine.llm import quotes

ROWS = [
    (1, 0, "user", "Hello there.\nHow are you?"),
    (1, 1, "assistant", "> Hello there.\n> How   are YOU?\nFine."),
    (1, 2, "user", "New topic"),
    (1, 3, "user", ">> Hello there.\n>> How are you?\n> Fine.\nGood."),
    (1, 4, "user", "> nobody wrote this\n"),
    (2, 0, "user", "> Hello there.\n> How are you?"),
    (2, 1, "user", None),
    (2, 1, "user", ""),
    (None, 3, "user", "> x\nleft"),
    (3, None, "system", "a\r\n>b\rc"),
]


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "n") for r in rows], "conv_id long, turn long, role string, text string, level string"
    )


def test_links_texts_and_order(spark):
    got = {(r.conv_id, r.turn, r.text): r for r in quotes.reply_order(frame(spark, ROWS)).collect()}
    assert len(got) == len(ROWS)

    def one(conv, turn, text):
        r = got[conv, turn, text]
        return r.parent_turn, r.n_quotes, r.n_linked, r.position

    assert one(1, 0, "Hello there.\nHow are you?") == (None, 0, 0, 0)
    assert one(1, 1, "Fine.") == (0, 1, 1, 1)
    assert one(1, 2, "New topic") == (1, 0, 0, 2)
    # the outermost quotation that was found decides: "Fine." of turn 1
    assert one(1, 3, "Good.") == (1, 2, 2, 3)
    assert one(1, 4, "") == (3, 1, 0, 4)
    assert one(2, 0, "") == (None, 1, 0, 0)
    assert one(2, 1, None)[:3] == one(2, 1, "")[:3] == (0, 0, 0)
    assert one(None, 3, "left") == (None, 0, 0, 0)
    assert one(3, None, "a\nc")[:3] == (None, 0, 0)


def test_a_long_conversation_in_spans(spark):
    rows = [(7, t, "user", f"> text {t // 2}\nown {t}" if t % 2 else f"text {t}") for t in range(300)]
    whole = {r.turn: r for r in quotes.reply_order(frame(spark, rows)).collect()}
    parts = {r.turn: r for r in quotes.reply_order(frame(spark, rows), span=16).collect()}
    assert whole == parts
    assert sorted(r.position for r in whole.values()) == list(range(300))
    for r in whole.values():
        if r.parent_turn is not None:
            assert whole[r.parent_turn].position < r.position
    assert whole[9].parent_turn == 4 and whole[9].n_linked == 1


def test_only_built_in_functions(spark):
    plan = quotes.reply_order(frame(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert quotes.reply_order(frame(spark, [])).count() == 0


def test_parts_of_messages_are_linked(spark):
    first = "Alpha one.\nAlpha two.\n\nBeta one is long.\nBeta two.\n \nGamma."
    rows = [
        (1, 0, "user", first),
        (1, 1, "user", "Something else"),
        (1, 2, "user", "> beta one is  LONG.\n> Beta two.\nOne paragraph."),
        (1, 3, "user", "> Alpha two.\nOne line."),
        # full quotation, parted by blank lines without a mark
        (1, 4, "user", "> Alpha one.\n> Alpha two.\n\n> Beta one is long.\n> Beta two.\n\n> Gamma.\nAll."),
        # answers between the quoted paragraphs
        (1, 5, "user", "> Alpha one.\n> Alpha two.\nyes\n> Gamma.\nno\n> never written\nwhat?"),
        # lines across two paragraphs, and one that was never written
        (1, 6, "user", "> Alpha two.\n>\n> Beta one is long.\n> unknown\nMixed."),
        # more characters of turn 0 than of turn 1; blank quoted lines are nothing
        (1, 7, "user", "> Something else\n>\n> Beta one is long.\n> Beta two.\nMost."),
        # a paragraph of its own is found in the message that quoted it and wrote it again
        (1, 8, "user", "Gamma."),
        (1, 9, "user", "> Gamma.\nLatest."),
        # the quoted text stands in parts of the own text
        (1, 10, "user", "left\n> Gamma.\nright"),
        (1, 11, "user", "> left\n> right\nBoth."),
        (2, 0, "user", "Delta"),
        (2, 1, "user", "> Alpha two.\nOther conversation."),
    ]
    got = {(r.conv_id, r.turn): (r.parent_turn, r.n_quotes, r.n_linked) for r in quotes.reply_order(frame(spark, rows)).collect()}
    assert got == {
        (1, 0): (None, 0, 0),
        (1, 1): (0, 0, 0),
        (1, 2): (0, 1, 1),
        (1, 3): (0, 1, 1),
        (1, 4): (0, 3, 3),
        (1, 5): (0, 3, 2),
        (1, 6): (0, 1, 1),
        (1, 7): (0, 1, 1),
        (1, 8): (7, 0, 0),
        (1, 9): (8, 1, 1),
        (1, 10): (8, 1, 1),
        (1, 11): (10, 1, 1),
        (2, 0): (None, 0, 0),
        (2, 1): (0, 1, 0),
    }


def test_long_messages(spark):
    n = 50_000
    own = "\n".join(f"line {i} of a text" for i in range(n))
    mixed = "\n".join(f"> line {i} of a text" if i % 3 else f"said {i}" for i in range(n))
    rows = [(1, 0, "user", own), (1, 1, "user", mixed), (1, 2, "user", ">" * n + "deep\nleft")]
    got = {r.turn: r for r in quotes.reply_order(frame(spark, rows)).collect()}
    assert got[0].text == own
    assert got[1].text == "\n".join(f"said {i}" for i in range(0, n, 3))
    # a run of two lines is found by its lines
    assert (got[1].parent_turn, got[1].n_quotes, got[1].n_linked) == (0, n // 3 + 1, n // 3 + 1)
    assert (got[2].text, got[2].parent_turn, got[2].n_quotes, got[2].n_linked) == ("left", 1, 1, 0)


def test_passages(spark):
    text = "a\r\nb\n> c\r>\n>> d\n\n"
    row = spark.createDataFrame([(text,), ("",), (None,), (">",)], "text string")
    got = [r.p for r in row.select(quotes.passages_of(row.text).alias("p")).collect()]
    assert got == [["0\na\nb", "1\nc\n", "2\nd", "0\n\n"], ["0\n"], None, ["1\n"]]


def test_rows_without_conversation_or_turn_are_parted(spark):
    rows = [(None, i % 7, "user", f"> x\nsaid {i}") for i in range(300)]
    rows += [(4, None, "user", f"said {i}") for i in range(300)] + [(4, 2, "user", "one")]
    got = quotes.reply_order(frame(spark, rows)).collect()
    for conv, n in ((None, 300), (4, 301)):
        own = [r for r in got if r.conv_id == conv]
        assert sorted(r.position for r in own) == list(range(n))
        assert all(r.parent_turn is None for r in own)
    turns = [r.turn for r in sorted(got, key=lambda r: r.position) if r.conv_id is None]
    assert turns == sorted(turns)


def test_many_answers_to_one_message(spark):
    rows = [(9, 0, "user", "The question.")]
    rows += [(9, t, "user", f"> The question.\nanswer {t}") for t in range(1, 200)]
    got = quotes.reply_order(frame(spark, rows), span=8).collect()
    assert all(r.parent_turn == (0 if r.turn else None) and r.position == r.turn for r in got)
