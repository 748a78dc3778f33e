import pytest
from pyspark.sql import functions as F

from threadmine.functions import text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v STRING").select(column.alias("r")).first().r


@pytest.mark.parametrize(
    "raw, cleaned",
    [
        ("Foo\nBar", "foobar"),
        ("\x00a\x1fb\x7f", "ab\x7f"),
        ("a <pre>x</pre> b <pre>y</pre> c", "a   c"),
        ("a <pre></pre> b", "a    b"),
        ('<pre class="x">kept</pre>', " kept "),
        ("<>", "  "),
        ("1 < 2 > 3", " " * 5),
        ("v2.10.3 of 2018.", "v  of   "),
        ("1.2.", "  "),
        ("1." * 200_000 + "1", " "),
        ("<" + "x" * 500_000 + ">", " "),
        ("a|b\\c", "a|b\\c"),
        ("!@#$%^&*()_=+.,<:;?/{}`~'\"[]-", " " * 29),
        ("A <pre>b" + chr(0x2028) + "c</pre>", "a  b" + chr(0x2028) + "c "),
        (None, None),
    ],
    ids=lambda value: str(value)[:20],
)
def test_clean_document(spark, raw, cleaned):
    assert one(spark, raw, text.clean_document("v")) == cleaned


def test_control_characters_may_become_spaces(spark):
    assert one(spark, "Foo\nBar", text.clean_document("v", control_to_space=True)) == "foo bar"


def test_tokens_are_ascii_words(spark):
    assert one(spark, r"ação café |\x\yy Foo_bar", text.tokenize("v")) == [
        "caf", "yy", "foo", "bar",
    ]
    assert one(spark, "", text.tokenize("v")) == []
    assert one(spark, "a bb ccc", text.tokenize("v", 3)) == ["ccc"]


def test_words_are_removed_without_regard_to_case(spark):
    column = text.remove_words(F.split("v", " "), [" The ", "the", "OF", ""])
    assert one(spark, "the Cat OF tHe house of", column) == ["Cat", "house"]
    assert one(spark, "a b", text.remove_words(F.split("v", " "), [])) == ["a", "b"]


def test_word_list_from_table_and_join(spark):
    words = spark.createDataFrame([("the",), (" The ",), ("of",), ("",)], "word STRING")
    assert text.word_list(words) == ["of", "the"]
    terms = spark.createDataFrame([("THE",), ("cat",), ("of",)], "term STRING")
    assert [r.term for r in text.remove_words_by_join(terms, words).collect()] == ["cat"]


def test_long_word_list_is_refused(spark, monkeypatch):
    monkeypatch.setattr(text, "STOP_WORD_LIMIT", 2)
    with pytest.raises(ValueError):
        text.word_list(["a", "b", "c"])
    with pytest.raises(ValueError):
        text.word_list(spark.createDataFrame([("a",), ("b",), ("c",)], "word STRING"))


def test_tags_match_as_substrings(spark):
    rows = [("<pyspark-sql>", True), ("<java>", False), ("", False), (None, False),
            ("<Apache-Spark>", False), ("<x><sparkr>", True)]
    df = spark.createDataFrame(rows, "tags STRING, expected BOOLEAN")
    assert df.filter(text.has_tag("tags") != F.col("expected")).count() == 0
    assert df.filter(text.has_tag("tags", ["java"])).count() == 1


def test_tag_filter_reaches_the_parquet_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("<pyspark>",)], "tags STRING").write.parquet(path)
    found = spark.read.parquet(path).filter(text.has_tag("tags", ["pyspark"]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(tags,pyspark)" in plan


def test_word_expressions_are_computed_once(spark):
    df = spark.createDataFrame([("a b",)], "v STRING")
    rows = text.word_rows(df, text.tokenize(text.clean_document("v"), 1))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert [r.term for r in rows.collect()] == ["a", "b"]


def test_sql_functions_equal_columns(spark):
    text.register_sql_functions(spark)
    df = spark.createDataFrame(
        [("A\n<b>it's</b> \"1.2\" [x]\\|\x00<pre>c</pre>", "<pyspark>"), (None, None)],
        "v STRING, tags STRING",
    )
    got = df.selectExpr("cleanDocument(v) AS c", "sparkRelated(tags) AS s", "v", "tags")
    assert got.filter(
        ~F.col("c").eqNullSafe(text.clean_document("v")) | (F.col("s") != text.has_tag("tags"))
    ).count() == 0
