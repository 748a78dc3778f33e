import datetime
import re

import pytest

from checks import fixtures as fx
from threadmine.operators import selection
from threadmine.sources import posts as dump
from threadmine.sources.corpus_files import write_corpus
from threadmine.sources.wordlists import read_stop_words

SF = "/root/testdata/sf0.001"
GOOD = 'Id="1" PostTypeId="1" CreationDate="2015-03-04T05:06:07.890" Score="5"'


def parsed(spark, line):
    rows = dump.posts_from_lines(spark.createDataFrame([(line,)], "value STRING")).collect()
    return rows[0] if rows else None


@pytest.mark.parametrize(
    "line",
    [
        '<?xml version="1.0" encoding="utf-8"?>',
        "<posts>", "</posts>", "junk", "", "null",
        f"<row {GOOD}>",
        f"<row {GOOD} /> more",
        f"<row {GOOD} /><row {GOOD} />",
        f"<row {GOOD}></row><row {GOOD}></row>",
        f'<row {GOOD} Id="2" />',
        f'<row {GOOD} Body="a < b" />',
        f'<row {GOOD} Body="a & b" />',
        f'<row {GOOD.replace(chr(34) + "1" + chr(34), chr(34) + "x" + chr(34), 1)} />',
        f'<row {GOOD.replace("Score=" + chr(34), "Score=" + chr(34) + " ")} />',
        f'<row {GOOD.replace("Score=" + chr(34) + "5", "Score=" + chr(34) + "5.0")} />',
        f'<row {GOOD.replace("Score=" + chr(34) + "5", "Score=" + chr(34) + "99999999999")} />',
        '<row Id="1" PostTypeId="1" Score="5" />',
        '<row Id="1" PostTypeId="1" CreationDate="2015-03-04" Score="5" />',
        '<row Id="1" PostTypeId="1" CreationDate="2015-02-30T05:06:07" Score="5" />',
        '<row Id="1" PostTypeId="1" CreationDate="2015-03-04T05:06:07Z" Score="5" />',
        f'<row {GOOD} ViewCount="many" />',
        f'<row {GOOD} AcceptedAnswerId="3000000000" />',
        f'<row {GOOD.replace("PostTypeId=" + chr(34) + "1", "PostTypeId=" + chr(34) + "2")} ParentId="-" />',
    ],
)
def test_bad_lines_are_rejected(spark, line):
    assert parsed(spark, line) is None
    lines = spark.createDataFrame([(line,)], "value STRING")
    assert [r.value for r in dump.rejected_lines(lines).collect()] == [line]


def test_question_fields(spark):
    row = parsed(
        spark,
        f'  <row {GOOD} AcceptedAnswerId="7" ParentId="8" ViewCount="9" Body="&lt;p&gt;a&#xA;b &amp;amp; c&lt;/p&gt;"'
        ' Title=" T " Tags="&lt;x&gt;" AnswerCount="" CommentCount="+2" />',
    )
    assert (row.id, row.postTypeId, row.acceptedAnswerId, row.parentId) == (1, 1, 7, None)
    assert row.creationDate == datetime.datetime(2015, 3, 4, 5, 6, 7, 890000)
    assert (row.score, row.viewCount, row.answerCount, row.commentCount) == (5, 9, None, 2)
    assert (row.body, row.title, row.tags) == ("<p>a\nb &amp; c</p>", " T ", "<x>")
    assert row.favoriteCount is None


def test_missing_text_is_empty_for_questions_only(spark):
    question = parsed(spark, f"<row {GOOD} />")
    assert (question.body, question.title, question.tags) == ("", "", "")
    answer = parsed(
        spark,
        '<row Id="-3" PostTypeId="2" CreationDate="2015-03-04T05:06" Score="-1" ParentId="1"'
        ' Title="t" Tags="x" CommentCount="bad" AcceptedAnswerId="4"></row>',
    )
    assert (answer.id, answer.parentId, answer.score) == (-3, 1, -1)
    assert (answer.title, answer.tags, answer.commentCount, answer.acceptedAnswerId) == (None,) * 4


def test_one_parse_per_line(spark):
    lines = spark.createDataFrame([("junk",)], "value STRING")
    plan = dump.posts_from_lines(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1


def test_round_trip_through_files(spark, tmp_path):
    posts = fx.posts(spark, SF)
    path = str(tmp_path / "dump")
    fx.dump_lines(posts).unionByName(fx.broken_lines(posts)).write.text(path)
    got = dump.read_posts(spark, path)
    assert got.count() == posts.count()
    assert posts.exceptAll(got.select(posts.columns)).count() == 0
    staged = dump.stage_posts(got, str(tmp_path / "staged"))
    assert staged.drop("creationYear").exceptAll(got).count() == 0


def test_year_filter_is_a_pushed_range(spark, tmp_path):
    rows = [(1, datetime.datetime(2012, 12, 31, 23, 59, 59)), (2, datetime.datetime(2013, 1, 1))]
    path = str(tmp_path / "p")
    spark.createDataFrame(rows, "id BIGINT, creationDate TIMESTAMP").write.parquet(path)
    kept = selection.since_year(spark.read.parquet(path))
    assert [r.id for r in kept.collect()] == [2]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(creationDate,2013-01-01" in plan


def test_year_filter_prunes_folders(spark, tmp_path):
    staged = dump.stage_posts(fx.posts(spark, SF), str(tmp_path / "staged"))
    kept = selection.since_year(staged, 2015)
    assert kept.count() == selection.since_year(fx.posts(spark, SF), 2015).count() > 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    folders = re.search(r"PartitionFilters: \[([^]]*)\]", plan)[1]
    assert "creationYear" in folders and "2014" in folders


@pytest.mark.parametrize("sensitive", ["true", "false"])
def test_attribute_names_are_compared_to_the_letter(spark, sensitive):
    spark.conf.set("spark.sql.caseSensitive", sensitive)
    try:
        lines = [
            f"<row {GOOD.replace('Id=', 'id=', 1)} />",
            f"<row {GOOD} SCORE=\"7\" viewcount='3' Body=\" id='1' Score='2' \" />",
            f"<row id=\"8\" {GOOD} ID = '9'/>",
        ]
        rows = dump.parse_posts(spark.createDataFrame([(x,) for x in lines], "value STRING")).collect()
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    good = parsed(spark, f"<row {GOOD} />")
    assert [r.valid for r in rows] == [False, True, True]
    assert (rows[1].post.score, rows[1].post.viewCount) == (good.score, None)
    assert rows[1].post.body == " id='1' Score='2' " and rows[2].post.id == good.id


def test_stop_word_file(spark, tmp_path):
    (tmp_path / "words.txt").write_bytes(b"the\r\n a \r\nthe\r\n\r\nwould\r\n")
    got = read_stop_words(spark, str(tmp_path / "words.txt"))
    assert sorted(r.word for r in got.collect()) == ["a", "the", "would"]


def test_staging_writes_years_not_tasks(spark, tmp_path):
    posts = fx.posts(spark, SF).repartition(6)
    dump.stage_posts(posts, str(tmp_path / "staged"))
    files = [f.parent.name for f in (tmp_path / "staged").glob("*/part-*")]
    assert files and len(files) == len(set(files))


def test_few_corpus_rows_make_few_files(spark, tmp_path):
    corpus = spark.range(1000).repartition(8).filter("id % 10 = 0")
    write_corpus(corpus, str(tmp_path / "corpus"))
    assert len(list((tmp_path / "corpus").glob("part-*"))) == 1
    assert spark.read.parquet(str(tmp_path / "corpus")).count() == 100
