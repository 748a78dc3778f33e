import datetime

import pytest
from pyspark.sql import functions as F

from threadmine.operators import corpus as corpora
from threadmine.operators import selection, skew, stop_words, terms, topics
from threadmine.operators.answer_text import concatenated
from threadmine.plans.corpora import build_corpora
from threadmine.plans.corpora import corpora as corpora_of
from threadmine.sources.corpus_files import write_corpus_csv

YEAR = datetime.datetime(2015, 1, 1)
SCHEMA = (
    "id BIGINT, postTypeId INT, acceptedAnswerId BIGINT, parentId BIGINT, creationDate TIMESTAMP,"
    " score INT, viewCount INT, body STRING, title STRING, tags STRING, answerCount INT,"
    " commentCount INT, favoriteCount INT"
)


def question(id, title, body, tags="<pyspark>"):
    return (id, 1, None, None, YEAR, 1, 10, body, title, tags, 0, 0, None)


def answer(id, parent, body):
    return (id, 2, None, parent, YEAR, 0, None, body, None, None, None, None, None)


ROWS = [
    question(1, "Joining tables", "<p>the tables</p> <pre>code"),
    question(2, "Empty", ""),
    question(3, "Other", "none", "<java>"),
    question(4, "Counting", "rows"),
    answer(11, 1, "zebra </pre> first 1.2"),
    answer(12, 1, "second <pre>x</pre> gone"),
    answer(13, 1, "gone <pre>y</pre> third tables"),
    answer(14, 3, "not selected"),
    answer(15, 4, "answered rows"),
    answer(16, 99, "orphan"),
]


@pytest.fixture(scope="module")
def parts(spark):
    posts = spark.createDataFrame(ROWS, SCHEMA)
    return selection.tagged_questions(posts), selection.answers(posts)


PREP = corpora.TextPrep(stop_words=("the",))


def documents(df):
    return {r.id: r.document for r in df.collect()}


def test_title_and_question_corpora(parts):
    asked, _ = parts
    assert documents(corpora.title_corpus(asked, PREP)) == {
        1: ["join", "tabl"], 2: ["empti"], 4: ["count"],
    }
    found = corpora.question_corpus(asked, PREP)
    assert tuple(found.columns) == corpora.CORPUS_COLUMNS
    assert documents(found)[1] == ["join", "tabl", "tabl", "code"]


def test_question_and_answers_are_cleaned_apart(parts):
    found = documents(corpora.question_answer_corpus(*parts, PREP))
    assert found == {
        1: ["join", "tabl", "tabl", "code", "zebra", "first", "second", "third", "tabl"],
        2: ["empti"],
        4: ["count", "row", "answer", "row"],
    }


@pytest.mark.parametrize("per_answer", [False, True])
def test_spread_documents_count_the_same(parts, per_answer):
    whole = corpora.question_answer_corpus(*parts, PREP, per_answer=per_answer)
    spread = corpora.question_answer_corpus(*parts, PREP, max_answers=1, per_answer=per_answer)
    rows = [(r.id, r.part) for r in spread.collect()]
    assert sorted(rows, key=str) == sorted(
        [(1, 0), (1, 11), (1, 12), (1, 13), (2, None), (4, None)], key=str
    )
    for count in (terms.term_counts, terms.term_frequency, terms.document_frequency):
        a, b = count(whole, words="document"), count(spread, words="document")
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    a, b = (terms.term_statistics(c, "document") for c in (whole, spread))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    assert terms.corpus_size(spread).first().documents == 3

    vectorizer = topics.fit_vectorizer(whole, 1, words="document")
    vectors = [
        {r.id: r.features.toArray().tolist() for r in topics.vectorize(vectorizer, c).collect()}
        for c in (whole, spread)
    ]
    assert vectors[0] == vectors[1]


def test_answer_corpus(parts):
    rows = corpora.answer_corpus(*parts).collect()
    assert dict(corpora.answer_corpus(*parts).dtypes) == {
        "id": "bigint", "title": "string", "cleaned": "string"
    }
    assert {(r.id, None, r.title) for r in rows} == {
        (1, None, "Joining tables"), (4, None, "Counting"),
    }
    spread = corpora.answer_corpus(*parts, max_answers=2).collect()
    assert sorted((r.id, r.part or 0) for r in spread) == [(1, 11), (1, 12), (1, 13), (4, 0)]


def test_heavy_keys_as_table_or_literals(spark):
    df = spark.createDataFrame([(i, i % 5 if i < 50 else 7) for i in range(100)], "id INT, k INT")
    few = skew.heavy_keys(df, "k", 20)
    assert few.inline == (7,)
    many = skew.heavy_keys(df, "k", 5, inline=2)
    assert many.inline is None
    for keys, kept in ((few, 50), (many, 100)):
        assert keys.keep(df, "k", "id").count() == kept
        assert keys.drop(df, "k", "id").count() == 100 - kept
    assert skew.heavy_keys(df, "k", 1000).empty


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_the_plain_join(spark, how):
    left = spark.range(200).selectExpr("id", "id % 7 AS k")
    right = spark.createDataFrame([(0, "a"), (3, "b"), (50, "c")], "k BIGINT, v STRING")
    plain = left.join(right, ["k"], how)
    spread = skew.spread_join(left, right, ["k"], how, "id", span=16)
    assert plain.exceptAll(spread.select(plain.columns)).count() == 0
    assert plain.count() == spread.count()


def test_carry_last_equals_a_plain_window(spark):
    from pyspark.sql import Window as W

    df = spark.range(500).selectExpr(
        "id * 3 AS id", "id % 3 AS k", "CASE WHEN hash(id) % 11 = 0 THEN concat('v', id) END AS v"
    )
    w = W.partitionBy("k").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    plain = df.withColumn("c", F.last("v", ignorenulls=True).over(w))
    got = skew.carry_last(df, "k", ["id"], "v", "c", span=64).select(plain.columns)
    assert plain.exceptAll(got).count() == 0 and got.count() == 500


def test_corpora_at_rest(spark, tmp_path):
    posts = spark.createDataFrame(ROWS, SCHEMA)
    paths = build_corpora(posts, str(tmp_path), csv=True, prep=PREP, kinds=("QT", "Q", "QA"))
    assert set(paths) == {"QT", "Q", "QA"}
    assert documents(spark.read.parquet(paths["QT"]))[1] == ["join", "tabl"]
    csv = spark.read.csv(str(tmp_path / "CorpusQT.csv"), schema="id BIGINT, doc STRING")
    assert {tuple(r) for r in csv.collect()} == {(1, "join tabl"), (2, "empti"), (4, "count")}
    with pytest.raises(ValueError):
        build_corpora(posts, str(tmp_path), kinds=("X",))


def test_top_terms_and_vocabulary(spark):
    rows = [(1, ["b", "a", "b"]), (2, ["a", "c"]), (3, ["a", "b"]), (4, [])]
    corpus = spark.createDataFrame(rows, "id INT, removed ARRAY<STRING>")
    assert [tuple(r) for r in terms.top_terms(corpus, 2).collect()] == [("a", 3), ("b", 3)]
    assert {tuple(r) for r in terms.document_frequency(corpus, 2).collect()} == {("a", 3), ("b", 2)}
    assert [tuple(r) for r in terms.vocabulary(corpus, 2).collect()] == [("a", 3), ("b", 3)]
    assert [tuple(r) for r in terms.vocabulary(corpus, 1, limit=1).collect()] == [("a", 3)]
    assert terms.vocabulary_size(corpus, 2).first().terms == 2
    plan = terms.vocabulary(corpus, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_domain_words(spark):
    corpus = spark.createDataFrame([(1, ["spark", "join", "data"])], "id INT, document ARRAY<STRING>")
    assert corpora.without_domain_words(corpus).first().removed == ["join"]
    assert corpora.without_domain_words(corpus, ["join"]).first().removed == ["spark", "data"]


def test_one_row_per_question_at_every_size(spark, tmp_path):
    n = 2_001
    own = ["word" + str(i).translate(str.maketrans("0123456789", "abcdefghij")) for i in range(n)]
    rows = [question(1, "Joining tables", "many"), question(4, "Counting", "rows")]
    rows += [answer(10 + i, 1, f"{word} <b>x") for i, word in enumerate(own)] + [answer(9000, 4, "two rows")]
    posts = spark.createDataFrame(rows, SCHEMA)
    both = selection.tagged_questions(posts), selection.answers(posts)
    unstemmed = corpora.TextPrep(stem=False)
    whole = corpora.question_answer_corpus(*both, unstemmed)
    assert tuple(whole.columns) == corpora.CORPUS_COLUMNS
    found = documents(whole)
    assert whole.count() == len(found) == 2
    assert [w for w in found[1] if w.startswith("word")] == own
    assert corpora.answer_corpus(*both).count() == 2

    spread = corpora.spread_question_answer_corpus(*both, unstemmed)
    listed = sorted((r.id, r.part or 0, r.document) for r in spread.collect())
    assert len(listed) == n + 2
    assert [w for id_, _, words in listed if id_ == 1 for w in words] == found[1]
    assert corpora.spread_answer_corpus(*both).count() == n + 1
    write_corpus_csv(spread, str(tmp_path / "csv"))
    assert len(spark.read.csv(str(tmp_path / "csv")).columns) == 3


def test_a_question_of_200000_answers(spark):
    answers = spark.range(200_000).select(
        F.col("id"),
        F.when(F.col("id") % 100 < 99, 1).otherwise(F.col("id")).alias("parentId"),
        F.concat(F.lit("a"), F.col("id")).alias("body"),
    )
    found = {r.id: r.text for r in concatenated(answers.repartition(7)).collect()}
    assert len(found) == 2001 and found[199] == "a199"
    assert found[1] == " ".join(f"a{i}" for i in range(200_000) if i % 100 < 99)
    # a list holds the answers in a span of ids, or the texts of the spans
    plan = concatenated(answers)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 2


def test_concatenation_of_null_and_empty_bodies(spark):
    rows = [(1, 1, None), (9000, 1, "x"), (9001, 1, None), (20000, 1, ""), (30000, 1, "y"), (2, 2, None)]
    answers = spark.createDataFrame(rows, "id BIGINT, parentId BIGINT, body STRING")
    assert {r.id: r.text for r in concatenated(answers).collect()} == {1: "x  y", 2: ""}


def test_bitmap_keeps_all_that_are_asked_for(spark):
    asked = spark.range(0, 3000, 3).select(F.col("id").alias("parentId"))
    answers = spark.range(9000).select("id", (F.col("id") % 4000).alias("parentId"), F.lit("b").alias("body"))
    answers = answers.unionByName(spark.createDataFrame([(-1, None, "n")], "id BIGINT, parentId BIGINT, body STRING"))
    for bits in (1 << 15, 1 << 25):
        kept = selection.maybe_among(answers, asked, "parentId", bits)
        assert kept.columns == answers.columns
        exact = answers.join(asked, "parentId", "left_semi")
        assert exact.select(answers.columns).exceptAll(kept).count() == 0
        assert kept.filter("parentId IS NULL").count() == 0
    few = selection.maybe_among(answers, asked, "parentId")
    assert few.count() <= exact.count() * 1.01
    none = selection.maybe_among(answers, asked.filter("parentId < 0"), "parentId")
    assert none.count() == 0


def test_answers_are_filtered_before_their_texts_are_shuffled(spark, tmp_path):
    path = str(tmp_path / "posts")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        made = corpora_of(spark.read.parquet(path), prep=PREP)
        scans = {
            kind: sum(path in f for f in map(str, corpus.inputFiles())) for kind, corpus in made.items()
        }
        plan = made["QA"]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # titles and questions come from the staged questions; answers from one scan of the posts
    assert scans["QT"] == scans["Q"] == 0 and scans["QA"] > 0
    lines = plan.splitlines()
    posts_scans = [i for i, line in enumerate(lines) if "FileScan" in line and path[-20:] in line or f"{path}]" in line]
    assert len(posts_scans) == 1
    above = lines[: posts_scans[0]]
    depth = lines[posts_scans[0]].index("FileScan")
    semi = max(i for i, line in enumerate(above) if "BroadcastHashJoin" in line and "LeftSemi" in line)
    shuffles = [i for i, line in enumerate(above) if "Exchange hashpartitioning(parentId" in line]
    assert depth and shuffles and max(i for i in shuffles if i < semi) < semi
    assert documents(made["QA"])[4] == ["count", "row", "answer", "row"]


@pytest.mark.parametrize("stem", [False, True])
def test_stop_words_in_a_table_of_any_length(spark, parts, stem):
    asked, answered = parts
    listed = spark.createDataFrame([(" The ",), ("tables",), ("row",), ("",), (None,)], "word string")
    many = listed.union(spark.range(150_000).selectExpr("concat('zz', cast(id as string))"))
    prep = corpora.TextPrep(stop_words=("the", "tables", "row"), stem=stem)
    long = corpora.TextPrep(stop_words=many, stem=stem)
    for build in (corpora.title_corpus, corpora.question_corpus):
        assert build(asked, long).columns == build(asked, prep).columns
        assert documents(build(asked, long)) == documents(build(asked, prep))
    for most in (None, 1):
        want, got = (
            corpora.question_answer_corpus(asked, answered, p, most).collect() for p in (prep, long)
        )
        assert sorted(map(str, got)) == sorted(map(str, want))
    with pytest.raises(TypeError):
        long.document("title")


def test_listed_words_leave_by_position(spark):
    rows = [(1, 0, ["A", "b", "a", "c"]), (1, 1, ["a"]), (2, 0, []), (3, 0, None), (4, 0, ["b", "b"])]
    df = spark.createDataFrame(rows, "id long, part int, words array<string>")
    words = spark.createDataFrame([("a",), ("A",)], "w string")
    got = stop_words.remove_listed_words(df, "words", words, ["id", "part"])
    assert got.columns == df.columns
    assert {(r.id, r.part): r.words for r in got.collect()} == {
        (1, 0): ["b", "c"], (1, 1): [], (2, 0): [], (3, 0): None, (4, 0): ["b", "b"],
    }
    assert stop_words.remove_listed_words(df.limit(0), "words", words, ["id", "part"]).count() == 0
    assert stop_words.remove_listed_words(df, "words", words.limit(0), ["id", "part"]).count() == 5
