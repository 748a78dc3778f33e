"""The registered queries: every operator of the library over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checks import fixtures as fx
from threadmine.functions import text, weights
from threadmine.functions.stem import stem_dictionary, stem_words
from threadmine.operators import corpus as corpora
from threadmine.operators import metrics, quality, reports, selection, terms, topics, vectors
from threadmine.plans.analysis import sweep_metrics
from threadmine.plans.modelling import model_corpus
from threadmine.session import fresh_path
from threadmine.sources import posts as dump
from threadmine.sources.corpus_files import read_corpus, write_corpus, write_corpus_csv
from threadmine.sources.wordlists import read_stop_words

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}

# A short general stop-word list for the checks; the library takes any list.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "with", "as", "was",
    "are", "be", "this", "have", "from", "or", "by", "not", "at", "but", "we", "an", "you",
    "de", "la", "que", "el", "en", "los", "et", "les", "des", "le", "der", "die", "und", "das",
)
PREP = corpora.TextPrep(stop_words=STOP_WORDS)
UNSTEMMED = corpora.TextPrep(stop_words=STOP_WORDS, stem=False)
MIN_DOCUMENTS = 3
TOP = 20
REPORT_TOPICS = 4
FIT = {"iterations": 5, "seed": 7}


def query(fn: Query) -> Query:
    REGISTERED[fn.__name__] = fn
    return fn


def _date(column: str = "creationDate") -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias("creationDate")


def _shown(posts: DataFrame) -> DataFrame:
    return posts.select(*[_date() if c == "creationDate" else c for c in posts.columns])


def _shown_corpus(corpus: DataFrame) -> DataFrame:
    shown = {"creationDate": _date(), "document": text.join_tokens("document").alias("document")}
    return corpus.select(*[shown.get(c, c) for c in corpora.CORPUS_COLUMNS])


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.since_year(fx.posts(spark, sf_dir))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.tagged_questions(_recent(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a corpus with ``document`` and ``removed`` columns."""
    source = fx.document_corpus(spark, sf_dir)
    prepared = source.withColumn("document", PREP.document(PREP.clean("body"))).drop("body")
    return corpora.without_domain_words(prepared)


# --- sources -----------------------------------------------------------------------------


@query
def posts_from_dump(spark, sf_dir):
    return _shown(dump.posts_from_lines(fx.dump_lines(fx.posts(spark, sf_dir))))


@query
def dump_line_validity(spark, sf_dir):
    posts = fx.posts(spark, sf_dir)
    lines = fx.dump_lines(posts).unionByName(fx.broken_lines(posts))
    checked = dump.parse_posts(lines)
    return checked.groupBy("valid").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.when(F.col("valid"), F.col("post.id"))).alias("id_sum"),
    )


@query
def dump_files_scan(spark, sf_dir):
    path = fresh_path(spark, "dump")
    posts = fx.posts(spark, sf_dir)
    fx.dump_lines(posts).unionByName(fx.broken_lines(posts)).write.text(path)
    return dump.read_posts(spark, path).groupBy("postTypeId").agg(
        F.count(F.lit(1)).alias("posts"),
        F.sum("score").alias("score_sum"),
        F.sum(F.length("body")).alias("body_characters"),
    )


@query
def staged_posts_by_year(spark, sf_dir):
    path = fresh_path(spark, "posts")
    staged = dump.stage_posts(fx.posts(spark, sf_dir), path)
    return (
        selection.since_year(staged, 2014)
        .groupBy(F.year("creationDate").alias("creation_year"))
        .agg(F.count(F.lit(1)).alias("posts"), F.count("tags").alias("tagged"))
    )


@query
def stop_word_file_scan(spark, sf_dir):
    path = fresh_path(spark, "words")
    words = text.word_rows(fx.table(spark, sf_dir, "benchmark"), text.tokenize("text", 1))
    words.select(F.concat("term", F.lit(" \r")).alias("value")).write.text(path)
    return read_stop_words(spark, path)


@query
def corpus_parquet_files(spark, sf_dir):
    path = fresh_path(spark, "corpus")
    write_corpus(corpora.question_corpus(_asked(spark, sf_dir), PREP), path)
    return _shown_corpus(read_corpus(spark, path))


@query
def corpus_csv_files(spark, sf_dir):
    path = fresh_path(spark, "csv")
    write_corpus_csv(corpora.question_corpus(_asked(spark, sf_dir), PREP), path)
    return spark.read.csv(path, schema="id BIGINT, doc STRING")


# --- selection ---------------------------------------------------------------------------


@query
def posts_since_2013(spark, sf_dir):
    return _recent(spark, sf_dir).select("id", F.year("creationDate").alias("creation_year"))


@query
def questions(spark, sf_dir):
    return selection.questions(fx.posts(spark, sf_dir)).select("id", "title", "tags")


@query
def answers(spark, sf_dir):
    return selection.answers(fx.posts(spark, sf_dir)).select("id", "parentId")


@query
def tagged_questions(spark, sf_dir):
    return _asked(spark, sf_dir).select("id", "tags")


@query
def answers_of_tagged_questions(spark, sf_dir):
    found = selection.answers_of(
        selection.answers(_recent(spark, sf_dir)), _asked(spark, sf_dir)
    )
    return found.select("id", "parentId", F.length("body").alias("body_characters"))


@query
def conditional_post_fields(spark, sf_dir):
    posts = dump.posts_from_lines(fx.dump_lines(fx.posts(spark, sf_dir)))
    optional = ("acceptedAnswerId", "parentId", "title", "tags", "viewCount", "answerCount",
                "commentCount", "favoriteCount")
    return posts.groupBy("postTypeId").agg(*[F.count(c).alias(c) for c in optional])


# --- text --------------------------------------------------------------------------------


@query
def clean_documents(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", text.clean_document("text").alias("cleaned")
    )


@query
def clean_pages(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select(
        "page_id", text.clean_document("html").alias("cleaned")
    )


@query
def cleaning_steps(spark, sf_dir):
    body = fx.posts(spark, sf_dir).select("id", "body")
    steps = {
        "controls": text.drop_control_characters("body"),
        "lowered": F.lower("body"),
        "code": text.drop_code_blocks("body"),
        "markup": text.drop_markup("body"),
        "numbers": text.drop_numbers("body"),
        "punctuation": text.drop_punctuation("body"),
    }
    return body.select("id", *[F.md5(c).alias(n) for n, c in steps.items()])


@query
def sql_functions(spark, sf_dir):
    text.register_sql_functions(spark)
    return fx.posts(spark, sf_dir).selectExpr(
        "id", "sparkRelated(tags) AS related", "cleanDocument(body) AS cleaned"
    )


@query
def document_tokens(spark, sf_dir):
    tokens = text.tokenize(text.clean_document("text"))
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", text.join_tokens(tokens).alias("tokens")
    )


@query
def tokens_without_stop_words(spark, sf_dir):
    words = text.remove_words(text.tokenize(text.clean_document("text")), STOP_WORDS)
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", text.join_tokens(words).alias("words")
    )


@query
def words_outside_benchmark(spark, sf_dir):
    words = text.word_rows(
        fx.table(spark, sf_dir, "documents"), text.tokenize("text"), "doc_id"
    )
    listed = text.word_rows(fx.table(spark, sf_dir, "benchmark"), text.tokenize("text"))
    kept = text.remove_words_by_join(words, listed)
    return kept.groupBy("doc_id").agg(F.count("term").alias("words"))


@query
def stems_of_terms(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(text.tokenize("text").alias("words"))
    return stem_dictionary(docs, "words")


@query
def stemmed_pages(spark, sf_dir):
    words = text.tokenize(text.clean_document("html"))
    return fx.table(spark, sf_dir, "pages").select(
        "page_id", text.join_tokens(stem_words(words)).alias("stems")
    )


@query
def domain_words_removed(spark, sf_dir):
    return _documents(spark, sf_dir).select("id", text.join_tokens("removed").alias("removed"))


# --- corpora -----------------------------------------------------------------------------


@query
def title_corpus(spark, sf_dir):
    return _shown_corpus(corpora.title_corpus(_asked(spark, sf_dir), PREP))


@query
def question_corpus(spark, sf_dir):
    return _shown_corpus(corpora.question_corpus(_asked(spark, sf_dir), PREP))


def _answers(spark, sf_dir):
    return selection.answers(_recent(spark, sf_dir))


@query
def answer_corpus(spark, sf_dir):
    return corpora.answer_corpus(_asked(spark, sf_dir), _answers(spark, sf_dir)).select(
        "id", "title", "cleaned"
    )


@query
def answer_corpus_per_answer(spark, sf_dir):
    return corpora.answer_corpus(
        _asked(spark, sf_dir), _answers(spark, sf_dir), per_answer=True
    ).select("id", "title", "cleaned")


@query
def question_answer_corpus(spark, sf_dir):
    return _shown_corpus(
        corpora.question_answer_corpus(_asked(spark, sf_dir), _answers(spark, sf_dir), PREP)
    )


@query
def question_answer_terms_of_spread_documents(spark, sf_dir):
    spread = corpora.question_answer_corpus(
        _asked(spark, sf_dir), _answers(spark, sf_dir), UNSTEMMED, max_answers=1
    )
    return terms.term_counts(spread, "document")


# --- terms -------------------------------------------------------------------------------


@query
def top_question_terms(spark, sf_dir):
    posts = dump.posts_from_lines(fx.dump_lines(fx.posts(spark, sf_dir)))
    asked = selection.tagged_questions(selection.since_year(posts))
    corpus = corpora.without_domain_words(corpora.question_corpus(asked, UNSTEMMED))
    return terms.top_terms(corpus, TOP)


@query
def corpus_size(spark, sf_dir):
    return terms.corpus_size(
        corpora.question_answer_corpus(
            _asked(spark, sf_dir), _answers(spark, sf_dir), UNSTEMMED, max_answers=1
        )
    )


@query
def term_frequency(spark, sf_dir):
    return terms.term_frequency(_documents(spark, sf_dir))


@query
def top_terms(spark, sf_dir):
    return terms.top_terms(_documents(spark, sf_dir), TOP)


@query
def document_frequency(spark, sf_dir):
    return terms.document_frequency(_documents(spark, sf_dir), MIN_DOCUMENTS)


@query
def document_frequency_of_spread_documents(spark, sf_dir):
    spread = corpora.question_answer_corpus(
        _asked(spark, sf_dir), _answers(spark, sf_dir), UNSTEMMED, max_answers=1
    )
    return terms.document_frequency(spread, 2, "document")


@query
def term_counts(spark, sf_dir):
    return terms.term_counts(_documents(spark, sf_dir))


@query
def vocabulary_size(spark, sf_dir):
    return terms.vocabulary_size(_documents(spark, sf_dir), MIN_DOCUMENTS)


@query
def count_vectors(spark, sf_dir):
    docs = _at_rest(spark, _documents(spark, sf_dir), fresh_path(spark, "corpus"))
    known = vectors.numbered_vocabulary(docs, MIN_DOCUMENTS)
    return vectors.vector_counts(vectors.count_vectors(docs, known), known)


@query
def numbered_terms(spark, sf_dir):
    return vectors.numbered_vocabulary(_documents(spark, sf_dir), MIN_DOCUMENTS)


@query
def saved_vectorizer(spark, sf_dir):
    base = fresh_path(spark, "vectorizer")
    fitted = topics.fit_vectorizer(_documents(spark, sf_dir), MIN_DOCUMENTS, as_table=True)
    topics.save_vectorizer(fitted, base, "D", 4)
    return topics.vocabulary_table(spark, topics.load_vectorizer(base, "D", 4))


# --- topic weights -----------------------------------------------------------------------


def _matrix(spark, sf_dir, values: Column) -> DataFrame:
    df = fx.distributions(spark, sf_dir).select("id", values.alias("values"))
    rounded = F.transform("values", lambda v: F.round(v, 9))
    return weights.spread_topics(df.select("id", rounded.alias("values")), "values", fx.TOPICS)


@query
def topic_membership(spark, sf_dir):
    return _matrix(spark, sf_dir, F.col("weights"))


@query
def topic_membership_rows(spark, sf_dir):
    rows = weights.topic_rows(fx.distributions(spark, sf_dir))
    return rows.withColumn("weight", F.round("weight", 9))


@query
def topic_membership_from_rows(spark, sf_dir):
    rows = weights.topic_rows(fx.distributions(spark, sf_dir))
    arrays = weights.topic_arrays(rows)
    rounded = F.transform("weights", lambda v: F.round(v, 9))
    return weights.spread_topics(arrays.select("id", rounded.alias("v")), "v", fx.TOPICS)


@query
def dominant_topic_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir, weights.dominant_weights("weights"))


@query
def dominant_topic_flags(spark, sf_dir):
    return _matrix(spark, sf_dir, weights.dominant_flags("weights"))


@query
def weights_above_threshold(spark, sf_dir):
    return _matrix(spark, sf_dir, weights.weights_from("weights"))


@query
def entropy_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir, weights.entropy_terms("weights"))


def _weighted(metric: str) -> Query:
    def run(spark, sf_dir):
        lean = metrics.lean_corpus(fx.document_corpus(spark, sf_dir))
        joined = fx.distributions(spark, sf_dir).join(lean, "id")
        values = weights.weighted_metric("weights", metrics.ENGAGEMENT[metric][0])
        rounded = F.transform(values, lambda v: F.round(v, 9))
        return weights.spread_topics(joined.select("id", rounded.alias("v")), "v", fx.TOPICS)

    return run


for _metric in metrics.ENGAGEMENT:
    REGISTERED[f"{_metric}_weighted_matrix"] = _weighted(_metric)


# --- topic metrics -----------------------------------------------------------------------

ROUNDED = 7


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.round(c, ROUNDED).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


@query
def corpus_totals(spark, sf_dir):
    return metrics.corpus_totals(fx.document_corpus(spark, sf_dir))


@query
def topic_metrics(spark, sf_dir):
    corpus = fx.document_corpus(spark, sf_dir)
    return _rounded(metrics.topic_metrics(fx.distributions(spark, sf_dir), corpus))


@query
def model_metrics(spark, sf_dir):
    return _rounded(metrics.model_metrics(fx.distributions(spark, sf_dir)))


@query
def model_metrics_single_winner(spark, sf_dir):
    tied = fx.distributions(spark, sf_dir).select(
        "id", F.transform("weights", lambda w: F.round(w, 1)).alias("weights")
    )
    return metrics.model_metrics(tied, single_winner=True).select("topic", "documents", "nddt")


def _wide(metric: str) -> Query:
    def run(spark, sf_dir):
        found = metrics.topic_metrics(
            fx.distributions(spark, sf_dir), fx.document_corpus(spark, sf_dir)
        )
        return _rounded(metrics.wide_metric(found, metric, fx.TOPICS))

    return run


for _metric in metrics.WIDE_NAMES:
    REGISTERED[f"{_metric}_by_topic"] = _wide(_metric)


# --- reports -----------------------------------------------------------------------------


def _described(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Topics as languages: term shares in the form a model describes its topics in."""
    docs = fx.table(spark, sf_dir, "documents")
    words = text.word_rows(docs, text.tokenize("text"), "lang")
    counted = words.groupBy("lang", "term").count()
    listed = counted.select("term").distinct().select(
        F.xxhash64("term").alias("termIndex"), "term"
    )
    total = counted.groupBy("lang").agg(F.sum("count").alias("total"))
    heaviest = W.partitionBy("lang").orderBy(F.desc("count"), "term")
    best = counted.withColumn("rank", F.row_number().over(heaviest)).filter(f"rank <= {TOP}")
    shares = best.join(total, "lang").select(
        "lang", "rank", F.xxhash64("term").alias("i"), F.try_divide("count", "total").alias("w")
    )
    lists = shares.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "i", "w"))).alias("l"))
    numbered = lists.withColumn("topic", F.row_number().over(W.orderBy("lang")) - 1)
    return numbered.select(
        "topic", F.transform("l", lambda x: x["i"]).alias("termIndices"),
        F.transform("l", lambda x: x["w"]).alias("termWeights"),
    ), listed


def _report(spark, sf_dir) -> DataFrame:
    described, listed = _described(spark, sf_dir)
    corpus = fx.document_corpus(spark, sf_dir)
    top = reports.top_documents(fx.distributions(spark, sf_dir, REPORT_TOPICS), 10)
    return reports.report_rows(
        topics.name_terms(described, listed), reports.with_titles(top, corpus)
    )


@query
def topic_terms_by_index(spark, sf_dir):
    described, listed = _described(spark, sf_dir)
    return _rounded(topics.name_terms(described, listed))


@query
def top_documents(spark, sf_dir):
    return _rounded(reports.top_documents(fx.distributions(spark, sf_dir), 10))


@query
def top_documents_with_titles(spark, sf_dir):
    top = reports.top_documents(fx.distributions(spark, sf_dir), 10)
    return _rounded(reports.with_titles(top, fx.document_corpus(spark, sf_dir)))


@query
def report_rows(spark, sf_dir):
    return _report(spark, sf_dir)


@query
def horizontal_report(spark, sf_dir):
    return reports.horizontal_report(_report(spark, sf_dir), REPORT_TOPICS)


@query
def vertical_report(spark, sf_dir):
    return reports.vertical_report(_report(spark, sf_dir))


# --- models ------------------------------------------------------------------------------


def _at_rest(spark, corpus: DataFrame, path: str) -> DataFrame:
    write_corpus(corpus, path)
    return read_corpus(spark, path)


def _fixed(spark, sf_dir):
    docs = _at_rest(spark, _documents(spark, sf_dir), fresh_path(spark, "corpus"))
    vectorizer = topics.fit_vectorizer(docs, MIN_DOCUMENTS, as_table=True)
    return vectorizer, topics.fix_rows(topics.vectorize(vectorizer, docs))


def _coverage(found: DataFrame) -> DataFrame:
    total = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)
    return found.select(
        "id", F.size("weights").alias("topics"), F.round(total, 6).alias("total_weight")
    )


def _judged(spark, sf_dir, optimizer: str) -> DataFrame:
    """Topics fitted on four fifths of the documents, and what they say about the last fifth."""
    docs = _at_rest(spark, _documents(spark, sf_dir), fresh_path(spark, "corpus"))
    train, held = docs.filter("id % 5 <> 0"), docs.filter("id % 5 = 0")
    known = vectors.numbered_vocabulary(train, MIN_DOCUMENTS).checkpoint()
    fixed = topics.fix_rows(vectors.count_vectors(train, known))
    fitted = topics.fit_topics(fixed, 4, optimizer, **FIT)
    shares = topics.term_shares(fitted, known).checkpoint()

    seen, unseen = quality.halves(held)
    inferred = topics.inferred_distributions(fitted.model, vectors.count_vectors(seen, known))
    score = quality.held_out_likelihood(unseen, inferred, shares, quality.unigram(known))

    best = topics.heaviest_terms(shares, TOP).withColumn(
        "before", F.lag("weight").over(W.partitionBy("topic").orderBy("rank"))
    )
    shape = best.join(known.select("term", F.lit(True).alias("known")), "term", "left").groupBy("topic").agg(
        F.count("term").alias("terms"),
        F.every(F.coalesce(F.col("before") >= F.col("weight"), F.lit(True))).alias("weights_fall"),
        F.every((F.col("weight") > 0) & (F.col("weight") <= 1)).alias("weights_in_range"),
        (F.count_distinct("term") == F.count("term")).alias("terms_distinct"),
        F.every(F.coalesce("known", F.lit(False))).alias("terms_known"),
    )
    return shape.crossJoin(  # one row
        score.select(
            F.col("words").alias("held_out_words"),
            F.round("unigram_log_likelihood", 3).alias("unigram_log_likelihood"),
            (F.col("topic_log_likelihood") > F.col("unigram_log_likelihood")).alias("better"),
        )
    )


@query
def em_topics(spark, sf_dir):
    return _judged(spark, sf_dir, "em")


@query
def em_distributions(spark, sf_dir):
    _, fixed = _fixed(spark, sf_dir)
    return _coverage(topics.distributions(topics.fit_topics(fixed, 4, "em", **FIT)))


@query
def online_topics(spark, sf_dir):
    return _judged(spark, sf_dir, "online")


@query
def online_distributions(spark, sf_dir):
    _, fixed = _fixed(spark, sf_dir)
    return _coverage(topics.distributions(topics.fit_topics(fixed, 4, "online", **FIT)))


def _sweep(spark, sf_dir):
    corpus = _documents(spark, sf_dir).drop("removed")
    base = fresh_path(spark, "models")
    corpus = _at_rest(spark, corpus, f"{base}/CorpusD.parquet")
    runs = list(
        model_corpus(corpus, "D", base, range(3, 6, 2), min_documents=MIN_DOCUMENTS, **FIT)
    )
    return corpus, base, runs


@query
def sweep_statistics(spark, sf_dir):
    _, _, runs = _sweep(spark, sf_dir)
    rows = runs[0].statistics
    for run in runs[1:]:
        rows = rows.unionByName(run.statistics)
    return _rounded(rows.drop("seconds"))


@query
def sweep_reports(spark, sf_dir):
    """The rows of the reports, and whether their labels have the right form and title."""
    _, _, runs = _sweep(spark, sf_dir)
    rows = [r.report.select(F.lit(r.fitted.k).alias("k"), "*") for r in runs]
    term = F.col("label").rlike(r"^[a-z0-9_]{2,} \([01]\.[0-9]{3}\)$") & (F.col("label") == F.col("detail"))
    document = F.col("label").rlike(r"^([0-9]+) : \S+ \1 : [01]\.[0-9]{4}$")
    return rows[0].unionByName(rows[1]).select(
        "k", "topic", "kind", "rank",
        F.when(F.col("kind") == "term", term).otherwise(document).alias("well_labelled"),
    )


@query
def metrics_of_saved_models(spark, sf_dir):
    """All metrics, held against bounds that hold for any topics."""
    corpus, base, runs = _sweep(spark, sf_dir)
    found = sweep_metrics(corpus, "D", base, [r.fitted.k for r in runs])
    totals = metrics.corpus_totals(corpus)
    every = W.partitionBy("k")
    n = F.col("documents")

    def near(x: Column, y: Column) -> Column:
        return F.abs(x - y) < 1e-9

    engaged = [
        (F.col(f"{name}_sum").between(0, F.col(total)))
        & near(F.col(f"{name}_share") * F.col(total), F.col(f"{name}_sum"))
        for name, (_, total) in metrics.ENGAGEMENT.items()
        if name != "score"  # may be negative
    ]
    return found.crossJoin(totals).select(  # one row
        "k", "topic", "documents",
        (F.col("nddt").between(0, n) & near(F.col("pddt"), F.col("nddt") / n)).alias("nddt_holds"),
        (F.sum("nddt").over(every) >= n).alias("every_document_dominated"),
        (F.col("impact").between(0, n) & near(F.col("share"), F.col("impact") / n)).alias("impact_holds"),
        (F.sum("impact").over(every) <= n + 1e-6).alias("weights_within_documents"),
        # -w log10 w is 1 / (e ln 10) at most
        F.col("entropy").between(0, n * 0.16).alias("entropy_holds"),
        reduce(lambda a, b: a & b, engaged).alias("engagement_holds"),
        near(F.col("score_share") * F.col("Scores"), F.col("score_sum")).alias("score_holds"),
    )


@query
def reloaded_model_topics(spark, sf_dir):
    """Terms of the model as it was read back, next to those of the report made at its fit."""
    _, base, runs = _sweep(spark, sf_dir)
    known = topics.vocabulary_table(spark, topics.load_vectorizer(base, "D", 3))
    described = topics.load_model(base, "D", 3).describeTopics(TOP)
    read_back = topics.name_terms(described, known)
    shares = topics.term_shares(runs[0].fitted, known, runs[0].path)
    reported = topics.heaviest_terms(shares, TOP).select(
        "topic", "rank", F.col("weight").alias("reported")
    )
    both = read_back.join(known.select("term", "termIndex"), "term").join(reported, ["topic", "rank"])
    return both.groupBy("topic").agg(
        F.count("term").alias("terms"),
        F.count("termIndex").alias("known_terms"),
        F.every(F.abs(F.col("weight") - F.col("reported")) < 1e-9).alias("as_reported"),
    )
