"""Vectors, LDA models and what is read off them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.ml.clustering import LDA, DistributedLDAModel, LDAModel, LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmine.operators.em import EmFit, fit_em
from threadmine.operators.terms import MIN_DOCUMENTS, vocabulary, vocabulary_size
from threadmine.operators.vectors import count_vectors, numbered_vocabulary, row_vectors
from threadmine.session import ensure_checkpoints, fresh_path
from threadmine.sources.versions import current_version, save_version

CHECKPOINT_INTERVAL = 50
#: Terms that one model can hold.
MODEL_TERMS = 1 << 18
#: Term counts in a partition of the rows that a fit reads: it makes an object of each.
PART_CELLS = 1 << 20
#: Bytes of a saved graph that one task reads: about ``PART_CELLS`` edges.
PART_BYTES = 1 << 22


# --- vectors ---------------------------------------------------------------------------


@dataclass(frozen=True)
class TableVectorizer:
    """Term-count vectorizer whose vocabulary, of any length, is a table at rest.

    ``terms`` has ``(termIndex, term)``.
    """

    terms: DataFrame
    words: str = "removed"

    @property
    def vocabulary(self) -> list[str]:
        """The terms on the driver: at most ``MODEL_TERMS`` of them."""
        rows = self.terms.orderBy("termIndex").limit(MODEL_TERMS + 1).collect()
        if len(rows) > MODEL_TERMS:
            raise ValueError(f"more than {MODEL_TERMS} terms: read them from the table")
        return [r.term for r in rows]

    def getInputCol(self) -> str:
        return self.words

    def setInputCol(self, words: str) -> TableVectorizer:
        return replace(self, words=words)


Vectorizer = CountVectorizerModel | TableVectorizer


def fit_vectorizer(
    corpus: DataFrame, min_documents: int = MIN_DOCUMENTS, limit: int | None = None,
    words: str = "removed", as_table: bool = False,
) -> Vectorizer:
    """Term-count vectorizer whose terms are ordered by count, then alphabetically.

    The vocabulary is the only thing that reaches the driver. A model holds it whole, so more
    than ``MODEL_TERMS`` terms are an error; ``limit`` asks for the most frequent ones only.
    With ``as_table`` nothing reaches the driver: the vocabulary is numbered and kept as a table,
    whatever its length.
    """
    if as_table:
        spark = corpus.sparkSession
        path = fresh_path(spark, "terms")
        numbered = numbered_vocabulary(corpus, min_documents, limit, words)
        numbered.select("termIndex", "term").write.parquet(path)
        return TableVectorizer(spark.read.parquet(path), words)
    found = vocabulary(corpus, min_documents, limit, words)
    terms = [r.term for r in found.limit(MODEL_TERMS + 1).collect()]
    if len(terms) > MODEL_TERMS:
        size = vocabulary_size(corpus, min_documents, words).first().terms
        raise ValueError(
            f"{size} terms are too many for one model ({MODEL_TERMS} at most): "
            "raise min_documents, give a limit or ask for a table"
        )
    return CountVectorizerModel.from_vocabulary(
        terms, inputCol=words, outputCol="features", minTF=1.0
    )


def vectorize(vectorizer: Vectorizer, corpus: DataFrame) -> DataFrame:
    """``(id, features)``, one row per document; parts of spread documents are added up."""
    if "part" in corpus.columns:
        terms = vocabulary_table(corpus.sparkSession, vectorizer)
        return count_vectors(corpus, terms, vectorizer.getInputCol())
    if isinstance(vectorizer, TableVectorizer):
        return row_vectors(corpus, vectorizer.terms, vectorizer.words)
    return vectorizer.transform(corpus).select("id", "features")


def save_vectorizer(vectorizer: Vectorizer, base: str, corpus_id: str, k: int) -> str:
    path = f"{base.rstrip('/')}/vectorizer-{corpus_id}-{k}"
    if not isinstance(vectorizer, TableVectorizer):
        vectorizer.write().overwrite().save(path)
        return path
    spark = vectorizer.terms.sparkSession

    def write(folder: str) -> None:
        vectorizer.terms.write.parquet(f"{folder}/terms")
        words = spark.createDataFrame([(vectorizer.words,)], "words STRING")
        words.coalesce(1).write.parquet(f"{folder}/settings")

    save_version(spark, path, write)
    return path


def load_vectorizer(base: str, corpus_id: str, k: int) -> Vectorizer:
    spark = SparkSession.active()
    path = f"{base.rstrip('/')}/vectorizer-{corpus_id}-{k}"
    folder = current_version(spark, path)
    if folder == path:  # a model saved whole has no versions
        return CountVectorizerModel.load(path)
    words = spark.read.parquet(f"{folder}/settings").first().words
    return TableVectorizer(spark.read.parquet(f"{folder}/terms"), words)


# --- models ----------------------------------------------------------------------------


def prior_defaults(optimizer: str, k: int, alpha: float = -1, beta: float = -1):
    """Document and topic concentration; -1 stands for the optimizer's default."""
    if optimizer == "em":
        defaults = (50.0 / k + 1.0, 1.01)
    elif optimizer == "online":
        defaults = (1.0 / k, 1.0 / k)
    else:
        raise ValueError(f"unknown optimizer: {optimizer}")
    return tuple(d if given == -1 else given for given, d in zip((alpha, beta), defaults))


@dataclass(frozen=True)
class TopicModel:
    """A fitted model with the settings of its fit.

    ``documents`` maps the row numbers that an em model knows its documents by to ids.
    """

    fit: LDAModel | EmFit
    optimizer: str
    k: int
    alpha: float
    beta: float
    iterations: int
    vectors: DataFrame
    documents: DataFrame

    @property
    def model(self) -> LDAModel:
        """Spark's model. That of an em fit is written and read the first time it is asked for."""
        if isinstance(self.fit, EmFit):
            with _small_splits(self.vectors.sparkSession):
                return self.fit.model
        return self.fit


def fix_rows(vectors: DataFrame) -> DataFrame:
    """Checkpointed vectors: every fit and look-up sees the same rows in the same order.

    A fit turns each partition into a part of a graph in one task's memory, so partitions are
    cut to about ``PART_CELLS`` term counts, however few files the vectors came from.
    """
    ensure_checkpoints(vectors.sparkSession)
    fixed = vectors.checkpoint()
    cells = F.size(F.unwrap_udt("features")["values"])
    parts = math.ceil((fixed.agg(F.sum(cells)).first()[0] or 0) / PART_CELLS)
    if parts <= fixed.rdd.getNumPartitions():
        return fixed
    return fixed.repartition(parts).checkpoint()


def _numbered(fixed: DataFrame) -> DataFrame:
    return fixed.select(F.monotonically_increasing_id().alias("row"), "id")


def fit_topics(
    fixed: DataFrame, k: int, optimizer: str = "em", iterations: int = 100,
    alpha: float = -1, beta: float = -1, seed: int | None = None,
) -> TopicModel:
    """Fit LDA on the output of :func:`fix_rows`."""
    doc_prior, topic_prior = prior_defaults(optimizer, k, alpha, beta)
    lda = LDA(
        featuresCol="features", k=k, optimizer=optimizer, maxIter=iterations,
        docConcentration=[doc_prior], topicConcentration=topic_prior,
        checkpointInterval=CHECKPOINT_INTERVAL, optimizeDocConcentration=False, seed=seed,
    )
    if optimizer == "em":
        fit = fit_em(fixed, lda, k, iterations, doc_prior, topic_prior, CHECKPOINT_INTERVAL)
    else:
        fit = lda.fit(fixed)
    return TopicModel(
        fit, optimizer, k, doc_prior, topic_prior, iterations, fixed, _numbered(fixed)
    )


def topic_sweep(
    fixed: DataFrame, smallest: int = 20, largest: int = 60, step: int = 10, **settings
) -> Iterator[TopicModel]:
    """One model for each number of topics from ``smallest`` to ``largest``."""
    for k in range(smallest, largest + 1, step):
        yield fit_topics(fixed, k, **settings)


def model_path(base: str, corpus_id: str, k: int) -> str:
    return f"{base.rstrip('/')}/ldaModel-{corpus_id}-{k}"


def save_model(fitted: TopicModel, base: str, corpus_id: str) -> str:
    """Replace the model saved for this corpus and number of topics.

    The model and the row table of an em model become current together: see ``save_version``.
    """
    path = model_path(base, corpus_id, fitted.k)

    def write(folder: str) -> None:
        if isinstance(fitted.fit, EmFit):
            fitted.fit.save(f"{folder}/model")
        else:
            fitted.fit.write().save(f"{folder}/model")
        if fitted.optimizer == "em":
            fitted.documents.write.parquet(f"{folder}/documents")

    save_version(fitted.vectors.sparkSession, path, write)
    return path


def load_model(base: str, corpus_id: str, k: int, optimizer: str = "em") -> LDAModel:
    return read_model(SparkSession.active(), model_path(base, corpus_id, k), optimizer)


def read_model(spark: SparkSession, path: str, optimizer: str = "em") -> LDAModel:
    """The current model of what :func:`save_model` returned."""
    reader = DistributedLDAModel if optimizer == "em" else LocalLDAModel
    with _small_splits(spark):
        return reader.load(f"{current_version(spark, path)}/model")


@contextmanager
def _small_splits(spark: SparkSession) -> Iterator[None]:
    """Files are read in splits of ``PART_BYTES``. A saved graph is compressed to few bytes an
    edge, and Spark makes an object of each edge of a split."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(PART_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


# --- what a model says -----------------------------------------------------------------


def _vertices(spark: SparkSession, path: str) -> DataFrame | None:
    """``(id, counts)`` of an em model's graph, or None if it was saved in another layout.

    Documents have row numbers from 0 up; term t has the id -t - 1.
    """
    try:
        vertices = spark.read.parquet(f"{current_version(spark, path)}/model/oldModel/data/topicCounts")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    types = dict(vertices.dtypes)
    if types.get("id") != "bigint" or "topicWeights" not in types:
        return None
    return _counts(vertices)


def _counts(vertices: DataFrame) -> DataFrame:
    return vertices.select("id", vector_to_array("topicWeights").alias("counts"))


def _weights_of_vertices(vertices: DataFrame, documents: DataFrame) -> DataFrame:
    total = F.aggregate("counts", F.lit(0.0), lambda a, c: a + c)
    weights = vertices.filter(F.col("id") >= 0).withColumn("total", total).select(
        F.col("id").alias("row"),
        F.transform("counts", lambda c: F.try_divide(c, F.col("total"))).alias("weights"),
    )
    return documents.join(weights, "row").select("id", "weights")


def saved_distributions(
    spark: SparkSession, path: str, vectors: Callable[[], DataFrame] | None = None
) -> DataFrame:
    """``(id, weights)`` an em model arrived at for its own documents.

    ``path`` is what :func:`save_model` returned. A document without any vocabulary term has no
    row. The weights are read from the saved graph. That layout is no public contract: if it is
    another one, topics are inferred for ``vectors()``, the vectors of the documents.
    """
    vertices = _vertices(spark, path)
    if vertices is None:
        if vectors is None:
            raise ValueError(f"unexpected layout of the model in {path}, and no vectors to infer from")
        return inferred_distributions(read_model(spark, path), vectors())
    documents = spark.read.parquet(f"{current_version(spark, path)}/documents")
    return _weights_of_vertices(vertices, documents)


def inferred_distributions(model: LDAModel, vectors: DataFrame) -> DataFrame:
    """``(id, weights)`` inferred for any vectors; documents without terms are left out."""
    weights = vector_to_array("topicDistribution").alias("weights")
    return (
        model.transform(vectors)
        .select("id", weights)
        .filter(F.exists("weights", lambda w: w > 0))
    )


def distributions(fitted: TopicModel, saved: str | None = None) -> DataFrame:
    """Topic weights of the documents the model was fitted on. ``saved`` is the path of an em
    model that is saved already."""
    if fitted.optimizer != "em":
        return inferred_distributions(fitted.model, fitted.vectors)
    if saved is None and isinstance(fitted.fit, EmFit):
        return _weights_of_vertices(_counts(fitted.fit.counts()), fitted.documents)
    spark = fitted.vectors.sparkSession
    path = saved or save_model(fitted, fresh_path(spark, "em"), "fit")
    return saved_distributions(spark, path, lambda: fitted.vectors)


def vocabulary_table(spark: SparkSession, vectorizer: Vectorizer) -> DataFrame:
    """``(termIndex, term)``: the table itself, or one as long as the vocabulary limit at most."""
    if isinstance(vectorizer, TableVectorizer):
        return vectorizer.terms
    terms = pa.array(vectorizer.vocabulary, pa.string())
    return spark.createDataFrame(
        pa.table({"termIndex": pa.array(range(len(terms)), pa.int32()), "term": terms})
    )


def name_terms(described: DataFrame, terms: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(topic, rank, term, weight)`` from topics given as arrays of term indices."""
    pairs = F.arrays_zip("termIndices", "termWeights")
    flat = described.select(
        (F.col("topic") + 1).alias("topic"), F.posexplode(pairs).alias("at", "pair")
    ).select(
        "topic", (F.col("at") + 1).alias("rank"),
        F.col("pair.termIndices").alias("termIndex"), F.col("pair.termWeights").alias("weight"),
    )
    return flat.join(terms, "termIndex").select("topic", "rank", "term", "weight", *keep)


def topic_terms(model: LDAModel, vectorizer: Vectorizer, n: int = 20) -> DataFrame:
    """The ``n`` heaviest terms of every topic, topics and ranks counting from 1."""
    described = model.describeTopics(n)
    return name_terms(described, vocabulary_table(described.sparkSession, vectorizer))


def term_shares(fitted: TopicModel, terms: DataFrame, saved: str | None = None) -> DataFrame:
    """``(termIndex, term, shares)``: the share of each topic that the term makes up.

    ``terms`` has ``(termIndex, term)``. For an em model they come from the term vertices of
    its saved graph, a table. An online model is a matrix on the driver already.
    """
    spark = fitted.vectors.sparkSession
    if fitted.optimizer == "em":
        if saved is None and isinstance(fitted.fit, EmFit):
            vertices = _counts(fitted.fit.counts())
        else:
            path = saved or save_model(fitted, fresh_path(spark, "em"), "fit")
            vertices = _vertices(spark, path)
        if vertices is not None:
            return _shares_of_vertices(vertices, fitted.k).join(terms, "termIndex").select(
                "termIndex", "term", "shares"
            )
    described = fitted.model.describeTopics(fitted.model.vocabSize())
    rows = name_terms(described, terms.select("termIndex", "term"), keep=("termIndex",))
    by_topic = F.transform(F.array_sort(F.collect_list(F.struct("topic", "weight"))), lambda t: t["weight"])
    return rows.groupBy("termIndex", "term").agg(by_topic.alias("shares"))


def _shares_of_vertices(vertices: DataFrame, k: int) -> DataFrame:
    terms = vertices.filter(F.col("id") < 0)
    totals = [F.sum(F.get("counts", F.lit(i))) for i in range(k)]
    total = terms.agg(F.array(*totals).alias("totals")).scalar()
    return terms.withColumn("totals", total).select(
        (-F.col("id") - 1).cast("int").alias("termIndex"),
        F.zip_with("counts", "totals", lambda c, n: F.try_divide(c, n)).alias("shares"),
    )


def heaviest_terms(shares: DataFrame, n: int = 20) -> DataFrame:
    """``(topic, rank, term, weight)``: the ``n`` heaviest terms of every topic, topics and ranks
    counting from 1, ties by term number. Every task cuts its rows to ``n`` per topic before
    anything is shuffled."""
    rows = shares.select("termIndex", "term", F.posexplode("shares").alias("at", "weight"))
    order = W.partitionBy("at").orderBy(F.desc("weight"), "termIndex")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.select((F.col("at") + 1).alias("topic"), "rank", "term", "weight")
