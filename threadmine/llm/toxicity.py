"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positive class; all other training documents count as
unlabelled. A linear model over the words and word beginnings that a document has, those
whose share of documents clearly differs between the two samples, is trained in numpy on the
class-prior-corrected risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),

with the logistic loss: the unlabelled risk, less the share of it that hidden positives
cause, may not become negative.

The model is fitted on bounded samples (``POSITIVES``, ``UNLABELLED`` documents on average,
``VOCABULARY`` words); class prior and scores cover all rows. Executors need this package.

Defined results: a null or empty text, or one without a known word, has the score of the
bias alone; a null id is never learned from; ids labelled more than once are toxic if any of
their labels says so; without any positive every score is 0; rows that repeat are scored each;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmine.llm.memory import released
from threadmine.llm.naming import drawn

POSITIVES = 3_000
UNLABELLED = 9_000
VOCABULARY = 1 << 14
MIN_DOCUMENTS = 5
#: Standard errors by which a word's shares in the two samples must differ.
CLEARLY = 7
#: Smaller weights are dropped.
LEAST = 0.1
STEPS = 250
RATE = 0.05
DECAY = 2e-3
SEED = 11
#: A document with this score or more is called toxic.
THRESHOLD = 0.5

#: Letters lower-cased; other ASCII characters separate words. Bytes from 128 on are kept.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def features(text: str | None) -> set[bytes]:
    """The distinct words of a text, and the first four bytes of the longer ones."""
    words = set((text or "").encode().translate(_LETTERS).split())
    return words | {b"^" + w[:4] for w in words if len(w) > 4}


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]
    bias: float

    def score(self, text: str | None) -> float:
        known = self.weights
        logit = self.bias + sum([known[w] for w in features(text) if w in known])
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def in_fold(column: str = "doc_id", folds: int = 5) -> Column:
    """Number of the row's fold by the checksum of its id; a null id is in fold 0."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds


def _share(column: str, share: float, salt: int) -> Column:
    """Whether the row is among a drawn ``share`` of all."""
    u = F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return u < F.lit(share)


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [list(features(t)) for t in batch.column(1).to_pylist()]
        yield pa.record_batch(
            [batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["toxic", "words"]
        )


def fit_risk(
    rows: list[np.ndarray], positive: np.ndarray, width: int, prior: float
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk. ``rows`` hold feature numbers."""
    sizes = np.array([len(r) for r in rows])
    doc = np.repeat(np.arange(len(rows)), sizes)
    feature = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    w, b = np.zeros(width), 0.0
    moments = np.zeros((2, width + 1))
    for step in range(1, STEPS + 1):
        logit = b + np.bincount(doc, w[feature], len(rows))
        p = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
        loss_minus = np.logaddexp(0, logit)  # of calling a row positive
        corrected = loss_minus[~positive].sum() / n_u - prior * loss_minus[positive].sum() / n_p
        g_plus = np.where(positive, prior * (p - 1) / n_p, 0.0)
        g_minus = np.where(positive, -prior * p / n_p, p / n_u)
        # Below zero the correction is undone instead of being driven on.
        g = g_plus + g_minus if corrected >= 0 else -g_minus
        grad = np.append(np.bincount(feature, g[doc], width) + DECAY * prior * w, g.sum())
        moments[0] += 0.1 * (grad - moments[0])
        moments[1] += 0.01 * (grad**2 - moments[1])
        move = moments[0] / (1 - 0.9**step) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w, b = w - RATE * move[:-1], b - RATE * move[-1]
    return w, float(b)


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", held_out: int = 0
) -> Model | None:
    """Model from the rows outside fold ``held_out``; None if there is no positive."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & (in_fold() != held_out))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .filter(F.col("toxic").isNotNull())
    )
    counts = known.agg(F.count("*"), F.sum("toxic")).first()
    if not counts[1]:
        return None
    prior = min(0.5, counts[1] / counts[0])
    share = min(1.0, POSITIVES / counts[1])
    chosen = known.filter((F.col("toxic") == 1) & _share("doc_id", share, SEED)).select("doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull() & (in_fold() != held_out))
    total = max(1, docs.count())
    # About POSITIVES ids, and rows drawn before the join: both sides are bounded. The rows
    # of an id are counted too, so that one with very many does not come whole.
    positives = rows.join(F.broadcast(chosen), "doc_id", "left_semi")
    most = min(1.0, POSITIVES / max(1, positives.count()))
    toxic = drawn(positives, most, SEED).select(F.lit(1).alias("toxic"), "text")
    others = drawn(rows, min(1.0, UNLABELLED / total), SEED + 1)
    other = others.join(known.filter("toxic = 1"), "doc_id", "left_anti").select(
        F.lit(0).alias("toxic"), "text"
    )
    sets = toxic.unionByName(other).mapInArrow(released(_word_sets), "toxic int, words array<binary>")
    sets = sets.persist()
    sizes = {r.toxic: r["count"] for r in sets.groupBy("toxic").count().collect()}
    n_toxic, n_other = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    ratio = F.col("count") / (n_toxic + n_other)
    error = F.sqrt(ratio * (1 - ratio) * (1 / n_toxic + 1 / n_other))
    apart = F.abs(F.col("toxic") / n_toxic - (F.col("count") - F.col("toxic")) / n_other)
    telling = (
        sets.select("toxic", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("count"), F.sum("toxic").alias("toxic"))
        .filter((F.col("count") >= MIN_DOCUMENTS) & (apart >= CLEARLY * error))
        .orderBy(F.desc(apart / (error + 1e-9)), "word")
        .limit(VOCABULARY)
        .collect()
    )
    numbers = {bytes(r.word): i for i, r in enumerate(telling)}

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                sorted(numbers[w] for w in own if w in numbers)
                for own in batch.column(1).to_pylist()
            ]
            yield pa.record_batch(
                [batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["toxic", "features"]
            )

    sample = sets.mapInArrow(released(indexed), "toxic int, features array<int>").toPandas()
    sets.unpersist()
    # The order of rows changes sums in their last digits only; sorting fixes even those.
    sample = sample.assign(key=sample["features"].map(lambda f: np.asarray(f).tobytes()))
    sample = sample.sort_values(["toxic", "key"], ignore_index=True)
    w, b = fit_risk(
        [np.asarray(f) for f in sample["features"]],
        (sample["toxic"] == 1).to_numpy(),
        len(numbers),
        prior,
    )
    # Very long texts have many words of next to no weight, which would add up.
    return Model({word: float(w[i]) for word, i in numbers.items() if abs(w[i]) >= LEAST}, b)


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: likelier toxic) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # VOCABULARY words at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(shared.value, batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text))
    return rows.mapInArrow(released(work), "doc_id long, score double")


def _scores(model: Model | None, texts: pa.Array) -> np.ndarray:
    return np.array([model.score(t) if model else 0.0 for t in texts.to_pylist()], np.float64)


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    return score(docs, train(docs, labels, text), text).select(
        "doc_id",
        (in_fold() == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that the model does not call toxic."""
    column = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(shared.value, batch.column(column))
            yield batch.filter(pa.array(scores < THRESHOLD))

    return docs.mapInArrow(released(work), docs.schema)
