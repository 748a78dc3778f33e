"""Registered queries of the training-data operators, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmine.llm import (
    exact,
    language,
    minhash,
    mixing,
    negatives,
    packing,
    quotes,
    repair,
    repeats,
    search,
    sharding,
    simhash,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)
    )


@query
def op2_temperature_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", *[c for c in mixed.columns if "mixing_" in c])


@query
def op3_quotation_linking(spark, sf_dir):
    return quotes.reply_order(table(spark, sf_dir, "conversations"))


@query
def op4_block_max_search(spark, sf_dir):
    """Queries are all documents whose id is divisible by 100, against all documents."""
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.filter("doc_id % 100 = 0"))


@query
def op5_simhash_pigeonring(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_sampled_splitters(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query
def op7_suffix_radix_sort(spark, sf_dir):
    return repeats.removal_report(table(spark, sf_dir, "documents"))


@query
def op8_nonnegative_pu(spark, sf_dir):
    return toxicity.score_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


@query
def op9_minhash(spark, sf_dir):
    """Fingerprints, and classes by signature bands and verified Jaccard similarity."""
    return minhash.fingerprint_report(table(spark, sf_dir, "documents"))


@query
def op10_recurrent_language_id(spark, sf_dir):
    return language.predict_languages(table(spark, sf_dir, "documents"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the damage that a checksum of conversation and turn picks; nulls are a space."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    pick = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    hurt = conversations.select(
        "conv_id",
        "turn",
        pick.alias("pick"),
        F.when(pick == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(pick == 1, F.lit(""))
        .when(pick == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text)
        .alias("text"),
    )
    times = F.when(F.col("pick") == 0, 0).when(F.col("pick") == 3, 2).otherwise(1)
    return hurt.withColumn("copy", F.explode(F.array_repeat(F.lit(0), times))).drop("copy", "pick")


@query
def op11_rank_convergence_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return repair.with_empty(repair.repair_report(damaged(conversations)), conversations)


@query
def op12_strassen_negatives(spark, sf_dir):
    """Labels of every seventh vector move on by one; every hundredth is an anchor."""
    moved = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "embedding",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10)
        .otherwise(F.col("label"))
        .alias("label"),
    )
    return negatives.hard_negatives(moved, F.col("id") % 100 == 0)


ORACLES["op12_strassen_negatives"] = """WITH whole AS (
  SELECT row_number() OVER () AS place, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.place, a.vec_id AS anchor_id, b.place AS other, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM whole a, whole b WHERE a.vec_id % 100 = 0 AND a.place <> b.place
),
positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY place ORDER BY score DESC, id NULLS LAST, other) <= 5
)
SELECT p.anchor_id, p.id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.place, p.other ORDER BY n.score DESC, n.id NULLS LAST, n.other)
    AS INT) AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.place = p.place AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5"""


@query
def op13_tree_merged_runs(spark, sf_dir):
    return exact.duplicate_report(table(spark, sf_dir, "documents"))


ORACLES["op13_tree_merged_runs"] = r"""WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER same = 1 AS kept, sha256(body) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST)"""
