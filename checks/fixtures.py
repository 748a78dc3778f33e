"""Inputs derived from the given tables, as Spark plans over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOPICS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts in the dump's thirteen fields: a conversation's first user turn is the question,
    assistant turns are its answers, other turns are posts of a third kind."""
    talk = table(spark, sf_dir, "conversations")
    first = talk.filter("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("qturn"))
    return talk.join(first, "conv_id", "left").selectExpr(
        "conv_id * 100 + turn AS id",
        "CASE WHEN turn = qturn THEN 1 WHEN role = 'assistant' THEN 2 ELSE 3 END AS postTypeId",
        "CASE WHEN turn = qturn AND conv_id % 3 = 0 THEN conv_id * 100 + turn + 1 END"
        " AS acceptedAnswerId",
        "CASE WHEN turn <> qturn AND role = 'assistant' THEN conv_id * 100 + qturn END AS parentId",
        "CAST(concat(2010 + conv_id % 8, '-03-04 05:06:', lpad(turn % 60, 2, '0')) AS TIMESTAMP)"
        " AS creationDate",
        "CAST(conv_id * 7 % 40 - 10 AS INT) AS score",
        "CASE WHEN turn = qturn AND conv_id % 6 <> 0 THEN CAST(conv_id * 13 % 1000 AS INT) END"
        " AS viewCount",
        "concat('<p>', text, '</p>', CASE WHEN conv_id % 5 = 0 THEN '<pre>val x = 1</pre> tail'"
        " ELSE '' END) AS body",
        "CASE WHEN turn = qturn THEN text END AS title",
        "CASE WHEN turn = qturn THEN CASE conv_id % 4 WHEN 0 THEN '<apache-spark><scala>'"
        " WHEN 1 THEN '<pyspark-sql>' WHEN 2 THEN '<java>' ELSE '' END END AS tags",
        "CASE WHEN turn = qturn THEN CAST(conv_id % 5 AS INT) END AS answerCount",
        "CASE WHEN turn = qturn AND conv_id % 4 <> 1 THEN CAST(conv_id % 9 AS INT) END"
        " AS commentCount",
        "CASE WHEN turn = qturn AND conv_id % 3 = 0 THEN CAST(conv_id % 7 AS INT) END"
        " AS favoriteCount",
    )


def _escaped(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                        ("\n", "&#xA;"), ("\r", "&#xD;"), ("\t", "&#x9;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def dump_lines(posts: DataFrame) -> DataFrame:
    """``value``: every post as one ``<row …/>`` line of the dump; null fields are left out."""
    def attribute(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f' {name}="'), _escaped(value), F.lit('"')), F.lit(""))

    c = {n: F.col(n).cast("string") for n in posts.columns}
    c["creationDate"] = F.date_format("creationDate", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    cells = [attribute(n[0].upper() + n[1:], c[n]) for n in posts.columns]
    return posts.select(F.concat(F.lit("  <row"), *cells, F.lit(" />")).alias("value"))


def broken_lines(posts: DataFrame) -> DataFrame:
    """``value``: one malformed line per post, of a kind that depends on its id."""
    line = F.col("value")
    kinds = [
        F.regexp_replace(line, ' Id="', ' Id="x'),
        F.regexp_replace(line, ' Score="', ' Score=" '),
        F.regexp_replace(line, ' CreationDate="[^"]*"', ""),
        F.regexp_replace(line, " />$", ">"),
        F.regexp_replace(line, "T05:", "T25:"),
        F.concat(line, F.lit(" and more")),
        F.lit('<?xml version="1.0" encoding="utf-8"?>'),
        F.lit("<posts>"),
        F.lit("</posts>"),
        F.lit("junk"),
        F.regexp_replace(line, ' Id="', ' id="'),
    ]
    number = F.regexp_extract(line, ' Id="([0-9]+)"', 1).cast("bigint")
    chosen = F.element_at(F.array(*kinds), (number % len(kinds) + 1).cast("int"))
    return dump_lines(posts).select(chosen.alias("value"))


def distributions(spark: SparkSession, sf_dir: str, k: int = TOPICS) -> DataFrame:
    """``(id, weights)``: topic t has the sizes of all components of the embedding whose place
    leaves the remainder t when divided by ``k``."""
    def size(t: Column) -> Column:
        own = F.filter("embedding", lambda _, i: i % k == t)
        return F.aggregate(own, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))

    sizes = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.transform(F.sequence(F.lit(0), F.lit(k - 1)), size).alias("sizes"),
    )
    total = F.aggregate("sizes", F.lit(0.0), lambda a, x: a + x)
    return sizes.withColumn("total", total).select(
        "id", F.transform("sizes", lambda x: x / F.col("total")).alias("weights")
    )


def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the engagement numbers of a corpus, text in ``body``."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id",
        "CAST(n_chars % 50 - 10 AS INT) AS score",
        "CASE WHEN doc_id % 7 <> 0 THEN CAST(n_chars % 1000 AS INT) END AS viewCount",
        "concat(source, ' ', doc_id) AS title",
        "text AS body",
        "CAST(n_chars % 6 AS INT) AS answerCount",
        "CAST(n_chars % 11 AS INT) AS commentCount",
        "CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars % 4 AS INT) END AS favoriteCount",
    )
