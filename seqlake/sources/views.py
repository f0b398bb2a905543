"""Sequences that tables hold, as (seq_id, letters) or (seq_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed letters of event types; the alphabet's size.
EVENTS = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
BASKET_LETTERS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(rows: DataFrame, key: str, letter: F.Column, *order: str) -> DataFrame:
    """(seq_id, letters): the letters of each key's rows in a given order."""
    listed = F.sort_array(F.collect_list(F.struct(*order, letter.alias("letter"))))
    return rows.groupBy(F.col(key).alias("seq_id")).agg(listed.getField("letter").alias("letters"))


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.create_map(*(F.lit(x) for pair in EVENTS.items() for x in pair))[F.col("event_type")]
    return sequences(table(spark, sf_dir, "events"), "user_id", letter, "ts", "event_id")


def basket_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = (1 + F.col("l_partkey") % BASKET_LETTERS).cast("int")
    return sequences(table(spark, sf_dir, "lineitem"), "l_suppkey", letter, "l_orderkey", "l_linenumber", "l_partkey")


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), "text")


def benchmark_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), "text")


def probability_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, pos, probs): embeddings as class probabilities; a label's vectors in the order of vec_id are a sequence."""
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    probs = F.transform("embedding", lambda x: F.abs(x.cast("double")) / F.col("total"))
    return table(spark, sf_dir, "embeddings").withColumn("total", size).select(F.col("label").alias("seq_id"), F.col("vec_id").alias("pos"), probs.alias("probs"))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, xyz): the first 63 numbers of an embedding as 21 points."""
    point = lambda i: F.struct(*(F.col("embedding")[3 * i + k].cast("double").alias(c) for k, c in enumerate("xyz")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq_id"), F.transform(F.sequence(F.lit(0), F.lit(20)), point).alias("xyz"))


def structural_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, letters, info, probs, xyz): each label's vectors as a sequence of quantised letters, profiles and points.

    A position's profile is its vector's class probabilities, its point the vector's first three numbers.
    """
    from ..functions.codes import encoded, make_alphabet

    vectors = probability_vectors(spark, sf_dir)
    point = F.struct(*(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")))
    rows = vectors.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), point.alias("point")), "pos")
    listed = F.sort_array(F.collect_list(F.struct("pos", "probs", "point")))
    whole = rows.groupBy("seq_id").agg(listed.alias("r")).select("seq_id", F.col("r.probs").alias("probs"), F.col("r.point").alias("xyz"))
    return encoded(vectors, make_alphabet(vectors)).join(whole, "seq_id")


#: The same views in SQL.
EVENT_SQL = "ev AS (SELECT user_id AS seq_id, list(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END ORDER BY ts, event_id) AS letters FROM events GROUP BY user_id)"
BASKET_SQL = "ba AS (SELECT l_suppkey AS seq_id, list(CAST(1 + l_partkey % 20 AS INTEGER) ORDER BY l_orderkey, l_linenumber, l_partkey) AS letters FROM lineitem GROUP BY l_suppkey)"
PROB_SQL = "pv AS (SELECT label AS seq_id, vec_id AS pos, list_transform(embedding, lambda x: abs(x::DOUBLE) / list_sum(list_transform(embedding, lambda y: abs(y::DOUBLE)))) AS probs FROM embeddings)"
