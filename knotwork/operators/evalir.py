"""Measures of ranked results against what was expected (V01-V07), for all queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.text import eval_path


def dedupe(results: DataFrame) -> DataFrame:
    """query_id, note, rank: chunk hits as notes, each at its first rank."""
    first = results.select("query_id", eval_path("note").alias("note"), "rank").groupBy("query_id", "note").agg(F.min("rank").alias("r"))
    return first.select("query_id", "note", F.row_number().over(Window.partitionBy("query_id").orderBy("r", "note")).alias("rank"))


def ranked_notes(hits: DataFrame, depth: int) -> DataFrame:
    """query_id, note, rank: the notes of hits(query_id, id, note, score) by their best chunk, down to a depth.

    Notes are told apart before anything is ranked, and partial limits run before the shuffle; so no task ranks all hits of a query.
    """
    best = hits.select("query_id", eval_path("note").alias("note"), F.struct((-F.round("score", 9)).alias("s"), "id").alias("x")).groupBy("query_id", "note").agg(F.min("x").alias("x"))
    return best.select("query_id", "note", F.row_number().over(Window.partitionBy("query_id").orderBy("x", "note")).alias("rank")).where(F.col("rank") <= depth)


def per_query(results: DataFrame, expected: DataFrame) -> DataFrame:
    """A row for each query of expected(query_id, note): rr and first_hit_rank (0 if none), recall, precision, ap (4 places),
    n_expected and n_retrieved.

    results(query_id, note, rank) holds each note once. Precision is over what was retrieved.
    """
    want = expected.select("query_id", eval_path("note").alias("note")).distinct()
    n = want.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"))
    got = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_retrieved"))
    hits = results.select("query_id", eval_path("note").alias("note"), "rank").join(want, ["query_id", "note"])
    running = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    scored = hits.withColumn("part", running / F.col("rank")).groupBy("query_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("hits"), F.sum("part").alias("parts"))
    all_ = n.join(got, "query_id", "left").join(scored, "query_id", "left")
    zero = F.lit(0)
    return all_.select(
        "query_id",
        F.coalesce(F.round(1 / F.col("first"), 4), F.lit(0.0)).alias("rr"),
        F.coalesce("first", zero).cast("bigint").alias("first_hit_rank"),
        F.round(F.coalesce("hits", zero) / F.col("n_expected"), 4).alias("recall"),
        F.coalesce(F.round(F.coalesce("hits", zero) / F.col("n_retrieved"), 4), F.lit(0.0)).alias("precision"),
        F.round(F.coalesce("parts", F.lit(0.0)) / F.col("n_expected"), 4).alias("ap"),
        "n_expected",
        F.coalesce("n_retrieved", zero).cast("bigint").alias("n_retrieved"),
    )


def aggregate(measured: DataFrame) -> DataFrame:
    """One row: n_queries, mrr, hits_at_1, 3 and 5, mean recall and precision, map, multi_hop_queries and their completeness."""
    multi = F.col("n_expected") >= 2
    share = lambda k: F.round(F.avg(F.when((F.col("first_hit_rank") >= 1) & (F.col("first_hit_rank") <= k), 1.0).otherwise(0.0)), 4)
    return measured.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg(F.when(F.col("first_hit_rank") > 0, 1 / F.col("first_hit_rank")).otherwise(0.0)), 4).alias("mrr"),
        share(1).alias("hits_at_1"),
        share(3).alias("hits_at_3"),
        share(5).alias("hits_at_5"),
        F.round(F.avg("recall"), 4).alias("recall"),
        F.round(F.avg("precision"), 4).alias("precision"),
        F.round(F.avg("ap"), 4).alias("map"),
        F.count_if(multi).alias("multi_hop_queries"),
        F.coalesce(F.round(F.avg(F.when(multi, F.when(F.col("recall") >= 1, 1.0).otherwise(0.0))), 4), F.lit(0.0)).alias("multi_hop_completeness"),
    )


def passes(metrics: dict, least_mrr: float = 0.80, least_recall: float = 0.80) -> bool:
    return metrics["mrr"] >= least_mrr and metrics["recall"] >= least_recall
