"""Ranking quality: reciprocal rank, recall and first hits of runs (query_id, rank, url) against qrels (query_id, url)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 20


def first_hits(runs: DataFrame, qrels: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(query_id, first): rank of the first relevant url within depth, null if none; one row per query with relevant urls.

    Fragments of urls do not count; rows that stand twice count once; null urls and ranks match nothing.
    """
    bare = lambda c: F.regexp_replace(c, "#.*$", "")
    relevant = qrels.filter("url is not null").select("query_id", bare("url").alias("url")).distinct()
    hits = runs.filter(F.col("rank").between(1, depth)).select("query_id", "rank", bare("url").alias("url")).join(relevant, ["query_id", "url"], "left_semi")
    first = hits.groupBy("query_id").agg(F.min("rank").alias("first"))
    return relevant.select("query_id").distinct().join(first, "query_id", "left")


def mrr(first: DataFrame) -> DataFrame:
    return first.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def recall(first: DataFrame) -> DataFrame:
    """Share of queries with any relevant url within depth."""
    return first.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.col("first").isNotNull().cast("double")), 6).alias("recall"))


def top1(first: DataFrame) -> DataFrame:
    return first.agg(F.count_if(F.col("first") == 1).alias("top1_hits"))
