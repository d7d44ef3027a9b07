"""Min-max fusion of a sparse and a dense ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import DIGITS, top

#: Fixed value: weight of the dense side.
ALPHA = 0.23


def candidates(limit: int) -> int:
    """Rows of each side that take part; cut before scores are normalised."""
    return max(100, 5 * limit)


def minmax(scored: DataFrame) -> DataFrame:
    """Scores of each query brought to 0..1; equal ones all become 1."""
    own = Window.partitionBy("query_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    return scored.withColumn("score", F.when(low == high, 1.0).otherwise((F.col("score") - low) / (high - low)))


def fuse(sparse: DataFrame, dense: DataFrame, limit: int, alpha: float = ALPHA, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """(query_id, rank, *keys, score): weighted sum of both sides, a missing side as 0.

    alpha 0 and 1 are the raw rankings of one side. The sides must already be cut to their candidates.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in 0..1")
    if limit <= 0:
        raise ValueError("limit must be positive")
    order: list[Column] = [F.desc("score"), *(F.asc(k) for k in keys)]
    if alpha in (0, 1):
        side = dense if alpha else sparse
        return top(side.select("query_id", *keys, "score"), limit, *order).select("query_id", "rank", *keys, "score")
    on = ["query_id", *keys]
    both = minmax(sparse).select(*on, F.col("score").alias("s")).join(minmax(dense).select(*on, F.col("score").alias("d")), on, "full_outer")
    score = F.round((1 - alpha) * F.coalesce("s", F.lit(0.0)) + alpha * F.coalesce("d", F.lit(0.0)), DIGITS)
    return top(both.select(*on, score.alias("score")), limit, *order).select("query_id", "rank", *keys, "score")
