"""Exact vector ranking. Vectors are unit length, so the inner product is the cosine."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are scored together; more of them make further passes over the batch.
QUERY_BLOCK = 256


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vectors in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scores(vectors: DataFrame, queries: dict[int, list[float]], keys: list[str], limit: int, vector: str = "embedding", once: bool = False) -> DataFrame:
    """(query_id, *keys, score): the best `limit` rows of every query within each batch, by one matrix product.

    What leaves a task is at most limit rows per query and batch; `top` of ranking takes the best of them. With `once`, a
    batch gives only the best row per value of the first key, so that many rows of one document cannot crowd out others.
    Ties are kept by key order. Rows with a null vector or one of another length are left out.
    """
    ids = list(queries)
    matrix = np.array([queries[q] for q in ids], np.float64).reshape(len(ids), -1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keys))
            lengths = pa.compute.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(lengths == matrix.shape[1])
            if not len(rows):
                continue
            x = pa.compute.list_flatten(column.take(pa.array(rows))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
            own = [batch.column(k).take(pa.array(rows)).to_numpy(zero_copy_only=False) for k in range(len(keys))]
            order = np.lexsort(own[::-1])
            for at in range(0, len(ids), QUERY_BLOCK):
                s = np.round(x[order] @ matrix[at : at + QUERY_BLOCK].T, 12)
                best = np.argsort(-s, axis=0, kind="stable")
                if once:
                    first = own[0][order]
                    chosen = [b[np.sort(np.unique(first[b], return_index=True)[1])][:limit] for b in best.T]
                else:
                    chosen = list(best[:limit].T)
                q = np.repeat(ids[at : at + QUERY_BLOCK], [len(c) for c in chosen])
                pick = rows[order[np.concatenate(chosen)]]
                score = np.concatenate([s[c, k] for k, c in enumerate(chosen)])
                yield pa.record_batch({"query_id": pa.array(q.astype(np.int32)), **{k: batch.column(i).take(pa.array(pick)) for i, k in enumerate(keys)}, "score": score})

    kinds = dict(vectors.dtypes)
    return vectors.select(*keys, vector).mapInArrow(run, "query_id int, " + ", ".join(f"{k} {kinds[k]}" for k in keys) + ", score double")


#: Query vectors of one pass over the vectors.
PASS_QUERIES = 4096


def scores_of(vectors: DataFrame, queries: DataFrame, keys: list[str], limit: int, once: bool = False) -> DataFrame:
    """`scores` for a table of stated queries (query_id, embedding), in blocks of PASS_QUERIES, each one pass."""
    out = None
    block: dict[int, list[float]] = {}

    def passed() -> None:
        nonlocal out
        part = scores(vectors, dict(block), keys, limit, once=once)
        out = part if out is None else out.unionByName(part)
        block.clear()

    for r in queries.select("query_id", "embedding").toLocalIterator():
        block[int(r.query_id)] = list(r.embedding)
        if len(block) >= PASS_QUERIES:
            passed()
    if block or out is None:
        passed()
    return out


def best_per_document(scored: DataFrame) -> DataFrame:
    """(query_id, document_id, chunk_index, score): the first passage of each document in ranked order."""
    best = F.max(F.struct("score", (-F.col("chunk_index")).alias("minus"))).alias("x")
    return scored.groupBy("query_id", "document_id").agg(best).select("query_id", "document_id", (-F.col("x.minus")).alias("chunk_index"), F.col("x.score").alias("score"))


def validation(vectors: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """One row: rows, wrong_dimension, not_finite, not_unit (norm off by more than 1e-4)."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce(F.size(v), F.lit(-1)) != dimension).alias("wrong_dimension"),
        F.count_if(F.coalesce(bad, F.lit(True))).alias("not_finite"),
        F.count_if(F.abs(F.sqrt(dot(v, v)) - 1) > 1e-4).alias("not_unit"),
    )


def checked(vectors: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """The vectors, or ValueError where any is of wrong length, not finite or not of unit length."""
    r = validation(vectors, dimension, vector).first()
    if r.wrong_dimension or r.not_finite or r.not_unit:
        raise ValueError(f"bad vectors: {r.asDict()}")
    return vectors


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "chunk_index")
    return scored.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= limit)
