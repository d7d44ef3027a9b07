"""Passages: overlapping windows of model tokens, and their sparse ranking."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS
from ..functions.tokens import Segmenter, spans
from ..sources.staging import spread, stage
from .ranking import DIGITS, terms_of, wanted

#: Tokens of a passage, of its title, of the overlap, and those that a model adds.
MAX_TOKENS, TITLE_TOKENS, OVERLAP, SPECIALS = 384, 64, 64, 2
#: Tokens of the labels that stand before title and body.
FRAME_TOKENS = 6
#: Saturation, length share, weights of title and body, least idf.
K1, B, WEIGHTS, LEAST_IDF = 1.2, 0.75, (2.0, 1.0), 1e-6


def windows(n: int, window: int, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(first, end) token of each window; the last one ends at n."""
    if window <= overlap:
        raise ValueError("a window must be longer than the overlap")
    out, at = [], 0
    while True:
        out.append((at, min(at + window, n)))
        if at + window >= n:
            return out
        at += window - overlap


def cut(title: str, text: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the passages of a text; a title alone is one empty passage, nothing at all none."""
    if not title and not text:
        return []
    _, start, end, _ = spans([title], "model")
    window = max_tokens - SPECIALS - FRAME_TOKENS - min(len(start), TITLE_TOKENS)
    _, start, end, _ = spans([text], "model")
    if not len(start):
        return [(0, 0, 0)] if title else []
    return [(int(start[a]), int(end[b - 1]), b - a) for a, b in windows(len(start), window, overlap)]


def passages(df: DataFrame, key: str = "document_id", title: str = "title_norm", text: str = "text_norm", max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """(document_id, chunk_index, start, end, tokens, text): passages of normalised documents; nulls count as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, a, b, n, t[a:b]) for i, (h, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)) for k, (a, b, n) in enumerate(cut(h or "", t or "", max_tokens, overlap))]
            i, k, a, b, n, t = zip(*rows, strict=True) if rows else ([],) * 6
            yield pa.record_batch({"document_id": batch.column(0).take(pa.array(i, pa.int64())), "chunk_index": pa.array(k, pa.int32()), "start": pa.array(a, pa.int32()), "end": pa.array(b, pa.int32()), "tokens": pa.array(n, pa.int32()), "text": pa.array(t, pa.string())})

    return spread(df.select(F.col(key).cast("long").alias("document_id"), title, text)).mapInArrow(run, "document_id long, chunk_index int, start int, end int, tokens int, text string")


def passage_terms(df: DataFrame, terms: list[str] | None, key: str = "document_id", title: str = "title_norm", text: str = "text_norm", max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, mode: str | Segmenter = "search") -> DataFrame:
    """(document_id, chunk_index, size, hits array<struct<term, tf0, tf1>>): search tokens of each passage with its title.

    With terms None all tokens are kept, else only these; size counts every token.
    """
    only = None if terms is None else frozenset(terms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles, texts = ([x or "" for x in batch.column(k).to_pylist()] for k in (1, 2))
            out: list[tuple[int, int, int, list[dict]]] = []
            for i, (h, t) in enumerate(zip(titles, texts, strict=True)):
                where = cut(h, t, max_tokens, overlap)
                if not where:
                    continue
                _, a0, b0, f0 = spans([h], mode)
                head = [w for w in (f0[a:b] for a, b in zip(a0.tolist(), b0.tolist(), strict=True)) if w not in STOPWORDS]
                _, a1, b1, f1 = spans([t], mode)
                body = [f1[a:b] for a, b in zip(a1.tolist(), b1.tolist(), strict=True)]
                keep = np.fromiter((w not in STOPWORDS for w in body), bool, len(body))
                for k, (s, e, _) in enumerate(where):
                    inside = np.flatnonzero((a1 >= s) & (b1 <= e) & keep)
                    hits: dict[str, list[int]] = {}
                    for w in head:
                        if only is None or w in only:
                            hits.setdefault(w, [0, 0])[0] += 1
                    for j in inside.tolist():
                        if only is None or body[j] in only:
                            hits.setdefault(body[j], [0, 0])[1] += 1
                    out.append((i, k, len(head) + len(inside), [{"term": w, "tf0": x, "tf1": y} for w, (x, y) in hits.items()]))
            i, k, n, hits = zip(*out, strict=True) if out else ([],) * 4
            kind = pa.list_(pa.struct([("term", pa.string()), ("tf0", pa.int32()), ("tf1", pa.int32())]))
            yield pa.record_batch({"document_id": batch.column(0).take(pa.array(i, pa.int64())), "chunk_index": pa.array(k, pa.int32()), "size": pa.array(n, pa.int32()), "hits": pa.array(hits, kind)})

    schema = "document_id long, chunk_index int, size int, hits array<struct<term:string,tf0:int,tf1:int>>"
    return spread(df.select(F.col(key).cast("long").alias("document_id"), title, text)).mapInArrow(run, schema)


def stored_passage_postings(rows: DataFrame) -> DataFrame:
    """(term, document_id, chunk_index, size, tf0, tf1): passage postings that can be scored without another table."""
    return rows.select("document_id", "chunk_index", "size", F.inline("hits")).select("term", "document_id", "chunk_index", "size", "tf0", "tf1")


def passage_stats(rows: DataFrame) -> DataFrame:
    """One row: the number of passages and their mean size."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.avg("size").alias("mean"))


def passage_bm25(df: DataFrame, queries: dict[int, str], mode: str | Segmenter = "search", **options) -> DataFrame:
    """(query_id, document_id, chunk_index, score) over texts without a stored index."""
    rows = stage(passage_terms(df, [t for _, t in terms_of(queries, mode)], mode=mode, **options), "passage-terms")  # read for statistics and for hits
    return passage_bm25_of_index(passage_stats(rows), stored_passage_postings(rows.filter(F.size("hits") > 0)), queries, mode)


def passage_bm25_of_index(stats: DataFrame, stored: DataFrame, queries: dict[int, str], mode: str | Segmenter = "search") -> DataFrame:
    """(query_id, document_id, chunk_index, score): passages that hold a query term, by two-field BM25 with a least idf.

    stats is one row (rows, mean); of the stored postings only those of the query terms are read.
    """
    pairs = terms_of(queries, mode)
    words = stored.sparkSession.createDataFrame(pairs, "query_id int, term string")
    hits = wanted(stored, words.select("term").distinct(), sorted({t for _, t in pairs}))
    found = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    f = WEIGHTS[0] * F.col("tf0") + WEIGHTS[1] * F.col("tf1")
    part = F.when(idf <= 0, LEAST_IDF).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    scored = hits.join(F.broadcast(found), "term").crossJoin(F.broadcast(stats)).withColumn("part", part).join(F.broadcast(words), "term")  # a row per query term, and one row
    return scored.groupBy("query_id", "document_id", "chunk_index").agg(F.round(F.sum("part"), DIGITS).alias("score"))
