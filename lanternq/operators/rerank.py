"""Reranking: windows of a document for a scorer, saturated scores, and the capped choice of passages."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import spans
from .passages import FRAME_TOKENS, OVERLAP, SPECIALS, TITLE_TOKENS, windows

#: Tokens of a pair, of the query in it; saturation and the margin of a plateau; passages per document.
PAIR_TOKENS, QUERY_TOKENS, SATURATION, MARGIN, EPSILON, PER_DOCUMENT = 512, 256, 0.99, 0.2, 1e-7, 3
#: Candidates that are scored where the caller asks for fewer, and the least share of a second window.
SCORE_LIMIT, SECOND_SHARE = 50, 0.8


def compact(text: str) -> str:
    return "".join(c for c in text if c.isalnum())


def lexical_parts(query: str, text: str) -> tuple[int, int, int]:
    """(contained, bigrams, characters) of the query that the text holds."""
    q, t = compact(query), compact(text)
    return int(q in t), sum(g in t for g in {q[i : i + 2] for i in range(len(q) - 1)}), sum(c in t for c in set(q))


def lexical_scorer(query: str, text: str) -> float:
    """Share of the query's bigrams and characters in the text. A stand-in for a cross-encoder, which is not shipped."""
    q = compact(query)
    if not q:
        return 0.0
    has, pairs, chars = lexical_parts(query, text)
    return round((2 * pairs + chars + has) / (2 * len({q[i : i + 2] for i in range(len(q) - 1)}) + len(set(q)) + 1), 6)


def scored_windows(title: str, text: str, query_tokens: int, max_tokens: int = PAIR_TOKENS) -> list[str]:
    """The windows of a text that fit a scorer's pair beside so many tokens of the query, each under the title."""
    _, _, ends, _ = spans([title], "model")
    used = min(len(ends), TITLE_TOKENS)
    head = title if used == len(ends) and used < TITLE_TOKENS else title[: int(ends[used - 1])]
    _, start, end, _ = spans([text], "model")
    if not len(start):
        return [head] if head else []
    room = max_tokens - SPECIALS - min(query_tokens, QUERY_TOKENS) - used - FRAME_TOKENS
    cuts = windows(len(start), max(room, OVERLAP + 1))
    return ["\n".join(x for x in (head, text[int(start[a]) : int(end[b - 1])]) if x) for a, b in cuts]


def chosen_windows(query: str, title: str, text: str, max_tokens: int = PAIR_TOKENS) -> list[str]:
    """One or two windows of the document, with its title, that a scorer should see for the query.

    The first has the most of the query: as a whole, then in pairs, then in characters, then the earliest. If it does not
    hold the query as a whole, the next in that order that is not beside it joins it, if it has at least SECOND_SHARE of
    its pairs (counted twice) and characters.
    """
    made = scored_windows(title, text, len(spans([query], "model")[1]), max_tokens)
    if len(made) < 2 or not compact(query):
        return made[:1]
    whole, pairs, chars = np.array([lexical_parts(query, x) for x in made]).T
    order = np.lexsort((-chars, -pairs, -whole))  # stable: the earliest of equal ones first
    best = order[0]
    strength = 2 * pairs + chars
    fits = (np.abs(order - best) > 1) & (strength[order] > 0) & (strength[order] >= SECOND_SHARE * strength[best])
    second = order[fits][: 0 if whole[best] else 1]
    return [made[k] for k in (best, *second)]


def rerank_documents(hits: DataFrame, documents: DataFrame, queries: dict[int, str], scorer: Callable[[str, str], float] = lexical_scorer, limit: int = 20) -> DataFrame:
    """(query_id, rank, document_id, score): candidates by the best score of their windows, saturated ones in old order.

    hits has (query_id, rank, document_id); documents (document_id, title_norm, text_norm). Missing documents drop out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            score = [max((scorer(queries[q], w) for w in chosen_windows(queries[q], h or "", t or "")), default=None) for q, _, _, h, t in rows]
            yield pa.record_batch({"query_id": b.column(0), "candidate": b.column(1), "document_id": b.column(2), "score": pa.array(score, pa.float64())})

    pairs = documents.select("document_id", "title_norm", "text_norm").join(hits.select("query_id", F.col("rank").alias("candidate"), "document_id"), "document_id")
    scored = pairs.select("query_id", "candidate", "document_id", "title_norm", "text_norm").mapInArrow(run, "query_id int, candidate int, document_id long, score double")
    out = plateau(scored.filter("score is not null"))
    return out.filter(F.col("rank") <= limit).select("query_id", "rank", "document_id", "score")


def plateau(scored: DataFrame) -> DataFrame:
    """Adds rank: score descending, but scores saturated near the best (by logit) keep the order of their candidates.

    scored has (query_id, candidate, score). Scores outside 0..1 never belong to the plateau.
    """
    own = Window.partitionBy("query_id")
    best = F.max("score").over(own)
    bound = lambda x: F.least(F.greatest(x, F.lit(EPSILON)), F.lit(1 - EPSILON))
    logit = lambda x: F.log(bound(x) / (1 - bound(x)))
    score = F.col("score")
    flat = (best >= SATURATION) & (best <= 1) & (score >= 0) & (score <= 1) & (logit(best) - logit(score) <= MARGIN)
    marked = scored.withColumn("flat", flat)
    order = Window.partitionBy("query_id").orderBy(F.desc("flat"), F.when(F.col("flat"), F.col("candidate").cast("double")).otherwise(-score), "candidate")
    return marked.withColumn("rank", F.row_number().over(order)).drop("flat")


def capped(rows: pd.DataFrame, limit: int, per_document: int = PER_DOCUMENT) -> pd.DataFrame:
    """Greedy choice in order: no text twice among the chosen, at most per_document passages of a document.

    A passage refused by the cap does not mark its text as seen, so this is a fold and no filter.
    """
    seen: set[str] = set()
    used: dict[int, int] = {}
    out = []
    for r in rows.sort_values(["score", "candidate"], ascending=[False, True]).itertuples(index=False):
        if len(out) >= limit:
            break
        if r.text in seen or used.get(r.document_id, 0) >= per_document:
            continue
        seen.add(r.text)
        used[r.document_id] = used.get(r.document_id, 0) + 1
        out.append((r.query_id, len(out) + 1, r.document_id, r.chunk_index, r.score))
    return pd.DataFrame(out, columns=["query_id", "rank", "document_id", "chunk_index", "score"])


def rerank_passages(candidates: DataFrame, limit: int, candidate_limit: int = SCORE_LIMIT) -> DataFrame:
    """(query_id, rank, document_id, chunk_index, score) of candidates (.., candidate, score, text), capped per document.

    The first max(limit, candidate_limit) candidates of a query take part, which also bounds its group.
    """
    if limit <= 0 or candidate_limit <= 0:
        raise ValueError("limits must be positive")
    few = candidates.filter(F.col("candidate") <= max(limit, candidate_limit))
    return few.groupBy("query_id").applyInPandas(lambda x: capped(x, limit), "query_id int, rank int, document_id long, chunk_index int, score double")


def logit(x: float) -> float:
    x = min(max(x, EPSILON), 1 - EPSILON)
    return math.log(x / (1 - x))
