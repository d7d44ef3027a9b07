"""Sparse ranking: field-weighted BM25, phrases, and the ranking tail shared by all of them.

Queries are a DataFrame (query_id, text) of stated queries; their terms are cut on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..functions.tokens import Segmenter, query_terms, tokenize_with_positions
from ..sources.staging import stage
from .index import corpus_stats, indexed, postings, stored_postings

#: Saturation, and (weight, length share) of title and text.
K1 = 1.2
FIELDS = ((2.0, 0.3), (1.0, 0.75))
#: Places that scores are ranked by, so that the order of a sum's parts decides nothing; output may round further.
DIGITS = 12
#: Query terms up to which the scan itself is filtered by a list of them.
SCAN_TERMS = 1000


def top(scored: DataFrame, limit: int, *order: Column, key: str = "document_id") -> DataFrame:
    """The best `limit` rows of each query with their rank: score descending, then key."""
    by = Window.partitionBy("query_id").orderBy(*(order or (F.desc("score"), F.asc(key))))
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit)


def terms_of(queries: dict[int, str], mode: str | Segmenter = "search") -> list[tuple[int, str]]:
    return [(q, t) for q, text in queries.items() for t in query_terms(text, mode)]


def bm25f(df: DataFrame, queries: dict[int, str], mode: str | Segmenter = "search") -> DataFrame:
    """(query_id, document_id, score) of all documents that hold a query term; df has document_id, title_norm, text_norm.

    For texts without a stored index. Only the postings of query terms leave the scan, so what is shuffled is the matches
    and not the corpus.
    """
    words = [t for _, t in terms_of(queries, mode)]
    index = stage(indexed(df, mode=mode, terms=words), "matches")  # read for lengths and for hits
    return scored_bm25f(corpus_stats(index), stored_postings(index.filter(F.size("terms") > 0)), queries, mode)


def wanted(stored: DataFrame, words: DataFrame, terms: list[str]) -> DataFrame:
    """The rows of a table sorted by term that stand under one of the words; a short list of terms reaches the scan."""
    few = stored.filter(F.col("term").isin(terms)) if len(terms) <= SCAN_TERMS else stored
    return few.join(F.broadcast(words), "term") if len(terms) <= SCAN_TERMS else few.join(words, "term")


def bm25f_of_index(stats: DataFrame, stored: DataFrame, queries: dict[int, str], mode: str | Segmenter = "search") -> DataFrame:
    """The same over a stored index: one row of statistics, and the postings, of which only the query terms are read."""
    return scored_bm25f(stats, stored, queries, mode)


def scored_bm25f(stats: DataFrame, stored: DataFrame, queries: dict[int, str], mode: str | Segmenter = "search") -> DataFrame:
    """Scores from one row (documents, title_tokens, text_tokens) and stored postings."""
    pairs = terms_of(queries, mode)
    words = stored.sparkSession.createDataFrame(pairs, "query_id int, term string")
    stats = stats.select("documents", (F.col("title_tokens") / F.col("documents")).alias("avg0"), (F.col("text_tokens") / F.col("documents")).alias("avg1"))
    terms = sorted({t for _, t in pairs})
    count = lambda f: F.sum(F.when(F.col("field") == f, F.col("tf")).otherwise(0))
    hits = wanted(stored.select("term", "document_id", "field", "tf", "title_len", "text_len"), words.select("term").distinct(), terms)
    per = hits.groupBy("term", "document_id", "title_len", "text_len").agg(count(0).alias("tf0"), count(1).alias("tf1"))
    found = per.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.lit(0.0)
    for k, (w, b) in enumerate(FIELDS):
        size = F.col("title_len" if k == 0 else "text_len") / F.col(f"avg{k}")
        weight = weight + w * F.col(f"tf{k}") / F.when(F.col(f"avg{k}") == 0, 1.0).otherwise(1 - b + b * size)
    idf = F.log(1 + (F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (K1 + 1) * weight / (K1 + weight)
    scored = per.join(F.broadcast(found), "term").crossJoin(F.broadcast(stats))  # a row per query term, and one row
    scored = scored.withColumn("part", part).join(F.broadcast(words), "term")
    return scored.groupBy("query_id", "document_id").agg(F.round(F.sum("part"), DIGITS).alias("score"))


def phrase_search(df: DataFrame, phrases: dict[int, str], mode: str | Segmenter = "search") -> DataFrame:
    """(query_id, document_id): documents with the phrase in one field, every token at its place relative to the first.

    The shifted starts of all tokens of a phrase meet in one group; a group of all tokens is an occurrence.
    """
    rows = phrase_rows(phrases, mode)
    return phrase_of_postings(postings(indexed(df, mode=mode, terms=[r[1] for r in rows])), phrases, mode)


def phrase_rows(phrases: dict[int, str], mode: str | Segmenter) -> list[tuple[int, str, int, int]]:
    """(query_id, term, shift, n) of every token of every phrase."""
    rows = []
    for q, text in phrases.items():
        tokens = tokenize_with_positions(normalize(text), mode)
        rows += [(q, t, at - tokens[0][1], len(tokens)) for t, at in tokens]
    return rows


def phrase_of_postings(stored: DataFrame, phrases: dict[int, str], mode: str | Segmenter = "search") -> DataFrame:
    """phrase_search over stored postings; the filter on term reaches the scan."""
    rows = phrase_rows(phrases, mode)
    words = stored.sparkSession.createDataFrame(rows, "query_id int, term string, shift int, n int")
    found = wanted(stored.select("term", "document_id", "field", "positions"), words, sorted({r[1] for r in rows}))
    starts = found.select("query_id", "document_id", "field", "shift", "n", F.explode("positions").alias("at"))
    whole = starts.groupBy("query_id", "document_id", "field", (F.col("at") - F.col("shift")).alias("start")).agg(F.countDistinct("shift").alias("met"), F.max("n").alias("n"))
    return whole.filter("met = n").select("query_id", "document_id").distinct()
