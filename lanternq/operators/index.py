"""Inverted index: one nested row per document, so that building it needs no shuffle; postings are its flat view."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS
from ..functions.tokens import Segmenter, spans
from ..sources.staging import spread

TERM = pa.struct([("term", pa.string()), ("field", pa.int8()), ("positions", pa.list_(pa.int32()))])
SCHEMA = "document_id long, title_len long, text_len long, terms array<struct<term:string,field:byte,positions:array<int>>>"
#: Characters that are tokenised at a time.
CHUNK = 1_000_000


def _rows(ids: pa.Array, titles: list[str], texts: list[str], mode: str | Segmenter, only: frozenset[str] | None) -> pa.RecordBatch:
    both = [x for pair in zip(titles, texts, strict=True) for x in pair]
    of, start, end, flat = spans(both, mode)
    words = [flat[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    keep = np.fromiter((w not in STOPWORDS for w in words), bool, len(words))
    size = np.bincount(of[keep], minlength=len(both)).reshape(-1, 2)
    if only is not None:
        keep &= np.fromiter((w in only for w in words), bool, len(words))
    at = np.flatnonzero(keep)
    base = np.cumsum([0, *(len(x) + 1 for x in both[:-1])]) if both else np.zeros(1, np.int64)
    number: dict[str, int] = {}
    code = np.fromiter((number.setdefault(words[i], len(number)) for i in at.tolist()), np.int64, len(at))
    order = np.lexsort((start[at], code, of[at]))
    code, doc, place = code[order], of[at][order], (start[at] - base[of[at]])[order]
    new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]) if len(code) else np.zeros(0, np.int64)
    names = list(number)
    terms = pa.StructArray.from_arrays(
        [pa.array([names[c] for c in code[new].tolist()], pa.string()), pa.array((doc[new] % 2).astype(np.int8)), pa.ListArray.from_arrays(pa.array(np.r_[new, len(code)].astype(np.int32)), pa.array(place.astype(np.int32)))],
        fields=list(TERM),
    )
    bounds = np.searchsorted(doc[new] // 2, np.arange(len(titles) + 1))
    return pa.record_batch({"document_id": ids, "title_len": size[:, 0].astype(np.int64), "text_len": size[:, 1].astype(np.int64), "terms": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), terms)})


def indexed(df: DataFrame, key: str = "document_id", title: str = "title_norm", text: str = "text_norm", mode: str | Segmenter = "search", terms: list[str] | None = None) -> DataFrame:
    """(document_id, title_len, text_len, terms): the index rows of normalised documents; nulls count as empty.

    With `terms`, only their postings are kept, while lengths still count every token.
    """
    only = frozenset(terms) if terms is not None else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            titles, texts = ([x or "" for x in batch.column(k).to_pylist()] for k in (1, 2))
            first = total = 0
            for i in range(len(texts)):
                total += len(titles[i]) + len(texts[i])
                if total >= CHUNK or i == len(texts) - 1:
                    yield _rows(ids.slice(first, i + 1 - first), titles[first : i + 1], texts[first : i + 1], mode, only)
                    first, total = i + 1, 0

    return spread(df.select(F.col(key).cast("long").alias("document_id"), F.col(title), F.col(text))).mapInArrow(run, SCHEMA)


def postings(index: DataFrame) -> DataFrame:
    """(term, document_id, field, positions)."""
    return index.select("document_id", F.inline("terms")).select("term", "document_id", "field", "positions")


def stored_postings(index: DataFrame) -> DataFrame:
    """(term, document_id, field, tf, title_len, text_len, positions): postings that can be scored without another table."""
    flat = index.select("document_id", "title_len", "text_len", F.inline("terms"))
    return flat.select("term", "document_id", "field", F.size("positions").alias("tf"), "title_len", "text_len", "positions")


def posting_lookup(index: DataFrame, term: str, field: int) -> DataFrame:
    """(document_id, positions) of one term in one field."""
    return postings(index).filter((F.col("term") == term) & (F.col("field") == field)).select("document_id", "positions")


def lengths(index: DataFrame) -> DataFrame:
    return index.select("document_id", "title_len", "text_len")


def document_frequency(index: DataFrame) -> DataFrame:
    """(term, df): documents that hold the term in either field. A document's fields are merged before the shuffle."""
    terms = index.select(F.explode(F.array_distinct(F.transform("terms", lambda t: t["term"]))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: documents, title_tokens, text_tokens."""
    return index.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("title_len"), F.lit(0)).alias("title_tokens"), F.coalesce(F.sum("text_len"), F.lit(0)).alias("text_tokens"))


def changed(documents: DataFrame, snapshot: DataFrame, manifest: dict[str, str], wanted: dict[str, str]) -> DataFrame:
    """The documents to index again: all of them if any version in the manifest differs, else those whose fetched_at does."""
    if any(manifest.get(k) != v for k, v in wanted.items()):
        return documents
    known = snapshot.select(F.col("document_id").alias("_d"), F.col("fetched_at").alias("_f"))
    return documents.join(known, (F.col("document_id") == F.col("_d")) & (F.col("fetched_at") == F.col("_f")), "left_anti")


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """The index with the rows of `new` in place of those of the same documents."""
    return old.join(new.select("document_id"), "document_id", "left_anti").unionByName(new)


def upserted(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Documents with the latest row per url and the id the url had first; a missing content_html becomes empty.

    Both have (document_id, url, title, text, fetched_at, content_html).
    """
    rows = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True).filter("url is not null")
    latest = F.max_by(F.struct("title", "text", "fetched_at", F.coalesce("content_html", F.lit("")).alias("content_html")), F.struct("_new", "fetched_at", "document_id"))
    out = rows.groupBy("url").agg(F.min_by("document_id", F.struct("_new", "document_id")).alias("document_id"), latest.alias("x"))
    return out.select("document_id", "url", "x.*")


def latest_per_url(documents: DataFrame, key: str, order: str) -> DataFrame:
    """One row per url: the last by (order, key)."""
    own = Window.partitionBy("url").orderBy(F.desc(order), F.desc(key))
    return documents.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")
