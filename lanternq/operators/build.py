"""The stored tables of an index: what is built once, so that searches read only what stands under their terms."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import Segmenter
from ..sources.staging import stage
from . import index, passages

Encoder = Callable[[list[str]], list[list[float]]]


def tables(documents: DataFrame, encode: Encoder | None = None, mode: str | Segmenter = "search") -> dict[str, DataFrame]:
    """ids, lengths, postings, passages, passage_postings[, vectors] of documents (document_id, title_norm, text_norm, ..).

    Documents are tokenised once for the documents' index and once for the passages'. `encode` turns a list of texts into
    vectors, a batch at a time; a passage is encoded with its title before it.
    """
    rows = stage(index.indexed(documents, mode=mode), "index-rows")
    cut = stage(passages.passage_terms(documents, None, mode=mode), "passage-rows")
    texts = stage(passages.passages(documents), "passages")
    out = {
        "ids": documents.select("document_id"),
        "lengths": index.lengths(rows),
        "postings": index.stored_postings(rows),
        "passages": texts,
        "passage_sizes": cut.select("document_id", "chunk_index", "size"),
        "passage_postings": passages.stored_passage_postings(cut),
    }
    return out | ({"vectors": vectors(texts, documents, encode)} if encode is not None else {})


def vectors(texts: DataFrame, documents: DataFrame, encode: Encoder) -> DataFrame:
    """(document_id, chunk_index, embedding) of passages, each encoded with the title of its document before it.

    A passage without its document is an error.
    """

    def run(batches):
        for b in batches:
            yield pa.record_batch({"document_id": b.column(0), "chunk_index": b.column(1), "embedding": pa.array(encode(b.column(2).to_pylist()), pa.list_(pa.float32()))})

    of = documents.select("document_id", "title_norm", F.lit(1).alias("_here"))
    titled = texts.join(of, "document_id", "left")
    text = F.when(F.col("_here").isNull(), F.raise_error(F.concat(F.lit("a passage of no document: "), "document_id"))).otherwise(F.concat_ws("\n", "title_norm", "text"))
    titled = titled.select("document_id", "chunk_index", text.alias("t"))
    return titled.mapInArrow(run, "document_id long, chunk_index int, embedding array<float>")


def stats(merged: dict[str, DataFrame]) -> dict[str, float]:
    """The numbers that scores need of all documents and passages, for the manifest."""
    d = index.corpus_stats(merged["lengths"]).first()
    p = passages.passage_stats(merged["passage_sizes"]).first()
    return {"documents": d.documents, "title_tokens": d.title_tokens, "text_tokens": d.text_tokens, "rows": p.rows, "mean": p.mean}


def stats_row(spark, numbers: dict[str, float]) -> DataFrame:
    """The manifest's numbers as one row."""
    kinds = {"mean": "double"}
    return spark.range(1).select(*[F.lit(v).cast(kinds.get(k, "long")).alias(k) for k, v in numbers.items()])
