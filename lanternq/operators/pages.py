"""Page extraction over Arrow batches: one parse per page for whatever is asked of it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dom
from ..sources.staging import spread


def per_page(df: DataFrame, columns: list[str], schema: str, make: Callable[..., list[tuple]]) -> DataFrame:
    """mapInArrow over rows of columns: `make` turns the values of a row into output rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for x in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in make(*x)]
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], schema=kind)

    return spread(df.select(*columns)).mapInArrow(run, schema)


def extracted(df: DataFrame, rules: dict[str, dom.Rule] | None = None, key: str = "doc_id", url: str = "url", page: str = "content_html") -> DataFrame:
    """(key, title, text, content_html, links, error) of each page; a null page has no text and no links.

    A page that cannot be read at all comes out empty with what went wrong, and stops nothing.
    """

    def make(i: int, u: str | None, p: str | None) -> list[tuple]:
        try:
            x = dom.extract(p, u or "", rules)
        except Exception as e:  # noqa: BLE001
            return [(i, "", "", "", [], f"{type(e).__name__}: {e}")]
        return [(i, x["title"], x["text"], x["content_html"], x["links"], None)]

    return per_page(df, [key, url, page], f"{key} long, title string, text string, content_html string, links array<string>, error string", make)


def html_blocks(df: DataFrame, key: str = "doc_id", page: str = "content_html") -> DataFrame:
    """(key, block, tag, text, heading_path): the evidence blocks of each page in order."""

    def make(i: int, p: str | None) -> list[tuple]:
        of = dom.blocks(dom.parse(p))
        out, open_ = [], {}
        for k, n in enumerate(of):
            text = n.text()
            if len(n.tag) == 2 and n.tag[0] == "h":
                open_ = {x: v for x, v in open_.items() if x < int(n.tag[1])} | {int(n.tag[1]): text}
            out.append((i, k, n.tag, text, " > ".join(open_[x] for x in sorted(open_))))
        return out

    return per_page(df, [key, page], f"{key} long, block int, tag string, text string, heading_path string", make)


def table_cells(df: DataFrame, key: str = "doc_id", page: str = "content_html") -> DataFrame:
    """(key, table, row, column, text): the data cells of all tables."""

    def make(i: int, p: str | None) -> list[tuple]:
        return [(i, t, r, c, v) for t, n in enumerate(x for x in dom.parse(p).walk() if x.tag == "table") for r, c, v in dom.table_values(n)]

    return per_page(df, [key, page], f"{key} long, table int, row int, column int, text string", make)


def table_cards(df: DataFrame, terms: list[str], limit: int = 8, key: str = "doc_id", page: str = "content_html") -> DataFrame:
    """(key, table, label, size, score): the best tables of the given pages."""

    def make(i: int, p: str | None) -> list[tuple]:
        return [(i, c["index"], c["label"], c["size"], c["score"]) for c in dom.table_sections(p or "", terms)]

    with_tables = df.filter(F.regexp_like(page, F.lit("(?i)<table")))
    out = per_page(with_tables, [key, page], f"{key} long, table int, label string, size int, score int", make)
    return out.orderBy(F.desc("score"), key, "table").limit(limit)


def structured_evidence(hits: DataFrame, terms: list[str]) -> DataFrame:
    """(document_id, chunk_index, scope, content, heading_path) of hits with (document_id, chunk_index, text, content_html)."""

    def make(i: int, k: int, text: str | None, p: str | None) -> list[tuple]:
        x = dom.structured(p or "", text or "", terms)
        return [(i, k, x["scope"], x["content"], x["heading_path"])]

    return per_page(hits, ["document_id", "chunk_index", "text", "content_html"], "document_id long, chunk_index int, scope string, content string, heading_path string", make)


def resolved(df: DataFrame, references: list[str], key: str = "doc_id", url: str = "url") -> DataFrame:
    """(key, ref, resolved): each reference as a link on each page; a url that cannot be read gives null."""

    def make(i: int, u: str | None) -> list[tuple]:
        return [(i, r, dom.resolve(u or "", r)) for r in references]

    return per_page(df, [key, url], f"{key} long, ref string, resolved string", make)
