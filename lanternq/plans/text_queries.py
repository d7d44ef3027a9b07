"""Queries over text functions, the index and sparse ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..operators import index, pages, ranking
from ..sources.tables import table
from . import sqlparts as S
from . import stored

QUERIES = {1: "课程评估 完整范围", 2: "图书馆统一认证", 3: "Cookie 保存问卷", 4: "library catalogue", 5: "café near the Wing"}
PHRASES = {1: "统一认证", 2: "only one cookie", 3: "percent of the", 4: "cookie保存"}
REFERENCES = ["/p/1.htm", "//other.example/a?x=1#top", "https://z.example/b", "?q=1", "#part"]
DOCS, INDEXED = "documents", "indexed_documents"


def _index(spark: SparkSession, d: str, terms: list[str] | None = None) -> DataFrame:
    return index.indexed(table(spark, d, INDEXED), terms=terms)


def bm25f(spark, d):
    return ranking.bm25f_of_index(stored.stats(spark, d), stored.postings(spark, d), QUERIES)


def bm25f_top20(spark, d):
    return ranking.top(bm25f(spark, d), 20).select("query_id", "rank", "document_id", F.round("score", 6).alias("score"))


def phrase_search(spark, d):
    return ranking.phrase_of_postings(stored.postings(spark, d), PHRASES)


def normalize_text_all(spark, d):
    """Exact normalisation of title and text of every document; SQL has no twin for it."""
    docs = table(spark, d, DOCS)
    return docs.select("doc_id", T.normalize_text("title").alias("title_norm"), T.normalize_text("text").alias("text_norm"))


def normalize_native(spark, d):
    return table(spark, d, INDEXED).select("document_id", T.normalize_native(F.col("title_norm")).alias("title_norm"))


def tokenize_positions(spark, d):
    flat = index.postings(_index(spark, d))
    return flat.select("document_id", F.col("field").cast("int").alias("field"), "term", F.explode("positions").alias("start"))


def query_terms(spark, d):
    return spark.createDataFrame(ranking.terms_of(QUERIES), "query_id int, term string")


def compact_bigrams(spark, d):
    docs = table(spark, d, INDEXED).select("document_id", T.compact(F.col("title_norm")).alias("c"))
    return docs.select("document_id", "c", F.explode(T.bigrams(F.col("c"))).alias("bigram"))


def clean_text(spark, d):
    return table(spark, d, DOCS).select("doc_id", T.clean(F.col("title")).alias("title"))


def token_estimate(spark, d):
    return table(spark, d, DOCS).filter("text is not null").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


def evidence_ids(spark, d):
    docs = table(spark, d, DOCS).filter("url is not null")
    return docs.select("doc_id", T.evidence_id(F.col("url"), F.concat_ws(":", "doc_id", F.lit("0")), F.coalesce("text", F.lit(""))).alias("evidence_id"))


def url_canonical(spark, d):
    return table(spark, d, DOCS).filter("url is not null").select("doc_id", urls.canonical(F.col("url")).alias("url"), urls.host(F.col("url")).alias("host"))


def host_scope(spark, d):
    allowed = spark.createDataFrame([("jwc.lanwan.example",), ("lib.lanwan.example",)], "host string")
    docs = table(spark, d, DOCS).select("doc_id", urls.host(F.col("url")).alias("host"))
    return docs.join(F.broadcast(allowed), "host", "left_semi").select("doc_id", "host")


def url_resolve(spark, d):
    """Every url with each of some references resolved against it."""
    return pages.resolved(table(spark, d, DOCS).filter("url is not null"), REFERENCES)


def published_dates(spark, d):
    docs = table(spark, d, DOCS).select("doc_id", T.published_date(F.coalesce("text", F.lit("")), F.coalesce("url", F.lit(""))).alias("published_at"))
    return docs


def postings(spark, d):
    return index.postings(_index(spark, d)).select("term", "document_id", F.col("field").cast("int").alias("field"), F.array_join("positions", ",").alias("positions"))


def field_lengths(spark, d):
    return index.lengths(_index(spark, d))


def term_df(spark, d):
    return stored.postings(spark, d).groupBy("term").agg(F.countDistinct("document_id").alias("df"))


def corpus_stats(spark, d):
    return stored.stats(spark, d).select("documents", "title_tokens", "text_tokens")


def posting_lookup(spark, d):
    found = stored.postings(spark, d).filter((F.col("term") == "课程") & (F.col("field") == 1))
    return found.select("document_id", F.array_join("positions", ",").alias("positions"))


def scan_documents(spark, d):
    return table(spark, d, DOCS).select("doc_id", "url", "title", "fetched_at")


def docs_lookup(spark, d):
    hits = bm25f_top20(spark, d)
    docs = table(spark, d, DOCS).select(F.col("doc_id").alias("document_id"), "url", "title")
    return hits.join(docs, "document_id").select("query_id", "rank", "document_id", "url", "title")


def docs_by_host(spark, d):
    return table(spark, d, DOCS).select(urls.host(F.col("url")).alias("host")).filter("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("documents"))


def index_incremental(spark, d):
    docs = table(spark, d, DOCS).select(F.col("doc_id").alias("document_id"), "fetched_at")
    same = {"tokenizer_mode": "search", "stopwords_version": T.STOPWORDS_VERSION, "text_normalizer_version": T.NORMALIZER_VERSION}
    return index.changed(docs, table(spark, d, INDEXED).select("document_id", "fetched_at"), same, same).select("document_id")


def index_replace(spark, d):
    rows = _index(spark, d)
    new = index.indexed(table(spark, d, INDEXED).filter("document_id % 10 = 0"), text="title_norm")
    flat = index.postings(index.replaced(rows, new))
    return flat.select("term", "document_id", F.col("field").cast("int").alias("field"), F.array_join("positions", ",").alias("positions"))


def docs_upsert(spark, d):
    docs = table(spark, d, DOCS).withColumnRenamed("doc_id", "document_id").select("document_id", "url", "title", "text", "fetched_at", "content_html")
    out = index.upserted(docs.filter("document_id % 2 = 0"), docs.filter("document_id % 2 = 1"))
    return out.select("document_id", "url", "title", "fetched_at")


HOST = r"regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"
TOK = f"WITH {S.tokens()} "
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id)"
TOP20 = f"WITH {S.bm25f(QUERIES)}, r AS (SELECT query_id, {RANK} AS rank, document_id, round(score, 6) AS score FROM sparse) "
PHRASE_TERMS = []
for _q, _p in PHRASES.items():
    _t = ranking.tokenize_with_positions(ranking.normalize(_p), "search")
    PHRASE_TERMS += [f"({_q}, {S.text(t)}, {a - _t[0][1]}, {len(_t)})" for t, a in _t]

SQL = {
    "bm25f_top20": TOP20 + "SELECT CAST(query_id AS INTEGER) AS query_id, rank, document_id, score FROM r WHERE rank <= 20",
    "phrase_search": TOK + f", q(query_id, term, shift, n) AS (VALUES {', '.join(PHRASE_TERMS)}), m AS (SELECT query_id, document_id, field, start - shift AS s, count(DISTINCT shift) AS met, max(n) AS n FROM tok JOIN q USING (term) GROUP BY 1, 2, 3, 4) SELECT DISTINCT query_id, document_id FROM m WHERE met = n",
    "normalize_text_all": None,
    "normalize_native": r"SELECT document_id, trim(regexp_replace(replace(lower(title_norm), 'ß', 'ss'), '[ \t\n\x0B\f\r\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') AS title_norm FROM indexed_documents",
    "tokenize_positions": TOK + "SELECT document_id, field, term, start FROM tok",
    "query_terms": f"WITH {S.term_values(QUERIES)} SELECT query_id, term FROM q",
    "compact_bigrams": r"WITH c AS (SELECT document_id, regexp_replace(title_norm, '[^\p{L}\p{N}]', '', 'g') AS c FROM indexed_documents) SELECT document_id, c, unnest(list_distinct([substr(c, i, 2) for i in range(1, length(c))])) AS bigram FROM c WHERE length(c) >= 2",
    "clean_text": r"SELECT doc_id, trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g'), ' ') AS title FROM documents",
    "token_estimate": r"SELECT doc_id, CAST(length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) + (length(text) - length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) + 3) // 4 + 4 AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL",
    "evidence_ids": "SELECT doc_id, 'ev_' || left(sha256(url || chr(0) || doc_id || ':0' || chr(0) || coalesce(text, '')), 16) AS evidence_id FROM documents WHERE url IS NOT NULL",
    "url_canonical": r"WITH p AS (SELECT doc_id, url, regexp_replace(url, '#.*$', '') AS u FROM documents WHERE url IS NOT NULL), a AS (SELECT doc_id, url, u, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')) AS origin FROM p) SELECT doc_id, regexp_replace(regexp_replace(origin, '^(http://[^/]*):80$', '\1'), '^(https://[^/]*):443$', '\1') || CASE WHEN substr(u, length(origin) + 1) = '' THEN '/' ELSE substr(u, length(origin) + 1) END AS url, nullif(" + HOST + ", '') AS host FROM a",
    "host_scope": f"SELECT doc_id, {HOST} AS host FROM documents WHERE {HOST} IN ('jwc.lanwan.example', 'lib.lanwan.example')",
    "url_resolve": r"WITH b AS (SELECT doc_id, url, trim(url) AS u, regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') AS origin FROM documents WHERE url IS NOT NULL), r AS (SELECT unnest(['/p/1.htm', '//other.example/a?x=1#top', 'https://z.example/b', '?q=1', '#part']) AS ref) SELECT doc_id, ref, CASE ref WHEN '/p/1.htm' THEN lower(scheme) || substr(origin, length(scheme) + 1) || ref WHEN '//other.example/a?x=1#top' THEN lower(scheme) || '://other.example/a?x=1' WHEN 'https://z.example/b' THEN ref WHEN '?q=1' THEN lower(scheme) || substr(regexp_replace(u, '[?#].*$', ''), length(scheme) + 1) || '?q=1' ELSE lower(scheme) || substr(regexp_replace(u, '#.*$', ''), length(scheme) + 1) END AS resolved FROM b CROSS JOIN r",
    "published_dates": r"WITH m AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '(?:日期|发布时间|更新时间)\s*[:：]?\s*(20\d{2})[-年/.](\d{1,2})[-月/.](\d{1,2})日?', ['y', 'm', 'd']) AS t, regexp_extract(coalesce(url, ''), '(?:^|[^0-9])(20\d{2})(\d{2})(\d{2})', ['y', 'm', 'd']) AS u FROM documents), x AS (SELECT doc_id, CASE WHEN t.y <> '' THEN t ELSE u END AS x FROM m) SELECT doc_id, coalesce(strftime(try_cast(x.y || '-' || lpad(x.m, 2, '0') || '-' || lpad(x.d, 2, '0') AS DATE), '%Y-%m-%d'), '') AS published_at FROM x",
    "postings": TOK + "SELECT term, document_id, field, string_agg(CAST(start AS VARCHAR), ',' ORDER BY start) AS positions FROM tok GROUP BY ALL",
    "field_lengths": TOK + "SELECT d.document_id, count(t.term) FILTER (t.field = 0) AS title_len, count(t.term) FILTER (t.field = 1) AS text_len FROM indexed_documents d LEFT JOIN tok t USING (document_id) GROUP BY 1",
    "term_df": TOK + "SELECT term, count(DISTINCT document_id) AS df FROM tok GROUP BY 1",
    "corpus_stats": TOK + "SELECT (SELECT count(*) FROM indexed_documents) AS documents, CAST(count(*) FILTER (field = 0) AS BIGINT) AS title_tokens, CAST(count(*) FILTER (field = 1) AS BIGINT) AS text_tokens FROM tok",
    "posting_lookup": TOK + "SELECT document_id, string_agg(CAST(start AS VARCHAR), ',' ORDER BY start) AS positions FROM tok WHERE term = '课程' AND field = 1 GROUP BY 1",
    "scan_documents": "SELECT doc_id, url, title, fetched_at FROM documents",
    "docs_lookup": TOP20 + "SELECT CAST(query_id AS INTEGER) AS query_id, rank, document_id, url, title FROM r JOIN documents ON doc_id = document_id WHERE rank <= 20",
    "docs_by_host": f"SELECT {HOST} AS host, count(*) AS documents FROM documents WHERE {HOST} <> '' GROUP BY 1",
    "index_incremental": "SELECT doc_id AS document_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM indexed_documents i WHERE i.document_id = d.doc_id AND i.fetched_at = d.fetched_at)",
    "index_replace": f"WITH {S.tokens(S.FIELDS.replace('SELECT document_id, 1, text_norm FROM indexed_documents WHERE text_norm', 'SELECT document_id, 1, CASE WHEN document_id % 10 = 0 THEN title_norm ELSE text_norm END AS text_norm FROM indexed_documents WHERE CASE WHEN document_id % 10 = 0 THEN title_norm ELSE text_norm END'))} SELECT term, document_id, field, string_agg(CAST(start AS VARCHAR), ',' ORDER BY start) AS positions FROM tok GROUP BY ALL",
    "docs_upsert": "WITH r AS (SELECT *, doc_id % 2 AS nw FROM documents WHERE url IS NOT NULL), i AS (SELECT url, doc_id AS document_id FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY nw, doc_id) = 1), l AS (SELECT url, title, fetched_at FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY nw DESC, fetched_at DESC NULLS LAST, doc_id DESC) = 1) SELECT document_id, url, title, fetched_at FROM i JOIN l USING (url)",
}


def queries() -> dict:
    return {k: globals()[k] for k in SQL}
