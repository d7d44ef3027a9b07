"""Queries over pages, the crawl queue, calculations and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..functions.tokens import query_terms
from ..operators import calc, crawl, evidence, pages, passages, ranking
from ..sources.tables import table
from . import sqlparts as S
from .retrieval_queries import BY, _passages
from .text_queries import HOST, INDEXED, QUERIES, bm25f

NOW, CUTOFF = "2026-01-01T00:00:00+00:00", "2025-06-01"
RULES = [{"label": "small", "lt": 100000}, {"label": "middle", "gte": 100000, "lt": 250000}, {"label": "large", "gte": 250000}]


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "url", "content_html")


def page_titles(spark, d):
    got = pages.extracted(_pages(spark, d))
    return got.select("doc_id", "title")


def page_links(spark, d):
    got = pages.extracted(_pages(spark, d))
    return got.select("doc_id", F.explode("links").alias("link")).select("doc_id", F.regexp_extract("link", r"^https?://[^/]+(/.*)$", 1).alias("path"))


def link_scope(spark, d):
    got = pages.extracted(_pages(spark, d))
    return got.select("doc_id", F.explode("links").alias("link")).filter(urls.host(F.col("link")).isin("jwc.lanwan.example", "lib.lanwan.example"))


def page_text(spark, d):
    return pages.extracted(_pages(spark, d)).select("doc_id", "title", "text")


def minimal_html(spark, d):
    return pages.extracted(_pages(spark, d)).select("doc_id", "content_html")


def html_blocks(spark, d):
    return pages.html_blocks(_pages(spark, d)).select("doc_id", "block", "tag", "text")


def heading_paths(spark, d):
    return pages.html_blocks(_pages(spark, d)).filter("heading_path <> ''").select("doc_id", "block", "heading_path")


def table_values(spark, d):
    return pages.table_cells(_pages(spark, d))


def table_sections(spark, d):
    return pages.table_cards(_pages(spark, d), query_terms(QUERIES[1]))


def structured_evidence(spark, d):
    hits = ranking.top(_passages(spark, d), 50, F.desc("score"), F.asc("document_id"), F.asc("chunk_index"))
    text = passages.passages(table(spark, d, INDEXED)).select("document_id", "chunk_index", "text")
    rows = hits.select("document_id", "chunk_index").distinct().join(text, ["document_id", "chunk_index"]).join(_pages(spark, d).withColumnRenamed("doc_id", "document_id"), "document_id")
    return pages.structured_evidence(rows, query_terms(QUERIES[1]))


def _tasks(spark, d):
    return table(spark, d, "crawl_tasks")


def crawl_enqueue(spark, d):
    """The links of all pages that no task has, together with the urls of the pages themselves."""
    links = pages.extracted(_pages(spark, d)).select(F.explode("links").alias("url"))
    found = links.union(table(spark, d, "documents").select("url"))
    return crawl.enqueue(_tasks(spark, d), found.select("url", urls.host(F.col("url")).alias("host")))


def crawl_recover(spark, d):
    return crawl.state_counts(crawl.recover(_tasks(spark, d)))


def crawl_claim(spark, d):
    return crawl.claim(_tasks(spark, d), 100).select("seq", "url", "state", "attempts")


def crawl_complete(spark, d):
    done = crawl.complete(_tasks(spark, d), F.col("state") == "processing", NOW)
    return done.select("seq", "state", "finished_at", "last_error")


def crawl_fail_retry(spark, d):
    return crawl.fail(_tasks(spark, d), F.col("state") == "processing", "timeout", NOW).select("seq", "state", "attempts", "finished_at", "last_error")


def crawl_requeue(spark, d):
    return crawl.requeue(_tasks(spark, d), CUTOFF, True).select("seq", "state", "attempts", "finished_at")


def crawl_state_counts(spark, d):
    return crawl.state_counts(_tasks(spark, d))


def host_schedule(spark, d):
    return crawl.host_schedule(_tasks(spark, d), 0.2).select("seq", "host", "offset")


def _orders(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"]).alias("q"), F.collect_set("l_partkey").alias("parts"))


def _calc(operator: str):
    return lambda spark, d: _orders(spark, d).select("l_orderkey", calc.column(operator, F.col("q")).alias("result"))


calc_count, calc_count_unique, calc_sum = _calc("count"), _calc("count_unique"), _calc("sum")


def calc_minmax(spark, d):
    return _orders(spark, d).select("l_orderkey", calc.column("min", F.col("q")).alias("low"), calc.column("max", F.col("q")).alias("high"))


def calc_sort(spark, d):
    return _orders(spark, d).select("l_orderkey", F.array_join(F.transform(calc.column("sort", F.col("q")), lambda x: x.cast("int").cast("string")), ",").alias("sorted"))


def calc_classify(spark, d):
    return table(spark, d, "orders").select("o_orderkey", calc.classified(F.col("o_totalprice"), RULES).alias("label"))


def calc_arithmetic(spark, d):
    a, b = F.col("l_quantity"), F.col("l_discount")
    names = ("add", "subtract", "multiply")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(calc.column(n, a, b), 6).alias(n) for n in names])


def calc_ratio(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(calc.column("ratio", F.col("l_tax"), F.col("l_discount")), 6).alias("ratio"))


def calc_set_ops(spark, d):
    left = _orders(spark, d).select((F.col("l_orderkey") % 100).alias("g"), F.explode("parts").alias("p")).groupBy("g").agg(F.collect_set(F.col("p") % 50).alias("a"), F.collect_set(F.floor(F.col("p") / 7) % 60).alias("b"))
    return left.select("g", *[F.array_join(F.transform(F.array_sort(calc.column(n, F.col("a"), F.col("b"))), lambda x: x.cast("string")), ",").alias(n) for n in ("intersection", "union", "difference")])


def _hits(spark, d):
    hits = ranking.top(bm25f(spark, d), 20).select("query_id", "rank", "document_id").withColumn("conversation", F.lit(1))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "url", F.coalesce("text", F.lit("")).alias("text"))
    return evidence.interleave(hits).join(docs, "document_id")


def evidence_interleave(spark, d):
    return _hits(spark, d).select("query_id", "rank", "document_id", "place")


def evidence_merge(spark, d):
    rows = _hits(spark, d).withColumns({"passage_id": F.concat_ws(":", "document_id", F.lit("0")), "query": F.col("query_id").cast("string")})
    return evidence.merge(rows).select("evidence_id", "url", "place", "retrieved_by")


def context_budget(spark, d):
    rows = _hits(spark, d).withColumn("cost", T.token_estimate(F.col("text")))
    return evidence.budgeted(rows, 4000)


ALLHITS = f"WITH {S.bm25f(QUERIES)}, r AS (SELECT query_id, row_number() OVER ({BY}) AS rank, document_id FROM sparse QUALIFY rank <= 20), j AS (SELECT *, row_number() OVER (ORDER BY rank, query_id) AS place FROM r), i AS (SELECT CAST(query_id AS INTEGER) AS query_id, rank, document_id, place, url, coalesce(text, '') AS text FROM j JOIN documents ON doc_id = document_id) "
L = "WITH o AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber) AS q, list(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) "

#: Links of all pages: all of them are absolute paths.
LINKS = f"WITH h AS (SELECT DISTINCT doc_id, url AS base, unnest(regexp_extract_all(content_html, 'href=\"([^\"]*)\"', 1)) AS path FROM documents), k AS (SELECT DISTINCT doc_id, link, {HOST.replace('url', 'link')} AS host FROM (SELECT doc_id, regexp_extract(base, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') || path AS link FROM h)) "
SQL = {
    "page_titles": r"SELECT doc_id, CASE WHEN content_html LIKE '%<h1>%' THEN trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_extract(content_html, '<h1>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&'), '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') ELSE '' END AS title FROM documents",
    "page_links": "SELECT DISTINCT doc_id, unnest(regexp_extract_all(content_html, 'href=\"([^\"]*)\"', 1)) AS path FROM documents",
    "link_scope": LINKS + "SELECT doc_id, link FROM k WHERE host IN ('jwc.lanwan.example', 'lib.lanwan.example')",
    "page_text": None,
    "minimal_html": None,
    "html_blocks": None,
    "heading_paths": None,
    "table_values": None,
    "table_sections": None,
    "structured_evidence": None,
    "crawl_enqueue": LINKS + f", f AS (SELECT link AS url FROM k UNION SELECT url FROM documents WHERE url IS NOT NULL) SELECT DISTINCT url, nullif({HOST}, '') AS host FROM f WHERE url NOT IN (SELECT url FROM crawl_tasks WHERE url IS NOT NULL)",
    "crawl_recover": "SELECT CASE WHEN state = 'processing' THEN 'pending' ELSE state END AS state, count(*) AS tasks FROM crawl_tasks GROUP BY 1",
    "crawl_claim": "SELECT seq, url, 'processing' AS state, coalesce(attempts, 0) + 1 AS attempts FROM (SELECT * FROM crawl_tasks WHERE state = 'pending' ORDER BY seq LIMIT 100)",
    "crawl_complete": f"SELECT seq, CASE WHEN state = 'processing' THEN 'done' ELSE state END AS state, CASE WHEN state = 'processing' THEN '{NOW}' ELSE finished_at END AS finished_at, CASE WHEN state = 'processing' THEN NULL ELSE last_error END AS last_error FROM crawl_tasks",
    "crawl_fail_retry": f"SELECT seq, CASE WHEN state = 'processing' THEN CASE WHEN attempts < 3 THEN 'pending' ELSE 'failed' END ELSE state END AS state, attempts, CASE WHEN state = 'processing' THEN CASE WHEN attempts < 3 THEN NULL ELSE '{NOW}' END ELSE finished_at END AS finished_at, CASE WHEN state = 'processing' THEN 'timeout' ELSE last_error END AS last_error FROM crawl_tasks",
    "crawl_requeue": f"WITH t AS (SELECT *, (state = 'done' AND (finished_at IS NULL OR finished_at <= '{CUTOFF}')) OR state = 'failed' AS b FROM crawl_tasks) SELECT seq, CASE WHEN b THEN 'pending' ELSE state END AS state, CASE WHEN b THEN 0 ELSE attempts END AS attempts, CASE WHEN b THEN NULL ELSE finished_at END AS finished_at FROM t",
    "crawl_state_counts": "SELECT state, count(*) AS tasks FROM crawl_tasks GROUP BY 1",
    "host_schedule": "SELECT seq, host, round((row_number() OVER (PARTITION BY host ORDER BY seq) - 1) * 0.2e0, 3) AS \"offset\" FROM crawl_tasks WHERE state = 'pending' AND host IS NOT NULL",
    "calc_count": L + "SELECT l_orderkey, len(q) AS result FROM o",
    "calc_count_unique": L + "SELECT l_orderkey, len(list_distinct(q)) AS result FROM o",
    "calc_sum": L + "SELECT l_orderkey, list_sum(q) AS result FROM o",
    "calc_minmax": L + "SELECT l_orderkey, list_min(q) AS low, list_max(q) AS high FROM o",
    "calc_sort": L + "SELECT l_orderkey, array_to_string(list_transform(list_sort(q), lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), ',') AS sorted FROM o",
    "calc_classify": "SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 250000 THEN 'middle' ELSE 'large' END AS label FROM orders",
    "calc_arithmetic": "SELECT l_orderkey, l_linenumber, round(l_quantity + l_discount, 6) AS add, round(l_quantity - l_discount, 6) AS subtract, round(l_quantity * l_discount, 6) AS multiply FROM lineitem",
    "calc_ratio": "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 6) END AS ratio FROM lineitem",
    "calc_set_ops": L + ", x AS (SELECT l_orderkey % 100 AS g, unnest(parts) AS p FROM o), s AS (SELECT g, list(DISTINCT p % 50) AS a, list(DISTINCT (p // 7) % 60) AS b FROM x GROUP BY 1) SELECT g, array_to_string(list_sort(list_filter(a, lambda v: list_contains(b, v))), ',') AS \"intersection\", array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS \"union\", array_to_string(list_sort(list_filter(a, lambda v: NOT list_contains(b, v))), ',') AS difference FROM s",
    "evidence_interleave": ALLHITS + "SELECT query_id, rank, document_id, place FROM i",
    "evidence_merge": ALLHITS + "SELECT 'ev_' || left(sha256(coalesce(url || chr(0), '') || document_id || ':0' || chr(0) || text), 16) AS evidence_id, first(url) AS url, min(place) AS place, string_agg(DISTINCT CAST(query_id AS VARCHAR), '|' ORDER BY CAST(query_id AS VARCHAR)) AS retrieved_by FROM i WHERE text <> '' GROUP BY 1",
    "context_budget": ALLHITS.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT place, text, url, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) + (length(text) - length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) + 3) // 4 + 4 AS cost, row_number() OVER (ORDER BY place) AS n FROM i),
f AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS place, false AS ok, CAST(0 AS BIGINT) AS spent, CAST([] AS VARCHAR[]) AS texts, CAST([] AS VARCHAR[]) AS urls
UNION ALL SELECT g.n, g.place, g.ok, CASE WHEN g.ok THEN g.spent + g.cost ELSE g.spent END, CASE WHEN g.ok THEN list_append(g.texts, g.text) ELSE g.texts END, CASE WHEN g.ok THEN list_append(g.urls, g.url) ELSE g.urls END FROM (
SELECT o.n, o.place, o.cost, o.text, o.url, f.spent, f.texts, f.urls, len(f.texts) < 20 AND NOT list_contains(f.texts, o.text) AND (coalesce(o.url, '') = '' OR len(list_filter(f.urls, lambda u: u = o.url)) < 3) AND f.spent + o.cost <= 4000 AS ok FROM f JOIN o ON o.n = f.n + 1) g)
SELECT 1 AS conversation, CAST(place AS INTEGER) AS place FROM f WHERE ok""",
}


def queries() -> dict:
    return {k: globals()[k] for k in SQL}
