"""Queries over pages whose structure is known, as they are made from relational tables: one page per nation.

A page has the nation as first heading, a table of its customers and a list of its suppliers under headings of their own, and
a closing paragraph. So SQL can say what must be read from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages
from ..sources.tables import table

LABEL = "客户名单 customers"
TERMS = ["名单", "customers", "x"]


def _rows(t: DataFrame, key: str, order: str, cell) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, cell.alias("cell")))), lambda x: x["cell"]), "")
    return t.groupBy(F.col(key).alias("n_nationkey")).agg(joined.alias(key))


def built(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, url, content_html)."""
    tr = F.concat(F.lit("<tr><td>"), "c_name", F.lit("</td><td>"), "c_mktsegment", F.lit("</td><td>-</td></tr>"))
    customers = _rows(table(spark, d, "customer"), "c_nationkey", "c_custkey", tr)
    suppliers = _rows(table(spark, d, "supplier"), "s_nationkey", "s_suppkey", F.concat(F.lit("<li>"), "s_name", F.lit("</li>")))
    nations = table(spark, d, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("long"))
    of = nations.join(customers, "n_nationkey").join(suppliers, "n_nationkey", "left")
    html = F.concat(
        F.lit("<h1>"), "n_name", F.lit(f"</h1><h2>{LABEL}</h2><table><tr><th>name</th><th>segment</th></tr>"), "c_nationkey", F.lit("</table><h2>suppliers</h2><ul>"), F.coalesce("s_nationkey", F.lit("")), F.lit("</ul><p>end of "), "n_name", F.lit("</p>")
    )
    return of.select(F.col("n_nationkey").alias("doc_id"), F.lit("http://a.example/").alias("url"), html.alias("content_html"))


def built_table_values(spark, d):
    return pages.table_cells(built(spark, d))


def built_table_sections(spark, d):
    return pages.table_cards(built(spark, d), TERMS, 100)


def built_html_blocks(spark, d):
    return pages.html_blocks(built(spark, d)).select("doc_id", "block", "tag", "text")


def built_heading_paths(spark, d):
    return pages.html_blocks(built(spark, d)).select("doc_id", "block", "heading_path")


def built_page_text(spark, d):
    return pages.extracted(built(spark, d)).select("doc_id", "title", "text")


def built_minimal_html(spark, d):
    return pages.extracted(built(spark, d)).select("doc_id", "content_html")


def built_structured(spark, d):
    """The structure around a passage that holds the names of all suppliers of a nation."""
    names = _rows(table(spark, d, "supplier"), "s_nationkey", "s_suppkey", F.concat(F.lit(" "), "s_name")).withColumnRenamed("n_nationkey", "doc_id")
    rows = built(spark, d).join(names.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "left")
    hits = rows.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.trim(F.coalesce("s_nationkey", F.lit(""))).alias("text"), "content_html")
    return pages.structured_evidence(hits, TERMS)


BASE = """WITH c AS (SELECT c_nationkey AS k, c_custkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
s AS (SELECT s_nationkey AS k, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier WHERE s_nationkey IN (SELECT k FROM c)),
m AS (SELECT k, max(n) AS n, string_agg('<tr><td>' || c_name || '</td><td>' || c_mktsegment || '</td><td>-</td></tr>', '' ORDER BY r) AS trs, string_agg(c_name || ' ' || c_mktsegment || ' -', ' ' ORDER BY r) AS words FROM c GROUP BY 1),
l AS (SELECT k, count(*) AS n, string_agg('<li>' || s_name || '</li>', '' ORDER BY r) AS lis, string_agg(s_name, ' ' ORDER BY r) AS words FROM s GROUP BY 1),
p AS (SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name, m.n, trs, m.words AS cwords, coalesce(l.n, 0) AS ns, coalesce(lis, '') AS lis, coalesce(l.words, '') AS swords FROM nation JOIN m ON m.k = n_nationkey LEFT JOIN l ON l.k = n_nationkey),
""".replace("LABEL", LABEL)
BLOCKS = f"""b AS (SELECT doc_id, 0 AS block, 'h1' AS tag, n_name AS text, n_name AS heading_path FROM p
UNION ALL SELECT doc_id, 1, 'h2', '{LABEL}', n_name || ' > {LABEL}' FROM p
UNION ALL SELECT doc_id, 2, 'tr', 'name segment', n_name || ' > {LABEL}' FROM p
UNION ALL SELECT doc_id, 2 + r, 'tr', c_name || ' ' || c_mktsegment || ' -', n_name || ' > {LABEL}' FROM p JOIN c ON c.k = doc_id
UNION ALL SELECT doc_id, 3 + n, 'h2', 'suppliers', n_name || ' > suppliers' FROM p
UNION ALL SELECT doc_id, 3 + n + r, 'li', s_name, n_name || ' > suppliers' FROM p JOIN s ON s.k = doc_id
UNION ALL SELECT doc_id, 4 + n + ns, 'p', 'end of ' || n_name, n_name || ' > suppliers' FROM p) """
SQL = {
    "built_table_values": BASE + "v AS (SELECT k AS doc_id, 0 AS \"table\", CAST(r AS INTEGER) AS \"row\", 0 AS \"column\", c_name AS text FROM c UNION ALL SELECT k, 0, CAST(r AS INTEGER), 1, c_mktsegment FROM c) SELECT CAST(doc_id AS BIGINT) AS doc_id, \"table\", \"row\", \"column\", text FROM v",
    "built_table_sections": BASE + f"v AS (SELECT doc_id, t AS \"table\", '{LABEL}' AS label, CAST(2 * n AS INTEGER) AS size, {sum(len(t) for t in TERMS if len(t) >= 2)} AS score FROM p CROSS JOIN (VALUES (0), (-1)) x(t)) SELECT * FROM v",
    "built_html_blocks": BASE + BLOCKS + "SELECT doc_id, CAST(block AS INTEGER) AS block, tag, text FROM b",
    "built_heading_paths": BASE + BLOCKS + "SELECT doc_id, CAST(block AS INTEGER) AS block, heading_path FROM b",
    "built_structured": BASE + "v AS (SELECT doc_id AS document_id, 0 AS chunk_index, CASE WHEN ns > 0 THEN 'ul' ELSE 'passage' END AS scope, swords AS content, CASE WHEN ns > 0 THEN n_name || ' > suppliers' ELSE '' END AS heading_path FROM p) SELECT * FROM v",
    "built_page_text": BASE + f"v AS (SELECT doc_id, n_name AS title, n_name || ' {LABEL} name segment ' || cwords || ' suppliers ' || CASE WHEN swords = '' THEN '' ELSE swords || ' ' END || 'end of ' || n_name AS text FROM p) SELECT * FROM v",
    "built_minimal_html": BASE + f"v AS (SELECT doc_id, '<h1>' || n_name || '</h1><h2>{LABEL}</h2><table><tr><th>name</th><th>segment</th></tr>' || trs || '</table><h2>suppliers</h2><ul>' || lis || '</ul><p>end of ' || n_name || '</p>' AS content_html FROM p) SELECT * FROM v",
}


def queries() -> dict:
    return {k: globals()[k] for k in SQL}
