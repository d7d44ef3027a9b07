"""SQL text shared by the SQL twins: tokens and scores written a second time, by windows over characters."""

from __future__ import annotations

from ..functions.text import STOPWORDS
from ..functions.tokens import query_terms

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
FIELDS = """fld AS (SELECT document_id, 0 AS field, title_norm AS x FROM indexed_documents WHERE title_norm <> ''
  UNION ALL SELECT document_id, 1, text_norm FROM indexed_documents WHERE text_norm <> ''),"""


def tokens(fields: str = FIELDS) -> str:
    """WITH-parts up to `tok(document_id, field, term, start)` in search mode."""
    return f"""{fields}
arr AS (SELECT document_id, field, regexp_extract_all(x, '(?s).') AS a FROM fld),
ch AS (SELECT document_id, field, unnest(a) AS c, generate_subscripts(a, 1) - 1 AS p FROM arr),
k AS (SELECT *, CASE WHEN unicode(c) BETWEEN 19968 AND 40959 THEN 1 WHEN regexp_matches(c, '[\\p{{L}}\\p{{M}}\\p{{N}}]') THEN 2 ELSE 0 END AS kind FROM ch),
nb AS (SELECT *, lead(c) OVER w AS c2, coalesce(lead(kind) OVER w, 0) AS k2, coalesce(lag(kind) OVER w, 0) AS k0 FROM k WINDOW w AS (PARTITION BY document_id, field ORDER BY p)),
runs AS (SELECT *, sum(CASE WHEN k0 <> 2 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, field ORDER BY p) AS r FROM nb WHERE kind = 2),
tok AS (SELECT document_id, field, c || c2 AS term, p AS start FROM nb WHERE kind = 1 AND k2 = 1
  UNION ALL SELECT document_id, field, c, p FROM nb WHERE kind = 1 AND k2 <> 1 AND k0 <> 1 AND c NOT IN ({STOP})
  UNION ALL SELECT document_id, field, string_agg(c, '' ORDER BY p), min(p) FROM runs GROUP BY document_id, field, r)"""


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def term_values(queries: dict[int, str]) -> str:
    """`q(query_id, term)` as a WITH-part."""
    return "q(query_id, term) AS (VALUES " + ", ".join(f"({k}, {text(t)})" for k, v in queries.items() for t in query_terms(v)) + ")"


def bm25f(queries: dict[int, str]) -> str:
    """WITH-parts up to `sparse(query_id, document_id, score)`."""
    return f"""{tokens()}, {term_values(queries)},
len AS (SELECT d.document_id, count(t.term) FILTER (t.field = 0) AS l0, count(t.term) FILTER (t.field = 1) AS l1 FROM indexed_documents d LEFT JOIN tok t USING (document_id) GROUP BY 1),
st AS (SELECT count(*) AS n, sum(l0) / CAST(count(*) AS DOUBLE) AS a0, sum(l1) / CAST(count(*) AS DOUBLE) AS a1 FROM len),
tf AS (SELECT term, document_id, count(*) FILTER (field = 0) AS f0, count(*) FILTER (field = 1) AS f1 FROM tok WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT tf.term, tf.document_id, dfs.df, st.n,
  2e0 * f0 / (CASE WHEN a0 = 0 THEN 1e0 ELSE 1e0 - 0.3e0 + 0.3e0 * (l0 / a0) END) + 1e0 * f1 / (CASE WHEN a1 = 0 THEN 1e0 ELSE 1e0 - 0.75e0 + 0.75e0 * (l1 / a1) END) AS s
  FROM tf JOIN dfs USING (term) JOIN len USING (document_id) CROSS JOIN st),
sparse AS (SELECT q.query_id, document_id, round(sum(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * 2.2e0 * s / (1.2e0 + s)), 12) AS score FROM w JOIN q USING (term) GROUP BY 1, 2)"""
