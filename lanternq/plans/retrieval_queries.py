"""Queries over passages, vectors, fusion, reranking, cards and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import query_terms as terms
from ..functions.tokens import spans
from ..operators import dense, evaluate, fusion, pages, passages, ranking, rerank
from ..sources.tables import table
from . import sqlparts as S
from . import stored
from .text_queries import INDEXED, QUERIES, SQL as TEXT_SQL, bm25f

LIMIT, SIDE = 20, 100
#: Vectors whose id is divisible by this are the queries.
EVERY = 50


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, chunk_index, embedding): all supplied vectors, dealt to two passages of each document."""
    emb = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = emb.agg(F.count(F.lit(1)).alias("n"))
    ids = table(spark, d, INDEXED).select("document_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index")).crossJoin(F.broadcast(n))  # one row
    return ids.withColumn("vec_id", (F.col("document_id") * 7 + F.col("chunk_index")) % F.col("n")).join(emb, "vec_id").select("document_id", "chunk_index", "embedding")


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").filter(F.col("vec_id") % EVERY == 0)
    return rows.select((F.col("vec_id") / EVERY).cast("int").alias("query_id"), "embedding")


def index_build(spark, d):
    """Build and publish the stored index that the searches read; rows per table."""
    counts = stored.index_of(spark, d)[0]["counts"]
    return spark.createDataFrame([(k, counts[k]) for k in ("lengths", "postings", "passages")], "name string, rows long")


def passage_chunks(spark, d):
    return passages.passages(table(spark, d, INDEXED)).select("document_id", "chunk_index", "start", F.col("end").alias("stop"), "tokens")


def _passages(spark, d):
    rows = stored.index_of(spark, d)[1]["passage_postings"]
    return passages.passage_bm25_of_index(stored.stats(spark, d), rows, QUERIES)


def _rounded(ranked: DataFrame, *keys: str) -> DataFrame:
    return ranked.select("query_id", "rank", *keys, F.round("score", 6).alias("score"))


def passage_bm25(spark, d):
    return _rounded(dense.ranked(_passages(spark, d), LIMIT), "document_id", "chunk_index")


def _dense(spark, d, limit, once=False):
    return dense.scores_of(vectors(spark, d), query_vectors(spark, d), ["document_id", "chunk_index"], limit, once=once)


def dense_passages_topk(spark, d):
    return _rounded(dense.ranked(_dense(spark, d, LIMIT), LIMIT), "document_id", "chunk_index")


def _dense_documents(spark, d):
    return ranking.top(dense.best_per_document(_dense(spark, d, SIDE, True)), SIDE)


def dense_documents_topk(spark, d):
    return _rounded(_dense_documents(spark, d).filter(F.col("rank") <= LIMIT), "document_id", "chunk_index")


def vector_validation(spark, d):
    return dense.validation(table(spark, d, "embeddings"), 64)


def dense_index_stats(spark, d):
    docs = table(spark, d, INDEXED)
    chunks = passages.passages(docs)
    return chunks.agg(F.countDistinct("document_id").alias("indexed_documents"), F.count(F.lit(1)).alias("chunks")).crossJoin(docs.agg(F.count(F.lit(1)).alias("documents")))


def _sparse(spark, d):
    return ranking.top(bm25f(spark, d), SIDE)


def minmax_scores(spark, d):
    return fusion.minmax(_sparse(spark, d)).select("query_id", "document_id", F.round("score", 6).alias("score"))


def hybrid_documents(spark, d):
    return _rounded(fusion.fuse(_sparse(spark, d), _dense_documents(spark, d), LIMIT), "document_id")


def hybrid_alpha0(spark, d):
    return _rounded(fusion.fuse(_sparse(spark, d), _dense_documents(spark, d), LIMIT, 0), "document_id")


def hybrid_alpha1(spark, d):
    return _rounded(fusion.fuse(_sparse(spark, d), _dense_documents(spark, d), LIMIT, 1), "document_id")


def hybrid_passages(spark, d):
    sparse = dense.ranked(_passages(spark, d), SIDE)
    found = dense.ranked(_dense(spark, d, SIDE), SIDE)
    return _rounded(fusion.fuse(sparse, found, LIMIT, keys=("document_id", "chunk_index")), "document_id", "chunk_index")


def rerank_documents_lexical(spark, d):
    hits = ranking.top(bm25f(spark, d), 50)
    return rerank.rerank_documents(hits, table(spark, d, INDEXED), {q: T.normalize(t) for q, t in QUERIES.items()})


def rerank_windows(spark, d):
    query = T.normalize(QUERIES[1])
    make = lambda i, h, t: [(i, k, w) for k, w in enumerate(rerank.chosen_windows(query, h or "", t or ""))]
    return pages.per_page(table(spark, d, INDEXED), ["document_id", "title_norm", "text_norm"], "document_id long, window int, text string", make)


def _runs(spark, d):
    """Scores of the given runs by a rule, some saturated and some not."""
    runs = table(spark, d, "eval_runs").filter("rank is not null").select("query_id", F.col("rank").alias("candidate")).distinct()
    step = (F.col("candidate") * 7) % 10
    return runs.withColumn("score", F.when(F.col("query_id") % 2 == 0, 1 - step / 4000).otherwise(0.5 + step / 25))


def rerank_plateau(spark, d):
    return rerank.plateau(_runs(spark, d)).select("query_id", "candidate", "rank")


def rerank_passages_capped(spark, d):
    scored = dense.ranked(_passages(spark, d), 50)
    text = passages.passages(table(spark, d, INDEXED)).select("document_id", "chunk_index", "text")
    rows = scored.withColumnRenamed("rank", "candidate").join(text, ["document_id", "chunk_index"])
    return _rounded(rerank.rerank_passages(rows.select("query_id", "candidate", "document_id", "chunk_index", "score", "text"), LIMIT), "document_id", "chunk_index")


def _terms():
    return F.array(*[F.lit(t) for t in terms(QUERIES[1])])


def lexical_score(spark, d):
    docs = table(spark, d, INDEXED).filter("text_norm is not null")
    return docs.select("document_id", T.lexical_score(F.col("text_norm"), _terms()).alias("score"))


def query_snippets(spark, d):
    docs = table(spark, d, INDEXED).filter("text_norm is not null")
    return docs.select("document_id", T.snippet(F.col("text_norm"), _terms()).alias("snippet"))


def search_cards(spark, d):
    hits = ranking.top(bm25f(spark, d), LIMIT).select("query_id", "rank", "document_id")
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "document_id")
    title = F.when(F.coalesce(F.col("title"), F.lit("")) == "", F.col("url")).otherwise(F.col("title"))
    return hits.join(docs, "document_id").select("query_id", "rank", title.alias("title"), "url", T.published_date(F.coalesce("text", F.lit("")), F.coalesce("url", F.lit(""))).alias("published_at"))


def ranked_urls(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "url")
    return hybrid_documents(spark, d).join(docs, "document_id").select("query_id", "rank", "url")


def _first(spark, d):
    return evaluate.first_hits(table(spark, d, "eval_runs"), table(spark, d, "qrels"))


def mrr_at_20(spark, d):
    return evaluate.mrr(_first(spark, d))


def recall_at_20(spark, d):
    return evaluate.recall(_first(spark, d))


def top1_hits(spark, d):
    return evaluate.top1(_first(spark, d))


CHUNKS = f"""{S.tokens()},
mt AS (SELECT document_id, field, p AS s, p + 1 AS e FROM k WHERE kind = 1 UNION ALL SELECT document_id, field, min(p), max(p) + 1 FROM runs GROUP BY document_id, field, r),
mn AS (SELECT *, row_number() OVER (PARTITION BY document_id, field ORDER BY s) - 1 AS i FROM mt),
tl AS (SELECT document_id, count(*) FILTER (field = 0) AS t0, count(*) FILTER (field = 1) AS n FROM mn GROUP BY 1),
wd AS (SELECT d.document_id, coalesce(d.title_norm, '') <> '' AS has, coalesce(n, 0) AS n, 376 - least(coalesce(t0, 0), 64) AS w FROM indexed_documents d LEFT JOIN tl USING (document_id)),
cn AS (SELECT *, unnest(range(CASE WHEN n <= w THEN 1 ELSE CAST(ceil((n - w) / (w - 64e0)) AS INTEGER) + 1 END)) AS c FROM wd WHERE n > 0 OR has),
cb AS (SELECT document_id, c, n, c * (w - 64) AS f, least(c * (w - 64) + w, n) AS l FROM cn),
chunk AS (SELECT cb.document_id, CAST(c AS INTEGER) AS chunk_index, coalesce(a.s, 0) AS start, coalesce(b.e, 0) AS stop, l - f AS tokens
  FROM cb LEFT JOIN mn a ON a.document_id = cb.document_id AND a.field = 1 AND a.i = f LEFT JOIN mn b ON b.document_id = cb.document_id AND b.field = 1 AND b.i = l - 1)"""
PASSAGE = f"""{CHUNKS}, {S.term_values(QUERIES)},
pt AS (SELECT c.document_id, c.chunk_index, 1 AS field, t.term FROM chunk c JOIN tok t ON t.document_id = c.document_id AND t.field = 1 AND t.start >= c.start AND t.start + length(t.term) <= c.stop
  UNION ALL SELECT c.document_id, c.chunk_index, 0, t.term FROM chunk c JOIN tok t ON t.document_id = c.document_id AND t.field = 0),
pl AS (SELECT c.document_id, c.chunk_index, count(p.term) AS size FROM chunk c LEFT JOIN pt p ON p.document_id = c.document_id AND p.chunk_index = c.chunk_index GROUP BY 1, 2),
ps AS (SELECT count(*) AS rows, avg(size) AS mean FROM pl),
pf AS (SELECT document_id, chunk_index, term, 2e0 * count(*) FILTER (field = 0) + count(*) FILTER (field = 1) AS f FROM pt WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
pd AS (SELECT term, count(*) AS df FROM pf GROUP BY 1),
psparse AS (SELECT q.query_id, pf.document_id, pf.chunk_index, round(sum((CASE WHEN ln((rows - df + 0.5e0) / (df + 0.5e0)) <= 0 THEN 1e-6 ELSE ln((rows - df + 0.5e0) / (df + 0.5e0)) END) * f * 2.2e0 / (f + 1.2e0 * (0.25e0 + 0.75e0 * size / mean))), 12) AS score
  FROM pf JOIN pd USING (term) JOIN pl ON pl.document_id = pf.document_id AND pl.chunk_index = pf.chunk_index JOIN q USING (term) CROSS JOIN ps GROUP BY 1, 2, 3)"""
VEC = """pv AS (SELECT document_id, c.chunk_index, CAST(embedding AS DOUBLE[]) AS e FROM indexed_documents CROSS JOIN (VALUES (0), (1)) c(chunk_index) JOIN embeddings ON vec_id = (document_id * 7 + c.chunk_index) % (SELECT count(*) FROM embeddings)),
qv AS (SELECT CAST(vec_id // 50 AS INTEGER) AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0),
dp AS (SELECT query_id, document_id, chunk_index, round(list_inner_product(e, v), 12) AS score FROM pv CROSS JOIN qv),
dd AS (SELECT query_id, document_id, arg_min(chunk_index, (-score, chunk_index)) AS chunk_index, max(score) AS score FROM dp GROUP BY 1, 2)"""
BY = "PARTITION BY query_id ORDER BY score DESC, document_id"
BYC = BY + ", chunk_index"


def _fused(sparse: str, found: str, keys: str, by: str, alpha: float) -> str:
    low = lambda t: f"(CASE WHEN min(score) OVER (PARTITION BY query_id) = max(score) OVER (PARTITION BY query_id) THEN 1e0 ELSE (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id)) END) AS {t}"
    return f"""sa AS (SELECT * FROM {sparse} QUALIFY row_number() OVER ({by}) <= {SIDE}), sn AS (SELECT query_id, {keys}, {low('s')} FROM sa),
da AS (SELECT * FROM {found} QUALIFY row_number() OVER ({by}) <= {SIDE}), dn AS (SELECT query_id, {keys}, {low('d')} FROM da),
fu AS (SELECT query_id, {keys}, round({1 - alpha}e0 * coalesce(s, 0e0) + {alpha}e0 * coalesce(d, 0e0), 12) AS score FROM sn FULL JOIN dn USING (query_id, {keys})),
out AS (SELECT CAST(query_id AS INTEGER) AS query_id, row_number() OVER ({by}) AS rank, {keys}, round(score, 6) AS score FROM fu)"""


Q1 = ", ".join(S.text(t) for t in terms(QUERIES[1]))
SCORE = "list_sum(list_transform([{t}], lambda t: length(t) * ((length({x}) - length(replace({x}, t, ''))) // length(t))))"
RUNS = "r AS (SELECT DISTINCT query_id, rank AS candidate FROM eval_runs WHERE rank IS NOT NULL), s AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN 1e0 - ((candidate * 7) % 10) / 4000e0 ELSE 0.5e0 + ((candidate * 7) % 10) / 25e0 END AS score FROM r)"
LOGIT = lambda x: f"ln(greatest(least({x}, 1e0 - 1e-7), 1e-7) / (1e0 - greatest(least({x}, 1e0 - 1e-7), 1e-7)))"
#: Ranks of s(query_id, candidate, score) with saturated scores in the order of their candidates.
PLATEAU = f"b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM s), fl AS (SELECT *, best >= 0.99e0 AND best <= 1 AND score BETWEEN 0 AND 1 AND {LOGIT('best')} - {LOGIT('score')} <= 0.2e0 AS flat FROM b), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY flat DESC, CASE WHEN flat THEN candidate ELSE -score END, candidate) AS rank FROM fl)"
FIRST = r"""WITH rel AS (SELECT DISTINCT query_id, regexp_replace(url, '#.*$', '') AS url FROM qrels WHERE url IS NOT NULL),
h AS (SELECT query_id, min(rank) AS first FROM (SELECT query_id, rank, regexp_replace(url, '#.*$', '') AS url FROM eval_runs WHERE rank BETWEEN 1 AND 20) JOIN rel USING (query_id, url) GROUP BY 1),
f AS (SELECT query_id, first FROM (SELECT DISTINCT query_id FROM rel) LEFT JOIN h USING (query_id)) """
OUT = "SELECT * FROM out WHERE rank <= 20"
RANKED = "SELECT CAST(query_id AS INTEGER) AS query_id, row_number() OVER ({by}) AS rank, {keys}, round(score, 6) AS score FROM {t} QUALIFY row_number() OVER ({by}) <= 20"

def _windows(query: str) -> str:
    """WITH-parts up to chosen(document_id, window, text): the windows for a query, of titles under 64 tokens."""
    q = rerank.compact(T.normalize(query))
    pairs, chars = sorted({q[i : i + 2] for i in range(len(q) - 1)}), sorted(set(q))
    room = rerank.PAIR_TOKENS - rerank.SPECIALS - passages.FRAME_TOKENS - len(spans([T.normalize(query)], "model")[1])
    held = lambda of: f"len(list_filter([{', '.join(S.text(x) for x in of)}], lambda x: contains(c, x)))"
    return f"""WITH {CHUNKS.replace("376 -", f"{room} -")},
wt AS (SELECT c.document_id, c.chunk_index AS k, CASE WHEN coalesce(text_norm, '') = '' OR stop = start THEN coalesce(title_norm, '') WHEN coalesce(title_norm, '') = '' THEN '' ELSE title_norm || chr(10) END || substr(coalesce(text_norm, ''), CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)) AS text FROM chunk c JOIN indexed_documents d USING (document_id)),
wc AS (SELECT *, regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS c FROM wt),
wp AS (SELECT document_id, k, text, contains(c, {S.text(q)}) AS whole, {held(pairs)} AS pairs, {held(chars)} AS chars FROM wc),
wo AS (SELECT *, 2 * pairs + chars AS strength, row_number() OVER (PARTITION BY document_id ORDER BY whole DESC, pairs DESC, chars DESC, k) AS place FROM wp),
wb AS (SELECT document_id, k AS bk, whole AS bwhole, strength AS bs FROM wo WHERE place = 1),
far AS (SELECT wo.document_id, text, whole, pairs, chars FROM wo JOIN wb USING (document_id) WHERE NOT bwhole AND abs(k - bk) > 1 AND strength > 0 AND strength >= 0.8e0 * bs QUALIFY row_number() OVER (PARTITION BY wo.document_id ORDER BY place) = 1),
chosen AS (SELECT document_id, 0 AS "window", text, whole, pairs, chars FROM wo WHERE place = 1 UNION ALL SELECT document_id, 1, text, whole, pairs, chars FROM far) """.replace("\\\\p", "\\p")


def _lexical(q: int, query: str) -> str:
    """The best lexical score of the windows of each document for a query, as a subquery."""
    c = rerank.compact(T.normalize(query))
    whole = 2 * len({c[i : i + 2] for i in range(len(c) - 1)}) + len(set(c)) + 1
    return f"SELECT {q} AS query_id, document_id, max(score) AS score FROM ({_windows(query)} SELECT document_id, round((2 * pairs + chars + CAST(whole AS INTEGER)) / {whole}e0, 6) AS score FROM chosen) GROUP BY ALL"


WINDOWS = _windows(QUERIES[1])
SQL = {
    "index_build": f"WITH {CHUNKS}, p AS (SELECT DISTINCT term, document_id, field FROM tok) SELECT 'lengths' AS name, (SELECT count(*) FROM indexed_documents) AS rows UNION ALL SELECT 'postings', (SELECT count(*) FROM p) UNION ALL SELECT 'passages', (SELECT count(*) FROM chunk)",
    "passage_chunks": f"WITH {CHUNKS} SELECT document_id, chunk_index, start, stop, tokens FROM chunk",
    "passage_bm25": f"WITH {PASSAGE} " + RANKED.format(by=BYC, keys="document_id, chunk_index", t="psparse"),
    "dense_passages_topk": f"WITH {VEC} " + RANKED.format(by=BYC, keys="document_id, chunk_index", t="dp"),
    "dense_documents_topk": f"WITH {VEC} " + RANKED.format(by=BY, keys="document_id, chunk_index", t="dd"),
    "vector_validation": "WITH e AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT count(*) AS rows, count(*) FILTER (coalesce(len(e), -1) <> 64) AS wrong_dimension, count(*) FILTER (coalesce(len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))), 1) > 0) AS not_finite, count(*) FILTER (abs(sqrt(list_inner_product(e, e)) - 1) > 1e-4) AS not_unit FROM e",
    "dense_index_stats": f"WITH {CHUNKS} SELECT count(DISTINCT document_id) AS indexed_documents, count(*) AS chunks, (SELECT count(*) FROM indexed_documents) AS documents FROM chunk",
    "minmax_scores": f"WITH {S.bm25f(QUERIES)}, {VEC}, {_fused('sparse', 'dd', 'document_id', BY, 0.23)} SELECT CAST(query_id AS INTEGER) AS query_id, document_id, round(s, 6) AS score FROM sn",
    "hybrid_documents": f"WITH {S.bm25f(QUERIES)}, {VEC}, {_fused('sparse', 'dd', 'document_id', BY, 0.23)} {OUT}",
    "hybrid_alpha0": f"WITH {S.bm25f(QUERIES)} " + RANKED.format(by=BY, keys="document_id", t="sparse"),
    "hybrid_alpha1": f"WITH {VEC} " + RANKED.format(by=BY, keys="document_id", t="dd"),
    "hybrid_passages": f"WITH {PASSAGE}, {VEC}, {_fused('psparse', 'dp', 'document_id, chunk_index', BYC, 0.23)} {OUT}",
    "rerank_documents_lexical": f"WITH {S.bm25f(QUERIES)}, cd AS (SELECT query_id, document_id, row_number() OVER ({BY}) AS candidate FROM sparse QUALIFY row_number() OVER ({BY}) <= 50), lx AS ({' UNION ALL '.join(_lexical(q, t) for q, t in QUERIES.items())}), s AS (SELECT query_id, document_id, candidate, score FROM cd JOIN lx USING (query_id, document_id)), {PLATEAU} SELECT CAST(query_id AS INTEGER) AS query_id, rank, document_id, score FROM rk WHERE rank <= 20",
    "rerank_windows": WINDOWS + "SELECT document_id, \"window\", text FROM chosen",
    "rerank_plateau": f"WITH {RUNS}, {PLATEAU} SELECT query_id, candidate, rank FROM rk",
    "rerank_passages_capped": f"""WITH RECURSIVE {PASSAGE}, cd AS (SELECT *, row_number() OVER ({BYC}) AS candidate FROM psparse QUALIFY row_number() OVER ({BYC}) <= 50),
o AS (SELECT query_id, cd.document_id, cd.chunk_index, cd.score, substr(text_norm, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)) AS text, row_number() OVER (PARTITION BY query_id ORDER BY cd.score DESC, candidate) AS n FROM cd JOIN chunk USING (document_id, chunk_index) JOIN indexed_documents d USING (document_id)),
f AS (SELECT query_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS document_id, 0 AS chunk_index, 0e0 AS score, false AS ok, CAST([] AS VARCHAR[]) AS texts, CAST([] AS BIGINT[]) AS docs FROM o GROUP BY 1
UNION ALL SELECT query_id, n, document_id, chunk_index, score, ok, CASE WHEN ok THEN list_append(texts, text) ELSE texts END, CASE WHEN ok THEN list_append(docs, document_id) ELSE docs END FROM (
SELECT o.*, f.texts, f.docs, len(f.texts) < 20 AND NOT list_contains(f.texts, o.text) AND len(list_filter(f.docs, lambda x: x = o.document_id)) < 3 AS ok FROM f JOIN o ON o.query_id = f.query_id AND o.n = f.n + 1))
SELECT CAST(query_id AS INTEGER) AS query_id, CAST(len(docs) AS INTEGER) AS rank, document_id, chunk_index, round(score, 6) AS score FROM f WHERE ok""",
    "lexical_score": f"SELECT document_id, CAST({SCORE.format(t=Q1, x='text_norm')} AS BIGINT) AS score FROM indexed_documents WHERE text_norm IS NOT NULL",
    "query_snippets": f"""WITH d AS (SELECT document_id, text_norm AS x FROM indexed_documents WHERE text_norm IS NOT NULL), t AS (SELECT unnest([{Q1}]) AS t),
p AS (SELECT document_id, x, t, string_split(x, t) AS a FROM d CROSS JOIN t), u AS (SELECT document_id, x, t, unnest(a) AS part, generate_subscripts(a, 1) AS i, len(a) AS n FROM p),
o AS (SELECT document_id, x, n, i, sum(length(part)) OVER (PARTITION BY document_id, t ORDER BY i) + (i - 1) * length(t) AS pos FROM u),
s AS (SELECT document_id, x, greatest(0, least(pos - 80, length(x) - 240)) AS st FROM o WHERE i < n UNION SELECT document_id, x, 0 FROM d),
w AS (SELECT document_id, x, st, substr(x, CAST(st + 1 AS BIGINT), 240) AS win FROM s), g AS (SELECT *, {SCORE.format(t=Q1, x='win')} AS sc FROM w)
SELECT document_id, CASE WHEN length(x) <= 240 THEN x ELSE win END AS snippet FROM g QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY sc DESC, st) = 1""",
    "search_cards": f"WITH {S.bm25f(QUERIES)}, r AS (SELECT query_id, row_number() OVER ({BY}) AS rank, document_id FROM sparse QUALIFY rank <= 20), pd2 AS ({TEXT_SQL['published_dates']}) SELECT CAST(query_id AS INTEGER) AS query_id, rank, CASE WHEN coalesce(title, '') = '' THEN url ELSE title END AS title, url, published_at FROM r JOIN documents ON doc_id = document_id JOIN pd2 USING (doc_id)",
    "ranked_urls": f"WITH {S.bm25f(QUERIES)}, {VEC}, {_fused('sparse', 'dd', 'document_id', BY, 0.23)} SELECT query_id, rank, url FROM out JOIN documents ON doc_id = document_id WHERE rank <= 20",
    "mrr_at_20": FIRST + "SELECT count(*) AS queries, round(avg(coalesce(1e0 / first, 0e0)), 6) AS mrr FROM f",
    "recall_at_20": FIRST + "SELECT count(*) AS queries, round(avg(CASE WHEN first IS NULL THEN 0e0 ELSE 1e0 END), 6) AS recall FROM f",
    "top1_hits": FIRST + "SELECT count(*) FILTER (first = 1) AS top1_hits FROM f",
}


def queries() -> dict:
    return {k: globals()[k] for k in SQL}
