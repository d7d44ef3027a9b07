"""The engine: an index folder, its rankings as result cards, and answers from it."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dom
from .functions import text as T
from .functions.tokens import Segmenter, query_terms, spans
from .operators import build, crawl, dense, evaluate, fusion, index, passages, ranking, rerank
from .rag.engine import answer_question
from .sources import generation
from .sources.staging import stage
from .sources.tables import ship

RANKINGS = ("dense", "phrase", "bm25f", "hybrid", "rerank")
DIMENSION = 64
#: Takes a list of texts and gives a unit vector for each.
Encoder = Callable[[list[str]], list[list[float]]]
VERSIONS = {"tokenizer_mode": "search", "stopwords_version": T.STOPWORDS_VERSION, "text_normalizer_version": T.NORMALIZER_VERSION}


def hashed_vectors(texts: list[str], dimension: int = DIMENSION) -> list[list[float]]:
    """Unit vectors of hashed search tokens. A stand-in for a text encoder, which is not shipped."""
    v = np.zeros((len(texts), dimension))
    of, a, b, flat = spans(texts, "search")
    known: dict[str, int] = {}
    for i, s, e in zip(of.tolist(), a.tolist(), b.tolist(), strict=True):
        t = flat[s:e]
        h = known.get(t)
        if h is None:
            h = known[t] = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        v[i, h % dimension] += 1 if h >> 63 else -1
    n = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.where(n > 0, v / np.maximum(n, 1e-300), np.eye(1, dimension))
    return v.tolist()


def loaded_encoder(load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 256) -> Encoder:
    """An encoder whose model is loaded once per Python worker, and called for at most `batch` texts at a time."""
    held: list = []

    def encode(texts: list[str]) -> list[list[float]]:
        if not held:
            held.append(load())
        return [v for at in range(0, len(texts), batch) for v in held[0](texts[at : at + batch])]

    return encode


#: Hits up to which they are sent to the documents; more are joined by shuffle.
SENT_HITS = 10_000


def sent(hits: DataFrame, n: int) -> DataFrame:
    """Hits, of which there are at most n, as a side of a join."""
    return F.broadcast(hits) if n <= SENT_HITS else hits


class Engine:
    """All operations of one index folder. Rankings take a limit; document rankings give cards in rank order."""

    def __init__(self, spark: SparkSession, directory: str, encoder: Encoder = hashed_vectors, scorer: Callable[[str, str], float] = rerank.lexical_scorer, tokenizer: str | Segmenter = "search", tokenizer_name: str = "") -> None:
        """`tokenizer` is a mode of tokens, or a word segmenter; its name is kept with the index, and another name builds it anew."""
        ship(spark)
        self.tokenizer = tokenizer
        self.versions = VERSIONS | {"tokenizer_mode": tokenizer_name or (tokenizer if isinstance(tokenizer, str) else getattr(tokenizer, "__name__", "segmenter"))}
        self.spark, self.directory, self.encoder, self.scorer = spark, directory, encoder, scorer
        self._loaded: tuple[str, dict[str, DataFrame]] | None = None

    # ---- building ----

    def build(self, documents: DataFrame) -> dict[str, int]:
        """Index documents (document_id, url, title, text, fetched_at[, content_html]); counters of seen, indexed and skipped.

        Documents whose fetched_at and the index's versions are unchanged keep their rows.
        """
        html = F.col("content_html") if "content_html" in documents.columns else F.lit("")
        docs = documents.select("document_id", "url", "title", "text", "fetched_at", F.coalesce(html, F.lit("")).alias("content_html"))
        try:
            old_manifest, old = generation.load(self.spark, self.directory)
        except ValueError:
            old_manifest, old = {}, {}
        todo = index.changed(docs, old["documents"], old_manifest, self.versions) if old else docs
        fresh = stage(todo.withColumns({"title_norm": T.normalize_text("title"), "text_norm": T.normalize_text("text")}), "fresh")
        seen, n = docs.count(), fresh.count()
        if n or not old:
            tables = build.tables(fresh, self.encoder, self.tokenizer) | {"documents": fresh}
            same = old and all(old_manifest.get(k) == v for k, v in self.versions.items()) and len(old_manifest["segments"]) < generation.MOST_SEGMENTS
            if old and not same:  # everything as one segment again
                gone = fresh.select("document_id")
                tables = {k: old[k].join(gone, "document_id", "left_anti").unionByName(v) if k in old else v for k, v in tables.items()}
            generation.publish(self.directory, tables, old_manifest if same else None, build.stats, dimension=len(self.encoder(["x"])[0]), **self.versions)
            self._loaded = None
        return {"seen": seen, "indexed": n, "skipped": seen - n}

    @property
    def manifest(self) -> dict:
        return self._index()[0]

    @property
    def tables(self) -> dict[str, DataFrame]:
        return self._index()[1]

    def _index(self) -> tuple[dict, dict[str, DataFrame]]:
        """The manifest and tables in force, loaded again when another build was published."""
        current = generation.manifest(self.directory).get("generation", "")
        if self._loaded is None or self._loaded[0] != current:
            self._loaded = (current, generation.load(self.spark, self.directory))
        return self._loaded[1]

    def _numbers(self) -> DataFrame:
        return build.stats_row(self.spark, self.manifest["stats"])

    def encode_again(self) -> int:
        """New vectors for all stored passages, as with another encoder; the number of them."""
        m, old = generation.load(self.spark, self.directory)
        tables = {k: v for k, v in old.items() if k != "vectors"} | {"vectors": build.vectors(old["passages"], old["documents"], self.encoder)}
        new = generation.publish(self.directory, tables, None, build.stats, dimension=len(self.encoder(["x"])[0]), **{k: m[k] for k in VERSIONS})
        self._loaded = None
        return new["counts"]["vectors"]

    def evaluate(self, queries: dict[int, str], qrels: DataFrame, rankings: tuple[str, ...] = ("bm25f", "dense", "hybrid", "rerank"), limit: int = 20) -> list[dict[str, object]]:
        """Per ranking: reciprocal rank, recall and first hits against (query_id, url), and mean seconds of a query."""
        out = []
        for how in rankings:
            rows, began = [], time.perf_counter()
            for q, text in queries.items():
                rows += [(q, k, card["url"]) for k, card in enumerate(self.search_documents(text, how, limit), 1)]
            took = time.perf_counter() - began
            runs = self.spark.createDataFrame(rows, "query_id long, rank int, url string")
            first = evaluate.first_hits(runs, qrels)
            figures = {k: v for f in (evaluate.mrr, evaluate.recall, evaluate.top1) for k, v in f(first).first().asDict().items()}
            out.append({"ranking": how, **figures, "seconds": round(took / max(len(queries), 1), 3)})
        return out

    def warm_up(self) -> None:
        """Load the index and the encoder and run a search of each kind, so that the first question does not wait for it."""
        for how in RANKINGS:
            self.search_documents("a", how, 1)
        self.search_passages("a", 1)

    def stats(self) -> dict[str, object]:
        docs = self.tables["documents"]
        hosts = docs.groupBy(F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/:?#]+)", 1).alias("host")).count()
        terms = self.tables["postings"].select("term").distinct().count()
        return {"documents": docs.count(), "terms": terms, "hosts": {r.host: r["count"] for r in hosts.collect()}}

    # ---- rankings ----

    def _sparse(self, query: str, side: int) -> DataFrame:
        return ranking.top(ranking.bm25f_of_index(self._numbers(), self.tables["postings"], {1: query}, self.tokenizer), side)

    def _vectors(self, query: str, side: int, once: bool = False) -> DataFrame:
        return dense.scores(self.tables["vectors"], {1: self.encoder([T.normalize(query)])[0]}, ["document_id", "chunk_index"], side, once=once)

    def _dense(self, query: str, side: int) -> DataFrame:
        return ranking.top(dense.best_per_document(self._vectors(query, side, True)), side)

    def rank(self, query: str, how: str = "hybrid", limit: int = 20, alpha: float = fusion.ALPHA, candidates: int = rerank.SCORE_LIMIT) -> DataFrame:
        """(query_id, rank, document_id, score)."""
        if how not in RANKINGS:
            raise ValueError(f"unknown ranking {how!r}")
        if limit <= 0 or candidates <= 0:
            raise ValueError("limits must be positive")
        if not query_terms(query, self.tokenizer):
            return self.spark.createDataFrame([], "query_id int, rank int, document_id long, score double")
        side = fusion.candidates(limit)
        if how == "phrase":
            return ranking.top(ranking.phrase_of_postings(self.tables["postings"], {1: query}, self.tokenizer).withColumn("score", F.lit(0.0)), limit)
        if how == "bm25f":
            return self._sparse(query, limit)
        if how == "dense":
            return self._dense(query, limit)
        if how == "hybrid":
            return fusion.fuse(self._sparse(query, side), self._dense(query, side), limit, alpha)
        few = self.rank(query, "hybrid", max(limit, candidates), alpha)
        return rerank.rerank_documents(few, self.tables["documents"], {1: T.normalize(query)}, self.scorer, limit)

    def search_documents(self, query: str, how: str = "hybrid", limit: int = 20, alpha: float = fusion.ALPHA, content_limit: int = 0, candidates: int = rerank.SCORE_LIMIT) -> list[dict[str, str]]:
        """Cards (title, url, snippet[, published_at, content, structured_content]) in rank order."""
        if content_limit < 0:
            raise ValueError("content_limit must not be negative")
        hits = self.rank(query, how, limit, alpha, candidates)
        terms = F.array(*[F.lit(t) for t in query_terms(query, self.tokenizer)]).cast("array<string>")
        day = T.published_date(F.coalesce("text", F.lit("")), F.coalesce("url", F.lit("")))
        hits = stage(hits.select("rank", "document_id"), "hits")
        rows = self.tables["documents"].join(sent(hits, limit), "document_id")
        snippet = T.snippet(F.col("text_norm"), terms)
        if how in ("dense", "hybrid", "rerank"):  # the nearest passage, unless the text has a better place
            near = dense.scores(self.tables["vectors"].join(sent(hits, limit).drop("rank"), "document_id", "left_semi"), {1: self.encoder([T.normalize(query)])[0]}, ["document_id", "chunk_index"], limit, once=True)
            near = dense.best_per_document(near).select("document_id", "chunk_index")
            near = self.tables["passages"].join(sent(near, limit), ["document_id", "chunk_index"]).select("document_id", T.snippet(F.col("text"), terms).alias("_near"))
            rows = rows.join(near, "document_id", "left")
            score = lambda x: F.coalesce(T.lexical_score(x, terms), F.lit(-1))
            snippet = F.when(score(F.col("_near")) >= score(snippet), F.col("_near")).otherwise(snippet)
        columns = ["rank", "title_norm", "url", snippet.alias("snippet"), day.alias("day"), F.length("text_norm").alias("n"), F.substring("text_norm", 1, max(content_limit, 1)).alias("content"), F.when(F.length("text_norm") <= content_limit, F.col("content_html")).alias("html")]
        cards = []
        for r in rows.select(*columns).orderBy("rank").collect():
            card = {"title": r.title_norm or r.url, "url": r.url, "snippet": r.snippet}
            if r.day:
                card["published_at"] = r.day
            if content_limit:
                card["content"] = r.content
                if r.html:
                    card["structured_content"] = r.html
            cards.append(card)
        return cards

    def search_passages(self, query: str, limit: int = 8, alpha: float = fusion.ALPHA, candidates: int = rerank.SCORE_LIMIT) -> list[dict[str, str]]:
        """Cards of reranked passages with the structure they came from."""
        terms = query_terms(query, self.tokenizer)
        if not terms:
            return []
        side = fusion.candidates(limit)
        sparse = dense.ranked(passages.passage_bm25_of_index(self._numbers(), self.tables["passage_postings"], {1: query}, self.tokenizer), side)
        both = fusion.fuse(sparse, dense.ranked(self._vectors(query, side), side), max(limit, candidates), alpha, ("document_id", "chunk_index"))
        docs = self.tables["documents"].select("document_id", "url", "title_norm", "content_html", T.published_date(F.coalesce("text", F.lit("")), F.coalesce("url", F.lit(""))).alias("day"))
        rows = self.tables["passages"].join(sent(both, max(limit, candidates)), ["document_id", "chunk_index"]).join(docs, "document_id").toPandas()  # candidates rows
        if rows.empty:
            return []
        query_norm = T.normalize(query)
        rows["candidate"] = rows["rank"]
        rows["score"] = [self.scorer(query_norm, "\n".join(x for x in (h, t) if x)) for h, t in zip(rows.title_norm, rows.text, strict=True)]
        chosen = rerank.capped(rows, limit)
        at = {(r.document_id, r.chunk_index): r for r in rows.itertuples(index=False)}
        cards = []
        for c in chosen.itertuples(index=False):
            r = at[c.document_id, c.chunk_index]
            if not r.text:
                continue
            x = dom.structured(r.content_html, r.text, terms)
            card = {"title": r.title_norm or r.url, "url": r.url, "snippet": r.text[:240], "content": x["content"], "passage_id": f"{r.document_id}:{r.chunk_index}", "chunk_index": str(r.chunk_index), "candidate_content": r.text, "evidence_scope": x["scope"]}
            cards.append(card | ({"heading_path": x["heading_path"]} if x["heading_path"] else {}) | ({"published_at": r.day} if r.day else {}))
        return cards

    def collection(self, query: str, hits: int = 24, limit: int = 8) -> list[dict[str, str]]:
        """Cards of whole tables in the documents that a query finds."""
        terms = query_terms(query, self.tokenizer)
        if not terms:
            return []
        docs = self.tables["documents"].join(sent(self.rank(query, "hybrid", hits).select("rank", "document_id"), hits), "document_id")
        found = []
        for r in docs.select("rank", "document_id", "url", "title_norm", "content_html").orderBy("rank").collect():
            for c in dom.table_sections(r.content_html, terms):
                found.append((-c["score"], r["rank"], c["index"], {"title": r.title_norm or r.url, "url": r.url, "snippet": c["label"], "content": f"{c['label']}：{' '.join(c['values'])}", "passage_id": f"{r.document_id}:table{c['index']}", "document_id": str(r.document_id), "evidence_scope": "table", "heading_path": c["label"], "collection_size": str(c["size"]), "collection_complete": "true"}))
        return [c for *_, c in sorted(found, key=lambda x: x[:3])[:limit]]

    def answer(self, question: str, top_k: int = 8, **options) -> dict:
        """The audited answer to a question; the model is an option."""
        return answer_question(question, self.search_passages, top_k=top_k, collection=lambda q: self.collection(q, max(12, 3 * top_k)), **options)

    def crawl(self, directory: str, seeds: list[str], fetch: crawl.Fetcher, **options) -> tuple[dict[str, int], DataFrame | None]:
        """Crawl into a folder, or go on with the crawl kept there; counters, and the documents so far."""
        return crawl.crawl_into(self.spark, directory, seeds, fetch, **options)
