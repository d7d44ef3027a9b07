"""Command line: crawl, stats, index, search, rag, serve, eval."""

from __future__ import annotations

import argparse
import json
import logging
import math
from pathlib import Path

from .functions.text import normalize


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lanternq", description="Search and answers over an index folder")
    p.add_argument("--index", default="index", help="folder of the index")
    p.add_argument("--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl", help="fetch pages from seeds into a folder, or go on with the crawl kept there")
    c.add_argument("seeds", nargs="+")
    c.add_argument("--out", required=True)
    c.add_argument("--max-pages", type=int, default=500_000)
    c.add_argument("--attempts", type=int, default=3)
    c.add_argument("--refresh-hours", type=float)
    c.add_argument("--retry-failed", action="store_true")
    c.add_argument("--delay", type=float, default=0.2)
    c.add_argument("--fetchers", type=int, default=8)
    sub.add_parser("stats", help="documents per host and terms of the index")
    i = sub.add_parser("index", help="index a documents table or the folder of a crawl, again where it changed")
    i.add_argument("documents")
    sub.add_parser("dense-index", help="encode all stored passages again")
    s = sub.add_parser("search", help="rank documents for a query")
    s.add_argument("query")
    s.add_argument("--ranking", default="hybrid", choices=["dense", "phrase", "bm25f", "hybrid", "rerank"])
    s.add_argument("--phrase", action="store_const", dest="ranking", const="phrase")
    s.add_argument("--limit", type=int, default=20)
    s.add_argument("--alpha", type=float, default=0.23)
    s.add_argument("--candidates", type=int, default=50)
    r = sub.add_parser("rag", help="answer a question")
    r.add_argument("question")
    r.add_argument("--top-k", type=int, default=8)
    r.add_argument("--max-cycles", type=int, default=5)
    r.add_argument("--debug", action="store_true")
    w = sub.add_parser("serve", help="serve searches over HTTP")
    w.add_argument("--host", default="127.0.0.1")
    w.add_argument("--port", type=int, default=8000)
    e = sub.add_parser("eval", help="reciprocal rank and recall of runs, or of this index's rankings, against relevant urls")
    e.add_argument("runs", help="table of query_id, rank, url; with --queries, of query_id, text")
    e.add_argument("qrels")
    e.add_argument("--queries", action="store_true", help="run the queries of the first table in every ranking and time them")
    return p


def checked(a: argparse.Namespace) -> argparse.Namespace:
    """The arguments, or SystemExit with what is wrong."""
    for name in ("limit", "candidates", "top_k", "attempts", "fetchers"):
        if getattr(a, name, 1) <= 0:
            raise SystemExit(f"{name} must be positive")
    if not 0 <= getattr(a, "alpha", 0) <= 1:
        raise SystemExit("alpha must lie in 0..1")
    if not 1 <= getattr(a, "max_cycles", 1) <= 8:
        raise SystemExit("max_cycles must lie in 1..8")
    hours = getattr(a, "refresh_hours", None)
    if hours is not None and (not math.isfinite(hours) or hours < 0):
        raise SystemExit("refresh hours must be finite and not negative")
    for name in ("documents", "runs", "qrels"):
        if getattr(a, name, None) and not Path(getattr(a, name)).exists():
            raise SystemExit(f"{getattr(a, name)} does not exist")
    return a


def report(result: dict) -> str:
    """A readable account of an answer and, in debug mode, of how it came about."""
    lines = [result["answer"], f"status: {result['status']}"]
    lines += [f"- {c['statement']} {c['evidence_ids']}" for c in result["claims"]]
    lines += [f"source {s['evidence_id']}: {s.get('title', '')} {s.get('url', '')}" for s in result["sources"]]
    for t in result.get("trace", []):
        lines.append(f"cycle {t['cycle']}: {t.get('action', '')} {t['search_queries']} new {len(t['new_results'])}, evidence {t['evidence_count']}")
    return "\n".join(lines)


def main(argv: list[str] | None = None, engine=None) -> int:
    a = checked(arguments().parse_args(argv))
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING)
    if engine is None:
        from pyspark.sql import SparkSession

        from .engine import Engine

        engine = Engine(SparkSession.builder.appName("lanternq").getOrCreate(), a.index)
    from .sources import generation

    if a.command in ("stats", "dense-index", "search", "rag", "serve") and not generation.manifest(a.index):
        raise SystemExit(f"no index in {a.index}")
    if a.command == "crawl":
        from .sources.fetch import http_fetch

        stats, _ = engine.crawl(a.out, a.seeds, http_fetch, max_pages=a.max_pages, attempts=a.attempts, refresh_hours=a.refresh_hours, retry_failed=a.retry_failed, delay=a.delay, fetchers=a.fetchers)
        print(json.dumps(stats))
    elif a.command == "index":
        crawled = generation.manifest(f"{a.documents}/pages")
        documents = generation.load(engine.spark, f"{a.documents}/pages")[1]["documents"] if crawled else engine.spark.read.parquet(a.documents)
        print(json.dumps(engine.build(documents)))
    elif a.command == "stats":
        print(json.dumps(engine.stats(), ensure_ascii=False))
    elif a.command == "search":
        for k, card in enumerate(engine.search_documents(normalize(a.query), a.ranking, a.limit, a.alpha, candidates=a.candidates), 1):
            print(f"{k}. {card['title']}\n   {card['url']}\n   {card['snippet']}")
    elif a.command == "rag":
        print(report(engine.answer(a.question, a.top_k, cycles=a.max_cycles, debug=a.debug)))
    elif a.command == "dense-index":
        print(json.dumps({"vectors": engine.encode_again()}))
    elif a.command == "eval" and a.queries:
        texts = {r.query_id: r.text for r in engine.spark.read.parquet(a.runs).select("query_id", "text").collect()}
        for row in engine.evaluate(texts, engine.spark.read.parquet(a.qrels)):
            print(json.dumps(row))
    elif a.command == "eval":
        from .operators import evaluate

        first = evaluate.first_hits(engine.spark.read.parquet(a.runs), engine.spark.read.parquet(a.qrels))
        print(json.dumps({k: v for f in (evaluate.mrr, evaluate.recall, evaluate.top1) for k, v in f(first).first().asDict().items()}))
    else:
        from .web import server

        engine.warm_up()
        server(engine, a.host, a.port).serve_forever()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
