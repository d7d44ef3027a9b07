"""HTTP service: a page at /, and GET /api/search with q, ranking, limit, alpha, max_cycles and debug; everything else is 404."""

from __future__ import annotations

import json
import logging
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .functions.text import normalize

MODES = ("dense", "bm25f", "hybrid", "rerank", "rag")
log = logging.getLogger(__name__)


#: The page: results of the reranked search first, an answer on demand; a newer request ends the older one; the address keeps
#: the question and the view.
PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>lanternq</title><style>
body{font:16px sans-serif;max-width:46em;margin:2em auto;padding:0 1em}input{width:70%;padding:.4em}small{color:#567}li{margin:.8em 0}#answer{white-space:pre-wrap}
</style></head><body><form><input name="q" autofocus><button>Search</button> <button type="button" id="ask">Answer</button></form>
<p id="answer"></p><p id="count"></p><ol id="hits"></ol><script>
const $ = id => document.getElementById(id), box = document.querySelector("input");
let running = null;
async function load(ranking) {
  const q = box.value.trim();
  if (!q) return;
  if (running) running.abort();
  const own = running = new AbortController();
  const view = ranking === "rag" ? "&view=answer" : "";
  history.replaceState(null, "", "?q=" + encodeURIComponent(q) + view);
  $("count").textContent = "...";
  try {
    const got = await (await fetch("/api/search?ranking=" + ranking + "&q=" + encodeURIComponent(q), {signal: own.signal})).json();
    $("answer").textContent = got.answer || got.error || "";
    $("count").textContent = (got.count || 0) + " results";
    $("hits").replaceChildren(...(got.results || []).map(x => {
      const li = document.createElement("li"), a = document.createElement("a"), host = document.createElement("small"), text = document.createElement("div");
      a.textContent = x.title; a.href = /^https?:/.test(x.url) ? x.url : "#"; text.textContent = x.snippet || "";
      try { host.textContent = " " + new URL(x.url).host; } catch { }
      li.append(a, host, text);
      return li;
    }));
  } catch (e) { if (e.name !== "AbortError") $("count").textContent = String(e); }
}
document.querySelector("form").onsubmit = e => { e.preventDefault(); load("rerank"); };
$("ask").onclick = () => load("rag");
const at = new URLSearchParams(location.search);
if (at.get("q")) { box.value = at.get("q"); load(at.get("view") === "answer" ? "rag" : "rerank"); }
</script></body></html>"""


class Bad(ValueError):
    """A request that cannot be served; its text is for the client."""


def options(query: str) -> dict:
    """Checked parameters of a request."""
    got = {k: v[-1] for k, v in parse_qs(query, keep_blank_values=True).items()}
    q, ranking = normalize(got.get("q")), got.get("ranking", "hybrid")
    if not q:
        raise Bad("q is missing")
    if ranking not in MODES:
        raise Bad(f"ranking must be one of {', '.join(MODES)}")
    try:
        limit = int(got.get("limit") or (5 if ranking == "rag" else 20))
        alpha, cycles = float(got.get("alpha") or 0.23), int(got.get("max_cycles") or 5)
    except ValueError:
        raise Bad("limit, alpha and max_cycles are numbers") from None
    if not 0 <= alpha <= 1:
        raise Bad("alpha must lie in 0..1")
    if not 1 <= cycles <= 8:
        raise Bad("max_cycles must lie in 1..8")
    return {"q": q, "ranking": ranking, "limit": min(max(limit, 1), 100), "alpha": alpha, "cycles": cycles, "debug": got.get("debug", "").lower() in ("1", "true", "yes")}


def served(engine, query: str) -> dict:
    """The payload of a search request."""
    o = options(query)
    if o["ranking"] == "rag":
        got = engine.answer(o["q"], o["limit"], cycles=o["cycles"], debug=o["debug"])
        keys = ("answer", "status", "complete", "requirements", "claims", "sources", *(("trace",) if o["debug"] else ()))
        return {"query": o["q"], "count": len(got["results"]), "results": got["results"], **{k: got[k] for k in keys}}
    cards = engine.search_documents(o["q"], o["ranking"], o["limit"], o["alpha"])
    return {"query": o["q"], "count": len(cards), "results": cards}


def server(engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server over one engine; its threads share the Spark session."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            at = urlsplit(self.path)
            try:
                if at.path == "/":
                    return self.send(200, "text/html", PAGE)
                if at.path != "/api/search":
                    return self.reply(404, {"error": "not found"})
                return self.reply(200, served(engine, at.query))
            except Bad as e:
                return self.reply(400, {"error": str(e)})
            except Exception:
                log.exception("request failed")
                return self.reply(500, {"error": "internal error"})

        def reply(self, code: int, body: dict) -> None:
            self.send(code, "application/json", json.dumps(body, ensure_ascii=False))

        def send(self, code: int, kind: str, body: str) -> None:
            raw = body.encode()
            self.send_response(code)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, form: str, *args: object) -> None:
            log.info(form, *args)

    return ThreadingHTTPServer((host, port), Handler)
