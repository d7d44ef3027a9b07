import json
import threading
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import urlopen

import pytest

from lanternq import cli, web
from lanternq.engine import Engine
from lanternq.sources import generation

DOCS = "document_id long, url string, title string, text string, fetched_at string, content_html string"
ROWS = [
    (1, "http://a.example/1", "ＶＣＲ 手册", "统一认证平台的使用说明。发布时间：2024-03-05", "t1", "<p>x</p>"),
    (2, "http://a.example/2", "名单", "获奖名单 甲 乙", "t1", "<h2>获奖名单</h2><table><tr><td>甲</td><td>乙</td></tr></table>"),
    (3, "http://b.example/3", None, None, "t1", None),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("index")))
    assert e.build(spark.createDataFrame(ROWS, DOCS)) == {"seen": 3, "indexed": 3, "skipped": 0}
    return e


def test_rankings_and_cards(engine):
    for how in ("bm25f", "hybrid", "rerank", "phrase"):
        cards = engine.search_documents("统一认证", how)
        assert cards[0]["url"] == "http://a.example/1" and cards[0]["published_at"] == "2024-03-05" and "统一认证" in cards[0]["snippet"]
    assert engine.search_documents("vcr", "bm25f")[0]["title"] == "vcr 手册"
    assert engine.search_documents("统一", "bm25f", content_limit=500)[0]["structured_content"] == "<p>x</p>"
    assert engine.search_documents("!?") == []
    with pytest.raises(ValueError):
        engine.rank("x", "best")
    got = engine.search_passages("获奖名单")
    assert got[0]["passage_id"] == "2:0" and engine.collection("获奖名单")[0]["collection_size"] == "2"
    assert engine.stats()["documents"] == 3


def test_only_changed_documents_are_indexed_again(engine, spark):
    rows = [ROWS[0], ROWS[1][:4] + ("t2", None), ROWS[2]]
    assert engine.build(spark.createDataFrame(rows, DOCS)) == {"seen": 3, "indexed": 1, "skipped": 2}
    assert engine.search_documents("统一认证", "bm25f")[0]["url"] == "http://a.example/1"


def test_failed_publish_keeps_the_old_generation(spark, tmp_path):
    good = spark.createDataFrame([(1,)], "x int")
    before = generation.publish(str(tmp_path), {"t": good})
    from pyspark.sql import functions as F

    bad = good.select(F.raise_error(F.lit("boom")).alias("x"))
    with pytest.raises(Exception):  # noqa: B017
        generation.publish(str(tmp_path), {"t": bad})
    assert generation.manifest(str(tmp_path))["generation"] == before["generation"]


def test_bad_generations(spark, tmp_path):
    with pytest.raises(ValueError):
        generation.load(spark, str(tmp_path))
    generation.publish(str(tmp_path), {"vectors": spark.createDataFrame([([2.0, 0.0],)], "embedding array<float>")}, dimension=2)
    with pytest.raises(ValueError):
        generation.load(spark, str(tmp_path))
    m = generation.manifest(str(tmp_path))
    (tmp_path / "manifest.json").write_text(json.dumps(m | {"counts": {"vectors": 5}}))
    with pytest.raises(ValueError):
        generation.load(spark, str(tmp_path))
    (tmp_path / "manifest.json").write_text("{")
    with pytest.raises(ValueError):
        generation.load(spark, str(tmp_path))


def test_http(engine):
    s = web.server(engine, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_address[1]}"
    try:
        got = json.load(urlopen(f"{base}/api/search?q={quote('ＶＣＲ')}&ranking=bm25f"))
        assert got["query"] == "vcr" and got["count"] == 1 == len(got["results"])
        assert b"/api/search" in urlopen(f"{base}/").read()
        for bad, code in (("/api/search", 400), ("/api/search?q=x&ranking=phrase", 400), ("/api/search?q=x&limit=a", 400), ("/api/search?q=x&alpha=2", 400), ("/api/search?q=x&max_cycles=9", 400), ("/other", 404)):
            with pytest.raises(HTTPError) as e:
                urlopen(base + bad)
            assert e.value.code == code
    finally:
        s.shutdown()


def test_cli(engine, capsys):
    assert cli.main(["--index", engine.directory, "search", "统一认证", "--ranking", "bm25f"], engine) == 0
    assert "http://a.example/1" in capsys.readouterr().out
    for bad in (["search", "x", "--limit", "0"], ["search", "x", "--alpha", "2"], ["rag", "x", "--max-cycles", "9"]):
        with pytest.raises(SystemExit):
            cli.main(["--index", engine.directory, *bad], engine)
    with pytest.raises(SystemExit):
        cli.main(["--index", "/nowhere", "stats"], engine)


def pairs_and_rest(run):
    return [run[:2], *run[2:]]


def test_a_segmenter_takes_part(spark, tmp_path):
    e = Engine(spark, str(tmp_path), tokenizer=pairs_and_rest)
    e.build(spark.createDataFrame(ROWS, DOCS))
    assert e.manifest["tokenizer_mode"] == "pairs_and_rest"
    assert {r.term for r in e.tables["postings"].filter("document_id = 2 and field = 1").collect()} == {"获奖", "名", "单", "甲", "乙"}
    assert e.search_documents("获奖", "bm25f")[0]["url"] == "http://a.example/2"
    assert e.search_documents("奖名", "bm25f") == []


def test_segments_hide_old_rows_and_are_written_as_one_at_last(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(generation, "MOST_SEGMENTS", 2)
    e = Engine(spark, str(tmp_path))
    for n, word in enumerate(("alpha", "beta", "gamma")):
        e.build(spark.createDataFrame([(1, "http://a.example/1", "t", word, f"t{n}", None), ROWS[1]], DOCS))
        assert e.stats()["documents"] == 2
        assert len(e.manifest["segments"]) == (1, 2, 1)[n] and e.manifest["stats"]["documents"] == 2
        hits = {w: len(e.search_documents(w, "bm25f")) for w in ("alpha", "beta", "gamma")}
        assert hits == {w: int(w == word) for w in hits}
    assert e.encode_again() == 2 and e.search_documents("gamma", "dense")
    qrels = spark.createDataFrame([(1, "http://a.example/1")], "query_id long, url string")
    got = e.evaluate({1: "gamma"}, qrels, ("bm25f",))[0]
    assert got["mrr"] == got["recall"] == 1.0 and got["seconds"] > 0
