from lanternq.functions import dom
from lanternq.operators import crawl, pages

PAGE = """<html><head><title>Site</title></head><body><header>Top</header><nav><a href="/n#x">Next</a></nav>
<div class=box><div class=location>You are here</div><h1>Title &amp; more</h1><div id=body><p>Body <b>one</b><p>Body two
<script>no()</script></div><div class=pager>1 2 3</div></div><footer>Foot</footer></body></html>"""


def test_site_rule_keeps_the_body_only():
    rule = {"a.example": dom.Rule(content=(".box #body",), title=(".box h1",), excluded=(".pager",))}
    x = dom.extract(PAGE, "http://a.example/p/1", rule)
    assert x["title"] == "Title & more" and x["text"] == "Body one Body two" and x["links"] == ["http://a.example/n"]
    assert x["content_html"].startswith("<p>Body <strong>one</strong></p>") and "script" not in x["content_html"]
    common = dom.extract(PAGE, "http://b.example/")
    assert "Foot" not in common["text"] and "Next" not in common["text"]
    assert dom.extract(None, "")["text"] == "" and dom.extract("<nav>only menu</nav>", "http://b.example/")["text"] == "only menu"


def test_page_rule_by_path():
    rule = {"a.example": dom.Rule(content=("#x",), pages=((r"^/v/\d+$", dom.Rule(content=("#y",))),))}
    page = "<div id=x>site</div><div id=y>page</div>"
    assert dom.extract(page, "http://a.example/v/3", rule)["text"] == "page" and dom.extract(page, "http://a.example/w", rule)["text"] == "site"


def test_tables_and_headings():
    page = "<h2>获奖名单</h2><table><tr><th>n</th></tr><tr><td>甲</td><td>乙</td></tr><tr><td>丙</td><td>-</td></tr></table><h2>其他清单</h2><table><tr><td>丁</td><td>戊</td></tr></table>"
    cards = dom.table_sections(page, ["名单"])
    assert [c["size"] for c in cards] == [3, 2, 5] and [c["label"] for c in cards][:2] == ["获奖名单", "其他清单"]
    root = dom.parse("<h1>A</h1><h2>B</h2><p>x</p><h2>C</h2><p>y</p>")
    of = dom.blocks(root)
    assert [dom.heading_path(of, k) for k in (2, 4)] == ["A > B", "A > C"]


def test_structure_of_a_passage():
    page = "<h2>项目名单</h2><ul><li>甲</li><li>乙</li><li>丙</li></ul><h2>其他</h2><p>说明文字</p>"
    x = dom.structured(page, "项目名单 甲 乙", ["项目"])
    assert x["scope"] == "ul" and x["content"] == "甲 乙 丙" and x["heading_path"] == "项目名单"
    assert dom.structured("", "abc", [])["scope"] == "passage"


def test_pages_in_bulk(spark):
    df = spark.createDataFrame([(1, "http://a.example/", PAGE), (2, None, None), (3, "http://a.example/", "")], "doc_id long, url string, content_html string")
    got = {r.doc_id: r for r in pages.extracted(df).collect()}
    assert got[1].title == "Title & more" and got[2].text == "" and got[3].links == []
    assert pages.html_blocks(df).filter("tag = 'h1'").count() == 1


WEB = {
    "http://a.example/": '<a href="/next#part">n</a><a href="http://out.example/">o</a><p>root a</p>',
    "http://a.example/next": "<p>next</p>",
    "http://b.example/": "<p>root b</p>",
}


def test_breadth_first_crawl():
    saved = {}
    stats, tasks = crawl.crawl(["http://a.example/", "http://b.example/"], lambda u: (u, WEB[u]), save=saved.__setitem__)
    assert set(saved) == set(WEB) and stats["saved"] == 3 and all(t["state"] == "done" for t in tasks.values())


def test_retry_skip_and_limits():
    tries = iter([None, ("http://a.example/", "<p>x</p>")])
    stats, _ = crawl.crawl(["http://a.example/"], lambda u: next(tries))
    assert (stats["processed"], stats["retried"], stats["saved"]) == (2, 1, 1)
    stats, _ = crawl.crawl(["http://a.example/"], lambda u: ("http://out.example/", "<p>x</p>"))
    assert stats["skipped"] == 1 and stats["saved"] == 0
    stats, tasks = crawl.crawl(["http://a.example/"], lambda u: None, attempts=2)
    assert stats["failed"] == 1 and tasks["http://a.example/"]["state"] == "failed"
    assert crawl.crawl(["http://a.example/"], lambda u: None, max_pages=0)[0]["processed"] == 0
    for bad in ({"attempts": 0}, {"refresh_hours": float("nan")}):
        try:
            crawl.crawl([], lambda u: None, **bad)
        except ValueError:
            continue
        raise AssertionError


def test_refresh_and_retry_of_failed():
    tasks = {u: {"state": s, "attempts": 3, "last_error": None, "finished_at": f} for u, s, f in (("http://a.example/1", "done", "2020"), ("http://a.example/2", "done", "2999"), ("http://a.example/3", "failed", "2020"))}
    stats, _ = crawl.crawl([], lambda u: (u, "<p>x</p>"), allowed={"a.example"}, refresh_hours=1, retry_failed=True, tasks=tasks)
    assert (stats["refreshed"], stats["requeued_failed"], stats["saved"]) == (1, 1, 2)


def test_queue_transitions(spark):
    cols = "url string, host string, state string, attempts int, last_error string, finished_at string, seq long"
    t = spark.createDataFrame([("a", "h", "pending", 0, None, None, 2), ("b", "h", "processing", 3, None, None, 1), ("c", "h", "done", 1, None, None, 3), ("d", None, "failed", 3, "x", "2020", 4), ("e", "h", "pending", None, None, None, 5)], cols)
    assert [r.url for r in crawl.claim(t, 1).collect()] == ["a"]
    from pyspark.sql import functions as F

    assert {r.url: r.state for r in crawl.fail(t, F.col("state") == "processing", "e", "now").collect()}["b"] == "failed"
    assert {r.url: r.state for r in crawl.requeue(t, "2021").collect()} == {"a": "pending", "b": "processing", "c": "pending", "d": "failed", "e": "pending"}
    assert {r.seq: r.offset for r in crawl.host_schedule(t, 0.5).collect()} == {2: 0.0, 5: 0.5}
    assert {r.url: r.state for r in crawl.recover(t).collect()}["b"] == "pending"
    new = spark.createDataFrame([("a", "h"), ("z", "h"), ("z", "h"), (None, "h")], "url string, host string")
    assert [r.url for r in crawl.enqueue(t, new).collect()] == ["z"]


def test_deep_and_broken_pages_do_not_stop_the_rest(spark):
    deep = "<ul>" + "<li><ul>" * 3000 + "x"
    rows = [(1, "http://a.example/", deep), (2, "http://[bad/", "<p>text <a href='//[x'>l</a><a href='/y'>m</a>"), (3, "http://a.example/", "<p>fine")]
    df = spark.createDataFrame(rows, "doc_id long, url string, content_html string")
    got = {r.doc_id: r for r in pages.extracted(df).collect()}
    assert got[1].text == "x" and got[1].content_html.count("<li>") == 3000
    assert got[2].text == "text l m" and got[3].text == "fine" and all(r.error is None for r in got.values())
    assert {r.resolved for r in pages.resolved(df, ["/z#q"]).collect()} == {"http://a.example/z", None}


def test_implied_ends_reach_through_paragraphs():
    root = dom.parse("<ul><li><p>a<li>b<ul><li>c</ul></ul><table><tr><td><p>x<td>y<tr><td>z</table>")
    items = [n for n in root.walk() if n.tag == "li"]
    assert [n.text() for n in items] == ["a", "b c", "c"] and items[0].parent is items[1].parent
    assert [[c.text() for c in n.children] for n in root.walk() if n.tag == "tr"] == [["x", "y"], ["z"]]


def test_a_crawl_is_kept_and_goes_on(spark, tmp_path):
    at, web = str(tmp_path), dict(WEB)
    fetch = lambda u: (u, web[u])
    stats, docs = crawl.crawl_into(spark, at, ["http://a.example/", "http://b.example/"], fetch, max_pages=2, fetchers=2)
    assert (stats["scheduled"], stats["saved"]) == (2, 2)
    first = {r.url: r.document_id for r in docs.collect()}
    assert set(first) == {"http://a.example/", "http://b.example/"}
    stats, docs = crawl.crawl_into(spark, at, ["http://a.example/"], fetch)  # the link found before waits in the queue
    assert stats["saved"] == 1 and {r.url for r in docs.collect()} == set(WEB)
    web["http://a.example/"] = "<p>changed</p>"
    stats, docs = crawl.crawl_into(spark, at, ["http://a.example/"], fetch, refresh_hours=0)
    got = {r.url: (r.document_id, r.text) for r in docs.collect()}
    assert stats["refreshed"] == 3 and len(got) == 3 and got["http://a.example/"] == (first["http://a.example/"], "changed")
    assert sorted(i for i, _ in got.values()) == [1, 2, 3]


def test_a_kept_crawl_retries_skips_and_fails(spark, tmp_path):
    def fetch(u):
        if u.endswith("/out"):
            return "http://out.example/", "<p>x</p>"
        if u.endswith("/bad"):
            raise OSError("boom")
        return None if u.endswith("/none") else (u, "<a href='/out'>o</a><a href='/bad'>b</a><a href='/none'>n</a><a href='http://[x'>y</a>")

    stats, docs = crawl.crawl_into(spark, str(tmp_path), ["http://a.example/"], fetch, attempts=2)
    assert (stats["saved"], stats["skipped"], stats["failed"], stats["retried"], stats["processed"]) == (1, 1, 2, 2, 6)
    stats, _ = crawl.crawl_into(spark, str(tmp_path), ["http://a.example/"], lambda u: (u, "<p>now"), retry_failed=True)
    assert stats["requeued_failed"] == 2 and stats["saved"] == 2
    assert crawl.crawl_into(spark, str(tmp_path / "none"), [], fetch, max_pages=0)[1] is None


def test_the_container_with_most_text_is_the_content():
    page = "<body><div><a href=/1>menu one</a> <a href=/2>menu two</a></div><div id=all><div>side note</div><div><p>" + "long text. " * 20 + "</p></div></div><div>foot</div></body>"
    x = dom.extract(page, "http://a.example/")
    assert x["text"] == ("long text. " * 20).strip()
    spread = dom.extract("<div>one two</div><div>three four</div>", "http://a.example/")
    assert spread["text"] == "one two three four" and dom.densest(dom.parse("")) is None
