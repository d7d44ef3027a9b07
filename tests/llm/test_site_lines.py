from collections import Counter, defaultdict

from lanternq.llm import site_lines as L

SCHEMA = "doc_id long, url string, text string"


def brute(rows):
    import re

    docs, forms = Counter(), defaultdict(set)
    for n, (_, url, text) in enumerate(rows):
        m = re.match(r"[a-z]+://([^/:?#]+)", (url or "").lower())
        if m:
            s = re.sub(r"^(www|m)\.", "", m[1])
            docs[s] += 1
            for line in (text or "").split("\n"):
                if line.strip():
                    forms[s, L.form_of(line)].add(n)
    many = {k for k, v in forms.items() if len(v) >= 6 and len(v) * 20 >= docs[k[0]]}
    out = []
    for k, url, text in rows:
        m = re.match(r"[a-z]+://([^/:?#]+)", (url or "").lower())
        s = re.sub(r"^(www|m)\.", "", m[1]) if m else None
        out += [(k, i) for i, line in enumerate((text or "").split("\n"), 1) if line.strip() and (s, L.form_of(line)) in many]
    return sorted(out, key=str)


def rows():
    out = []
    for k in range(160):
        host = ["http://www.A.example:80/x", "https://m.a.example/", "http://a.example?q"][k % 3]
        text = f"本页访问 {k} 次\n\n　正文 第{k}段 own{k}own\n本页访问\t{k * 7} 次"
        text += "\n仅六篇" * (k < 7) + "\n仅八篇 a" * (k < 8) + "\n五篇" * (k < 5)
        out.append((k, host, text))
    out += [(1000 + k, "http://b.example/", "same line\nsame line") for k in range(6)] + [(1100 + k, "http://c.example/", "same line") for k in range(5)]
    return out + [(2000, None, "same line"), (2001, "http://b.example/", None), (2002, "", ""), (1000, "http://b.example/", "same line"), (None, "http://b.example/", "same line\n" + "y" * 20000)]


def test_lines_equal_brute_force(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumnsRenamed({}).selectExpr("*", "1 as site", "2 as form", "3 as line_no")
    got = sorted(((r.doc_id, r.line_no) for r in L.repeated_lines(df).collect()), key=str)
    assert got == brute(rows()) and got


def test_small_trees_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(L, "TREE_NODES", 3)
    got = sorted(((r.doc_id, r.line_no) for r in L.repeated_lines(spark.createDataFrame(rows(), SCHEMA)).collect()), key=str)
    assert got == brute(rows())


def test_clean_text_templates_and_empty(spark):
    df = spark.createDataFrame([(k, "http://b.example/", f"a\n\nshare {k}\nown{'abcdefgh'[k]}z") for k in range(8)] + [(9, "http://b.example/", None)], SCHEMA)
    found = L.repeated_lines(df)
    clean = {r.doc_id: r.text for r in L.without_lines(df, found).collect()}
    assert clean[3] == "\nowndz" and clean[9] is None
    assert {(r.template, r.documents) for r in L.templates(df).collect()} == {("a", 8), ("share #", 8)}
    assert L.repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_name_in_the_middle_is_a_wildcard(spark):
    """Planted lines with changing names, against the same by hand; article lines stay."""
    names = ["Anna Ho", "Ben Li", "Cy Ma", "Di Wu", "Ed Xu", "Flo Yi", "Gus Zu", "Hal Ke"]
    rows = [(k, "http://b.example/", f"Edited by {n} for the campus paper\n作者：{n.split()[0]}作\nword{'abcdefgh'[k]} and nothing like it{'?' * k}\nsame") for k, n in enumerate(names)]
    rows += [(100 + k, "http://c.example/", f"Edited by {n} for the campus paper") for k, n in enumerate(names[:5])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    lines, found = L.template_lines(df)
    assert sorted((r.doc_id, r.line_no) for r in lines.collect()) == sorted((k, n) for k in range(8) for n in (1, 2, 4))
    got = {(r.site, r.template, r.documents, r.lines) for r in L.templates(df).collect()}
    assert got == {("b.example", "Edited by <*> <*> for the campus paper", 8, 8), ("b.example", "作者 ： <*>", 8, 8), ("b.example", "same", 8, 8)}
    assert {r.line_no for r in L.repeated_lines(df).collect()} == {4}
