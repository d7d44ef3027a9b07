import math
import re
import unicodedata
from collections import Counter

from lanternq.llm import terms


def brute(text):
    kind = lambda c: "h" if "一" <= c <= "鿿" else "w" if unicodedata.category(c)[0] in "LMN" else " "
    out = []
    for run in re.finditer(r"h+|w+", "".join(map(kind, text))):
        piece = text[run.start() : run.end()]
        if run.group()[0] == "w" or len(piece) == 1:
            out.append(piece)
        else:
            out += [piece[i : i + 2] for i in range(len(piece) - 1)]
    return out


ROWS = [
    (1, "校园网 abc", "校园网，校园\nabc ABC 第3号 été \U00020000\U00020001x"),
    (2, None, "的的的"),
    (3, "", ""),
    (3, "校", None),
    (None, "abc 校园", "x" * 5000 + " 国" * 3000),
    (5, "abc", "abc abc abc 稀"),
]
SCHEMA = "document_id long, title_norm string, text_norm string"


def test_frequencies_equal_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    total, records = Counter(), Counter()
    for _, a, b in ROWS:
        t = brute((a or "") + "\n" + (b or ""))
        total.update(t)
        records.update(set(t))
    got = {r.term: (r.total, r.records, r.mark) for r in terms.term_frequencies(df, ["title_norm", "text_norm"]).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: (total[k], records[k]) for k in total}
    for k, (n, d, mark) in got.items():
        assert mark == ("rare" if n <= 2 else "common" if d >= 0.2 * len(ROWS) else None)


def test_light_and_heavy_paths_agree(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, SCHEMA)
    cols = ["title_norm", "text_norm"]
    a = sorted(map(tuple, terms.term_frequencies(df, cols).collect()), key=str)
    monkeypatch.setattr(terms, "heavy_terms", lambda *_: [])
    b = sorted(map(tuple, terms.term_frequencies(df, cols).collect()), key=str)
    assert a == b


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert terms.term_frequencies(empty, ["title_norm", "text_norm"]).count() == 0
    assert terms.distinctive_terms(empty, "document_id", ["title_norm", "text_norm"]).count() == 0
    wide = spark.createDataFrame([(1, "甲乙", "甲乙", "x", "y")], "document_id long, title_norm string, text_norm string, term string, n string")
    assert {r.term for r in terms.distinctive_terms(wide, "document_id", ["title_norm", "text_norm"]).collect()} == {"甲乙"}


def test_scores_equal_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    bags = [Counter(brute((a or "") + "\n" + (b or ""))) for _, a, b in ROWS]
    d = Counter(t for bag in bags for t in bag)
    n_rows, mean = len(bags), sum(sum(b.values()) for b in bags) / len(bags)
    want = []
    for (key, _, _), bag in zip(ROWS, bags, strict=True):
        length = sum(bag.values())
        for t, n in bag.items():
            idf = math.log(1 + (n_rows - d[t] + 0.5) / (d[t] + 0.5))
            want.append((str(key), t, n, length, d[t], round(idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / mean)), 9)))
    got = [(str(r.document_id), r.term, r.n, r.length, r.records, round(r.score, 9)) for r in terms.distinctive_terms(df, "document_id", ["title_norm", "text_norm"]).collect()]
    assert sorted(got) == sorted(want)
    few = terms.distinctive_terms(df, "document_id", ["title_norm", "text_norm"], least=2, records_between=(1, 2)).collect()
    assert sorted((str(r.document_id), r.term, r.n) for r in few) == sorted(x[:3] for x in want if x[2] >= 2 and x[4] <= 2)
