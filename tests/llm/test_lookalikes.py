from lanternq.llm import lookalikes as A

CASES = {
    "ＡＢ": ["full-width"],
    "１": ["full-width"],
    "ｶﾞ": ["half-width kana"],
    "éte": ["separate accent"],
    "ẹ́": ["separate accent"],
    "a​b": ["invisible"],
    "a‍b": ["invisible"],
    "­": ["invisible"],
    "a b": ["space"],
    "⽆": ["han form"],
    "豈": ["han form"],
    "Cоokie": ["look-alike letter"],
    "αb": ["look-alike letter"],
}
CLEAN = ["", "plain", "，。！（）", "кот", "αβγ", "\U0001f468‍\U0001f52c", "\U0001f3f3️‍\U0001f308", "é", "中文 　", "を゙", "e ́"]


def test_faults(spark):
    rows = [(k, t) for k, t in enumerate([*CASES, *CLEAN])] + [(99, None), (0, "ＡＢ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as form", "1 as bits")
    got = [(r.doc_id, list(r.faults)) for r in A.inconsistent(df, "doc_id", "text").collect()]
    assert sorted(got) == sorted([*enumerate(CASES.values()), (0, ["full-width"])])
    assert A.inconsistent(df.limit(0), "doc_id", "text").count() == 0


def test_forms():
    pairs = {"ＡＢ１": "ab1", "ｶﾞ": "ガ", "ét": "ét", "a​b­c": "abc", "a  b": "a  b", "⽆": "无", "Cоοkіe": "cookie", "кот": "кот", "Straße": "strasse", "\U0001f468‍\U0001f52c x‍y": "\U0001f468‍\U0001f52c xy", "x\ty": "x y"}
    for a, b in pairs.items():
        assert A.consistent(a) == b
        assert A.consistent(b) == b
    assert A.consistent("Ａ" * 100_000) == "a" * 100_000


def test_every_row_gets_its_form(spark):
    df = spark.createDataFrame([(1, "ＡＢＣ"), (2, "abc"), (3, "ABC"), (4, None), (5, "q̃"), (6, "cafθ")], "doc_id long, text string")
    got = {r.doc_id: (list(r.faults), r.form) for r in A.inconsistent(df, "doc_id", "text", True).collect()}
    assert {k: v[1] for k, v in got.items()} == {1: "abc", 2: "abc", 3: "abc", 5: "q̃", 6: "cafθ"}
    assert got[6][0] == ["look-alike letter"]
    assert got[1][0] == ["full-width"] and got[2][0] == got[3][0] == [] and got[5][0] == ["separate accent"]
