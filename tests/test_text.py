from pyspark.sql import functions as F

from lanternq.functions import text as T
from lanternq.functions.tokens import query_terms, tokenize_with_positions
from lanternq.operators import passages


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(expr.alias("x")).first().x


def test_normalize_folds_width_case_and_blanks(spark):
    rows = spark.createDataFrame([("ＶＣＲ　１０ Straße\n x",), (None,), ("",)], "t string")
    assert [r.x for r in rows.select(T.normalize_text("t").alias("x")).collect()] == ["vcr 10 strasse x", "", ""]


def test_tokens_by_mode():
    assert tokenize_with_positions("统一认证 abc", "search") == [("统一", 0), ("一认", 1), ("认证", 2), ("abc", 5)]
    assert tokenize_with_positions("统一认证 abc", "default") == [("统一认证", 0), ("abc", 5)]
    assert tokenize_with_positions("的", "default") == []
    assert query_terms("ABC abc 校园") == ["abc", "校园"]
    try:
        tokenize_with_positions("x", "other")
    except ValueError:
        pass
    else:
        raise AssertionError


def test_published_date_prefers_text_even_if_invalid(spark):
    f = lambda t, u: one(spark, T.published_date(F.col("t"), F.col("u")), t=t, u=u)
    assert f("发布时间：2024年3月5日", "http://a/20230101/x") == "2024-03-05"
    assert f("日期: 2024-13-40", "http://a/20230101/x") == ""
    assert f("none", "http://a/20230101/x") == "2023-01-01"
    assert f("none", "http://a/920230101/x") == ""


def test_snippet_and_scores(spark):
    text = "x" * 300 + "课程" + "y" * 100 + "课程课程" + "z" * 300
    got = one(spark, T.snippet(F.col("t"), F.array(F.lit("课程"))), t=text)
    assert len(got) == 240 and got.count("课程") == 3
    assert one(spark, T.snippet(F.col("t"), F.array(F.lit("a"))), t="short") == "short"
    assert one(spark, T.lexical_score(F.col("t"), F.array(F.lit("aa"), F.lit("b"))), t="aaaab") == 5
    assert one(spark, T.bigrams(F.col("t")), t="a") == []
    assert one(spark, T.token_estimate(F.col("t")), t="校园abcde") == 2 + 2 + 4


def test_passage_windows_cover_everything_with_the_overlap():
    for n in (1, 5, 10, 11, 50, 64, 199):
        w = passages.windows(n, 10, 3)
        assert {i for a, b in w for i in range(a, b)} == set(range(n))
        assert all(b0 - a1 == 3 for (_, b0), (a1, _) in zip(w, w[1:], strict=False)) and w[-1][1] == n
    assert passages.cut("", "") == [] and passages.cut("t", "") == [(0, 0, 0)]
    assert passages.cut("", "字" * 1000)[0] == (0, 376, 376)


def test_normalize_text_of_every_document(spark, tmp_path):
    from lanternq.plans import catalog

    rows = [(1, "ＡＢＣ　图书馆", "Straße\n ﬁn"), (2, None, "Обычный  ТЕКСТ"), (3, "plain Title", None), (4, "カﾞイド", "")]
    spark.createDataFrame(rows, "doc_id long, title string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.title_norm, r.text_norm) for r in catalog.queries()["normalize_text_all"](spark, str(tmp_path)).collect()}
    assert got.keys() == {1, 2, 3, 4}
    assert got[1] == ("abc 图书馆", "strasse fin") and got[2][1] == "обычный текст" and got[3][0] == "plain title" and got[4][0] == "ガイド"


def test_snippets_of_many_occurrences(spark):
    """Occurrences far into a long text count, and their places are added up in blocks."""
    from pyspark.sql import functions as F

    text = "a n b " * 3000 + "x" * 400 + "needle needle" + "y" * 400
    got = spark.createDataFrame([(text,), ("short",), ("",)], "t string").select(T.snippet(F.col("t"), F.array(F.lit("needle"), F.lit("zz"))).alias("s")).collect()
    assert "needle needle" in got[0].s and len(got[0].s) == 240 and [r.s for r in got[1:]] == ["short", ""]
    n = spark.range(1).select(T.sums(F.sequence(F.lit(1), F.lit(50)).cast("array<int>")).alias("x")).first().x
    assert n == [k * (k + 1) // 2 for k in range(1, 51)]


def test_canonical_urls(spark):
    from lanternq.functions import urls

    pairs = {
        "HTTP://A.Example:80": "http://a.example/",
        "https://a.example:443/x/../y/./z?q=../k#f": "https://a.example/y/z?q=../k",
        "http://a.example/a/b/..": "http://a.example/a/",
        "http://a.example/../../c": "http://a.example/c",
        "http://a.example/%e4%bd%A0%zz?x=%2f": "http://a.example/%E4%BD%A0%zz?x=%2F",
        "http://a.example?x": "http://a.example?x",
        "http://a.example/v1.2/..x": "http://a.example/v1.2/..x",
    }
    df = spark.createDataFrame([*pairs.items(), (None, None)], "u string, want string")
    assert all(r.got == r.want for r in df.select("want", urls.canonical(F.col("u")).alias("got")).collect())
