import pytest

from lanternq.operators import dense, evaluate, fusion, index, passages, ranking, rerank

DOCS = "document_id long, title_norm string, text_norm string"


def test_phrase_needs_adjacent_tokens(spark):
    df = spark.createDataFrame([(1, "", "in the city park today"), (2, "", "city and park"), (3, None, None), (4, "city, park", "")], DOCS)
    assert [r.document_id for r in ranking.phrase_search(df, {1: "city park"}).collect()] == [1]


def test_title_beats_short_body_beats_long_body(spark):
    df = spark.createDataFrame([(3, "x", "term " + "pad " * 10), (2, "x", "term pad pad pad"), (1, "term", "pad pad pad pad"), (4, None, "nothing")], DOCS)
    got = ranking.top(ranking.bm25f(df, {1: "term"}), 10).orderBy("rank").collect()
    assert [r.document_id for r in got] == [1, 2, 3]


def test_fusion_keeps_one_sided_hits(spark):
    sparse = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0)], "query_id int, document_id long, score double")
    found = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.5)], "query_id int, document_id long, score double")
    order = lambda a: [r.document_id for r in fusion.fuse(sparse, found, 10, a).orderBy("rank").collect()]
    assert order(0.5) == [1, 2, 3] and order(0) == [1, 2] and order(1) == [2, 3]
    for bad in (-0.1, 1.5):
        with pytest.raises(ValueError):
            fusion.fuse(sparse, found, 10, bad)


def test_vectors(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [0.0, 1.0]), (3, 0, None), (4, 0, [1.0])]
    df = spark.createDataFrame(rows, "document_id long, chunk_index int, embedding array<float>")
    got = dense.ranked(dense.scores(df, {1: [0.0, 1.0]}, ["document_id", "chunk_index"], 5), 5).orderBy("rank").collect()
    assert [(r.document_id, r.chunk_index) for r in got][:2] == [(1, 1), (2, 0)]
    once = dense.scores(df.filter("document_id < 3").coalesce(1), {1: [0.0, 1.0]}, ["document_id", "chunk_index"], 5, once=True).collect()
    assert sorted(r.document_id for r in once) == [1, 2]
    with pytest.raises(ValueError):
        dense.checked(df, 2)
    nan = spark.createDataFrame([([float("nan"), 1.0],)], "embedding array<float>")
    assert dense.validation(nan, 2).first().not_finite == 1


def test_plateau_keeps_candidate_order(spark):
    rows = [(1, 1, 0.991), (1, 2, 0.992), (1, 3, 0.5), (2, 1, 0.8), (2, 2, 0.81), (3, 1, 1.2), (3, 2, 1.1)]
    df = spark.createDataFrame(rows, "query_id int, candidate int, score double")
    got = {(r.query_id, r["rank"]): r.candidate for r in rerank.plateau(df).collect()}
    assert [got[1, k] for k in (1, 2, 3)] == [1, 2, 3] and got[2, 1] == 2 and got[3, 1] == 1


def test_capped_choice_does_not_mark_refused_texts():
    import pandas as pd

    rows = pd.DataFrame([(1, k, 1, k, 1 - k / 10, t) for k, t in enumerate("abcT", 1)] + [(1, 5, 2, 0, 0.1, "T"), (1, 6, 3, 0, 0.05, "a")], columns=["query_id", "candidate", "document_id", "chunk_index", "score", "text"])
    got = rerank.capped(rows, 10)
    assert list(zip(got.document_id, got.chunk_index, strict=True)) == [(1, 1), (1, 2), (1, 3), (2, 0)]


def test_windows_prefer_the_one_that_contains_the_query():
    text = "甲" * 900 + "统一认证平台" + "乙" * 900
    got = rerank.chosen_windows("统一认证平台", "标题", text)
    assert len(got) == 1 and "统一认证平台" in got[0] and got[0].startswith("标题\n")
    assert rerank.chosen_windows("?!", "", text)[0].startswith("甲") and rerank.chosen_windows("x", "t", "") == ["t"]


def test_incremental_replace_and_upsert(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, fetched_at string")
    snap = spark.createDataFrame([(1, "a"), (2, "old")], "document_id long, fetched_at string")
    v = {"m": "1"}
    assert [r.document_id for r in index.changed(docs, snap, v, v).collect()] == [2]
    assert index.changed(docs, snap, {"m": "0"}, v).count() == 2
    old = index.indexed(spark.createDataFrame([(1, "a", "b b"), (2, "c", "d")], DOCS))
    new = index.indexed(spark.createDataFrame([(1, "a", "e")], DOCS))
    assert sorted(r.term for r in index.document_frequency(index.replaced(old, new)).collect()) == ["a", "c", "d", "e"]
    cols = "document_id long, url string, title string, text string, fetched_at string, content_html string"
    a = spark.createDataFrame([(1, "u", "old", "x", "2020", None)], cols)
    b = spark.createDataFrame([(9, "u", "new", "y", "2021", None), (10, "w", "n", "y", "2021", "<p>")], cols)
    got = sorted((r.document_id, r.url, r.title, r.content_html) for r in index.upserted(a, b).collect())
    assert got == [(1, "u", "new", ""), (10, "w", "n", "<p>")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert ranking.bm25f(none, {1: "x"}).count() == 0 and passages.passages(none).count() == 0 and index.corpus_stats(index.indexed(none)).first().documents == 0


def test_reciprocal_rank(spark):
    runs = spark.createDataFrame([(1, 1, "a#f"), (1, 1, "a"), (2, 7, "b"), (3, 21, "c"), (None, 1, None)], "query_id long, rank int, url string")
    rel = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (4, "z")], "query_id long, url string")
    first = evaluate.first_hits(runs, rel)
    assert evaluate.mrr(first).first().mrr == round((1 + 1 / 7) / 4, 6) and evaluate.recall(first).first().recall == 0.5 and evaluate.top1(first).first().top1_hits == 1


def test_second_window_is_the_first_far_one_that_is_strong_enough(monkeypatch):
    """Windows 0, 2 and 3 with (pairs, characters) (3, 3), (2, 3), (1, 7): window 2 is too weak, window 3 is not."""
    parts = {"w0": (0, 3, 3), "w1": (0, 0, 0), "w2": (0, 2, 3), "w3": (0, 1, 7)}
    monkeypatch.setattr(rerank, "scored_windows", lambda *_: list(parts))
    monkeypatch.setattr(rerank, "lexical_parts", lambda q, w: parts[w])
    assert rerank.chosen_windows("query", "", "") == ["w0", "w3"]
    monkeypatch.setattr(rerank, "lexical_parts", lambda q, w: (w == "w0", *parts[w][1:]))
    assert rerank.chosen_windows("query", "", "") == ["w0"]


def test_candidates_beyond_fifty_take_part(spark):
    rows = [(1, k, k, 0, k / 100, f"t{k}") for k in range(1, 81)]
    df = spark.createDataFrame(rows, "query_id int, candidate int, document_id long, chunk_index int, score double, text string")
    assert rerank.rerank_passages(df, 60).count() == 60
    assert rerank.rerank_passages(df, 5, 80).orderBy("rank").first().document_id == 80
    assert rerank.rerank_passages(df, 5).orderBy("rank").first().document_id == 50
    with pytest.raises(ValueError):
        rerank.rerank_passages(df, 5, 0)
