from lanternq.llm import mixing as M

TARGETS = "source string, target_share double, max_repeats int"


def run(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "7 as tokens", "8 as copies")
    mixture, report = M.mix(d, spark.createDataFrame(targets, TARGETS), **kw)
    return sorted(map(tuple, mixture.collect()), key=str), {r.source: r for r in report.collect()}


def docs():
    return [(k, "abc"[k % 3], "字" * (5 + k % 40)) for k in range(900)] + [(1000, "d", "字" * 50), (1001, "d", None), (1002, None, "字"), (1003, "z", "字" * 999), (1004, "d", "")]


def test_shares_and_caps(spark):
    targets = [("a", 0.5, 3), ("b", 0.2, 2), ("c", 0.2, 1), ("d", 0.05, 4), ("e", 0.05, 9)]
    got, report = run(spark, docs(), targets)
    cap = {s: m for s, _, m in targets}
    total = report["a"].total
    size = {k: len(t or "") for k, _, t in docs()}
    assert all(copies <= cap[s] and tokens == size[k] for k, s, tokens, copies in got)
    assert total == sum(len(t or "") for _, s, t in docs() if s in cap)
    for s, share, most in targets:
        own = sum(len(t or "") for _, x, t in docs() if x == s)
        assert report[s].short == (own * most < share * total)
        assert abs(report[s].reached - min(share * total, own * most)) <= 0.03 * total  # the sample has a fixed number of documents, not of tokens
    assert abs(sum(r.reached_share for r in report.values()) - 1) < 1e-9
    assert (got, report) == run(spark, docs(), targets)


def test_token_size(spark):
    d = spark.createDataFrame([("abcde",), ("校a",), ("é",), (None,), ("",)], "t string")
    assert [r.n for r in d.select(M.token_size(d.t).alias("n")).collect()] == [2, 2, 1, 0, 0]


def test_sizes_weigh_the_draw(spark):
    """Inclusion grows with size: large documents are drawn more often over seeds."""
    rows = [(k, "a", "字" * (10 if k < 100 else 40)) for k in range(200)] + [(900, "b", "字" * 2000)]
    hits = [k for seed in range(5) for k, s, _, c in run(spark, rows, [("a", 0.15, 1), ("b", 0.2, 1)], seed=seed)[0] if s == "a"]
    assert sum(k >= 100 for k in hits) > 2 * sum(k < 100 for k in hits) > 0


def test_edges(spark):
    assert run(spark, [], [("a", 1.0, 2)])[1]["a"].reached == 0
    got, report = run(spark, [(1, "a", "字字"), (1, "a", "字字"), (None, "a", "字")], [("a", 1.0, 1), (None, 0.1, 1)])
    assert sum(c for *_, c in got) == 3 and report["a"].reached == 5 and report[None].tokens == 0
