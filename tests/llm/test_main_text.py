import random

import numpy as np

from lanternq.llm import main_text as M

SCHEMA = "doc_id long, text string, content_html string"


def page(r, k, keep=True):
    menu = r.sample(["Home", "News", "People", "Contact", "Map", "Study"], 4)
    body = [" ".join(r.choice(["report", "meeting", "student", "library", "result", "group"]) for _ in range(r.randrange(8, 20))) + "." for _ in range(r.randrange(2, 6))]
    foot = [f"Copyright {2000 + k % 20} Campus", f"Visitors {r.randrange(9999)}"]
    text = "\n".join([*menu, "", *body, *foot])
    html = "<nav>" + "".join(f"<li><a href='/{m}'>{m}</a></li>" for m in menu) + "</nav><article>" + "".join(f"<p>{b}</p>" for b in body) + "</article><footer>" + "".join(f"<p>{f}</p>" for f in foot) + "</footer>"
    outside = {*range(1, 5), *range(6 + len(body), 8 + len(body))}
    return (k, text, html if keep else ""), outside


def test_learns_and_labels_pages_without_blocks(spark):
    r = random.Random(1)
    made = [page(r, k, k % 3 > 0) for k in range(240)]
    rows = [x for x, _ in made] + [(1000, None, None), (1001, "", None), (1002, " \n ", "<p>"), (1003, "word " * 20000, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as line_no")
    got = {}
    for x in M.outside_lines(df).collect():
        got.setdefault(x.doc_id, set()).add(x.line_no)
    right = [len(got.get(x[0], set()) ^ want) for x, want in made]
    assert sum(right) <= 0.02 * sum(len(w) for _, w in made)
    assert not got.keys() & {1000, 1001, 1002}


def test_gradients():
    net = M.Labeller()
    p = M.page_of("a menu\nlong text here.\nfoot", "<nav>a menu</nav><p>long text here.</p>", {}, [1, 0, 1])
    x, y = net.inputs([p, p]), np.r_[p["label"], p["label"]]

    def loss():
        z = net.run(net.inputs([p, p]), [3, 3])
        return float(np.mean(np.log1p(np.exp(-np.where(y > 0, z, -z)))))

    z = net.run(x, [3, 3], True)
    g = net.gradients(x, [3, 3], ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32))
    for name in ("hl", "xr", "out", "bl"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        assert abs((up - loss()) / 2e-2 - g[name][at]) < 0.05 * abs(g[name][at]) + 1e-4
        net.p[name][at] = old


def test_blocks_and_no_teacher(spark):
    assert [b[1] for b in M.blocks("<div class=a>x <a href=1>y</a><br>z</div><!-- n --><p>&lt;w")] == ["x y", "z", "<w"]
    assert M.outside_lines(spark.createDataFrame([(1, "a\nb", None)], SCHEMA)).count() == 0
    assert M.outside_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_fitted_labeller_is_kept_and_given(spark):
    r = random.Random(2)
    rows = [page(r, k)[0] for k in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    fitted = M.trained(df)
    a, b = M.loaded(fitted), M.loaded(spark.read.parquet(fitted.inputFiles()[0]))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)
    bare = spark.createDataFrame([(k, t, None) for k, t, _ in rows], SCHEMA)
    want = {(x.doc_id, x.line_no) for x in M.outside_lines(df).collect()}
    got = {(x.doc_id, x.line_no) for x in M.outside_lines(bare, fitted=fitted).collect()}
    assert len(got ^ want) <= 0.03 * len(want)


def test_rows_without_blocks_do_not_thin_the_lessons(spark):
    """The share of drawn pages is taken over the pages that can teach, not over all rows."""
    r = random.Random(3)
    rows = [page(r, k, k < 60)[0] for k in range(3000)]
    assert M.loaded(M.trained(spark.createDataFrame(rows, SCHEMA))) is not None


def test_added():
    like, at, rows = np.zeros((5, 2)), np.array([3, 0, 3]), np.array([[1.0, 2], [3, 4], [5, 6]])
    assert (M.added(like, at, rows) == [[3, 4], [0, 0], [0, 0], [6, 8], [0, 0]]).all()
