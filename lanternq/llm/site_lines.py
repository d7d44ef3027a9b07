"""Problem 4: lines that stand in many documents of one site.

A line is parsed into tokens (digits are one kind of token) and goes down a tree of fixed depth: by site, by the number of
its tokens, then by its leading tokens, to a leaf. Each task grows such a tree and counts the documents of every line form
in its leaves; the trees of all partitions are merged leaf by leaf. In a leaf, a form joins the template that it agrees with
in at least SIMILAR of the tokens, and the slots where they differ become wildcards; else it is a new template. Templates
that cover many documents of their site are kept, and with them their forms and lines. A form belongs to one template and
is never in more documents than it, so a rule on forms can follow without loss.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import site
from ..sources.staging import spread, stage

SPACES = re.compile("[ \t\u00a0\u3000]+")
DIGITS = re.compile("[0-9]+")
TOKENS = re.compile(r"#|[^\W\d_]+|\d+|[^\w\s]|_")
#: Share of the tokens that a line must have in common with a template.
SIMILAR = 0.5
#: Forms that a task's tree holds before it is handed on.
TREE_NODES = 500_000
WILDCARD = "<*>"


def form_of(line: str) -> str:
    """The line with runs of blanks as one space, outer spaces gone, and each run of 0-9 as `#`."""
    return DIGITS.sub("#", SPACES.sub(" ", line).strip(" "))


def hash64(text: str) -> int:
    """Signed 64-bit hash, the same on every machine."""
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def depth_of(n: int) -> int:
    """Leading tokens that the tree looks at in a line of n tokens."""
    return 1 if n <= 4 else 2 if n <= 12 else 3


def tokens_of(form: str) -> list[str]:
    return TOKENS.findall(form) or [form]


def parsed(form: str) -> tuple[int, bytes]:
    """The leaf of a form, and a 32-bit number for each of its tokens, never 0."""
    t = tokens_of(form)
    numbers = np.fromiter(((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) & 0xFFFFFFFF) or 1 for x in t), np.uint32, len(t))
    return hash64(" ".join([str(len(t)), *t[: depth_of(len(t))]])), numbers.tobytes()


class Forms:
    """Form hash of lines, remembered for lines that come again."""

    def __init__(self, most: int = 200_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __getitem__(self, line: str) -> int:
        got = self.known.get(line)
        if got is None:
            got = hash64(form_of(line))
            if len(line) <= 60:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[line] = got
        return got


def task_tree(most: int):
    """mapInArrow function: (site, text) -> (site, leaf, form, tokens, docs): the forms in the leaves of this task's tree."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, tree = Forms(), {}

        def grown() -> pa.RecordBatch:
            sites, form = zip(*tree, strict=True)
            docs, leaf, tokens = zip(*tree.values(), strict=True)
            out = pa.record_batch({"site": pa.array(sites, pa.string()), "leaf": pa.array(leaf, pa.int64()), "form": pa.array(form, pa.int64()), "tokens": pa.array(tokens, pa.binary()), "docs": pa.array(docs, pa.int64())})
            tree.clear()
            return out

        for batch in batches:
            for s, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: set[int] = set()
                for x in text.split("\n"):
                    if x and not x.isspace() and (form := forms[x]) not in own:
                        own.add(form)
                        node = tree.get((s, form))
                        if node is None:
                            node = tree[s, form] = [0, *parsed(form_of(x))]
                        node[0] += 1
                if len(tree) > most:
                    yield grown()
        if tree:
            yield grown()

    return run


class Leaf:
    """The templates of one leaf: token numbers by slot, 0 where a slot is a wildcard."""

    def __init__(self) -> None:
        self.rows, self.used = np.zeros((0, 0), np.uint32), 0

    def add(self, tokens: np.ndarray) -> int:
        """The number of the template that takes the tokens."""
        if self.used:
            have = self.rows[: self.used]
            same = (have == tokens).sum(1)
            best = int(same.argmax())
            if same[best] >= SIMILAR * len(tokens):
                have[best][have[best] != tokens] = 0
                return best
        if self.used == len(self.rows):
            new = np.zeros((max(4, 2 * self.used), len(tokens)), np.uint32)
            if self.used:
                new[: self.used] = self.rows
            self.rows = new
        self.rows[self.used] = tokens
        self.used += 1
        return self.used - 1


def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over (site, leaf, form, tokens, docs) sorted by the first three.

    Gives (site, form, template, docs) of every form, and (site, template, shape) of every template.
    """
    at: tuple | None = None
    form: tuple[int, bytes, int] | None = None
    leaf = Leaf()
    out: list[tuple] = []
    kinds = [("site", pa.string()), ("form", pa.int64()), ("template", pa.int64()), ("docs", pa.int64()), ("shape", pa.binary())]

    def name(k: int) -> int:
        return hash64(f"{at[1]}:{k}")

    def placed() -> None:
        f, tokens, docs = form
        out.append((at[0], f, name(leaf.add(np.frombuffer(tokens, np.uint32))), docs, None))

    def closed() -> None:
        out.extend((at[0], None, name(k), None, leaf.rows[k].tobytes()) for k in range(leaf.used))

    for batch in batches:
        for s, where, f, tokens, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if form is not None and (s, where) == at and f == form[0]:
                form = (f, tokens, form[2] + docs)
                continue
            if form is not None:
                placed()
            if (s, where) != at:
                if at is not None:
                    closed()
                at, leaf = (s, where), Leaf()
            form = (f, tokens, docs)
        if out:
            yield pa.record_batch({k: pa.array(x, t) for (k, t), x in zip(kinds, zip(*out, strict=True), strict=True)})
            out.clear()
    if form is not None:
        placed()
        closed()
        yield pa.record_batch({k: pa.array(x, t) for (k, t), x in zip(kinds, zip(*out, strict=True), strict=True)})


def lines_by_form(with_line: bool):
    """mapInArrow function: (key, row, site, text) -> (_key, _row, site, line_no, form[, line]) of the non-blank lines."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Forms()
        for batch in batches:
            rows, at, forms, lines = [], [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                for k, x in enumerate(text.split("\n"), 1):
                    if x and not x.isspace():
                        rows.append(i)
                        at.append(k)
                        forms.append(known[x])
                        if with_line:
                            lines.append(x)
            pick = pa.array(rows, pa.int64())
            out = {"_key": batch.column(0).take(pick), "_row": batch.column(1).take(pick), "site": batch.column(2).take(pick), "line_no": pa.array(at, pa.int64()), "form": pa.array(forms, pa.int64())}
            yield pa.record_batch(out | ({"line": pa.array(lines, pa.string())} if with_line else {}))

    return run


class SiteLines:
    """The lines of a table with their sites, forms and covering templates.

    Many means at least least_docs rows and at least share (a fraction as numerator, denominator) of all rows of the site; a
    row counts once per form or template. Rows without a url host have no site and no such lines; rows with a null or empty
    text count as rows of their site. form and template are hashes. Other columns are ignored; an empty df gives no rows.
    """

    def __init__(self, df: DataFrame, key: str = "doc_id", text: str = "text", url: str = "url", least_docs: int = 6, share: tuple[int, int] = (5, 100)) -> None:
        self.key, self.kind, self.least_docs, self.share = key, dict(df.dtypes)[key], least_docs, share
        base = spread(df.select(F.col(key).alias("_key"), site(F.col(url)).alias("site"), F.col(text).alias("_text")).filter("site is not null"))
        self.sizes = base.groupBy("site").agg(F.count(F.lit(1)).alias("of"))
        self.full = base.filter("_text is not null and _text <> ''")
        grown = self.full.select("site", "_text").mapInArrow(task_tree(TREE_NODES), "site string, leaf long, form long, tokens binary, docs long")
        tree = grown.repartition("site", "leaf").sortWithinPartitions("site", "leaf", "form").mapInArrow(merged, "site string, form long, template long, docs long, shape binary")
        tree = stage(tree, "tree")
        self.shapes = tree.filter("shape is not null").select("site", "template", "shape")
        forms = tree.filter("form is not null").select("site", "form", "template", "docs")
        covering = self.many(forms.groupBy("site", "template").agg(F.sum("docs").alias("docs"))).select("site", "template")
        self.forms = forms.join(covering, ["site", "template"], "left_semi")

    def many(self, rows: DataFrame) -> DataFrame:
        """The rows (site, .., docs) that reach the bounds."""
        num, den = self.share
        return rows.filter(F.col("docs") >= self.least_docs).join(self.sizes, "site").filter(F.col("docs") * den >= F.col("of") * num).drop("of")

    def lines(self, forms: DataFrame, with_line: bool = False) -> DataFrame:
        """(_key, _row, site, line_no, form, template[, line]): the lines of the given forms."""
        full = self.full.select("_key", F.monotonically_increasing_id().alias("_row"), "site", "_text")
        lines = full.mapInArrow(lines_by_form(with_line), f"_key {self.kind}, _row long, site string, line_no long, form long" + ", line string" * with_line)
        return lines.join(forms.select("site", "form", "template"), ["site", "form"])


def repeated_lines(df: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """(key, line_no, site, form, template): the lines under covering templates whose own form stands in many documents.

    For what many means, and for edge cases, see SiteLines.
    """
    s = SiteLines(df, key, **options)
    forms = stage(s.many(s.forms).select("site", "form", "template"), "forms")
    return s.lines(forms).select(F.col("_key").alias(key), "line_no", "site", "form", "template")


def template_lines(df: DataFrame, key: str = "doc_id", **options) -> tuple[DataFrame, DataFrame]:
    """Lines (key, line_no, site, template) under templates that stand in many documents, whatever their own forms do, and
    those templates (site, template, shape, documents, lines, example).

    So lines that differ in a name are found too. For what many means, and for edge cases, see SiteLines.
    """
    s = SiteLines(df, key, **options)
    lines = stage(s.lines(s.forms, True), "template-lines")
    docs = lines.groupBy("site", "template", "_row").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))
    docs = docs.groupBy("site", "template").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("lines"), F.min("line").alias("example"))
    found = stage(s.many(docs).join(s.shapes, ["site", "template"]).withColumnRenamed("docs", "documents"), "templates")
    lines = lines.join(found.select("site", "template"), ["site", "template"], "left_semi")
    return lines.select(F.col("_key").alias(key), "line_no", "site", "template"), found


def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (site, shape, example, documents, lines) -> (site, template, documents, lines)."""
    for b in batches:
        text = []
        for shape, line in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            form = form_of(line)
            fixed = np.frombuffer(shape, np.uint32) > 0
            text.append(form if fixed.all() else " ".join(t if f else WILDCARD for t, f in zip(tokens_of(form), fixed.tolist(), strict=True)))
        yield pa.record_batch({"site": b.column(0), "template": pa.array(text, pa.string()), "documents": b.column(3), "lines": b.column(4)})


def templates(df: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """(site, template, documents, lines): the templates that stand in many documents of a site, wildcards as `<*>`."""
    _, found = template_lines(df, key, **options)
    return found.select("site", "shape", "example", "documents", "lines").mapInArrow(named, "site string, template string, documents long, lines long")


def without_lines(df: DataFrame, dropped: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): the rows of df with the lines (key, line_no) of `dropped` taken out of the text; null stays null."""
    marks = dropped.groupBy(F.col(key).alias("_key")).agg(F.collect_set("line_no").alias("_lines"))
    kept: Column = F.expr("array_join(filter(split(_text, '\n', -1), (x, i) -> not array_contains(_lines, cast(i + 1 as bigint))), '\n')")
    base = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    out = base.join(marks, "_key", "left")
    return out.select(F.col("_key").alias(key), F.when(F.col("_lines").isNull(), F.col("_text")).otherwise(kept).alias(text))
