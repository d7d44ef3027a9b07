"""Problem 3: the main body of web pages, by a recurrent labeller of their blocks.

A page is the sequence of its text lines; where its blocks were kept, each line knows the tag path of its block. A
bidirectional LSTM in numpy reads for every line a tag-path vector, a hashed-word vector and a few measures, and labels
the line with the context of the whole page. It is trained on a bounded sample of pages whose kept blocks tell the article
apart: the container with most running text is the article, all other containers are not. In training the tag paths are
dropped from half of the pages, so that pages without kept blocks are labelled by their lines alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import spread, stage
from .codes import joined, major_category

#: Labelled pages that the model is fitted on, and the longest page that it may be fitted on; both bound the fit only, every
#: page is labelled.
TRAIN_PAGES = 1500
LONGEST_LESSON = 200_000
#: Slots and sizes of its vectors; passes over the sample.
WORD_SLOTS, WORD_DIM, PATH_SLOTS, PATH_DIM, HIDDEN, MEASURES = 1 << 14, 16, 1 << 10, 8, 24, 8
EPOCHS, BATCH, RATE = 8, 24, 0.01
#: Share of the pages whose articles are made strange while fitting.
STRANGE = 0.05
#: Lines in one padded batch of labelling; a longer page is a batch of its own.
BATCH_LINES = 30_000

TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+)|<", re.S)
CLASS = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
#: Tags that do not break a block, and tags without an end tag.
INLINE = frozenset("a b i u em strong small sub sup font code mark label cite abbr time q s big tt".split())
VOID = frozenset("br hr img input meta link col area base source wbr embed param track".split())
SPACE = re.compile(r"\s+")
DIGIT = re.compile("[0-9]+")


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, linked) of the leaf blocks of a page in order; linked is the share of the text inside links."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, str]] = []
    words: list[str] = []
    linked = total = 0

    def flush() -> None:
        nonlocal linked, total
        text = SPACE.sub(" ", "".join(words)).strip()
        if text:
            out.append((tuple(x for _, x in stack if x), text, linked / max(total, 1)))
        words.clear()
        linked = total = 0

    for m in TAG.finditer(page):
        end, tag, rest, text = m.groups()
        if text is not None:
            text = html.unescape(text)
            words.append(text)
            n = len(text.strip())
            total += n
            if any(t == "a" for t, _ in stack):
                linked += n
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID and not rest.endswith("/"):
            c = CLASS.search(rest)
            name = "" if tag in INLINE else tag + ("." + (c.group(1) or c.group(2) or c.group(3) or "") if c else "")
            stack.append((tag, name))
    flush()
    return out


def lines_with_paths(text: str, page: str | None) -> tuple[list[int], list[str], list[tuple[str, ...] | None], list[float]]:
    """Number, text, block path and linked share of the non-blank lines; a line without a like block has no path."""
    numbers, lines, paths, links = [], [], [], []
    of = blocks(page) if page else []
    at = 0
    where: dict[str, list[int]] = {}
    for k, (_, t, _) in enumerate(of):
        where.setdefault(t, []).append(k)
    for n, line in enumerate(text.split("\n"), 1):
        line = SPACE.sub(" ", line).strip()
        if not line:
            continue
        numbers.append(n)
        lines.append(line)
        places = where.get(line)
        if places:
            k = next((x for x in places if x >= at), places[-1])
            at = max(at, k)
            paths.append(of[k][0])
            links.append(of[k][2])
        else:
            paths.append(None)
            links.append(0.0)
    return numbers, lines, paths, links


def container(path: tuple[str, ...]) -> str:
    """The outermost element around a block, none for a block at the top. A table cell is a container of its own, as pages
    laid out by tables put their columns into cells."""
    return path[0] if len(path) > 1 or path[:1] == ("td",) else ""


def taught(text: str, page: str) -> list[int] | None:
    """Labels (1 outside the article) of the non-blank lines of a page whose containers tell; None where they do not."""
    of = blocks(page)
    if not of:
        return None
    _, _, paths, _ = lines_with_paths(text, page)
    if not paths or sum(p is None for p in paths) > 0.2 * len(paths):
        return None
    top = [container(p) for p, _, _ in of]
    if len(set(top)) == 1:  # an article saved alone
        return [0] * len(paths)
    groups: dict[str, float] = {}
    for g, (_, t, linked) in zip(top, of, strict=True):
        groups[g] = groups.get(g, 0.0) + len(t) * (1 - linked)
    main = max(groups, key=lambda g: groups[g])
    if groups[main] < 0.6 * sum(groups.values()):
        return None
    return [-1 if p is None else int(container(p) != main) for p in paths]


def hash_of(token: str, slots: int) -> int:
    h = 2166136261
    for c in token.encode("utf-8", "surrogatepass"):
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % slots


def path_slots(path: tuple[str, ...] | None, known: dict) -> list[int]:
    if path is None:
        return []
    got = known.get(path)
    if got is None:
        got = known[path] = [hash_of(f"{k}:{x}", PATH_SLOTS) for k, x in enumerate(path)] + [hash_of("/".join(path), PATH_SLOTS)]
    return got


def word_slots(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the character pairs of each line (digit runs as one sign, ends marked), and where each line starts."""
    codes, start = joined(["\n" + DIGIT.sub("0", x) + "\n" for x in lines])
    c = codes.astype(np.uint64)
    h = (c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(0x5BD1E995)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    slots = (h >> np.uint64(64 - 14)).astype(np.int32)
    keep = np.ones(len(slots), bool)
    keep[start[1:-1] - 1] = False
    return slots[keep], start[:-1] - np.arange(len(lines))


END_MARKS = re.compile("[。！？!?.…」”»।]$")


def measures(lines: list[str], linked: list[float]) -> np.ndarray:
    out = np.zeros((len(lines), MEASURES), np.float32)
    cat = major_category()
    codes, start = joined([x + "\n" for x in lines])
    c = cat[codes]
    size = np.diff(start).astype(np.float32)
    for k, letter in enumerate("NPZS"):
        out[:, k] = np.add.reduceat((c == ord(letter)).astype(np.float32), start[:-1]) / size
    out[:, 4] = np.log1p(size) / 4
    out[:, 5] = [1.0 if END_MARKS.search(x) else 0.0 for x in lines]
    out[:, 6] = linked
    out[:, 7] = size < 8
    return out


def added(like: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Zeros like `like` with each of the rows added at its place."""
    out = np.zeros_like(like)
    if len(at):
        order = np.argsort(at, kind="stable")
        place = at[order]
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        out[place[first]] = np.add.reduceat(rows[order], first)
    return out


class Labeller:
    """The network. Parameters are plain arrays, so it travels to the tasks as it is."""

    def __init__(self, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        dim = WORD_DIM + PATH_DIM + MEASURES + 1
        f = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        self.p = {"word": f(WORD_SLOTS, WORD_DIM, s=0.001), "path": f(PATH_SLOTS, PATH_DIM, s=0.1), "out": f(2 * HIDDEN, s=0.2), "bias": np.zeros(1, np.float32)}
        for d in "lr":
            self.p |= {"x" + d: f(dim, 4 * HIDDEN, s=dim**-0.5), "h" + d: f(HIDDEN, 4 * HIDDEN, s=HIDDEN**-0.5), "b" + d: np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)}

    def inputs(self, pages: list[dict]) -> np.ndarray:
        """One row of features for each line of the pages."""
        words, at = zip(*((p["words"], p["at"]) for p in pages), strict=True)
        sizes = np.array([len(w) for w in words])
        first = np.concatenate([a + o for a, o in zip(at, np.cumsum(sizes) - sizes, strict=True)])
        ids = np.concatenate(words)
        n = np.diff(np.r_[first, len(ids)])[:, None]
        w = np.add.reduceat(self.p["word"][ids], first) / n
        rows = sum(len(p["measures"]) for p in pages)
        path = np.zeros((rows, PATH_DIM), np.float32)
        has = np.zeros((rows, 1), np.float32)
        line, slot = np.concatenate([np.c_[p["path_line"] + o, p["path_slot"]] for p, o in zip(pages, np.cumsum([0, *(len(p["measures"]) for p in pages[:-1])]), strict=True)]).T.astype(np.int64) if rows else (np.zeros(0, np.int64),) * 2
        if len(line):
            np.add.at(path, line, self.p["path"][slot])
            has[line] = 1
        self.seen = (ids, first, n, line, slot)
        return np.concatenate([w, path, np.concatenate([p["measures"] for p in pages]), has], 1)

    def run(self, x: np.ndarray, sizes: list[int], keep: bool = False) -> np.ndarray:
        """Logits of all lines; sizes are the lines of each page."""
        b, t = len(sizes), max(sizes)
        place = np.concatenate([np.arange(n) for n in sizes])
        page = np.repeat(np.arange(b), sizes)
        back = np.repeat(sizes, sizes) - 1 - place
        self.index = {"l": (place, page), "r": (back, page)}
        self.tape = {}
        out = np.zeros((len(x), 2 * HIDDEN), np.float32)
        for k, d in enumerate("lr"):
            pad = np.zeros((t, b, 4 * HIDDEN), np.float32)
            pad[self.index[d]] = x @ self.p["x" + d] + self.p["b" + d]
            h = c = np.zeros((b, HIDDEN), np.float32)
            hs, tape = np.zeros((t, b, HIDDEN), np.float32), []
            w = self.p["h" + d]
            for s in range(t):
                z = pad[s] + h @ w
                gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN].clip(-30, 30)))
                i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
                g = np.tanh(z[:, 3 * HIDDEN :])
                old, prev = c, h
                c = f * c + i * g
                tc = np.tanh(c)
                h = o * tc
                hs[s] = h
                if keep:
                    tape.append((i, f, o, g, old, tc, prev))
            self.tape[d] = tape
            out[:, k * HIDDEN : (k + 1) * HIDDEN] = hs[self.index[d]]
        self.last = out
        return out @ self.p["out"] + self.p["bias"]

    def gradients(self, x: np.ndarray, sizes: list[int], err: np.ndarray) -> dict[str, np.ndarray]:
        b, t = len(sizes), max(sizes)
        g = {"out": self.last.T @ err, "bias": err.sum(keepdims=True)}
        dh = np.outer(err, self.p["out"])
        dx = np.zeros_like(x)
        for k, d in enumerate("lr"):
            pad = np.zeros((t, b, HIDDEN), np.float32)
            pad[self.index[d]] = dh[:, k * HIDDEN : (k + 1) * HIDDEN]
            w, dw = self.p["h" + d], np.zeros_like(self.p["h" + d])
            dz_all = np.zeros((t, b, 4 * HIDDEN), np.float32)
            nh = nc = np.zeros((b, HIDDEN), np.float32)
            for s in range(t - 1, -1, -1):
                i, f, o, gg, old, tc, prev = self.tape[d][s]
                h = pad[s] + nh
                c = nc + h * o * (1 - tc * tc)
                dz = np.concatenate([c * gg * i * (1 - i), c * old * f * (1 - f), h * tc * o * (1 - o), c * i * (1 - gg * gg)], 1)
                dw += prev.T @ dz
                nh, nc = dz @ w.T, c * f
                dz_all[s] = dz
            dz = dz_all[self.index[d]]
            g["x" + d], g["b" + d], g["h" + d] = x.T @ dz, dz.sum(0), dw
            dx += dz @ self.p["x" + d].T
        ids, first, n, line, slot = self.seen
        g["word"] = added(self.p["word"], ids, (dx[:, :WORD_DIM] / n)[np.repeat(np.arange(len(n)), n[:, 0])])
        g["path"] = added(self.p["path"], slot, dx[line, WORD_DIM : WORD_DIM + PATH_DIM])
        return g

    def fit(self, pages: list[dict], seed: int = 5) -> Labeller:
        """Adam on the logistic loss; lines with label -1 do not count."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(pages))
            for at in range(0, len(order), BATCH):
                batch = [pages[i] for i in order[at : at + BATCH]]
                batch = [(p | {"path_line": p["path_line"][:0], "path_slot": p["path_slot"][:0], "measures": p["measures"] * NO_LINK}) if r.random() < 0.5 else p for p in batch]
                batch = [strange(p, r) if r.random() < STRANGE else p for p in batch]
                y = np.concatenate([p["label"] for p in batch])
                sizes = [len(p["label"]) for p in batch]
                x = self.inputs(batch)
                z = self.run(x, sizes, True)
                err = np.where(y < 0, 0, 1 / (1 + np.exp(-z.clip(-30, 30))) - y).astype(np.float32) / max(1, len(y))
                step += 1
                rate = RATE * (1 - 0.8 * epoch / EPOCHS)
                for k, g in self.gradients(x, sizes, err).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        self.seen = self.tape = self.last = self.index = None
        return self


def strange(page: dict, r: np.random.Generator) -> dict:
    """The page with the words of some lines of its article as words that stand nowhere else.

    Menus and notices use few words that all pages have, so words never seen speak for the article; wrong decoding makes
    such words too.
    """
    size = np.diff(np.r_[page["at"], len(page["words"])])
    some = np.repeat((page["label"] == 0) & (r.random(len(size)) < r.choice([0.3, 1.0])), size)
    return page | {"words": np.where(some, r.integers(0, WORD_SLOTS, len(some)), page["words"]).astype(np.int32)}


NO_LINK = np.r_[np.ones(6), 0, 1].astype(np.float32)


def page_of(text: str, page: str | None, known: dict, label: list[int] | None = None) -> dict | None:
    """The features of a page, or None where it has no lines."""
    numbers, lines, paths, linked = lines_with_paths(text, page)
    if not lines:
        return None
    words, at = word_slots(lines)
    slots = [path_slots(p, known) for p in paths]
    n = [len(s) for s in slots]
    out = {"numbers": numbers, "words": words, "at": at, "measures": measures(lines, linked), "path_line": np.repeat(np.arange(len(lines)), n), "path_slot": np.array([x for s in slots for x in s], np.int64)}
    return out | ({"label": np.array(label, np.float32)} if label is not None else {})


def lessons(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over the sampled (text, html) rows in order -> (name, shape, data) of the fitted parameters."""
    known: dict = {}
    pages = []
    for batch in batches:
        for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if len(pages) < TRAIN_PAGES and (label := taught(t, h)) is not None and (p := page_of(t, h, known, label)):
                pages.append(p)
    if pages:
        net = Labeller().fit(pages)
        yield pa.record_batch({"name": list(net.p), "shape": pa.array([list(x.shape) for x in net.p.values()], pa.list_(pa.int32())), "data": [x.tobytes() for x in net.p.values()]})


def trained(df: DataFrame, text: str = "text", page: str = "content_html") -> DataFrame:
    """(name, shape, data): a labeller fitted on at most TRAIN_PAGES pages that tell their article, the same on every run.

    The pages are drawn by a hash among those that have a text and kept blocks, and fitted in one task; the result is a
    staged table of about a megabyte that can be kept and given to outside_lines. It is empty if no page tells its article.
    """
    rows = df.select(text, page).filter(f"length(`{page}`) > 0 and length(`{text}`) > 0 and length(`{page}`) < {LONGEST_LESSON}")
    share = min(1.0, 4 * TRAIN_PAGES / max(1, rows.count()))
    some = rows.filter(F.pmod(F.xxhash64(text, page), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = some.orderBy(F.xxhash64(text, page)).limit(2 * TRAIN_PAGES)
    return stage(some.coalesce(1).mapInArrow(lessons, "name string, shape array<int>, data binary"), "labeller")


def loaded(fitted: DataFrame) -> Labeller | None:
    """The labeller of a table that `trained` made; None if it is empty."""
    rows = fitted.collect()  # a row per parameter
    if not rows:
        return None
    net = Labeller()
    net.p = {r.name: np.frombuffer(r.data, np.float32).reshape(r.shape) for r in rows}
    return net


def labelled(model, share: float):
    """mapInArrow function: (key, text, html) -> (_id, line_no, outside) of the lines outside the article."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Labeller = model.value
        cut = float(np.log(share / (1 - share)))
        known: dict = {}
        for batch in batches:
            made = ((i, page_of(t, h, known)) for i, (t, h) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)) if t)
            held: list[tuple[int, dict]] = []
            rows, numbers = [], []

            def label() -> None:
                held.sort(key=lambda x: len(x[1]["numbers"]))
                at = 0
                while at < len(held):
                    end = at + 1
                    while end < len(held) and (end + 1 - at) * len(held[end][1]["numbers"]) <= BATCH_LINES // 4:
                        end += 1
                    part = held[at:end]
                    z = net.run(net.inputs([p for _, p in part]), [len(p["numbers"]) for _, p in part])
                    o = 0
                    for i, p in part:
                        hit = np.flatnonzero(z[o : o + len(p["numbers"])] > cut)
                        rows.extend([i] * len(hit))
                        numbers.extend(p["numbers"][k] for k in hit.tolist())
                        o += len(p["numbers"])
                    at = end
                held.clear()

            total = 0
            for i, p in made:
                if p is not None:
                    held.append((i, p))
                    total += len(p["numbers"])
                    if total > BATCH_LINES:
                        label()
                        total = 0
            label()
            net.seen = net.tape = net.last = net.index = None
            yield pa.record_batch({"_id": batch.column(0).take(pa.array(rows, pa.int64())), "line_no": pa.array(numbers, pa.int64())})

    return run


def outside_lines(df: DataFrame, key: str = "doc_id", text: str = "text", page: str = "content_html", share: float = 0.5, fitted: DataFrame | None = None) -> DataFrame:
    """(key, line_no): the non-blank lines of each text that the labeller puts outside the article.

    `fitted` is a labeller that `trained` made; without one it is fitted on df. Lines count from 1, blank ones included.
    Where the page's blocks are null or empty, lines are judged by themselves and their neighbours. Null, empty and blank
    texts have no lines. If no page tells its article, nothing is reported. Rows with equal keys are reported each by
    itself. Other columns are ignored.
    """
    spark = df.sparkSession
    net = loaded(trained(df, text, page) if fitted is None else fitted)
    schema = f"_id {dict(df.dtypes)[key]}, line_no long"
    base = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"), F.col(page).alias("_page"))
    if net is None:
        return spark.createDataFrame([], schema).withColumnRenamed("_id", key)
    return spread(base).mapInArrow(labelled(spark.sparkContext.broadcast(net), share), schema).withColumnRenamed("_id", key)
