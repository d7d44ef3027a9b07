"""Problem 1: text that was decoded with the wrong code page.

A wrong decoding is a substitution cipher: bytes of the true code page were shown as letters of another. Letters and letter
pairs of the whole collection give the language model. Where each byte became one letter, the mapping of a source is learned
by expectation-maximisation against the letter pairs of the other sources (ciphers.py) and applied with translate(). Where
letters took several bytes, no table of letters can undo it; such lines are tried under keys, pairs of public code pages
(true, shown), and expectation-maximisation learns per source how much each key is used. A line is scored by the language
model as it stands and under everything that may undo it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import spread, stage
from . import ciphers
from .codes import MAX_CP, codes_of, text_of

#: Code pages that a text may be shown in by mistake, and that it may truly be in. euc_kr is a part of cp949.
SINGLE = ["cp1252", "mac_roman", "cp1251", "koi8_r", "cp437", "cp1250", "cp850", "cp866", "iso8859_5", "cp874", "cp1253", "cp1254"]
DOUBLE = ["gb18030", "cp950", "cp949", "cp932", "euc_jp", "big5hkscs"]
#: Fixed values: (true, shown) pairs besides UTF-8 shown in each of the pages above.
PAIRS = [
    *(("gb18030", x) for x in ["cp1252", "mac_roman", "cp1251", "cp437", "cp1250", "koi8_r", "cp850", "cp950", "cp949", "cp932", "euc_jp"]),
    *(("cp950", x) for x in ["cp1252", "gb18030", "cp949", "cp932"]),
    *(("cp932", x) for x in ["cp1252", "mac_roman", "gb18030", "cp950", "cp949", "cp1251", "cp437"]),
    *(("euc_jp", x) for x in ["cp1252", "mac_roman", "gb18030", "cp950", "cp949", "cp932"]),
    *(("cp949", x) for x in ["cp1252", "gb18030", "cp950", "cp932"]),
    *(("cp1251", x) for x in ["cp1252", "koi8_r", "cp866", "iso8859_5", "mac_roman", "cp437", "gb18030"]),
    *(("koi8_r", x) for x in ["cp1251", "cp1252", "cp866", "iso8859_5", "mac_roman", "gb18030"]),
    *(("cp866", x) for x in ["cp1251", "cp1252", "koi8_r", "mac_roman"]),
    *(("iso8859_5", x) for x in ["cp1251", "cp1252", "koi8_r"]),
    *(("cp1252", x) for x in ["cp437", "mac_roman", "cp850", "cp1250", "cp1251", "koi8_r", "gb18030", "cp932", "cp949", "cp950", "cp866"]),
    *(("mac_roman", x) for x in ["cp1252", "cp1250", "cp437"]),
    *(("cp437", x) for x in ["cp1252", "mac_roman"]),
    *(("cp850", x) for x in ["cp1252", "mac_roman"]),
    *(("cp874", x) for x in ["cp1252", "mac_roman", "gb18030", "cp1251"]),
]
KEYS = [*(("utf-8", x) for x in [*SINGLE, *DOUBLE]), *PAIRS]
LOST, LEARNED = len(KEYS), len(KEYS) + 1
PAGES = [*SINGLE, *DOUBLE]
BY_SHOWN = {page: [(k, true) for k, (true, shown) in enumerate(KEYS) if shown == page] for page in PAGES}
PAIR_BITS = 19
#: A letter at or below this probability is none of the collection, whatever its pairs.
LEAST = np.float32(1e-8)
#: A line counts from this gain (in nats) on, a field from this sum of the gains of its lines on, or from SURE nats above
#: what its source has learned about the key.
LINE_GAIN, FIELD_GAIN, SURE = 4.0, 9.0, 3.0
CYRILLIC = ("cp866", "cp1251")
#: Nats for a line that is valid UTF-8 by its bytes, which chance hardly makes.
VALID_GAIN = 5.0
#: Nats that a run of Cyrillic letters alone must gain more, as Russian words in cp866 hold valid UTF-8 by chance.
CHANCE = 8.0
UTF8 = rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3})"
RUNS = {1: re.compile(UTF8 + rb"+"), 3: re.compile(UTF8 + rb"{3,}")}
#: Signs that stand in clean text of every script; a piece of nothing else and ASCII has no letter to judge by.
SIGNS = "\u00a0©«\u00ad®°±·»×" + "".join(map(chr, [*range(0x2000, 0x200E), *range(0x2010, 0x2028), 0x202F, 0x2030, 0x2032, 0x2033, 0x205F, 0x2060, 0xFEFF]))
WORD = re.compile("[А-Яа-яЁё]+")
OPENING, CLOSING = "“\"‘「『'（([《", "”\"’」』'）)]》"
GARBAGE = "锟斤拷"


@lru_cache(maxsize=None)
def single_table(page: str) -> str:
    """The 256 characters of a single-byte page; a byte without one stands for its own control code."""
    return "".join((bytes([b]).decode(page, "ignore") or chr(b)) for b in range(256))


@lru_cache(maxsize=None)
def page_bytes(page: str) -> tuple[np.ndarray, np.ndarray | None]:
    """Which code points a page has, and for a single-byte page the byte of each."""
    has, byte = np.zeros(MAX_CP, bool), None
    if page in SINGLE:
        byte = np.zeros(MAX_CP, np.uint8)
        table = {c: b for b, c in reversed(list(enumerate(single_table(page))))}
        if page == "cp1252":  # also as plain ISO 8859-1
            table |= {chr(b): b for b in range(0x80, 0xA0)} | {c: b for b, c in enumerate(single_table(page))}
        for c, b in table.items():
            has[ord(c)], byte[ord(c)] = True, b
    else:
        every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
        has[codes_of(every.encode(page, "ignore").decode(page, "ignore"))] = True
    return has, byte


@lru_cache(maxsize=None)
def holders() -> np.ndarray:
    """Of each code point, a bit per page of PAGES that has it; none has the line end."""
    bits = np.zeros(MAX_CP, np.uint32)
    for i, page in enumerate(PAGES):
        bits[page_bytes(page)[0]] |= np.uint32(1 << i)
    bits[10] = 0
    return bits


@lru_cache(maxsize=None)
def letter_like() -> np.ndarray:
    odd = np.arange(MAX_CP) > 0x7F
    odd[codes_of(SIGNS)] = False
    return odd


def odd_parts(codes: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(page, starts, ends) of the longest pieces of the lines that the page has and that are not all ASCII and SIGNS."""
    held, odd = holders()[codes], np.r_[0, np.cumsum(letter_like()[codes])]
    for i, page in enumerate(PAGES):
        step = np.flatnonzero(np.diff(np.r_[False, held & np.uint32(1 << i) != 0, False]))
        start, end = step[::2], step[1::2]
        use = odd[end] > odd[start]
        if use.any():
            yield page, start[use], end[use]


def shown_text(raw: bytes, page: str) -> str:
    return "".join(map(single_table(page).__getitem__, raw)) if page in SINGLE else raw.decode(page, "replace")


def undone(raw: bytes, true: str, shown: str) -> str | None:
    """The bytes read in the true page, or None where that changes nothing or is impossible."""
    if true == "utf-8":
        run = RUNS[1 if shown in SINGLE and shown not in CYRILLIC else 3]  # Russian words are valid UTF-8 too often
        if not run.search(raw):
            return None
        out, at = [], 0
        for m in run.finditer(raw):
            out += [shown_text(raw[at : m.start()], shown), m.group().decode("utf-8", "replace")]
            at = m.end()
        return "".join(out) + shown_text(raw[at:], shown)
    if true in SINGLE:
        return "".join(map(single_table(true).__getitem__, raw))
    text = raw.decode(true, "replace")
    return text if text.count("�") * 8 <= len(text) else None


class Language:
    """Log probabilities of letters and letter pairs of the collection."""

    def __init__(self, letters: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray) -> None:
        self.letters, self.counts, self.pairs, self.pair_counts = letters, counts, pairs, pair_counts
        self.ready = False

    def prepare(self) -> Language:
        if not self.ready:
            total = float(self.counts.sum()) or 1.0
            self.single = np.full(MAX_CP, 0.02 / total)
            self.single[self.letters] = (self.counts + 0.02) / total
            self.single[0xFFFD] = 1e-9
            self.joint = np.zeros(1 << PAIR_BITS, np.float32)  # half the size: the tables are read at random
            self.joint[self.pairs] = 0.9 * self.pair_counts / total
            self.half = (0.5 * np.log(self.single)).astype(np.float32)
            self.single = self.single.astype(np.float32)
            self.ready = True
        return self

    def pairs_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Half the joint log probability of each letter of a with that of b.

        A pair is never more probable than its rarer letter, whatever else shares its slot.
        """
        p, q = self.single[a], self.single[b]
        joint = np.minimum(self.joint[pair_slot(a, b)], np.minimum(p, q))
        joint[p <= LEAST] = 0
        joint += np.float32(0.1) * p * q
        return np.float32(0.5) * np.log(joint)

    def pair_scores(self, c: np.ndarray) -> np.ndarray:
        """The pairs of each letter with the next one."""
        c = c.astype(np.uint64)
        return self.pairs_of(c[:-1], c[1:])

    def between(self, c: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The score of each piece of c between a left and a right neighbour, or more, where it stays below `least` anyway.

        A pair is never more probable than its rarer letter, which is the bound that most keys fail.
        """
        half = self.half[c]
        sums = np.r_[0.0, np.cumsum(np.minimum(half, np.r_[half[1:], np.float32(0)]), dtype=np.float64)]
        some = np.flatnonzero(end > start)
        a, b = start[some], end[some]
        bound = np.full(len(start), -np.inf)
        bound[some] = sums[b - 1] - sums[a] + half[a] + half[b - 1]
        use = np.flatnonzero(bound > least)
        size = end[use] - start[use]
        if 2 * int(size.sum()) < len(c):  # only the pieces that are left
            at = np.cumsum(size) - size
            c = c[np.arange(int(size.sum())) + np.repeat(start[use] - at, size)]
            bound[use] = self._between(c, at, at + size, left[use], right[use])
        else:
            bound[use] = self._between(c, start[use], end[use], left[use], right[use])
        return bound

    def _between(self, c: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        total = np.r_[0.0, np.cumsum(self.pair_scores(np.r_[c, 10]), dtype=np.float64)]
        out = np.zeros(len(start))
        some = end > start
        a, b = start[some], end[some]
        out[some] = total[b - 1] - total[a] + self.pairs_of(left[some], c[a]) + self.pairs_of(c[b - 1], right[some])
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """Of each text, the sum of the pair scores from its first to its last letter."""
        if not texts:
            return np.zeros(0)
        score = self.pair_scores(codes_of("".join(texts) + "\n"))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        end = np.cumsum(size)
        total = np.r_[0.0, np.cumsum(score, dtype=np.float64)]
        return total[end - 1] - total[end - size]


def pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a.astype(np.uint64, copy=False) * np.uint64(0x9E3779B97F4A7C15)
    h += b.astype(np.uint64, copy=False) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h >>= np.uint64(64 - PAIR_BITS)
    return h.view(np.int64)


def letter_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(title, text) rows -> (kind, slot, n): letters (kind 0) and hashed letter pairs (kind 1) of this task."""
    single, joint = np.zeros(MAX_CP, np.int64), np.zeros(1 << PAIR_BITS, np.int64)
    for batch in batches:
        texts = [x for c in batch.columns for x in c.to_pylist() if x]
        for at in range(0, len(texts), 1000):
            c = codes_of("\n" + "\n".join(texts[at : at + 1000]) + "\n").astype(np.int64)
            single += np.bincount(c, minlength=MAX_CP)
            joint += np.bincount(pair_slot(c[:-1], c[1:]), minlength=1 << PAIR_BITS)
    for kind, x in enumerate((single, joint)):
        some = np.flatnonzero(x)
        yield pa.record_batch({"kind": np.full(len(some), kind, np.int32), "slot": some.astype(np.int64), "n": x[some]})


def language(df: DataFrame, title: str, text: str, wrong: pd.DataFrame | None = None) -> Language:
    """The language model of all rows. What comes to the driver is bounded by the number of code points and slots.

    wrong has pairs of signs (a, b, n; 0 for none) known to be wrong, which are taken out of it.
    """
    counts = df.select(title, text).mapInArrow(letter_counts, "kind int, slot long, n long").groupBy("kind", "slot").agg(F.sum("n").alias("n")).toPandas()
    if wrong is not None and len(wrong):
        a, b, n = wrong.a.to_numpy(np.int64), wrong.b.to_numpy(np.int64), wrong.n.to_numpy(np.float64)
        both = (a > 0) & (b > 0)
        counts["n"] = counts.n.astype(np.float64)
        for kind, slot, less in ((0, a[a > 0], n[a > 0]), (1, pair_slot(a[both], b[both]), n[both])):
            at = counts.kind == kind
            less = pd.Series(less).groupby(slot).sum()
            counts.loc[at, "n"] = (counts.n[at] - counts.slot[at].map(less).fillna(0)).clip(lower=0)
    one, two = counts[counts.kind == 0], counts[counts.kind == 1]
    return Language(one.slot.to_numpy(), one.n.to_numpy(np.float64), two.slot.to_numpy(), two.n.to_numpy(np.float64))


def quoted(line: str, fixed: str) -> bool:
    """Whether all that differs is a short piece inside quotes or brackets: an example, not a fault."""
    a = 0
    while a < min(len(line), len(fixed)) and line[a] == fixed[a]:
        a += 1
    b = 0
    while b < min(len(line), len(fixed)) - a and line[-1 - b] == fixed[-1 - b]:
        b += 1
    piece = line[a : len(line) - b]
    return 0 < a and 0 < b and len(piece) <= 16 and line[a - 1] in OPENING and line[len(line) - b] in CLOSING


LOST_SIGNS = re.compile(f"(?:�|{GARBAGE}|[{GARBAGE}](?=[�{GARBAGE}])|(?<=[�{GARBAGE}])[{GARBAGE}])+")


Found = tuple[int, int, int, str, float]
Try = tuple[int, int, int, int, str]


class Pieces:
    """The pieces of some lines that a page has, as code points and as the bytes of the page, each ended by a line end."""

    def __init__(self, page: str, codes: np.ndarray, start: np.ndarray, end: np.ndarray, line: np.ndarray, total: np.ndarray, lm: Language) -> None:
        """total has the sums of the pair scores of codes: total[i] of all pairs before the letter i; line, the line of each piece."""
        self.line = line
        self.page, self.from_, self.total, self.lm = page, start, total, lm
        size = end - start + 1
        self.end = np.cumsum(size) - 1
        self.start = self.end - size + 1
        self.at = np.arange(int(size.sum())) + np.repeat(start - self.start, size)  # places in codes
        self.codes = codes[self.at]
        self.codes[self.end] = 10
        byte = page_bytes(page)[1]
        self.raw = text_of(self.codes).encode(page) if byte is None else byte[self.codes].tobytes()
        self.old = total[end] - total[start - 1]  # with the neighbours in the line
        self.left, self.right, self.shown = codes[start - 1], codes[end], codes

    @staticmethod
    def enough(gain: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Which tries may gain at all, in lines that may gain LINE_GAIN together."""
        gain = np.maximum(gain, 0.0)
        return (gain > 0) & (np.bincount(line, gain)[line] >= LINE_GAIN) if len(line) else gain > 0

    def whole(self) -> Iterator[Try]:
        """Tries of whole pieces in the one- and two-byte pages that may have been shown as this one."""
        return (t for k, true in BY_SHOWN[self.page] if true != "utf-8" for t in self.whole_in(k, true))

    def whole_in(self, k: int, true: str) -> Iterator[Try]:
        n = len(self.end)
        codes = codes_of(single_table(true))[np.frombuffer(self.raw, np.uint8)] if true in SINGLE else codes_of(self.raw.decode(true, "replace"))
        end = np.flatnonzero(codes == 10)
        if len(end) != n:  # a broken letter took a line end with it
            for j, x in enumerate(self.raw.split(b"\n")[:n]):
                text = x.decode(true, "replace")
                if text.count("�") * 8 <= len(text):
                    yield k, j, int(self.start[j]), int(self.end[j]), text
            return
        start = np.r_[0, end[:-1] + 1]
        bad = np.r_[0, np.cumsum(codes == 0xFFFD)]
        fits = ((bad[end] - bad[start]) * 8 <= end - start) & (end > start)
        fits &= self.enough(np.where(fits, self.lm.between(codes, start, end, self.left, self.right, self.old) - self.old, 0.0), self.line)
        for j in np.flatnonzero(fits).tolist():
            yield k, j, int(self.start[j]), int(self.end[j]), text_of(codes[start[j] : end[j]])

    def utf8(self) -> Iterator[Try]:
        """Tries of UTF-8: all runs of a piece together, and where letters make such runs by chance, each run by itself."""
        k = KEYS.index(("utf-8", self.page))
        byte = np.frombuffer(self.raw, np.uint8)
        begin, after, letters, code = utf8_runs(byte)
        if not len(begin):
            return
        double = self.page in DOUBLE
        chancy = double or self.page in CYRILLIC
        long = letters >= (3 if chancy else 1)
        if chancy:
            first = np.r_[0, np.cumsum(byte_lengths(self.page)[self.codes].astype(np.int64))] if double else np.arange(len(byte) + 1)
            if first[-1] != len(byte):
                return
            a = np.searchsorted(first, begin)
            b = np.searchsorted(first, after)  # the last byte may be shown together with the letter after it
            stop = np.cumsum(letters)
            old = self.total[self.at[b - 1] + 1] - self.total[self.at[a] - 1]
            new = self.lm.between(code, stop - letters, stop, self.shown[self.at[a] - 1], self.shown[self.at[b - 1] + 1], old)
            starts, ends_ = first[a] == begin, first[b] == after
            if double:  # runs of whole letters are tried by themselves; others can only gain with the rest of their piece
                long &= ~(starts & ends_) & (new > old)
        ends = np.flatnonzero(byte == 10)
        pieces = np.unique(np.searchsorted(ends, begin[long]))
        for j in pieces.tolist():
            text = undone(self.raw[ends[j - 1] + 1 if j else 0 : ends[j]], "utf-8", self.page)
            if text is not None:
                yield k, j, int(self.start[j]), int(self.end[j]), text
        if not chancy:
            return
        gain = np.where(starts, np.where(ends_, new, 0.0) - old, 0.0)  # not known without the letter that shares a byte
        own = self.line[np.searchsorted(self.end, a)]
        for i in np.flatnonzero(self.enough(gain, own) | ((gain > 0) & np.isin(own, self.line[pieces]))).tolist():
            x, y = int(begin[i]), int(after[i])
            text = self.raw[x:y].decode("utf-8", "replace") + shown_text(self.raw[y : first[b[i]]], self.page)
            yield k, int(np.searchsorted(self.end, a[i])), int(a[i]), int(b[i]), text


@lru_cache(maxsize=None)
def byte_lengths(page: str) -> np.ndarray:
    """Bytes of every code point that a two-byte page has."""
    size = np.ones(MAX_CP, np.int8)
    for c in np.flatnonzero(page_bytes(page)[0]).tolist():
        if c > 0x7F:
            size[c] = len(chr(c).encode(page, "ignore")) or 1
    return size


def utf8_runs(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and number of letters of the longest runs of valid UTF-8 beyond ASCII, and the code points of all letters."""
    x = np.r_[byte, np.zeros(3, np.uint8)].astype(np.int32)
    n = len(byte)
    b0, b1, b2, b3 = (x[i : i + n] for i in range(4))
    more = [(b & 0xC0) == 0x80 for b in (b1, b2, b3)]
    two = (b0 >= 0xC2) & (b0 <= 0xDF) & more[0]
    three = (b0 >= 0xE0) & (b0 <= 0xEF) & more[0] & more[1] & ((b0 > 0xE0) | (b1 >= 0xA0))
    four = (b0 >= 0xF0) & (b0 <= 0xF4) & more[0] & more[1] & more[2] & ((b0 > 0xF0) | (b1 >= 0x90))
    at = np.flatnonzero(two | three | four)
    size = np.where(two[at], 2, np.where(three[at], 3, 4))
    b0, b1, b2, b3 = b0[at], b1[at] & 0x3F, b2[at] & 0x3F, b3[at] & 0x3F
    code = np.where(size == 2, (b0 & 0x1F) << 6 | b1, np.where(size == 3, (b0 & 0xF) << 12 | b1 << 6 | b2, np.minimum((b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3, MAX_CP - 1)))
    first = np.flatnonzero(np.r_[True, at[1:] != (at + size)[:-1]]) if len(at) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(at)] - 1 if len(at) else first
    return at[first], (at + size)[last], last - first + 1, code


def explained_pieces(pieces: Pieces, codes: np.ndarray, lm: Language) -> Iterator[Found]:
    """(key, start, end, text, gain) of what reads better under a key of the page, by places in codes."""
    tries = [*pieces.whole(), *pieces.utf8()]
    if not tries:
        return
    page = pieces.page
    where = [(int(pieces.at[a]), int(pieces.at[a]) + b - a) for _, _, a, b, _ in tries]
    was = [text_of(codes[a - 1 : b + 1]) for a, b in where]
    tries = [(t, a, b, w) for t, (a, b), w in zip(tries, where, was, strict=True) if t[4] != w[1:-1]]
    gain = lm.scores([w[0] + t[4] + w[-1] for t, _, _, w in tries]) - lm.scores([w for _, _, _, w in tries])
    runs: dict[tuple[int, int], list[tuple[float, int, int, str]]] = {}
    for g, ((k, j, _, _, text), a, b, w) in zip(gain.tolist(), tries, strict=True):
        if page in CYRILLIC and b - a < 9 and WORD.fullmatch(w[1:-1]):
            g -= CHANCE
        if g > 0:
            runs.setdefault((j, k), []).append((g, a, b, text))
    for (j, k), found in runs.items():
        a = int(pieces.from_[j])
        b = a + int(pieces.end[j] - pieces.start[j])
        whole = max(((g, t) for g, x, y, t in found if (x, y) == (a, b)), default=(0.0, ""))
        parts = sorted((x, y, t, g) for g, x, y, t in found if (x, y) != (a, b))
        if sum(p[3] for p in parts) > whole[0]:
            yield from ((k, x, y, t, g) for x, y, t, g in parts)
        else:
            yield k, a, b, whole[1], whole[0]


def explained(lines: list[str], lm: Language, twice: bool = True) -> list[list[tuple[int, float, str, bool]]]:
    """Of each line, (key, gain, restored line, whether it is but a quoted piece) of every key that explains it better."""
    out: list[list[tuple[int, float, str, bool]]] = [[] for _ in lines]
    codes = codes_of("\n" + "\n".join(lines) + "\n")
    first = np.r_[1, 1 + np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)]
    total = np.r_[0.0, np.cumsum(lm.pair_scores(codes), dtype=np.float64)]
    by: dict[tuple[int, int], list[Found]] = {}
    for page, start, end in odd_parts(codes):
        line = np.searchsorted(first, start, "right") - 1
        for k, a, b, text, gain in explained_pieces(Pieces(page, codes, start, end, line, total, lm), codes, lm):
            i = int(np.searchsorted(first, a, "right")) - 1
            by.setdefault((i, k), []).append((k, a - int(first[i]), b - int(first[i]), text, gain))
    for (i, k), found in by.items():
        total = float(sum(x[4] for x in found))
        true, shown = KEYS[k]
        if true == "utf-8" and shown in SINGLE and shown not in CYRILLIC:
            total += VALID_GAIN
        if total < LINE_GAIN:
            continue
        line, fixed, at = lines[i], [], 0
        for _, a, b, new, _ in sorted(found, key=lambda x: x[1]):
            fixed += [line[at:a], new]
            at = b
        fixed = "".join(fixed) + line[at:]
        out[i].append((k, total, fixed, quoted(line, fixed)))
    for x in out:
        x.sort(key=lambda y: -y[1])
    if twice:
        again = [i for i, x in enumerate(out) if x]
        for i, more in zip(again, explained([out[i][0][2] for i in again], lm, False) if again else [], strict=True):
            if more and more[0][0] != LOST:
                k, gain, _, q = out[i][0]
                out[i][0] = (k, gain + more[0][1], more[0][2], q)
    for i, line in enumerate(lines):
        if "�" in line or GARBAGE in line:
            out[i].append((LOST, 30.0, line, quoted(line, LOST_SIGNS.sub("", line))))
    return out


def deciphered(old: str, new: str, lm: Language) -> list[tuple[int, int, float, str, bool]]:
    """(line_no, key, gain, line, quoted) of the lines that read better in the learned letters."""
    pairs = [(n, a, b) for n, (a, b) in enumerate(zip(old.split("\n"), new.split("\n"), strict=True), 1) if a != b]
    gain = lm.scores([f"\n{b}\n" for _, _, b in pairs]) - lm.scores([f"\n{a}\n" for _, a, _ in pairs])
    return [(n, LEARNED, g, b, quoted(a, b)) for (n, a, b), g in zip(pairs, gain.tolist(), strict=True) if g >= LINE_GAIN]


def suspects(lm):
    """mapInArrow function: (key, source, title, text, new title, new text) -> (_id, source, field, line_no, key, gain, fixed, quoted).

    The new ones are title and text in the letters learned for the source, null where none were.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lm.value.prepare()
        known: dict[str, list[tuple[int, float, str, bool]]] = {}
        for batch in batches:
            where: list[tuple[int, str, int, str]] = []
            for field in ("title", "text"):
                for i, text in enumerate(batch.column(batch.schema.get_field_index(f"_{field}")).to_pylist()):
                    if text and not text.isascii():
                        where += [(i, field, n, line) for n, line in enumerate(text.split("\n"), 1) if not line.isascii()]
            if len(known) > 200_000:
                known.clear()
            new = list(dict.fromkeys(x[3] for x in where if x[3] not in known))
            for at in range(0, len(new), 4000):
                known |= zip(new[at : at + 4000], explained(new[at : at + 4000], model), strict=True)
            rows = [(i, field, n, *found) for i, field, n, line in where for found in known[line]]
            for field in ("title", "text"):
                old, new = (batch.column(batch.schema.get_field_index(f"_{x}{field}")).to_pylist() for x in ("", "new_"))
                rows += ((i, field, *found) for i, (a, b) in enumerate(zip(old, new, strict=True)) if b is not None and a != b for found in deciphered(a, b, model))
            if rows:
                i, field, n, k, g, f, q = zip(*rows, strict=True)
                pick = pa.array(i, pa.int64())
                yield pa.record_batch(
                    {"_id": batch.column(0).take(pick), "source": batch.column(1).take(pick), "field": pa.array(field, pa.string()), "line_no": pa.array(n, pa.int64()), "key": pa.array(k, pa.int32()), "gain": pa.array(g, pa.float64()), "fixed": pa.array(f, pa.string()), "quoted": pa.array(q, pa.bool_())}
                )

    return run


def learned_shares(pooled: DataFrame, fields: DataFrame, rounds: int) -> DataFrame:
    """(of, k, weight): how much more often than clean a field of the source `of` is wrong by key k, as a log.

    Expectation: the part of each key in each field, clean (with gain 0) being one of them. Maximisation: the share of each
    key in the fields of the source. pooled has (field.., source, key, gain), fields (o, all).
    """
    own = Window.partitionBy("_id", "field", "source")
    share = None
    for _ in range(rounds):
        seen = pooled.withColumn("weight", F.lit(-FIELD_GAIN)) if share is None else pooled.join(share, pooled.source.eqNullSafe(share.of) & (pooled.key == share.k)).drop("of", "k")
        log = F.col("gain") + F.col("weight")
        top = F.greatest(F.max(log).over(own), F.lit(0.0))
        seen = seen.withColumn("part", F.exp(log - top)).withColumn("part", F.col("part") / (F.sum("part").over(own) + F.exp(-top)))
        used = seen.groupBy(F.col("source").alias("of"), F.col("key").alias("k")).agg(F.sum("part").alias("n"))
        per = used.groupBy(F.col("of").alias("w")).agg(F.sum("n").alias("wrong"))
        used = used.join(per, used.of.eqNullSafe(per.w)).join(fields, F.col("of").eqNullSafe(F.col("o")))
        share = stage(used.select("of", "k", F.log((F.col("n") + 0.01) / (F.greatest(F.col("all") - F.col("wrong"), F.lit(0.0)) + 1)).alias("weight")), "shares")
    return share


def wrong_lines(df: DataFrame, key: str = "doc_id", title: str = "title", text: str = "text", source: str = "source", rounds: int = 2) -> DataFrame:
    """(key, field, line_no, true_page, shown_page, gain, fixed): lines decoded wrongly, with the line restored.

    true_page is null where the bytes are lost (replacement characters); the line then stays as it is. It is `learned` where
    the letters were learned from the source itself. A field is wrong if
    its lines gain at least FIELD_GAIN under one key together, or less where the key is frequent in its source. A short
    piece inside quotes is an example: it proves nothing by itself, but is restored where the rest of its field is wrong by
    the same key. Null and empty texts have no such lines; rows of a null source share one source. Keys of rows are taken as
    unique.
    """
    spark = df.sparkSession
    base = spread(df.select(F.col(key).alias("_id"), F.col(source).alias("source"), F.col(title).alias("_title"), F.col(text).alias("_text")))
    letters = stage(ciphers.learned(base, "source", "_title", "_text"), "letters")
    wrong = letters.groupBy("a", "b").agg(F.sum("n").alias("n")).toPandas()  # bounded by the alphabets
    lm = spark.sparkContext.broadcast(language(base, "_title", "_text", wrong))
    if len(wrong):
        own = letters.filter("shown is not null").select(F.col("source").alias("_of"), "shown", "letters")
        base = base.join(own, base.source.eqNullSafe(F.col("_of")), "left")
        new = {c: F.expr(f"translate({c}, shown, letters)") for c in ("_title", "_text")}
    else:
        new = dict.fromkeys(("_title", "_text"), F.lit(None).cast("string"))
    base = base.select("_id", "source", "_title", "_text", new["_title"].alias("_new_title"), new["_text"].alias("_new_text"))
    schema = f"_id {dict(df.dtypes)[key]}, source string, field string, line_no long, key int, gain double, fixed string, quoted boolean"
    lines = stage(base.mapInArrow(suspects(lm), schema), "suspects")

    field = ["_id", "field", "source"]
    pooled = stage(lines.filter("not quoted").groupBy(*field, "key").agg(F.sum("gain").alias("gain")), "evidence")
    fields = base.groupBy(F.col("source").alias("o")).agg((2 * F.count(F.lit(1))).alias("all"))
    share = learned_shares(pooled, fields, rounds)
    pooled = pooled.join(share, pooled.source.eqNullSafe(share.of) & (pooled.key == share.k))
    keep = pooled.filter((F.col("gain") >= FIELD_GAIN) | (F.col("gain") + F.least("weight", F.lit(0.0)) >= SURE)).select(*field, "key", "weight")
    kept = keep.select(F.col("_id").alias("_i"), F.col("field").alias("_f"), F.col("key").alias("_k"), "weight")
    lines = lines.join(kept, (F.col("_id") == F.col("_i")) & (F.col("field") == F.col("_f")) & (F.col("key") == F.col("_k")))
    best = F.max_by(F.struct("key", "gain", "fixed"), F.struct(F.col("key") != LOST, F.col("gain") + F.col("weight")))
    out = lines.groupBy("_id", "field", "line_no").agg(best.alias("x"))
    pages = F.create_map(*[F.lit(v) for k, p in enumerate(KEYS) for v in (k, ":".join(p))], F.lit(LEARNED), F.lit("learned:learned"))
    pair = F.split(pages[F.col("x.key")], ":")
    return out.select(F.col("_id").alias(key), "field", "line_no", pair[0].alias("true_page"), pair[1].alias("shown_page"), F.round("x.gain", 3).alias("gain"), F.col("x.fixed").alias("fixed"))


def restored(df: DataFrame, wrong: DataFrame, key: str = "doc_id", title: str = "title", text: str = "text") -> DataFrame:
    """(key, field, fixed): the whole fields that hold wrong lines, with those lines restored where possible."""
    fixes = wrong.groupBy(F.col(key).alias("_id"), "field").agg(F.map_from_entries(F.collect_list(F.struct("line_no", "fixed"))).alias("_fixes"))
    whole = df.select(F.col(key).alias("_key"), F.col(title).alias("_title"), F.col(text).alias("_text"))
    out = fixes.join(whole, F.col("_id") == F.col("_key")).withColumn("_of", F.when(F.col("field") == "title", F.col("_title")).otherwise(F.col("_text")))
    new = F.expr("array_join(transform(split(_of, '\n', -1), (x, i) -> coalesce(_fixes[cast(i + 1 as bigint)], x)), '\n')")
    return out.select(F.col("_id").alias(key), "field", new.alias("fixed"))
