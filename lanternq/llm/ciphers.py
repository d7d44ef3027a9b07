"""Unknown one-byte code pages as substitution ciphers, learned per source by expectation-maximisation.

A source's pairs of signs that the other sources do not hold are taken as a cipher: hidden letters of one alphabet follow
the letter pairs of the other sources, and each shows as a sign with a probability that is learned. Public pages are not
looked at. A mapping is kept only if the decoded pairs read about as well as clean text does. What cannot be learned so:
a part of a source whose signs are the letters that the clean rest of it uses, alphabets that no other source has, and Latin,
whose letters beyond ASCII stand too far apart for pairs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import MAX_CP, codes_of

#: Signs of one-byte pages stand below this code point; every other sign is a boundary (0) of a word here.
HIGHEST = 0x3000
#: Signs of a source that may be ciphers (a page has 128 beyond ASCII), pairs of them that it must hold before anything is
#: learned, the least part of a sign's uses that must be wrong, and letters that make an alphabet.
SIGNS, LEAST_PAIRS, LEAST_SHARE, LEAST_LETTERS = 128, 300, 0.02, 20
#: A cipher's signs stand beside each other nearly as often as letters do, and nearly each frequent sign is another letter.
SAME_WORDS, ONE_TO_ONE = 0.7, 0.7
#: Uses of a sign below which its letter stays unknown.
LEAST_USES = 10
#: Pairs that a task holds before it hands its counts on.
HELD_PAIRS = 2_000_000
#: Rounds of expectation-maximisation, and starts of it.
ROUNDS, STARTS = 60, 8
#: Nats a pair that decoded text may read worse than clean text, after all starts and after the first short one.
SLACK, FIRST_SLACK = 0.5, 1.3


@lru_cache(maxsize=None)
def alphabet(c: int) -> str:
    """The alphabet of a letter, by its name; empty for signs that are no letters, and for Latin."""
    name = unicodedata.name(chr(c), "").split(" ")[0] if unicodedata.category(chr(c))[0] in "LM" else ""
    return "" if name in ("LATIN", "COMBINING", "MODIFIER", "FEMININE", "MASCULINE", "MICRO") else name


@lru_cache(maxsize=1)
def sign_of() -> np.ndarray:
    """Every code point as a sign: itself, or 0 for what no cipher holds (ASCII, blanks, everything above)."""
    out = np.zeros(MAX_CP, np.int32)
    for c in range(0x80, HIGHEST):
        if unicodedata.category(chr(c))[0] in "LMNPS" and not 0x2000 <= c < 0x2070:
            out[c] = c
    return out


def pair_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, title, text) rows -> (source, a, b, n): neighbouring signs of this task, at least one of them no boundary."""
    held: dict[str | None, np.ndarray] = {}
    counts: dict[str | None, np.ndarray] = {}

    def add(source: str | None, texts: list[str]) -> None:
        c = sign_of()[codes_of("\n" + "\n".join(texts) + "\n")].astype(np.int64)
        key = (c[:-1] << 32) | c[1:]
        key, n = np.unique(key[key > 0], return_counts=True)
        if source in held:
            key, back = np.unique(np.r_[held[source], key], return_inverse=True)
            n = np.bincount(back, np.r_[counts[source], n]).astype(np.int64)
        held[source], counts[source] = key, n

    def handed_on() -> Iterator[pa.RecordBatch]:
        for s, key in held.items():
            yield pa.record_batch({"source": pa.array([s] * len(key), pa.string()), "a": (key >> 32).astype(np.int32), "b": (key & 0xFFFFFFFF).astype(np.int32), "n": counts[s].astype(np.int64)})
        held.clear()
        counts.clear()

    for batch in batches:
        by: dict[str | None, list[str]] = {}
        for s, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = by.setdefault(s, [])
            own += [x for x in (a, b) if x and not x.isascii()]
        for s, texts in by.items():
            if texts:
                add(s, texts)
        if sum(map(len, held.values())) > HELD_PAIRS:
            yield from handed_on()
    yield from handed_on()


def square(a: np.ndarray, b: np.ndarray, n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Counts as a matrix over the sorted signs `of`, whose first is the boundary; other signs count as boundaries."""
    at = lambda x: np.where(of[np.searchsorted(of, x).clip(max=len(of) - 1)] == x, np.searchsorted(of, x), 0)
    out = np.zeros((len(of), len(of)))
    np.add.at(out, (at(a), at(b)), n)
    out[0, 0] = 0
    return out


def frequent(a: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """0 and the most frequent signs, sorted."""
    signs, back = np.unique(a, return_inverse=True)
    total = np.bincount(back, n)
    use = signs > 0
    signs, total = signs[use], total[use]
    return np.sort(np.r_[0, signs[np.argsort(-total, kind="stable")[:most]]])


def decipher(seen: np.ndarray, language: np.ndarray, starts: int = STARTS, rounds: int = ROUNDS, seed: int = 11) -> tuple[np.ndarray, float]:
    """The letter of every sign, and the mean log probability of the decoded pairs.

    seen are pair counts of signs, language joint probabilities of letters, both with the boundary first, which stands for
    itself. Expectation-maximisation learns P(sign | letter) from several starts, then single signs and swaps are improved.
    """
    k, v = len(language), len(seen)
    r = np.random.default_rng(seed)
    letters, signs = language.sum(1) + language.sum(0), seen.sum(1) + seen.sum(0)
    rank = lambda x: np.argsort(np.argsort(-x[1:])) / 8.0
    near = np.exp(-np.abs(rank(letters)[:, None] - rank(signs)[None, :]))
    best: tuple[float, np.ndarray] | None = None
    log = np.log(language + 1e-9)
    for start in range(starts):
        e = np.zeros((k, v))
        e[0, 0] = 1.0
        e[1:, 1:] = near * r.random(near.shape) ** (1 + start % 3) + 1e-6
        e[1:, 1:] /= e[1:, 1:].sum(1, keepdims=True)
        for _ in range(rounds):
            shown = e.T @ language @ e
            ratio = seen / np.maximum(shown, 1e-300)
            e = e * (language @ e @ ratio.T + language.T @ e @ ratio)
            e[0, 1:] = e[1:, 0] = 0.0
            e /= np.maximum(e.sum(1, keepdims=True), 1e-300)
            e[0, 0] = 1.0
        of = np.argmax(letters[:, None] * e, axis=0)
        of[0] = 0
        of, score = improved(of, seen, log)
        if best is None or score > best[0]:
            best = (score, of)
    return best[1], best[0] / max(seen.sum(), 1.0)


def improved(of: np.ndarray, seen: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, float]:
    """The mapping after moving signs to better letters, a letter's former sign taking the place that gets free."""
    score = lambda m: float((seen * log[np.ix_(m, m)]).sum())
    now = score(of)
    order = np.argsort(-(seen.sum(0) + seen.sum(1)))
    changed = True
    while changed:
        changed = False
        for x in order.tolist():
            if x == 0:
                continue
            gain = log[:, of] @ seen[x] + log[of, :].T @ seen[:, x]
            for a in np.argsort(-gain[1:])[:4] + 1:
                if a == of[x]:
                    break
                new = of.copy()
                new[(of == a)] = of[x]
                new[x] = a
                if (s := score(new)) > now + 1e-9:
                    of, now, changed = new, s, True
                    break
    return of, now


def mapping(source: str | None, shown: str, letters: str, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """A row per pair, the first of which has the mapping."""
    text = lambda first, rest: pd.Series([first, *[rest] * (len(a) - 1)][: len(a)], dtype=object)
    return pd.DataFrame({"source": text(source, source), "shown": text(shown, None), "letters": text(letters, None), "a": a, "b": b, "n": n})


def learner(total: pd.DataFrame):
    """applyInPandas function: (source, a, b, n) of one source -> (source, shown, letters, a, b, n), of at most one mapping.

    The first row has the mapping; every row has a pair of signs that it explains and how often the source holds it.
    """
    whole = total.set_index(["a", "b"]).n

    def run(own: pd.DataFrame) -> pd.DataFrame:
        none = mapping(None, "", "", np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if own.n[(own.a > 0) & (own.b > 0)].sum() < LEAST_PAIRS:
            return none
        rest = whole.sub(own.set_index(["a", "b"]).n, fill_value=0).clip(lower=0).reset_index()
        a, b, n = rest.a.to_numpy(), rest.b.to_numpy(), rest.n.to_numpy(float)
        mine = pd.merge(own, rest.rename(columns={"n": "rest"}), on=["a", "b"], how="left").fillna({"rest": 0})
        # What the other sources hold too is clean: the part of each pair that is not, by a mixture with independent signs.
        p = mine.n.to_numpy(float)
        q = mine.rest.to_numpy(float) / max(n.sum(), 1.0)
        left, right = mine.groupby("a").n.transform("sum").to_numpy(float) / p.sum(), mine.groupby("b").n.transform("sum").to_numpy(float) / p.sum()
        clean = 0.5
        for _ in range(30):
            part = clean * q / np.maximum(clean * q + (1 - clean) * left * right, 1e-300)
            clean = float((part * p).sum() / p.sum())
        p = p * (1 - part)
        x, y = mine.a.to_numpy(), mine.b.to_numpy()
        names, at = np.unique(np.r_[x, y], return_inverse=True)
        ratio = np.bincount(at, np.r_[p, p]) / np.bincount(at, np.tile(mine.n.to_numpy(float), 2))
        wrong = names[(ratio >= LEAST_SHARE) & (names > 0)]
        inside = lambda c: np.where(np.isin(c, wrong), c, 0)
        u, w = inside(x), inside(y)
        if p[(u > 0) & (w > 0)].sum() < LEAST_PAIRS:
            return none
        signs = frequent(np.r_[u, w], np.r_[p, p], SIGNS)
        seen = square(u, w, p, signs)
        best = None
        for script in {alphabet(c) for c in np.unique(np.r_[a, b]).tolist() if c} - {""}:
            letters = np.sort(np.array([0, *(c for c in np.unique(np.r_[a, b]).tolist() if c and alphabet(c) == script)]))
            language = square(a, b, n, letters)
            if len(letters) <= LEAST_LETTERS or language[1:, 1:].sum() < LEAST_PAIRS:
                continue
            language /= language.sum()
            if seen[1:, 1:].sum() / seen.sum() < SAME_WORDS * language[1:, 1:].sum():
                continue  # signs that stand alone, as look-alikes and stray marks do, read well as short words
            usual = float((language * np.log(language + 1e-9)).sum())
            if decipher(seen, language, 1, ROUNDS // 2)[1] < usual - FIRST_SLACK:
                continue
            of, mean = decipher(seen, language)
            if mean >= usual - SLACK and (best is None or mean - usual > best[0]):
                best = (mean - usual, letters[of])
        if best is None:
            return none
        moved, uses = best[1] != signs, seen.sum(0) + seen.sum(1)
        often = 1 + np.argsort(-uses[1:])
        often = often[(np.cumsum(uses[often]) <= 0.95 * uses[1:].sum()) & moved[often]]
        if uses[1:][moved[1:]].sum() < 0.5 * uses[1:].sum() or len(np.unique(best[1][often])) < ONE_TO_ONE * len(often):
            return none
        moved &= (best[1] > 0) & (uses >= LEAST_USES)
        keep = np.isin(x, signs[moved]) | np.isin(y, signs[moved])
        return mapping(own.source.iloc[0], "".join(map(chr, signs[moved])), "".join(map(chr, best[1][moved])), x[keep], y[keep], p[keep])

    return run


def learned(df: DataFrame, source: str, title: str, text: str) -> DataFrame:
    """(source, shown, letters, a, b, n): per source whose page could be learned, the mapping for translate() in one row, and
    the pairs of signs it explains. What comes to the driver is the pairs of signs of all sources together, bounded by the
    alphabets; the pairs of one source meet in one task, bounded by the same."""
    counts = df.select(source, title, text).mapInArrow(pair_counts, "source string, a int, b int, n long").groupBy("source", "a", "b").agg(F.sum("n").alias("n"))
    total = counts.groupBy("a", "b").agg(F.sum("n").alias("n")).toPandas()
    return counts.groupBy("source").applyInPandas(learner(total), "source string, shown string, letters string, a int, b int, n double")
