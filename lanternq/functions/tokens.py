"""Tokens with character positions, by code-point classes over whole batches.

Mode `default` takes maximal runs of Han and maximal runs of other letters, marks and digits; mode `search` cuts a Han
run into overlapping pairs (a lone Han stays alone). Model tokens are single Han and the other runs. A mode can also be a
word segmenter, a function that cuts a run of Han into words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np

from .text import STOPWORDS, normalize

MODES = ("default", "search", "model")
#: Cuts a run of Han into words, which together are the run.
Segmenter = Callable[[str], Iterable[str]]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """0 separator, 1 Han, 2 other letter, mark or digit, for every code point."""
    kind = np.array([2 if unicodedata.category(chr(c))[0] in "LMN" else 0 for c in range(0x110000)], np.uint8)
    kind[0x4E00:0xA000] = 1
    return kind


def segmented(flat: str, start: np.ndarray, end: np.ndarray, segmenter: Segmenter) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of some runs; each distinct run is cut once."""
    known: dict[str, list[int]] = {}
    a: list[int] = []
    b: list[int] = []
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        run = flat[s:e]
        sizes = known.get(run)
        if sizes is None:
            sizes = known[run] = [len(w) for w in segmenter(run) if w]
            if sum(sizes) != len(run):
                raise ValueError(f"the words of {run!r} do not make it up")
        for n in sizes:
            a.append(s)
            s += n
            b.append(s)
    return np.array(a, np.int64), np.array(b, np.int64)


def spans(texts: list[str], mode: str | Segmenter = "search") -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """Text number, start and end of every token in the line-joined texts, in order, and the joined text.

    Starts and ends are places in the joined text.
    """
    if not callable(mode) and mode not in MODES:
        raise ValueError(f"tokenizer mode {mode!r} is none of {MODES}")
    flat = "\n".join(texts) + "\n"
    kind = classes()[np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)]
    prev, next_ = np.concatenate(([0], kind[:-1])), np.concatenate((kind[1:], [0]))
    start = np.flatnonzero((kind == 2) & (prev != 2))
    end = np.flatnonzero((kind == 2) & (next_ != 2)) + 1
    han = kind == 1
    if mode == "model":
        a = np.flatnonzero(han)
        b = a + 1
    elif mode == "search":
        a = np.flatnonzero(han & ((next_ == 1) | (prev != 1)))
        b = a + 1 + (next_[a] == 1)
    else:
        a, b = np.flatnonzero(han & (prev != 1)), np.flatnonzero(han & (next_ != 1)) + 1
        if callable(mode):
            a, b = segmented(flat, a, b, mode)
    start, end = np.concatenate((start, a)), np.concatenate((end, b))
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return np.searchsorted(bounds, start, "right"), start, end, flat


def tokenize_with_positions(text: str, mode: str | Segmenter = "default") -> list[tuple[str, int]]:
    """(token, character start) of the tokens of one text, without stop words."""
    _, start, end, flat = spans([text], mode)
    pairs = ((flat[a:b], a) for a, b in zip(start.tolist(), end.tolist(), strict=True))
    return [(t, a) for t, a in pairs if t.casefold() not in STOPWORDS]


def query_terms(query: str, mode: str | Segmenter = "search") -> list[str]:
    """Distinct search tokens of a query in order of first occurrence."""
    return list(dict.fromkeys(t for t, _ in tokenize_with_positions(normalize(query), mode)))
