"""Code-point arrays: the vectorised view of text that the Arrow operators of this package work on."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

MAX_CP = 0x110000
HAN_LO, HAN_HI = 0x4E00, 0x9FFF


def codes_of(text: str) -> np.ndarray:
    """Code points of a string as uint32."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def text_of(codes: np.ndarray) -> str:
    """The string of a code-point array."""
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of texts in one array, and where each text starts (with the end as last entry)."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=bounds[1:])
    return codes_of("".join(texts)), bounds


def chunks(n: int, lengths: np.ndarray, most: int = 1_500_000) -> Iterator[slice]:
    """Slices of rows that hold about `most` code points each; a longer row stands alone."""
    at, total = 0, 0
    for i in range(n):
        total += int(lengths[i])
        if total >= most:
            yield slice(at, i + 1)
            at, total = i + 1, 0
    if at < n:
        yield slice(at, n)


@lru_cache(maxsize=1)
def major_category() -> np.ndarray:
    """First letter of the Unicode category of every code point, as its ASCII number."""
    return np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(MAX_CP)).encode(), np.uint8)


@lru_cache(maxsize=1)
def term_class() -> np.ndarray:
    """0 separator, 1 Han (U+4E00-9FFF), 2 any other letter, mark or digit."""
    cat = major_category()
    out = np.where(np.isin(cat, [ord(x) for x in "LMN"]), 2, 0).astype(np.uint8)
    out[HAN_LO : HAN_HI + 1] = 1
    return out


@lru_cache(maxsize=1)
def is_letter_or_number() -> np.ndarray:
    """True for the Unicode categories L and N."""
    return np.isin(major_category(), [ord("L"), ord("N")])


def group_sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sum of each value array per key."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return (k[first], *(np.add.reduceat(v[order], first) for v in values))
