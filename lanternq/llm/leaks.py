"""Problem 8: passages of held-out items inside documents, by q-gram counting in diagonal bands.

Texts and items are folded and reduced to letters and digits. Every q-gram that a text shares with an item votes for its
diagonal (place in the text less place in the item). Bands of 2 * (edits + 1) diagonals overlap by half, so that every
passage within the edit budget lies in one of them; a band with as many votes as the q-gram lemma demands of such a passage
is kept and verified by alignment inside the band. Each item has the longest q that the lemma allows its length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.staging import spread
from .codes import chunks, codes_of, is_letter_or_number

#: Longest q-gram; code points of items that one pass holds (further items make further passes).
Q = 8
ITEM_CODES = 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def fold(text: str) -> str:
    """Compatibility and case folding."""
    return unicodedata.normalize("NFKC", text).casefold()


def kept_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the letters and digits of folded texts, and where each text starts among them."""
    folded = [fold(t) for t in texts]
    codes = codes_of("".join(folded))
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, folded), np.int64, len(folded)))
    keep = is_letter_or_number()[codes]
    return codes[keep], np.searchsorted(row[keep], np.arange(len(texts) + 1))


def grams(codes: np.ndarray, wanted: set[int]) -> dict[int, np.ndarray]:
    """By q, a 64-bit hash of the q code points from each place on; the hash of q is a step towards that of q + 1."""
    out = {}
    h = np.zeros(len(codes), np.uint64)
    for k in range(max(wanted, default=0)):
        h = (h[: max(0, len(codes) - k)] ^ codes[k:].astype(np.uint64)) * MIX
        h ^= h >> np.uint64(32)
        if k + 1 in wanted:
            out[k + 1] = h
    return out


class Grams:
    """The q-grams of all items of one q, sorted for lookup."""

    def __init__(self, h: np.ndarray, item: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], item[order].astype(np.int32), at[order].astype(np.int32)
        self.sieve: np.ndarray | None = None

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of h that some item has, and the first and the number of its entries here."""
        shift = np.uint64(64 - min(24, max(12, 4 + int(len(self.hash)).bit_length())))
        if self.sieve is None:
            self.sieve = np.zeros(1 << (64 - int(shift)), bool)
            self.sieve[(self.hash >> shift).astype(np.int64)] = True
        place = np.flatnonzero(self.sieve[(h >> shift).astype(np.int64)])
        first = np.searchsorted(self.hash, h[place], "left")
        n = np.searchsorted(self.hash, h[place], "right") - first
        return place[n > 0], first[n > 0], n[n > 0]


class Items:
    """Items with the part of each that must be found, and their q-grams by q."""

    def __init__(self, ids: list[int], texts: list[str], share: tuple[int, int], edits: int) -> None:
        self.ids, self.edits = ids, edits
        self.codes, self.start = kept_codes(texts)
        self.size = np.diff(self.start)
        self.need = -(-self.size * share[0] // share[1])
        q = np.clip(self.need // (edits + 1), 1, Q)
        self.votes = np.maximum(1, self.need + 1 - q * (edits + 1))
        item = np.repeat(np.arange(len(ids)), self.size)
        at = np.arange(len(self.codes)) - self.start[item]
        self.grams = {}
        for n, h in grams(self.codes, set(q[self.size > 0].tolist())).items():
            own = item[: len(h)]
            use = (q[own] == n) & (at[: len(h)] + n <= self.size[own])
            self.grams[n] = Grams(h[use], own[use], at[: len(h)][use])


def aligned(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, items: Items, item: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each candidate, the longest part of its item that the text holds unbroken, and within the edits, inside its band.

    A candidate is a text (codes from begin to end), an item and the lowest diagonal of a band. reach[c, e, k] is the
    longest part that ends at the current place of the item on diagonal low + k after e edits; all candidates go together.
    """
    edits = items.edits
    width = 2 * (edits + 1) if edits else 1
    size = items.size[item]
    order = np.argsort(-size, kind="stable")
    begin, end, item, low, size = begin[order], end[order], item[order], low[order], size[order]
    reach = np.zeros((len(item), edits + 1, width), np.int32)
    run, part = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
    diagonal = low[:, None] + np.arange(width)
    for j in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -j, "left"))  # candidates whose item is longer than j
        place = begin[:n, None] + diagonal[:n] + j
        inside = (diagonal[:n] + j >= 0) & (place < end[:n, None])
        same = inside & (codes[np.where(inside, place, 0)] == items.codes[items.start[item[:n]] + j][:, None])
        old, new = reach[:n], np.zeros((n, edits + 1, width), np.int32)
        for e in range(edits + 1):
            x = np.where(same, old[:, e] + 1, 0)
            if e:
                less = old[:, e - 1]
                x = np.maximum(x, np.where(~same & inside & (less > 0), less + 1, 0))
                x[:, :-1] = np.maximum(x[:, :-1], np.where(less[:, 1:] > 0, less[:, 1:] + 1, 0))
                x[:, 1:] = np.maximum(x[:, 1:], new[:, e - 1, :-1])
            new[:, e] = x
        reach[:n] = new
        run[:n] = np.maximum(run[:n], new[:, 0].max(1))
        part[:n] = np.maximum(part[:n], new.max((1, 2)))
    back = np.argsort(order, kind="stable")
    return run[back], part[back]


def matches(items: Items, codes: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, run, part) of texts that hold enough of an item within the edits."""
    rows, of, bands = [], [], []
    step = items.edits + 1
    for q, h in grams(codes, set(items.grams)).items():
        known = items.grams[q]
        place, first, n = known.lookup(h)
        row = np.searchsorted(start, place, "right") - 1
        fits = place + q <= start[row + 1]
        place, first, n, row = place[fits], first[fits], n[fits], row[fits]
        hit = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        band = (np.repeat(place - start[row], n) - known.at[hit]) // step
        item, row = known.item[hit], np.repeat(row, n)
        for b in (band, band - 1) if items.edits else (band,):
            rows.append(row)
            of.append(item)
            bands.append(b)
    key = np.stack([np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (rows, of, bands)], 1)
    if not len(key):
        return
    key = key[np.lexsort(key.T[::-1])]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
    votes = np.diff(np.r_[new, len(key)])
    row, item, band = key[new[votes >= items.votes[key[new, 1]]]].T
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for at in range(0, len(row), 50_000):
        r, i, low = row[at : at + 50_000], item[at : at + 50_000], band[at : at + 50_000] * step
        run, part = aligned(codes, start[r], start[r + 1], items, i, low)
        enough = part >= items.need[i]
        for a, b, x, y in zip(r[enough].tolist(), i[enough].tolist(), run[enough].tolist(), part[enough].tolist(), strict=True):
            u, v = best.get((a, b), (0, 0))
            best[a, b] = max(u, x), max(v, y)
    yield from ((*k, *v) for k, v in best.items())


def searched(block):
    """mapInArrow function: (key, text) rows -> (key, item_id, run, part, item_length)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = block.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for rows in chunks(len(texts), np.fromiter(map(len, texts), np.int64, len(texts))):
                found = list(matches(items, *kept_codes(texts[rows])))
                if found:
                    row, item, n, part = (np.array(x) for x in zip(*found, strict=True))
                    yield pa.record_batch({"_key": batch.column(0).take(pa.array(row + rows.start)), "item_id": np.array(items.ids, np.int64)[item], "run": n.astype(np.int64), "part": part.astype(np.int64), "item_length": items.size[item].astype(np.int64)})

    return run


def leaked_items(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", share: tuple[int, int] = (1, 2), edits: int = 0) -> DataFrame:
    """(key, item_id, run, part, item_length): rows whose text holds at least `share` of an item, within so many edits.

    run is the longest unbroken part of the item in the kept bands, part the longest within the edits. Lengths count
    letters and digits after folding. Items are a stated query set, read in blocks of ITEM_CODES code points. Null, empty or
    letterless texts and items match nothing. Rows with equal keys are reported each by itself. Other columns are ignored;
    empty inputs give no rows.
    """
    spark = df.sparkSession
    base = df.select(key, text).filter(f"`{text}` is not null and `{text}` <> ''").toDF("_key", "_text")
    base = spread(base)
    schema = f"_key {dict(df.dtypes)[key]}, item_id long, run long, part long, item_length long"
    out = None
    ids: list[int] = []
    texts: list[str] = []
    held = 0

    def block() -> None:
        nonlocal out, held
        items = spark.sparkContext.broadcast(Items(ids[:], texts[:], share, edits))  # bounded by ITEM_CODES and one item
        part = base.mapInArrow(searched(items), schema)
        out = part if out is None else out.unionByName(part)
        ids.clear()
        texts.clear()
        held = 0

    for r in benchmark.select("item_id", "text").filter("item_id is not null and text is not null").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        held += len(r.text)
        if held >= ITEM_CODES:
            block()
    if ids or out is None:
        block()
    return out.withColumnRenamed("_key", key)
