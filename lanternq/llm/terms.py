"""Problems 5 and 6: how often every term occurs, and how distinctive it is of its record.

A term is a pair of neighbouring Han characters, a lone Han character, or a maximal run of other letters, marks and
digits. Counting is heavy-light: terms found to be heavy are counted in exact local arrays that are merged by position,
only the remaining terms are shuffled by their text, and both tables are united.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import spread, stage
from .codes import HAN_HI, HAN_LO, chunks, codes_of, group_sums, term_class

SPAN = HAN_HI - HAN_LO + 1
WORDS = SPAN * SPAN + SPAN
ROW_BITS = 30
MASK = (1 << ROW_BITS) - 1
#: Distinct terms that one task holds before it hands its partial counts on.
FLUSH = 1_000_000
#: Rows looked at to find heavy terms, and how many terms may be heavy. They choose how a term is counted, never its count.
HEAVY_SAMPLE_ROWS = 2_000
HEAVY_TERMS = 2_048
HEAVY_SHARE = 0.002


class TermIds:
    """Numbers for terms: Han pairs and Han characters by their code points, words as they come."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.names: list[str] = []

    def word(self, text: str) -> int:
        k = self.words.get(text)
        if k is None:
            k = self.words[text] = len(self.names)
            self.names.append(text)
        return WORDS + k

    def of(self, term: str) -> int:
        c = [ord(x) - HAN_LO for x in term]
        if all(0 <= x < SPAN for x in c):
            if len(c) == 2:
                return c[0] * SPAN + c[1]
            if len(c) == 1:
                return SPAN * SPAN + c[0]
        return self.word(term)

    def texts(self, ids: np.ndarray) -> list[str]:
        """Terms of sorted ids."""
        a, b = np.searchsorted(ids, [SPAN * SPAN, WORDS])
        pairs = np.empty((a, 2), "<u4")
        pairs[:, 0], pairs[:, 1] = ids[:a] // SPAN + HAN_LO, ids[:a] % SPAN + HAN_LO
        flat = pairs.tobytes().decode("utf-32-le")
        lone = (ids[a:b] - SPAN * SPAN + HAN_LO).astype("<u4").tobytes().decode("utf-32-le")
        return [flat[i : i + 2] for i in range(0, 2 * a, 2)] + list(lone) + [self.names[i] for i in (ids[b:] - WORDS).tolist()]


def row_terms(texts: list[str], ids: TermIds) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row number, term id and count of each distinct term of each row, by row; and the number of terms of each row."""
    flat = "\n".join(texts) + "\n"
    codes = codes_of(flat)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    row = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    kind = term_class()[codes]
    han, word = kind == 1, kind == 2
    both = han[:-1] & han[1:]
    pair = np.flatnonzero(both)
    near = np.zeros(len(han), bool)
    near[:-1] |= both
    near[1:] |= both
    lone = np.flatnonzero(han & ~near)
    start = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    end = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
    number = ids.word
    words = np.fromiter((number(flat[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)), np.int64, len(start))
    c = codes.astype(np.int64) - HAN_LO
    keys = np.concatenate(
        [
            (row[pair] << ROW_BITS) | (c[pair] * SPAN + c[pair + 1]),
            (row[lone] << ROW_BITS) | (SPAN * SPAN + c[lone]),
            (row[start] << ROW_BITS) | words,
        ]
    )
    total = np.bincount(keys >> ROW_BITS, minlength=len(texts))
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    n = np.diff(np.r_[first, len(keys)])
    keys = keys[first]
    return keys >> ROW_BITS, keys & MASK, n, total


def texts_of(batch: pa.RecordBatch, columns: list[str]) -> list[str]:
    """The text columns of each row as one string, the fields set apart by a line end; nulls are empty."""
    cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
    return ["\n".join(x or "" for x in row) for row in zip(*cols, strict=True)]


def partial_counts(columns: list[str], heavy: list[str]):
    """mapInArrow function: partial (term, slot, n, d); slot is the place of a heavy term in the counter arrays."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> tuple[TermIds, np.ndarray, np.ndarray]:
            ids = TermIds()
            known = np.array([ids.of(t) for t in heavy], np.int64)
            order = np.argsort(known)
            return ids, known[order], order

        ids, known, slot = fresh()
        heavy_n, heavy_d = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
        held: list[tuple[np.ndarray, ...]] = []

        def light() -> pa.RecordBatch:
            t, n, d = group_sums(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.record_batch({"term": pa.array(ids.texts(t), pa.string()), "slot": pa.nulls(len(t), pa.int32()), "n": n, "d": d})

        for batch in batches:
            texts = texts_of(batch, columns)
            for part in chunks(len(texts), np.fromiter(map(len, texts), np.int64, len(texts))):
                _, term, n, _ = row_terms(texts[part], ids)
                t, n, d = group_sums(term, n, np.ones(len(term), np.int64))
                if len(known) and len(t):
                    at = np.searchsorted(known, t).clip(max=len(known) - 1)
                    hit = known[at] == t
                    heavy_n[slot[at[hit]]] += n[hit]
                    heavy_d[slot[at[hit]]] += d[hit]
                    t, n, d = t[~hit], n[~hit], d[~hit]
                held.append((t, n, d))
                if sum(len(x[0]) for x in held) > FLUSH:
                    held[:] = [group_sums(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    if len(held[0][0]) > FLUSH // 2 or len(ids.names) > FLUSH:
                        yield light()
                        held.clear()
                        ids, known, slot = fresh()
        if held:
            yield light()
        some = np.flatnonzero(heavy_d)
        if len(some):
            yield pa.record_batch({"term": pa.nulls(len(some), pa.string()), "slot": pa.array(some, pa.int32()), "n": heavy_n[some], "d": heavy_d[some]})

    return run


def heavy_terms(df: DataFrame, columns: list[str], rows: int, sample: int = HEAVY_SAMPLE_ROWS, most: int = HEAVY_TERMS) -> list[str]:
    """At most `most` terms that stand in at least 1 % of a sample of about `sample` rows, drawn by a hash of their text."""
    if not rows:
        return []
    share = min(1.0, sample / rows)
    few = df.select(*columns).filter(F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < int(share * (1 << 30)))
    part = few.mapInArrow(partial_counts(columns, []), "term string, slot int, n long, d long")
    top = part.groupBy("term").agg(F.sum("d").alias("d")).filter(F.col("d") >= max(2.0, 0.01 * min(rows, sample))).orderBy(F.desc("d"), "term").limit(most)
    return [r.term for r in top.select("term").collect()]


def term_frequencies(df: DataFrame, columns: list[str], rare_at_most: int = 2, common_share: float = 0.2) -> DataFrame:
    """(term, total, records, mark) over all rows of df.

    total counts occurrences in all the columns together, records the rows that hold the term. mark is `rare` for
    total <= rare_at_most, else `common` for records >= common_share of all rows, else null. A null or empty text has no
    terms but its row counts as a row. Other columns of df are ignored; an empty df gives no rows.
    """
    base = spread(df.select(*columns))
    rows = base.count()
    heavy = heavy_terms(base, columns, rows)
    parts = stage(base.mapInArrow(partial_counts(columns, heavy), "term string, slot int, n long, d long"), "term-counts")
    spark = df.sparkSession
    names = spark.createDataFrame(list(enumerate(heavy)), "slot int, term string")
    sums = [F.sum("n").alias("total"), F.sum("d").alias("records")]
    dense = parts.filter("slot is not null").groupBy("slot").agg(*sums).join(F.broadcast(names), "slot").select("term", "total", "records")
    sparse = parts.filter("slot is null").groupBy("term").agg(*sums)
    mark = F.when(F.col("total") <= rare_at_most, "rare").when(F.col("records") >= common_share * rows, "common")
    return dense.unionByName(sparse).withColumn("mark", mark)


def scored_terms(key: str, columns: list[str], least: int, heavy: dict[str, int], of_heavy: bool):
    """mapInArrow function: (key, term, n, length, records) of each distinct term with n >= least of each row.

    Gives the heavy terms, whose records it knows, or all others, whose records are null.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = texts_of(batch, columns), batch.column(batch.schema.get_field_index(key))
            for part in chunks(len(texts), np.fromiter(map(len, texts), np.int64, len(texts))):
                ids = TermIds()
                known = np.array([ids.of(t) for t in heavy], np.int64)
                order = np.argsort(known)
                known, records = known[order], np.array(list(heavy.values()), np.int64)[order]
                row, term, n, total = row_terms(texts[part], ids)
                at = np.searchsorted(known, term).clip(max=max(len(known) - 1, 0))
                hit = known[at] == term if len(known) else np.zeros(len(term), bool)
                keep = (n >= least) & (hit == of_heavy)
                row, term, n, at = row[keep], term[keep], n[keep], at[keep]
                order = np.argsort(term, kind="stable")
                row, term, n, at = row[order], term[order], n[order], at[order]
                d = pa.array(records[at]) if of_heavy else pa.nulls(len(term), pa.int64())
                yield pa.record_batch({"_key": keys.take(pa.array(row + part.start)), "term": pa.array(ids.texts(term), pa.string()), "n": n, "length": total[row], "records": d})

    return run


def distinctive_terms(df: DataFrame, key: str, columns: list[str], least: int = 1, k1: float = 1.2, b: float = 0.75, records_between: tuple[int, int | None] = (1, None)) -> DataFrame:
    """(key, term, n, length, records, rows, score): each term of each row with its relevance weight.

    score = ln(1 + (N - d + 0.5) / (d + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * L / mean L)), with N all rows,
    d the rows that hold the term, n its count in the row and L the row's counted number of terms (stored lengths are
    not used). Terms with n < least or d outside records_between are left out of the result, never out of the counts.
    Rows with equal keys are scored each by itself; a null key comes out as null. An empty df gives no rows.
    """
    base = spread(df.select(F.col(key).alias("_key"), *columns))
    counts = stage(term_frequencies(base, columns), "term-table").select("term", "total", "records")
    rows = base.count()
    mean = (counts.agg(F.sum("total")).first()[0] or 0) / max(rows, 1)
    low, high = records_between
    chosen = counts.filter(F.col("records") >= low) if high is None else counts.filter(F.col("records").between(low, high))
    # Heavy terms take their records along; only the others are joined by shuffle.
    many = counts.filter(F.col("records") >= max(2.0, HEAVY_SHARE * rows)).orderBy(F.desc("records"), "term").limit(HEAVY_TERMS).collect()
    heavy = {r.term: r.records for r in many}
    schema = f"_key {dict(df.dtypes)[key]}, term string, n long, length long, records long"
    light = base.mapInArrow(scored_terms("_key", columns, least, heavy, False), schema).drop("records")
    out = light.join(chosen.select("term", "records"), "term").select("_key", "term", "n", "length", "records")
    inside = {t: d for t, d in heavy.items() if d >= low and (high is None or d <= high)}
    if inside:
        out = out.unionByName(base.mapInArrow(scored_terms("_key", columns, least, inside, True), schema))
    idf = F.log(1 + (F.lit(float(rows)) - F.col("records") + 0.5) / (F.col("records") + 0.5))
    tf = F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("length") / (mean or math.inf)))
    return out.select(F.col("_key").alias(key), "term", "n", "length", "records", F.lit(rows).cast("long").alias("rows"), (idf * tf).alias("score"))
