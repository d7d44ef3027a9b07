"""Problem 7: strings that look alike but differ in characters, and one consistent form.

The form is composed compatibility normalisation, full case folding, every kind of space as one plain space, no
default-ignorable characters (but for joiners that hold an emoji together), and look-alike Greek and Cyrillic letters
inside Latin words as the Latin letters. Work is done once per distinct value of a batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import spread
from .codes import MAX_CP, chunks, joined

#: Greek and Cyrillic letters and the Latin letters that they look like.
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυχϲϳ"
GREEK_LATIN = "ABEZHIKMNOPTYXaivopuxcj"
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһ"
CYRILLIC_LATIN = "ABESIJKMHOPCTYXaesijopcyxdqwh"
TO_LATIN = dict(zip(map(ord, GREEK + CYRILLIC), GREEK_LATIN + CYRILLIC_LATIN, strict=True))

#: Bits of the classes of code points.
WIDE, KANA, ACCENT, HIDDEN, SPACE, HAN_FORM, LATIN, FOREIGN, JOINER, EMOJI = (1 << k for k in range(10))
#: Faults that may have no other form.
STAYING = np.uint16(ACCENT | HAN_FORM | FOREIGN)
#: Names of the faults, by bit.
FAULTS = {WIDE: "full-width", KANA: "half-width kana", ACCENT: "separate accent", HIDDEN: "invisible", SPACE: "space", HAN_FORM: "han form", FOREIGN: "look-alike letter"}


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class bits of every code point."""
    t = np.zeros(MAX_CP, np.uint16)
    for a, b in ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)):
        t[a : b + 1] |= WIDE
    t[0xFF66:0xFFA0] |= KANA
    for a, b in ((0x0300, 0x036F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20F0)):
        t[a : b + 1] |= ACCENT
    t[[0xAD, 0x180E, 0x200B, 0x200C, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF]] |= HIDDEN
    t[0x200D] |= JOINER
    t[[0xA0, 0x202F, 0x205F]] |= SPACE
    t[0x2000:0x200B] |= SPACE
    for a, b in ((0x2E80, 0x2EF3), (0x2F00, 0x2FD5), (0xF900, 0xFAD9), (0x2F800, 0x2FA1D)):
        t[a : b + 1] |= HAN_FORM
    t[[c for c in range(0xFA0E, 0xFA2A) if unicodedata.normalize("NFKC", chr(c)) == chr(c)]] &= ~np.uint16(HAN_FORM)
    for a, b in ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF)):
        t[a : b + 1] |= LATIN
    t[[0xD7, 0xF7]] = 0
    for a, b in ((0x370, 0x3FF), (0x400, 0x52F), (0x1F00, 0x1FFF)):
        for c in range(a, b + 1):
            if unicodedata.category(chr(c))[0] == "L":
                t[c] |= FOREIGN
    for a, b in ((0x1F000, 0x1FAFF), (0x2600, 0x27BF), (0x2300, 0x23FF), (0x2B00, 0x2BFF), (0xFE0E, 0xFE0F), (0x1F3FB, 0x1F3FF)):
        t[a : b + 1] |= EMOJI
    return t


def faults(texts: list[str]) -> np.ndarray:
    """The fault bits of each text."""
    out = np.zeros(len(texts), np.uint16)
    for part in chunks(len(texts), np.fromiter(map(len, texts), np.int64, len(texts))):
        own = texts[part]
        codes, start = joined([t + "\n" for t in own])
        t = classes()[codes]
        if not t.any():
            continue
        before, after = np.concatenate(([0], t[:-1])), np.concatenate((t[1:], [0]))
        bits = t & (WIDE | KANA | HIDDEN | SPACE | HAN_FORM)
        # the letter of an accent may stand before other accents of it
        place = np.arange(len(t))
        accent = (t & ACCENT) > 0
        base = np.maximum.accumulate(np.where(accent, 0, place))
        bits |= np.where(accent & ((t[base] & LATIN) > 0), ACCENT, 0).astype(np.uint16)
        joins = ((t & JOINER) > 0) & ~(((before & EMOJI) > 0) & ((after & EMOJI) > 0))
        bits |= np.where(joins, HIDDEN, 0).astype(np.uint16)
        mixed = ((t & FOREIGN) > 0) & (((before | after) & LATIN) > 0)
        bits |= np.where(mixed, FOREIGN, 0).astype(np.uint16)
        out[part] = np.bitwise_or.reduceat(bits, start[:-1])
    return out


EMOJI_JOIN = re.compile("(?<=[\u2300-\u23ff\u2600-\u27bf\u2b00-\u2bff\ufe0f\U0001f000-\U0001faff])\u200d(?=[\u2300-\u23ff\u2600-\u27bf\u2b00-\u2bff\U0001f000-\U0001faff])")
KEEP = "\ufdd0"  # a noncharacter
IGNORABLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U000e0000-\U000e0fff]")
BLANK = re.compile("[ \t\v\f\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ԯ]+")
HAS_LATIN, HAS_FOREIGN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]"), re.compile("[Ͱ-ϿЀ-ԯ]")


def latin_word(m: re.Match[str]) -> str:
    w = m.group()
    return w.translate(TO_LATIN) if HAS_FOREIGN.search(w) and HAS_LATIN.search(w) else w


def consistent(text: str) -> str:
    """The consistent form of a text."""
    if text.isascii():
        return text.casefold().translate({9: " ", 11: " ", 12: " "})
    text = EMOJI_JOIN.sub(KEEP, text) if "\u200d" in text else text
    text = IGNORABLE.sub("", text)
    text = unicodedata.normalize("NFKC", text)
    if HAS_FOREIGN.search(text):
        text = WORD.sub(latin_word, text)
    text = unicodedata.normalize("NFKC", text.casefold())
    return BLANK.sub(" ", text).replace(KEEP, "\u200d")


def checked(every: bool):
    """mapInArrow function: (key, text) -> (_id, bits, form) of the rows that hold a fault, or of all; each distinct value once.

    The form of every value is made; a value has a fault if it differs from its form and holds what a fault is made of.
    Accents without a composed letter, radicals without a character and foreign letters without a Latin look-alike stay in
    the form, so they count without a difference.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            values = coded.dictionary.to_pylist()
            forms = [consistent(v) for v in values]
            bits = faults(values)
            differs = np.fromiter((f != v for f, v in zip(forms, values, strict=True)), bool, len(values))
            bits[~differs] &= STAYING
            of = coded.indices.to_numpy(zero_copy_only=False)
            rows = (np.arange(len(of)) if every else np.flatnonzero(bits[of])) if len(values) else np.zeros(0, np.int64)
            yield pa.record_batch({"_id": batch.column(0).take(pa.array(rows)), "bits": bits[of[rows]].astype(np.int32), "form": pa.array([forms[k] for k in of[rows].tolist()], pa.string())})

    return run


def inconsistent(df: DataFrame, key: str, text: str, every: bool = False) -> DataFrame:
    """(key, faults, form): rows whose text differs from its consistent form by look-alike characters, and that form.

    Faults are full-width letters and digits, half-width kana, Latin letters with a separate accent, invisible characters
    (not joiners between emoji), unusual spaces, radicals and compatibility forms of Han characters, and Greek or Cyrillic
    letters directly beside Latin ones. With `every`, all rows with a text come out, those without a fault with no faults.
    Null and empty texts have none and no row. Rows with equal keys are reported each by itself.
    """
    base = df.select(F.col(key).alias("_id"), F.col(text).alias("_text")).filter("_text is not null and _text <> ''")
    out = spread(base).mapInArrow(checked(every), f"_id {dict(df.dtypes)[key]}, bits int, form string")
    names = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(b)) > 0, n) for b, n in FAULTS.items()]))
    return out.select(F.col("_id").alias(key), names.alias("faults"), "form")
