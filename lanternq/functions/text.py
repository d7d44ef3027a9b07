"""Scalar text functions: exact ones as Arrow UDFs, all others as Catalyst expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Function words that are never indexed, and the version of that list.
STOPWORDS = tuple("的了和与及或在是为于对把被由从向以而并也都")
STOPWORDS_VERSION = "builtin-v1"
NORMALIZER_VERSION = "nfkc-casefold-1"


def normalize(text: str | None) -> str:
    """Compatibility normalisation, case folding, and every run of white space as one space."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split()) if text else ""


@F.pandas_udf(StringType())
def normalize_text(texts: pd.Series) -> pd.Series:
    """`normalize` over Arrow batches, each distinct value once; null becomes empty."""
    values, at = pd.factorize(texts, use_na_sentinel=False)[::-1]
    return pd.Series([normalize(v if isinstance(v, str) else None) for v in values], dtype=object).take(at).reset_index(drop=True)


def normalize_native(text: Column) -> Column:
    """Case and white space folding inside the JVM, for text that is already in compatibility form."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[ \t\n\x0B\f\r  -   　]+", " "))


def clean(text: Column) -> Column:
    """White space collapsed, null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def compact(text: Column) -> Column:
    """Only the letters and digits."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters, in order; empty below two characters."""
    n = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(text, i, F.lit(2)))
    return F.when(n >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def token_estimate(text: Column) -> Column:
    """Rough number of model tokens: wide characters count one, four others one, and four for the frame."""
    wide = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return (wide + F.floor((F.length(text) - wide + 3) / 4) + 4).cast("long")


def evidence_id(url: Column, passage_id: Column, text: Column) -> Column:
    """Stable id of a piece of evidence."""
    return F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws("\0", url, passage_id, text), 256), 1, 16))


#: A date after a label in the text, and a date as a run of digits in a url.
LABELLED_DATE = r"(?:日期|发布时间|更新时间)\s*[:：]?\s*(20\d{2})[-年/.](\d{1,2})[-月/.](\d{1,2})日?"
URL_DATE = r"(?<!\d)(20\d{2})(\d{2})(\d{2})"


def published_date(text: Column, url: Column) -> Column:
    """`YYYY-MM-DD` after a date label in the text, else from a digit run in the url; empty if absent or no such day.

    Once the text matches, the url is not looked at.
    """
    part = lambda k: F.when(F.regexp_like(text, F.lit(LABELLED_DATE)), F.regexp_extract(text, LABELLED_DATE, k)).otherwise(F.regexp_extract(url, URL_DATE, k))
    day = F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd")
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))


def occurrences(text: Column, term: Column) -> Column:
    """How often a term occurs in the text without overlap."""
    return F.when(F.length(term) > 0, (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).otherwise(0).cast("long")


def lexical_score(text: Column, terms: Column) -> Column:
    """Sum over the terms of length times number of occurrences."""
    return F.aggregate(terms, F.lit(0).cast("long"), lambda a, t: a + F.length(t) * occurrences(text, t))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sums(sizes: Column) -> Column:
    """Running sums of an array of ints that is not empty, in blocks of the root of its length, so that it costs n^1.5."""
    add = lambda a, x: F.array_append(a, F.element_at(a, -1) + x)
    zero = F.array(F.lit(0).cast("long"))

    def by_block(b: Column) -> Column:
        part = lambda k: F.slice(sizes, (k - 1) * b + 1, b)
        blocks = F.sequence(F.lit(1), F.ceil(F.size(sizes) / b).cast("int"))
        firsts = F.aggregate(blocks, zero, lambda a, k: add(a, F.aggregate(part(k), F.lit(0).cast("long"), lambda s, x: s + x)))
        inner = lambda first, k: F.slice(F.aggregate(part(k), F.array(first), add), 2, b)
        return let(firsts, lambda f: F.flatten(F.transform(blocks, lambda k: inner(F.element_at(f, k), k))))

    return let(F.ceil(F.sqrt(F.size(sizes).cast("double"))).cast("int"), by_block)


def snippet(text: Column, terms: Column, limit: int = 240) -> Column:
    """The window of `limit` characters with the highest lexical score; the earliest of equal ones, all of a short text.

    Windows start at 0 and a third of the limit before each occurrence of a term.
    """
    last = F.length(text) - limit

    def starts(t: Column) -> Column:
        cuts = F.split(text, F.concat(F.lit("\\Q"), t, F.lit("\\E")), F.lit(-1))
        return let(F.transform(cuts, lambda c: F.length(c) + F.length(t)), lambda sizes: F.transform(F.slice(sums(sizes), 1, F.size(sizes) - 1), lambda e: (e - F.length(t)).cast("int")))

    places = F.flatten(F.transform(F.filter(terms, lambda t: F.length(t) > 0), starts))
    wanted = F.array_union(F.array(F.lit(0)), F.transform(places, lambda p: F.greatest(F.lit(0), F.least(p - limit // 3, last)).cast("int")))
    best = F.array_max(F.transform(wanted, lambda s: F.struct(lexical_score(F.substr(text, s + 1, F.lit(limit)), terms).alias("score"), (-s).alias("minus"))))
    return F.when(last <= 0, text).otherwise(F.substr(text, -best["minus"] + 1, F.lit(limit)))
