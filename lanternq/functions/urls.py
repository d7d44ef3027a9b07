"""URL columns as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host of a URL without user or port; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def site(url: Column) -> Column:
    """Host without a leading `www.` or `m.`."""
    return F.regexp_replace(host(url), r"^(?:www|m)\.", "")


def without_dots(path: Column) -> Column:
    """A path that starts with `/`, with its `.` and `..` segments worked off."""
    add = lambda a, s: F.when(s == ".", a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.array_append(a, s))
    kept = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), add), "/")
    short = F.concat(kept, F.when(F.regexp_like(path, F.lit(r"/\.\.?$")), "/").otherwise(""))
    return F.when(F.regexp_like(path, F.lit(r"/\.\.?(/|$)")), short).otherwise(path)


def upper_escapes(text: Column) -> Column:
    """Percent escapes with upper-case digits."""
    part = lambda x, i: F.when((i > 0) & F.regexp_like(x, F.lit("^[0-9A-Fa-f]{2}")), F.concat(F.upper(F.substring(x, 1, 2)), F.substr(x, F.lit(3)))).otherwise(x)
    return F.when(F.contains(text, F.lit("%")), F.array_join(F.transform(F.split(text, "%"), part), "%")).otherwise(text)


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, no dot segments, `/` for an empty path, upper-case escapes."""
    bare = F.regexp_replace(url, "#.*$", "")
    origin = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0))
    rest = F.substr(bare, F.length(origin) + 1)
    path = F.regexp_extract(rest, r"^[^?]*", 0)
    query = F.substr(rest, F.length(path) + 1)
    short = F.regexp_replace(F.regexp_replace(origin, r"^(http://[^/]*):80$", "$1"), r"^(https://[^/]*):443$", "$1")
    return F.concat(short, upper_escapes(F.concat(F.when(rest == "", "/").otherwise(without_dots(path)), query)))
