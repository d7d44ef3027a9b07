"""A page fetcher over HTTP on the standard library."""

from __future__ import annotations

import re
from urllib.error import URLError
from urllib.request import Request, urlopen

TIMEOUT = 30


def http_fetch(url: str) -> tuple[str, str | None] | None:
    """(final url, page) of an HTML page; no page for other content; None for an error that may pass."""
    try:
        with urlopen(Request(url, headers={"User-Agent": "lanternq/0.1"}), timeout=TIMEOUT) as got:
            kind = got.headers.get("Content-Type", "")
            if kind and "html" not in kind.lower():
                return got.geturl(), None
            raw = got.read()
            name = got.headers.get_content_charset() or (m[1].decode("ascii", "ignore") if (m := re.search(rb"charset=[\"']?([\w-]+)", raw[:2048])) else "utf-8")
            try:
                return got.geturl(), raw.decode(name, "replace")
            except LookupError:
                return got.geturl(), raw.decode("utf-8", "replace")
    except (URLError, TimeoutError, ValueError, OSError):
        return None
