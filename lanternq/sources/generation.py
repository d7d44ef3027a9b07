"""Index generations on any file system: segments of tables, and a manifest that names them and is replaced last.

A build writes a segment of the documents it indexed; where other segments stay in force, later ones hide the documents they
hold from earlier ones as the tables are read. After MOST_SEGMENTS builds all is written as one segment again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import dense
from . import store

SCHEMA_VERSION = 2
REQUIRED = ("schema_version", "generation", "segments", "counts")
MOST_SEGMENTS = 8
KEY = "document_id"


def _spark() -> SparkSession:
    return SparkSession.active()


def manifest(directory: str) -> dict:
    """The manifest of an index folder; empty where there is none yet."""
    text = store.read_text(_spark(), f"{directory}/manifest.json")
    return {} if text is None else json.loads(text)


def _merged(spark: SparkSession, directory: str, segments: list[dict]) -> dict[str, DataFrame]:
    """The tables of all segments: of each document, the rows of the last segment that holds it."""
    out: dict[str, DataFrame] = {}
    later: DataFrame | None = None
    for s in reversed(segments):
        own = {name: spark.read.parquet(f"{directory}/{name}-{s['id']}") for name in s["tables"]}
        for name, df in own.items():
            if later is not None and KEY in df.columns:
                df = df.join(later, KEY, "left_anti")
            out[name] = out[name].unionByName(df) if name in out else df
        if "ids" in own:
            later = own["ids"].select(KEY) if later is None else later.union(own["ids"].select(KEY))
    return out


def publish(directory: str, tables: dict[str, DataFrame], onto: dict | None = None, stats: Callable[[dict[str, DataFrame]], dict] | None = None, **extra: object) -> dict:
    """Write the tables as a segment and make it current, alone or on top of the segments of the manifest `onto`.

    The manifest is replaced in one step after every table is written, so a failure leaves the old one in force. Tables with
    a term are sorted by it within files, so that a lookup reads few row groups. `stats` gives numbers of the merged tables
    that are kept in the manifest. Vectors are validated here; a manifest that says they are bad does not load. Segments that
    no manifest but the one before names are deleted.
    """
    generation = uuid.uuid4().hex
    counts, bad = {}, None
    spark = _spark()
    for name, df in tables.items():
        path = f"{directory}/{name}-{generation}"
        (df.sortWithinPartitions("term") if "term" in df.columns else df).write.parquet(path)
        written = spark.read.parquet(path)
        counts[name] = written.count()
        if name == "vectors":
            try:
                dense.checked(written, int(extra.get("dimension", 0)))
            except ValueError as e:
                bad = str(e)
    before = manifest(directory)
    own = {"id": generation, "tables": sorted(tables), "counts": counts}
    segments = [*(onto["segments"] if onto else []), own]
    total: dict[str, int] = {}
    for s in segments:
        for name, n in s["counts"].items():
            total[name] = total.get(name, 0) + n
    new = {"schema_version": SCHEMA_VERSION, "generation": generation, "segments": segments, "counts": total, "bad": bad, "stats": stats(_merged(spark, directory, segments)) if stats else {}, "gone": [s for s in before.get("segments", []) if s["id"] not in {x["id"] for x in segments}], **extra}
    store.replace_text(spark, f"{directory}/manifest.json", json.dumps(new, ensure_ascii=False, indent=1))
    for s in before.get("gone", []):  # the manifest that named them was replaced before the last one
        for name in s["tables"]:
            store.delete(spark, f"{directory}/{name}-{s['id']}")
    return new


def load(spark: SparkSession, directory: str) -> tuple[dict, dict[str, DataFrame]]:
    """The current manifest and its tables; ValueError where they do not agree or a vector is bad. Only footers are read."""
    try:
        m = manifest(directory)
    except json.JSONDecodeError as e:
        raise ValueError(f"bad manifest: {e}") from e
    if not m or any(k not in m for k in REQUIRED) or m["schema_version"] != SCHEMA_VERSION:
        raise ValueError("the manifest is missing, incomplete or of another version")
    found: dict[str, int] = {}
    for s in m["segments"]:
        for name in s["tables"]:
            path = f"{directory}/{name}-{s['id']}"
            if not store.exists(spark, path):
                raise ValueError(f"table {name} of segment {s['id']} is missing")
            found[name] = found.get(name, 0) + spark.read.parquet(path).count()
    if found != m["counts"]:
        raise ValueError("the tables do not have the rows of the manifest")
    if m.get("bad"):
        raise ValueError(m["bad"])
    return m, _merged(spark, directory, m["segments"])
