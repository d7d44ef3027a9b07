"""The published index that the search queries read: built once an application for a directory, kept in the shared folder."""

from __future__ import annotations

from xxhash import xxh3_64_hexdigest

from pyspark.sql import DataFrame, SparkSession

from ..operators import build
from ..sources import generation
from ..sources.staging import shared_dir
from ..sources.tables import table

_loaded: dict[tuple[str, str], tuple[str, dict, dict[str, DataFrame]]] = {}


def index_of(spark: SparkSession, d: str) -> tuple[dict, dict[str, DataFrame]]:
    """(manifest, tables) of the index over indexed_documents of a directory."""
    at = spark.sparkContext.applicationId, d
    folder = f"{shared_dir(spark)}/index-{xxh3_64_hexdigest(d)}-{at[0]}"
    current = generation.manifest(folder).get("generation")
    if at not in _loaded or _loaded[at][0] != current:
        if current is None:
            docs = table(spark, d, "indexed_documents").select("document_id", "title_norm", "text_norm")
            current = generation.publish(folder, build.tables(docs), stats=build.stats)["generation"]
        _loaded[at] = (current, *generation.load(spark, folder))
    return _loaded[at][1:]


def postings(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d)[1]["postings"]


def stats(spark: SparkSession, d: str) -> DataFrame:
    return build.stats_row(spark, index_of(spark, d)[0]["stats"])
