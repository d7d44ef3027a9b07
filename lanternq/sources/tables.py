"""Parquet tables of a corpus directory."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parents[1]
    if not root.is_dir():  # the package already runs from an archive that was shipped
        return
    at = Path(tempfile.mkdtemp(prefix="lanternq-code-"), "lanternq.zip")  # read by the driver's file server only
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("lanternq", p.relative_to(root)))
    spark.sparkContext.addPyFile(str(at))


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table `name` of a directory that holds one Parquet file or folder per table."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")
