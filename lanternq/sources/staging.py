"""Shared-folder staging: cut a lineage by writing a table every executor can read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import store


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on a local master without one, a fresh temporary folder.

    On a cluster the setting is required: a machine-local folder would be lost with its executor.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = f"file://{tempfile.mkdtemp(prefix='lanternq-')}"
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def staged_dir(spark: SparkSession) -> str:
    """Where this application's staged tables stand in the shared folder."""
    return f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete this application's staged tables. DataFrames that still read them cannot be used any more."""
    store.delete(spark, staged_dir(spark))


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df once to the shared folder and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{staged_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Operators after which rows are already dealt out by a shuffle.
_DEALT = re.compile(r"\b(?:Join|Aggregate|Repartition\w*|RebalancePartitions|Window|Sort|Distinct|Deduplicate|Union|Intersect|Except|Limit|FlatMapGroups\w*|TransformWithState\w*)\b")


def spread(df: DataFrame) -> DataFrame:
    """df with its rows dealt over the cores where it is a scan of fewer splits than there are cores.

    Parquet cannot be split below a row group, so a small file would keep Python work on one core. Inputs with more splits
    than cores, which is every large one, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if _DEALT.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
