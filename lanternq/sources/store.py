"""Small files on any file system that Spark can reach."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """The file system of a path, without local checksum files, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if _local(fs):
        try:
            fs = fs.getRawFileSystem()
        except Py4JError:  # has none
            pass
    return fs, at


def _local(fs) -> bool:
    return fs.getUri().getScheme() == "file"


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a file; None where there is none."""
    fs, at = _at(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file beside and put it in place in one step, so that readers see the old or the new content."""
    fs, at = _at(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.draft")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if _local(fs):
        fs.rename(draft, at)  # replaces
        return
    jvm = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    how[0] = jvm.Options.Rename.OVERWRITE
    jvm.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, at, how)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)
