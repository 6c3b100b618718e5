"""Small files and folders in the storage that driver and executors share, through Spark's own file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`. A local session without one (tests, a laptop) gets a folder of its own,
    remembered in the session; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("colloquy.shared.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("colloquy.shared.dir", found)
    return found.rstrip("/")


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def entries(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """Name, bytes and time of change of what is in a folder, or of the one file; empty if there is none."""
    fs, at = _at(spark, folder)
    found = fs.listStatus(at) if fs.exists(at) else []
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that was not there, whole or not at all; False if another writer was first."""
    fs, at = _at(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{at.getParent()}/_{uuid.uuid4().hex}")
    stream = fs.create(aside)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.exists(at) and fs.rename(aside, at):
        return True
    fs.delete(aside, False)
    return False


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` written as Parquet into the shared folder and read back, and where: a cut of the lineage that
    survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
