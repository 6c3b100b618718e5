"""Sinks: tables, JSON and text, backups; plans are always computed and written only if asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .files import exists


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Rebuild: every table replaces what was there. `meetings` and what hangs on it are small beside
    `utterances`, which is partitioned by nothing and sorted by meeting within its files."""
    for name, df in tables.items():
        out = df.sortWithinPartitions("meeting_rowid") if "meeting_rowid" in df.columns else df
        out.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def register(tables: dict[str, DataFrame]) -> None:
    """Temp views under the tables' names: the open SQL surface."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def backup(spark: SparkSession, path: str) -> str | None:
    """Copies a file or folder to the first free `<path>.bak<n>`; None if there is nothing."""
    if not exists(spark, path):
        return None
    n = 1
    while exists(spark, f"{path}.bak{n}"):
        n += 1
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.bak{n}")
    files = source.getFileSystem(conf)
    jvm.org.apache.hadoop.fs.FileUtil.copy(files, source, files, target, False, conf)
    return f"{path}.bak{n}"


def write_json(df: DataFrame, folder: str, apply: bool = True) -> DataFrame:
    """One JSON object a line. Without `apply` nothing is written: the rows are the plan."""
    if apply:
        df.write.mode("overwrite").json(folder)
    return df


def write_lines(df: DataFrame, folder: str, key: str) -> None:
    """Text files of `key`, `line`, sorted by `ord`, one folder a key."""
    df.repartition(key).sortWithinPartitions(key, "ord").select(key, "line").write.mode("overwrite").partitionBy(key).text(folder)
