"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class body and as plain characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: A table of at most this many rows may be broadcast; larger ones take a shuffled join.
BROADCAST_ROWS = 200_000

#: The C library's call that gives free memory back, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns a Python worker's free memory to the system: one that waits for its next task, which may be
    of a later stage, should hold none."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where a local session has none (tests, a laptop) one is made on this machine and remembered in
    the session, so that all operators of the session use the same folder. On a cluster it must be
    set: executors would write into folders of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("colloquy.shared.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("colloquy.shared.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: a cut of the lineage that
    survives the loss of any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether `df` has at most `rows` rows. Reads no more than that many and one."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if its checked size allows; else as it is, for a shuffled join
    whose skewed partitions adaptive execution splits."""
    return F.broadcast(df) if small_enough(df, rows) else df


def fresh_name(columns: Iterable[str], wanted: str) -> str:
    """`wanted`, with underscores before it until it clashes with no column (case ignored)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. `lower` does it, much faster, where all is ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def zip_hash(a: Column, b: Column) -> Column:
    """Hash of each two elements of two arrays; past the end of the shorter one it hashes nulls."""
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def drop_first(array: Column, n: int) -> Column:
    """The array without its first `n` elements."""
    return F.slice(array, F.lit(n + 1), F.greatest(F.size(array) - n, F.lit(0)))


def drop_last(array: Column, n: int) -> Column:
    """The array without its last `n` elements."""
    return F.slice(array, F.lit(1), F.greatest(F.size(array) - n, F.lit(0)))


def split_words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; empty for null, empty and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE_CLASS}]+"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
