"""Sources: transcripts, JSON documents; all optional, none read on the driver."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

CORRUPT = "_corrupt_record"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or anything its pattern fits, is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return bool(found)


def _markdown(spark: SparkSession, corpus: str) -> DataFrame | None:
    """All `transcripts/**/*.md` as binary files under their paths relative to the corpus; None without the folder."""
    folder = f"{corpus}/transcripts"
    if not exists(spark, folder):
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    return files.withColumn("path", F.regexp_extract(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"(transcripts/.*)$", 1))


def transcripts(spark: SparkSession, corpus: str) -> DataFrame:
    """`path` (relative to the corpus) and whole `content` of all `transcripts/**/*.md`, read in
    parallel. Bytes that are no UTF-8 make a file unreadable: `readable` is false and it is skipped
    by what follows."""
    files = _markdown(spark, corpus)
    if files is None:
        return spark.createDataFrame([], "path string, content string, readable boolean")
    text = F.expr("try_validate_utf8(cast(content as string))")
    return files.select("path", text.alias("content"), text.isNotNull().alias("readable"))


def listing(spark: SparkSession, corpus: str) -> DataFrame:
    """`path`, `modified`, `length` of all transcripts; none of them is opened."""
    files = _markdown(spark, corpus)
    if files is None:
        return spark.createDataFrame([], "path string, modified timestamp, length long")
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def contents_since(spark: SparkSession, corpus: str, since: datetime) -> DataFrame:
    """`path`, `content`, `readable` and `digest` (of the bytes) of transcripts modified at `since` or later. The
    condition reaches the source, which does not open the others."""
    files = _markdown(spark, corpus)
    if files is None:
        return spark.createDataFrame([], "path string, content string, readable boolean, digest string")
    text = F.expr("try_validate_utf8(cast(content as string))")
    late = files.filter(F.col("modificationTime") >= F.lit(since))
    return late.select("path", text.alias("content"), text.isNotNull().alias("readable"), F.sha2("content", 256).alias("digest"))


def json_document(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of whole-file JSON documents; none if the path is absent. A document that does not parse
    is a row of nulls with its text in `_corrupt_record`."""
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    if not exists(spark, path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("columnNameOfCorruptRecord", CORRUPT).json(path, multiLine=True)


def section(document: DataFrame, name: str) -> DataFrame:
    """The objects of one array of a document, with their place `pos`."""
    return document.select(F.posexplode(F.col(name)).alias("pos", "o")).select("pos", "o.*")


def recorder_items(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Spoken items of a recorder's transcript: speaker, offset as `m:ss`, text."""
    rows = json_document(spark, path, schema).select(F.posexplode("items").alias("pos", "i")).filter(F.col("i.type") == "transaction")
    return rows.select("pos", F.col("i.speaker").alias("speaker"), offset(F.col("i.start") / 1000).alias("ts"), F.col("i.text").alias("text"))


def speech_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a speech-to-text result: offset as `m:ss`, text."""
    schema = "id string, text string, segments array<struct<start:double,text:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select("id", F.posexplode("segments").alias("pos", "s"))
    return rows.select("id", "pos", offset(F.col("s.start")).alias("ts"), F.trim("s.text").alias("text"))


def offset(seconds: Column) -> Column:
    """Seconds as `m:ss` or `h:mm:ss`."""
    whole = F.floor(seconds).cast("long")
    short = F.format_string("%d:%02d", (whole / 60).cast("long"), whole % 60)
    long = F.format_string("%d:%02d:%02d", (whole / 3600).cast("long"), ((whole % 3600) / 60).cast("long"), whole % 60)
    return F.when(whole >= 3600, long).otherwise(short)
