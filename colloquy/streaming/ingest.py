"""Transcripts that arrive: each new file is parsed once and appended to Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as t
from ..operators import parse

FILES = "path string, modificationTime timestamp, length long, content binary"


def transcript_stream(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "modificationTime", F.expr("try_validate_utf8(cast(content as string))").alias("content")).filter("content is not null")


def parse_batch(files: DataFrame) -> DataFrame:
    """Utterances of some files, known by path, line and offset."""
    bodies = files.select("path", parse.body(F.col("content")).alias("body"))
    said = parse.utterances(parse.lines(bodies, "path"), "path")
    return said.withColumn("is_generic", t.is_generic(F.col("speaker_raw")))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, processed: DataFrame | None = None) -> StreamingQuery:
    """Appends the utterances of files not seen before to `out`, a folder for each batch, so that a
    batch that is run again replaces its own. processed: `path`s to pass over."""

    def write(batch: DataFrame, number: int) -> None:
        new = batch if processed is None else batch.join(processed.select("path"), "path", "left_anti")
        parse_batch(new).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return transcript_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def talk_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events with `ts` and `event_type` counted by window; rows later than `delay` are not waited for."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
