"""Incremental ingestion of crawl outputs with Structured Streaming.

Crawl outputs arrive as new files (link pages and text pages, JSON lines).
A file-source stream picks up each new file exactly once, applies the same
column-level cleaning as the batch path, and appends parquet; the sink's
commit log plus the checkpoint make a restarted or partially failed run
resume without duplicates or gaps. The batch ranking job then reads the
appended table.

Checkpoints live under the session's ``spark.checkpoint.dir`` (a shared file
system on a cluster) unless the caller passes a location.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webloom import schemas as SC
from webloom.functions import text as TX
from webloom.session import ensure_checkpoint_dir


def _checkpoint(spark: SparkSession, name: str, location: str | None) -> str:
    if location:
        return location
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


def link_page_stream(spark: SparkSession, in_dir: str, files_per_trigger: int | None = None
                     ) -> DataFrame:
    """Stream of link pages ``(url, links, source_file)`` that have a link section."""
    reader = spark.readStream.schema(SC.LINK_PAGE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return (reader.json(in_dir).filter(F.col("links").isNotNull())
            .withColumn("source_file", F.input_file_name()))


def text_page_stream(spark: SparkSession, in_dir: str, files_per_trigger: int | None = None
                     ) -> DataFrame:
    """Stream of text pages ``(url, plaintext, source_file)``, re-cleaned."""
    reader = spark.readStream.schema(SC.TEXT_PAGE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return (TX.with_clean_text(reader.json(in_dir), "plaintext", "plaintext")
            .withColumn("source_file", F.input_file_name()))


def append_parquet(stream: DataFrame, out_dir: str, name: str,
                   checkpoint_location: str | None = None,
                   available_now: bool = True) -> StreamingQuery:
    """Append a stream to parquet; ``available_now`` processes what has landed
    and stops (a scheduled incremental batch), otherwise it keeps running."""
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", _checkpoint(stream.sparkSession, name,
                                                        checkpoint_location))
              .option("path", out_dir))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="1 minute")
    return writer.start()


def ingest_link_pages(spark: SparkSession, in_dir: str, out_dir: str,
                      checkpoint_location: str | None = None) -> StreamingQuery:
    return append_parquet(link_page_stream(spark, in_dir), out_dir, "link_pages",
                          checkpoint_location)


def ingest_text_pages(spark: SparkSession, in_dir: str, out_dir: str,
                      checkpoint_location: str | None = None) -> StreamingQuery:
    return append_parquet(text_page_stream(spark, in_dir), out_dir, "text_pages",
                          checkpoint_location)


def ingest_log(stream: DataFrame, out_dir: str, name: str = "ingest_log",
               checkpoint_location: str | None = None,
               available_now: bool = True) -> StreamingQuery:
    """Per micro-batch, records per source file, written under ``batch_id=N``.

    ``foreachBatch`` overwrites its own batch directory, so a batch replayed
    after a failure replaces its earlier attempt instead of counting twice.
    """
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_records"))
         .write.mode("overwrite").parquet(os.path.join(out_dir, f"batch_id={batch_id}")))

    writer = (stream.writeStream.foreachBatch(write_batch)
              .option("checkpointLocation", _checkpoint(stream.sparkSession, name,
                                                        checkpoint_location)))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="1 minute")
    return writer.start()


def read_ingest_log(spark: SparkSession, out_dir: str) -> DataFrame:
    """The ingest manifest so far: ``(source_file, n_records, batches)``."""
    return (spark.read.parquet(out_dir).groupBy("source_file")
            .agg(F.sum("n_records").alias("n_records"),
                 F.count_distinct("batch_id").alias("batches")))
