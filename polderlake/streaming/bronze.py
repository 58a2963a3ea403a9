"""Event files to bronze tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from polderlake.functions.streams import stream_of_path, table_of_stream
from polderlake.streaming.publish import BATCH, publish_batch, query_identity


def raw_jsonl_stream(spark: SparkSession, root: str, files_per_trigger: int | None = None) -> DataFrame:
    """Every line of every `*.jsonl` file below `root`, with the path of its file."""
    reader = (
        spark.readStream.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    )
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(root).select("value", F.col("_metadata.file_path").alias("source_file"))


def bronze_enrich(lines: DataFrame, root: str) -> DataFrame:
    """Raw text plus stream name, source file, and times. Event time is ingestion time for now."""
    return lines.select(
        F.col("value").alias("payload"),
        stream_of_path(F.col("source_file"), root).alias("stream"),
        "source_file",
        F.current_timestamp().alias("source_ts"),
        F.current_timestamp().alias("ingestion_ts"),
        F.current_date().alias("event_date"),
    )


def route_batch(batch: DataFrame, batch_id: int, base: str, prefix: str, query_id: str = "batch") -> None:
    """Append a micro-batch to its tables with one write; rows of unknown streams are left out.

    A batch that is repeated after a failure leaves no duplicates; see `publish_batch`. Its times are the batch's: Spark
    keeps them with the offsets and gives the same ones when the batch is run again.
    """
    if batch.isEmpty():
        return
    named = batch.withColumn("table_name", table_of_stream(F.col("stream"), prefix))
    known = named.filter(F.col("table_name").isNotNull()).drop("stream")
    publish_batch(known, base, ["table_name", "event_date"], query_id, batch_id)


def route_streams(
    enriched: DataFrame,
    base: str,
    prefix: str,
    checkpoint: str,
    trigger_seconds: int | None = 20,
    report: Callable[[int, DataFrame], None] | None = None,
) -> StreamingQuery:
    """Start the ingest; without a trigger interval it drains the input and stops.

    `report` receives the row counts per stream of each batch, a frame with one row per stream.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        query_id = query_identity(batch.sparkSession, checkpoint)
        route_batch(batch, batch_id, base, prefix, query_id)
        if report is not None:
            report(batch_id, batch.groupBy("stream").count())

    writer = enriched.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if trigger_seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{trigger_seconds} seconds").start()


def bronze_table(spark: SparkSession, base: str, table: str) -> DataFrame:
    """One bronze table; only its own folder is listed."""
    folder = f"{base.rstrip('/')}/table_name={table}"
    return spark.read.option("basePath", folder).parquet(folder).drop(BATCH)
