"""CSV uploads dropped into a folder, each taken once.

A batch of uploads is read once: its lines are written aside, and judged there. What is accepted goes to the bronze
table. Refused lines either stop the stream (`watch_incoming`), or go to a table of their own with the reasons
(`watch_with_quarantine`). The load date is the time at which the batch was planned; Spark keeps it with the batch's
offsets, so a batch that is repeated on another day has its first date.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from polderlake.functions.streams import without_scheme
from polderlake.session import stored
from polderlake.sources.csv_files import (
    LINE,
    REASONS,
    CsvColumn,
    CsvFormat,
    add_audit_columns,
    judged_lines,
    lines_of_files,
    within_prefix,
)
from polderlake.streaming.publish import publish_batch, query_identity

#: Seconds after which a file that still has no byte counts as empty, not as one that is being written.
SETTLE_SECONDS = 1.0


def _empty_files(spark: SparkSession, folder: str) -> dict[str, int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    named = {file.getPath().getName(): file.getModificationTime() for file in found if file.isFile() and file.getLen() == 0}
    return {name: at for name, at in named.items() if not name.startswith(("_", "."))}


def files_without_content(spark: SparkSession, folder: str, settle_seconds: float = SETTLE_SECONDS) -> list[str]:
    """Names of the files directly in `folder` that have no byte in two listings; hidden ones don't count."""
    before = _empty_files(spark, folder)
    if not before:
        return []
    time.sleep(settle_seconds)
    after = _empty_files(spark, folder)
    return sorted(name for name, at in before.items() if after.get(name) == at)


def staged_upload(spark: SparkSession, paths: Sequence[str], columns: Sequence[CsvColumn], form: CsvFormat = CsvFormat()) -> DataFrame:
    """The judged lines of some files, stored. The files themselves are read once."""
    lines = stored(lines_of_files(spark, paths, form))
    return stored(judged_lines(lines, columns, form))


def refusals(staged: DataFrame) -> DataFrame:
    """(source_file, rule, n) for each rule that lines of a file break."""
    return staged.select("source_file", F.explode(REASONS).alias("rule")).groupBy("source_file", "rule").agg(F.count(F.lit(1)).alias("n"))


def publish_upload(
    staged: DataFrame,
    columns: Sequence[CsvColumn],
    bronze_path: str,
    quarantine_path: str | None,
    query_id: str,
    batch_id: int,
    taken_at: datetime,
    partition_column: str = "event_date",
) -> None:
    """Accepted lines to the bronze table, refused ones to quarantine, both under one batch identity.

    Each line goes by its reasons to exactly one of the two. A batch that was lost between them is repeated as a whole
    and replaces what it had published.
    """
    audited = add_audit_columns(staged, F.col("source_file"), partition_column, taken_at)
    audit = [name for name in ("ingestion_ts", "source_file", partition_column) if name not in {c.name for c in columns}]
    accepted = audited.where(F.size(REASONS) == 0).select(*[F.col(f"`{c.name}`") for c in columns], *audit)
    publish_batch(accepted, bronze_path, [partition_column], query_id, batch_id)
    if quarantine_path is not None:
        day = F.lit(taken_at).cast("date").alias("refused_on")
        refused = audited.where(F.size(REASONS) > 0).select("source_file", LINE, REASONS, "ingestion_ts", day)
        publish_batch(refused, quarantine_path, ["refused_on"], query_id, batch_id)


def _watch(
    spark: SparkSession, incoming: str, processed: str, checkpoint: str, trigger_seconds: int | None, files_per_trigger: int, take: Callable[[list[str], int, datetime], None]
) -> StreamingQuery:
    """Call `take` with the files of each batch, its number and its time; finished files move to `processed`."""
    # One row per file; the content is not read here.
    arrivals = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("cleanSource", "archive")
        .option("sourceArchiveDir", processed)
        .load(incoming)
        .select("path", F.current_timestamp().alias("taken_at"))
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        # At most `files_per_trigger` rows. Spark passes over files without a byte, so these are looked for.
        empty = files_without_content(spark, incoming)
        if empty:
            raise ValueError(f"non_empty: no content in {empty}")
        rows = batch.collect()
        paths = [unquote(row.path) for row in rows]
        for path in paths:
            if not within_prefix(without_scheme(path), without_scheme(incoming)):
                raise ValueError(f"{path!r} is not below {incoming!r}")
        if paths:
            take(paths, batch_id, rows[0].taken_at)

    writer = arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if trigger_seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{trigger_seconds} seconds").start()


def watch_incoming(
    spark: SparkSession,
    incoming: str,
    processed: str,
    columns: Sequence[CsvColumn],
    bronze_path: str,
    checkpoint: str,
    form: CsvFormat = CsvFormat(),
    partition_column: str = "event_date",
    trigger_seconds: int | None = 120,
    files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Ingest each file of `incoming` once and move finished files to `processed`.

    The checkpoint remembers every file taken, so a restart skips it. The files of a batch are read together and
    checked one by one. An empty file, or one that breaks a constraint, stops the stream; the files of its batch stay
    where they are. The archive step runs when the following batch starts.
    """

    def take(paths: list[str], batch_id: int, taken_at: datetime) -> None:
        staged = staged_upload(spark, paths, columns, form)
        broken = refusals(staged).collect()
        if broken:
            raise ValueError("; ".join(sorted(f"{unquote(row.source_file)}: {row.rule}: {row.n}" for row in broken)))
        publish_upload(staged, columns, bronze_path, None, query_identity(spark, checkpoint), batch_id, taken_at, partition_column)

    return _watch(spark, incoming, processed, checkpoint, trigger_seconds, files_per_trigger, take)


def watch_with_quarantine(
    spark: SparkSession,
    incoming: str,
    processed: str,
    columns: Sequence[CsvColumn],
    bronze_path: str,
    quarantine_path: str,
    checkpoint: str,
    form: CsvFormat = CsvFormat(),
    partition_column: str = "event_date",
    trigger_seconds: int | None = 120,
    files_per_trigger: int = 1000,
) -> StreamingQuery:
    """The same, but lines that break a rule go aside with their reasons, and all others are taken.

    A file without rows is one refused row without a line. Only a file without a byte still stops the stream.
    """

    def take(paths: list[str], batch_id: int, taken_at: datetime) -> None:
        staged = staged_upload(spark, paths, columns, form)
        publish_upload(staged, columns, bronze_path, quarantine_path, query_identity(spark, checkpoint), batch_id, taken_at, partition_column)

    return _watch(spark, incoming, processed, checkpoint, trigger_seconds, files_per_trigger, take)
