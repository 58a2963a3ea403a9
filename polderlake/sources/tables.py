"""Writing stored tables, by path and by name."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

DEFAULT_FORMAT = "parquet"


def write_path(
    df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = (), file_format: str = DEFAULT_FORMAT
) -> None:
    writer = df.write.format(file_format).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def pending_path(path: str) -> str:
    """A fresh folder inside the table at `path`, which its readers pass over, for rows that are to join it."""
    return f"{path.rstrip('/')}/_pending-{uuid.uuid4().hex}"


def adopt_path(spark: SparkSession, pending: str, path: str) -> None:
    """Move the files of `pending`, partition folders kept, into the table at `path`: a rename each, as a write's commit does.

    If a file can't be moved, those moved before are taken back. The driver holds the names of the new files.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder, table = hadoop.Path(pending), hadoop.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    root = f"{system.makeQualified(folder).toString()}/"
    places, listed = [], system.listFiles(folder, True)
    while listed.hasNext():
        file = listed.next().getPath()
        if not file.toString().startswith(root):
            raise OSError(f"{file.toString()!r} is not below {root!r}")
        if not file.getName().startswith(("_", ".")):
            places.append((file, hadoop.Path(table, file.toString().removeprefix(root))))
    moved = []
    try:
        for parent in {new.getParent().toString() for _, new in places}:
            system.mkdirs(hadoop.Path(parent))
        for old, new in places:
            if not system.rename(old, new):
                raise OSError(f"{old.toString()!r} was not moved to {new.toString()!r}")
            moved.append(new)
        system.create(hadoop.Path(table, "_SUCCESS"), True).close()
    except Exception:
        for new in moved:
            system.delete(new, False)
        raise
    spark.catalog.refreshByPath(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete the folder at `path`, if there is one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ensure_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{where}")


def write_table(
    df: DataFrame,
    table: str,
    mode: str = "append",
    partition_by: Sequence[str] = (),
    file_format: str = DEFAULT_FORMAT,
) -> None:
    """Batch write to a named table, which is made (with its database) on first use.

    `mode="overwrite"` is the replaced-on-each-run form of the marts.
    """
    if "." in table:
        ensure_database(df.sparkSession, table.rsplit(".", 1)[0])
    writer = df.write.format(file_format).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if mode == "overwrite":
        # A mart is replaced whole, even in a session that overwrites partition by partition.
        writer = writer.option("partitionOverwriteMode", "static")
    writer.saveAsTable(table)


def register_location(spark: SparkSession, table: str, location: str, file_format: str = DEFAULT_FORMAT) -> None:
    """Name an existing folder as a table; a second call only finds new partitions.

    The table is never dropped, so readers do not see a gap.
    """
    if "." in table:
        ensure_database(spark, table.rsplit(".", 1)[0])
    if not spark.catalog.tableExists(table):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} USING {file_format} LOCATION '{location}'")
    detail = spark.sql(f"DESCRIBE TABLE {table}").filter("col_name = '# Partition Information'")
    if not detail.isEmpty():
        spark.sql(f"MSCK REPAIR TABLE {table}")


def write_stream_table(
    df: DataFrame,
    table: str,
    checkpoint: str,
    output_mode: str = "append",
    partition_by: Sequence[str] = (),
    trigger_seconds: int | None = 30,
    file_format: str = DEFAULT_FORMAT,
) -> StreamingQuery:
    """Streaming write to a named table; without a trigger interval it drains the input and stops."""
    if "." in table:
        ensure_database(df.sparkSession, table.rsplit(".", 1)[0])
    writer = df.writeStream.format(file_format).option("checkpointLocation", checkpoint).outputMode(output_mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if trigger_seconds is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.toTable(table)


def refresh_silver(bronze: DataFrame, columns: dict[str, str], path: str | None = None) -> DataFrame:
    """The listed columns (bronze name -> silver name) without exact duplicates, stored when `path` is given."""
    distinct = bronze.selectExpr(*[f"`{old}` as `{new}`" for old, new in columns.items()]).dropDuplicates()
    if path is None:
        return distinct
    write_path(distinct, path, "overwrite")
    return bronze.sparkSession.read.format(DEFAULT_FORMAT).load(path)
