"""Upkeep of stored tables: retention, compaction, freshness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polderlake.sources.tables import DEFAULT_FORMAT, write_path

# ---- retention ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class RetentionRule:
    """Rows older than `years` go; without a date column the table is only flagged."""

    table: str
    date_column: str | None
    years: int
    dry_run: bool = False


def retention_cutoff(as_of: date, years: int) -> Column:
    """The first day that is kept."""
    return F.add_months(F.lit(as_of), -12 * years)


def retention_survivors(df: DataFrame, column: str, years: int, as_of: date) -> DataFrame:
    """Rows that a delete of older rows would leave; rows without a date stay."""
    return df.filter((F.col(column) >= retention_cutoff(as_of, years)) | F.col(column).isNull())


def retention_report(tables: Mapping[str, DataFrame], rules: Sequence[RetentionRule], as_of: date) -> DataFrame:
    """(table_name, date_column, years, would_delete, action) per rule; one count per table with a date."""
    result = None
    for rule in rules:
        labels = [
            F.lit(rule.table).alias("table_name"),
            F.lit(rule.date_column).cast("string").alias("date_column"),
            F.lit(rule.years).alias("years"),
        ]
        df = tables[rule.table]
        if rule.date_column is None:
            row = df.sparkSession.range(1).select(
                *labels, F.lit(None).cast("bigint").alias("would_delete"), F.lit("manual").alias("action")
            )
        else:
            old = F.col(rule.date_column) < retention_cutoff(as_of, rule.years)
            row = df.agg(F.count_if(old).alias("would_delete")).select(
                *labels, "would_delete", F.lit("dry_run" if rule.dry_run else "delete").alias("action")
            )
        result = row if result is None else result.unionByName(row)
    return result


def file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def partition_folders(spark: SparkSession, path: str, column: str) -> dict[str, str]:
    """Value -> folder of the first partition level; one entry per load date."""
    fs, target = file_system(spark, path)
    folders = {}
    for status in fs.listStatus(target):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(f"{column}="):
            folders[name.split("=", 1)[1]] = status.getPath().toString()
    return folders


def delete_path(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)


def drop_expired_partitions(spark: SparkSession, path: str, column: str, years: int, as_of: date) -> list[str]:
    """Retention on the partition column: whole folders go, and no row is read or rewritten."""
    cutoff = spark.range(1).select(retention_cutoff(as_of, years).cast("string")).first()[0]
    expired = {day: folder for day, folder in partition_folders(spark, path, column).items() if day < cutoff}
    for folder in expired.values():
        delete_path(spark, folder)
    return sorted(expired)


def rewrite_survivors(
    spark: SparkSession, path: str, target: str, column: str, years: int, as_of: date,
    partition_by: Sequence[str] = (),
) -> str:
    """Retention on another column: survivors are written beside the table and verified.

    The old files stay until the caller has switched to `target` (`switch_location`).
    """
    kept = retention_survivors(spark.read.format(DEFAULT_FORMAT).load(path), column, years, as_of)
    write_path(kept, target, "errorifexists", partition_by)
    same_content(kept, spark.read.format(DEFAULT_FORMAT).load(target))
    return target


def enforce_retention(
    spark: SparkSession, paths: Mapping[str, str], rules: Sequence[RetentionRule], as_of: date
) -> tuple[DataFrame, dict[str, str]]:
    """Apply the rules to stored tables: (table_name, action, n_deleted) per rule, and each table's path afterwards.

    Without a date column a table is only flagged as manual, and a dry run only counts. Where the date is the first
    partition level, folders go as a whole; else the survivors are written beside the table, verified, and their
    path is returned. The caller switches to that path (`switch_location`) and drops the old one.
    """
    done, now = [], dict(paths)
    for rule in rules:
        path = paths[rule.table]
        if rule.date_column is None:
            done.append((rule.table, "manual", None))
            continue
        df = spark.read.format(DEFAULT_FORMAT).load(path)
        old = df.filter(F.col(rule.date_column) < retention_cutoff(as_of, rule.years)).count()
        if rule.dry_run or old == 0:
            done.append((rule.table, "dry_run" if rule.dry_run else "delete", old))
            continue
        if partition_folders(spark, path, rule.date_column):
            drop_expired_partitions(spark, path, rule.date_column, rule.years, as_of)
        else:
            target = f"{path.rstrip('/')}-kept-{as_of:%Y%m%d}"
            now[rule.table] = rewrite_survivors(spark, path, target, rule.date_column, rule.years, as_of)
        done.append((rule.table, "delete", old))
    return spark.createDataFrame(done, "table_name string, action string, n_deleted bigint"), now


#: Partitions in one statement.
SPECS_AT_ONCE = 500


def _partition_clause(spec: str) -> str:
    """`a=1/b=x%20y` -> `a='1', b='x y'`."""
    parts = []
    for level in spec.split("/"):
        name, value = level.split("=", 1)
        text = unquote(value).replace("'", "\\'")
        parts.append(f"`{name}`=NULL" if value == "__HIVE_DEFAULT_PARTITION__" else f"`{name}`='{text}'")
    return ", ".join(parts)


def switch_location(spark: SparkSession, table: str, location: str) -> None:
    """Point a named table at a new folder; the old files are not touched.

    A partitioned table keeps a location per partition, so these are moved one by one (there is one
    per load date, say). Meanwhile a partition shows its old or its new files, never a mix. Partitions
    that are gone are dropped `SPECS_AT_ONCE` at a time.
    """
    partitioned = not spark.sql(f"DESCRIBE TABLE {table}").filter("col_name = '# Partition Information'").isEmpty()
    known = [row[0] for row in spark.sql(f"SHOW PARTITIONS {table}").collect()] if partitioned else []
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{location}'")
    gone = []
    for spec in known:
        folder = f"{location.rstrip('/')}/{spec}"
        fs, target = file_system(spark, folder)
        if fs.exists(target):
            spark.sql(f"ALTER TABLE {table} PARTITION ({_partition_clause(spec)}) SET LOCATION '{folder}'")
        else:
            gone.append(f"PARTITION ({_partition_clause(spec)})")
    for start in range(0, len(gone), SPECS_AT_ONCE):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {', '.join(gone[start : start + SPECS_AT_ONCE])}")
    if partitioned:
        spark.sql(f"MSCK REPAIR TABLE {table}")
    spark.catalog.refreshTable(table)


# ---- compaction ---------------------------------------------------------------------------------


def content_checksum(df: DataFrame) -> DataFrame:
    """(n_records, checksum), independent of the order of the rows."""
    hashed = F.xxhash64(*[F.col(name) for name in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_records"), F.sum(hashed).alias("checksum"))


def same_content(before: DataFrame, after: DataFrame) -> None:
    """Raise unless both have the same rows, by count and checksum."""
    one, two = content_checksum(before).first(), content_checksum(after).first()
    if one != two:
        raise ValueError(f"rewritten table differs: {one} != {two}")


def compact_path(spark: SparkSession, path: str, target: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Rewrite many small files as few, beside the table, and verify row count and checksum.

    The rebalance hint gathers each partition value into files of the advisory size
    (`spark.sql.adaptive.advisoryPartitionSizeInBytes`): small values are merged, and a value that
    holds most of the table is split over several tasks.
    """
    before = spark.read.format(DEFAULT_FORMAT).load(path)
    gathered = before.hint("rebalance", *[F.col(name) for name in partition_by])
    write_path(gathered, target, "errorifexists", partition_by)
    after = spark.read.format(DEFAULT_FORMAT).load(target)
    same_content(before, after)
    return after


# ---- freshness ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class SourceSla:
    """How a source arrives (streaming, batch, csv_batch) and when its lag is an alert."""

    name: str
    mode: str
    alert_seconds: int


def bronze_freshness(tables: Mapping[str, DataFrame], slas: Sequence[SourceSla], as_of: datetime) -> DataFrame:
    """(source, mode, n_records, max_source_ts, lag_seconds, status) over the last day of each source.

    The date filter prunes the load-date partitions. A streaming source without rows is stale.
    """
    result = None
    for sla in slas:
        since = F.date_sub(F.lit(as_of).cast("date"), 1)
        recent = tables[sla.name].filter(F.col("event_date") >= since)
        seen = recent.agg(F.count(F.lit(1)).alias("n_records"), F.max("source_ts").alias("max_source_ts"))
        lag = F.timestamp_diff("SECOND", F.col("max_source_ts"), F.lit(as_of).cast("timestamp"))
        streaming = F.lit(sla.mode == "streaming")
        status = (
            F.when(streaming & (F.col("n_records") == 0), "stale")
            .when(streaming & (F.col("lag_seconds") > sla.alert_seconds), "late")
            .otherwise("ok")
        )
        row = seen.select(
            F.lit(sla.name).alias("source"), F.lit(sla.mode).alias("mode"), "n_records", "max_source_ts",
            lag.alias("lag_seconds"),
        ).withColumn("status", status)
        result = row if result is None else result.unionByName(row)
    return result
