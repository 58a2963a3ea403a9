"""Retention that rewrites only the files concerned.

One scan of the date column tells, for each file, how many of its rows have expired. Files without any stay as they
are, with name and time. Files of which all rows have expired go. Of the others the survivors are written aside and
verified; then a journal is written that names what comes and what goes, and is carried out. A run that was lost after
the journal is finished by the next one, a run that was lost before it has changed nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polderlake.sources.tables import DEFAULT_FORMAT
from polderlake.sources.upkeep import file_system, retention_cutoff, same_content

_JOURNAL = "_retention"


def file_counts(spark: SparkSession, path: str, column: str, years: int, as_of: date) -> DataFrame:
    """(file, n_rows, n_expired, first_day, last_day) from a scan of the date column; a row without a date never expires."""
    rows = spark.read.format(DEFAULT_FORMAT).load(path)
    old = F.col(column) < retention_cutoff(as_of, years)
    return rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(old).alias("n_expired"),
        F.min(column).cast("date").alias("first_day"),
        F.max(column).cast("date").alias("last_day"),
    )


@dataclass(frozen=True)
class FileRetention:
    """What one run did."""

    deleted_rows: int
    dropped_files: int
    rewritten_files: int


def retain_by_file(spark: SparkSession, path: str, column: str, years: int, as_of: date) -> FileRetention:
    """Delete the expired rows of the table at `path` in place; only files that hold some are read in full or replaced.

    The driver holds the names of these files, not of all. Partition folders are kept as they are. A reader that must
    never see a table between two states reads it by name and is switched (`switch_location`) instead.
    """
    path = path.rstrip("/")
    finish_retention(spark, path)
    concerned = file_counts(spark, path, column, years, as_of).where("n_expired > 0").collect()
    expired = sum(row["n_expired"] for row in concerned)
    gone = [unquote(row["file"]) for row in concerned]
    partly = [unquote(row["file"]) for row in concerned if row["n_expired"] < row["n_rows"]]
    if not gone:
        return FileRetention(0, 0, 0)
    run = f"{column}-{years}-{as_of:%Y%m%d}"
    moves = _survivors(spark, path, run, partly, column, years, as_of) if partly else []
    _write(spark, f"{path}/{_JOURNAL}/{run}.json", json.dumps({"come": moves, "go": gone}))
    finish_retention(spark, path)
    return FileRetention(expired, len(gone) - len(partly), len(partly))


def _survivors(spark: SparkSession, path: str, run: str, files: list[str], column: str, years: int, as_of: date) -> list[list[str]]:
    """Write the survivors of `files` aside, verified; returns (from, to) of each new file."""
    kept = spark.read.option("basePath", path).format(DEFAULT_FORMAT).load(files)
    kept = kept.where((F.col(column) >= retention_cutoff(as_of, years)) | F.col(column).isNull())
    aside = f"{path}/{_JOURNAL}/{run}"
    levels = _partition_levels(spark, path, files[0])
    writer = kept.hint("rebalance", *[F.col(name) for name in levels]).write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*levels) if levels else writer).parquet(aside)
    same_content(kept, spark.read.schema(kept.schema).parquet(aside))
    system, folder = file_system(spark, aside)
    root = system.makeQualified(folder).toString()
    found, listed = [], system.listFiles(folder, True)
    while listed.hasNext():
        file = listed.next().getPath().toString()
        if file.endswith(".parquet"):
            found.append(file)
    moves = []
    for number, file in enumerate(sorted(found)):
        inside = file[len(root) :].strip("/").rpartition("/")[0]
        moves.append([file, "/".join(x for x in (path, inside, f"part-kept-{run}-{number:05d}.parquet") if x)])
    return moves


def _partition_levels(spark: SparkSession, path: str, file: str) -> list[str]:
    """The partition columns in a file's path below the table's, however the two spell their store."""
    root, inside = (file_system(spark, x)[1].toUri().getPath() for x in (path, file))
    return [part.split("=", 1)[0] for part in inside[len(root) :].strip("/").split("/")[:-1] if "=" in part]


def _write(spark: SparkSession, file: str, text: str) -> None:
    """A small file in one step: written under another name, then named."""
    system, target = file_system(spark, file)
    _, draft = file_system(spark, f"{file}.draft")
    out = system.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not system.rename(draft, target):
        raise OSError(f"could not write {file}")


def finish_retention(spark: SparkSession, path: str) -> int:
    """Carry out the journals that are there, and take them away; returns their number.

    A step that was done before is passed over, so it may be lost and repeated at any point.
    """
    system, folder = file_system(spark, f"{path.rstrip('/')}/{_JOURNAL}")
    if not system.exists(folder):
        return 0
    journals = [entry.getPath() for entry in system.listStatus(folder) if entry.getPath().getName().endswith(".json")]
    for journal in journals:
        lines = spark.read.text(journal.toString(), wholetext=True).first()[0]
        steps = json.loads(lines)
        for source, target in steps["come"]:
            _, old = file_system(spark, source)
            _, new = file_system(spark, target)
            if system.exists(old):
                system.mkdirs(new.getParent())
                if not system.rename(old, new):
                    raise OSError(f"could not move {source} to {target}")
            elif not system.exists(new):
                raise OSError(f"{source} is lost")
        for file in steps["go"]:
            system.delete(file_system(spark, file)[1], False)
        system.delete(journal, False)
    system.delete(folder, True)
    return len(journals)
