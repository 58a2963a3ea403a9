"""Tables stored in buckets of a key, and joins that use that layout instead of a shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame

from polderlake.sources.tables import DEFAULT_FORMAT, ensure_database

#: Rows of a bucket that a task sorts comfortably.
BUCKET_ROWS = 2_000_000


def bucket_count(rows: int, bucket_rows: int = BUCKET_ROWS, least: int = 8) -> int:
    """A power of two, so that tables of different sizes fit each other: Spark reads the finer one in the coarser's buckets."""
    return max(least, 1 << (ceil(rows / bucket_rows) - 1).bit_length() if rows else 1)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, sort_by: Sequence[str] = ()) -> None:
    """Replace `table` by `df` in `buckets` buckets of `keys`, one sorted file each.

    The rows are dealt out by the hash that names the buckets, so each task writes one file. A bucket is the unit of later
    reads: store one row per key (or few), and aggregate hot keys before they are written.
    """
    if "." in table:
        ensure_database(df.sparkSession, table.rsplit(".", 1)[0])
    writer = df.repartition(buckets, *keys).write.format(DEFAULT_FORMAT).mode("overwrite")
    writer.option("partitionOverwriteMode", "static").bucketBy(buckets, *keys).sortBy(*(sort_by or keys)).saveAsTable(table)


def in_layout(df: DataFrame) -> DataFrame:
    """For the second side of a join on the bucket keys: merge bucket with bucket, whatever the size.

    Without the hint Spark may broadcast a small side or give up the buckets of a large one.
    """
    return df.hint("merge")
