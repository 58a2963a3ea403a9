"""Journey phases kept up by delivery: only persons with new events are folded again.

Events and phases are stored by bucket of the person. A delivery adds its events to the buckets of its persons. A
Bloom filter of these persons then tells, in the touched buckets only, whose stored events are read for a new fold;
all other persons of a bucket keep their stored phases. The folder of each touched bucket is replaced, and those of
untouched buckets are neither read nor written.

A person that the filter lets through by mistake is folded again like the others, with the same result. Repeating a
delivery replaces its own events and gives the same phases, so a run that was lost half way is simply run again.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polderlake.operators.membership import filter_bits, key_filter
from polderlake.operators.ranking import HEAVY_ROWS
from polderlake.plans.journey import EVENT_COLUMNS, PHASES, phases_of_events
from polderlake.session import stored

BUCKETS = 64


@dataclass(frozen=True)
class JourneyStore:
    """Where the events and phases of one journey are kept."""

    path: str
    buckets: int = BUCKETS

    @property
    def events(self) -> str:
        return f"{self.path.rstrip('/')}/events"

    @property
    def phases(self) -> str:
        return f"{self.path.rstrip('/')}/phases"


def _bucket(store: JourneyStore):
    return F.pmod(F.xxhash64("bsn"), F.lit(store.buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _replace(df: DataFrame, path: str, *partitions: str) -> None:
    """Write `df` over exactly the partitions it has rows for, each gathered into files of the advisory size."""
    gathered = df.hint("rebalance", *[F.col(name) for name in partitions])
    gathered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def _buckets_of(df: DataFrame) -> list[int]:
    """The buckets with rows: at most as many numbers as there are buckets."""
    return sorted(row["bucket"] for row in df.select("bucket").distinct().collect())


def _emptied(spark: SparkSession, store: JourneyStore, before: list[int], after: list[int]) -> None:
    """Folders of touched buckets that have no phase any more: a write replaces only what it has rows for."""
    for bucket in set(before) - set(after):
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{store.phases}/bucket={bucket}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def deliver(
    events: DataFrame, store: JourneyStore, delivery: str, rules: Mapping[str, str] = PHASES, heavy_rows: int = HEAVY_ROWS
) -> list[int]:
    """Add the events of one delivery and bring the phases up to date; returns the buckets that were touched.

    Events may be older than stored ones and may come in any order. A delivery of a known name replaces what it
    delivered before: persons that it no longer mentions are folded again as well.
    """
    spark = events.sparkSession
    placed = stored(events.select(*EVENT_COLUMNS).withColumns({"bucket": _bucket(store), "delivery": F.lit(delivery)}))
    concerned = placed.select("bsn", "bucket")
    known = _exists(spark, store.events)
    if known:
        earlier = read_events(spark, store).where(F.col("delivery") == delivery)
        concerned = concerned.unionByName(earlier.select("bsn", "bucket"))
    persons = stored(concerned.distinct())
    touched = _buckets_of(persons)
    if not touched:
        return []
    gone = [b for b in _buckets_of(earlier) if b not in _buckets_of(placed)] if known else []
    _replace(placed, store.events, "bucket", "delivery")
    for bucket in gone:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{store.events}/bucket={bucket}/delivery={delivery}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    held = key_filter(persons, "bsn", bits=filter_bits(persons.count()))
    own = held.may_hold(read_events(spark, store).where(F.col("bucket").isin(touched)), "bsn").where("_held")
    fresh = phases_of_events(own.drop("_held", "bucket", "delivery"), rules, heavy_rows).withColumn("bucket", _bucket(store))
    now = fresh
    before: list[int] = []
    if _exists(spark, store.phases):
        old = read_phases(spark, store).where(F.col("bucket").isin(touched))
        before = _buckets_of(old)
        now = fresh.unionByName(held.may_hold(old, "bsn").where("NOT _held").drop("_held"))
    # The new folders are made of the old ones, so they are written aside first.
    made = stored(now)
    _replace(made, store.phases, "bucket")
    _emptied(spark, store, before, _buckets_of(made))
    return touched


def read_events(spark: SparkSession, store: JourneyStore) -> DataFrame:
    return spark.read.option("basePath", store.events).parquet(store.events).withColumn("bucket", F.col("bucket").cast("int")).withColumn("delivery", F.col("delivery").cast("string"))


def read_phases(spark: SparkSession, store: JourneyStore) -> DataFrame:
    """All phases, with the bucket of their person."""
    return spark.read.parquet(store.phases).withColumn("bucket", F.col("bucket").cast("int"))
