"""Column profiles and drift between days."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_by_key(df: DataFrame, key: str, percent: int) -> DataFrame:
    """A repeatable sample: the same keys in every run, on every cluster size and in every engine that has MD5."""
    draw = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return df.filter(draw % 100 < percent)


def column_profile(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    """(column_name, n_records, n_null, null_fraction, n_distinct, min_value, max_value) per column.

    One scan for all columns. Distinct counts come from sketches of fixed size, so almost nothing is shuffled; `exact`
    ones multiply the rows once per column before the shuffle.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggregates: list[Column] = [F.count(F.lit(1)).alias("n_records")]
    for name in columns:
        aggregates += [
            F.count_if(F.col(name).isNull()).alias(f"{name}__null"),
            distinct(name).alias(f"{name}__distinct"),
            F.min(name).cast("string").alias(f"{name}__min"),
            F.max(name).cast("string").alias(f"{name}__max"),
        ]
    entry = lambda name: F.struct(
        F.lit(name).alias("column_name"),
        F.col(f"{name}__null").alias("n_null"),
        F.col(f"{name}__distinct").alias("n_distinct"),
        F.col(f"{name}__min").alias("min_value"),
        F.col(f"{name}__max").alias("max_value"),
    )
    rows = df.agg(*aggregates).select("n_records", F.explode(F.array(*[entry(c) for c in columns])).alias("e"))
    return rows.select(
        "e.column_name",
        "n_records",
        "e.n_null",
        F.try_divide(F.col("e.n_null").cast("double"), F.col("n_records")).alias("null_fraction"),
        "e.n_distinct",
        "e.min_value",
        "e.max_value",
    )


def top_values(df: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """The most frequent values of a column, ties by value."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(limit)


def value_distribution(df: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """Equal-width histogram between min and max: (bucket, low, high, n); empty buckets are left out."""
    value = F.col(column).cast("double")
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    spread = bounds.select(F.struct("lo", "hi").alias("b")).scalar()
    placed = df.filter(value.isNotNull()).select(value.alias("v"), spread.alias("b"))
    width = (F.col("b.hi") - F.col("b.lo")) / F.lit(buckets)
    bucket = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor(F.try_divide(F.col("v") - F.col("b.lo"), width)) + 1, F.lit(buckets))
    )
    counts = placed.groupBy(bucket.cast("int").alias("bucket"), F.col("b.lo").alias("_lo"), width.alias("_width")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.select(
        "bucket",
        (F.col("_lo") + (F.col("bucket") - 1) * F.col("_width")).alias("low"),
        (F.col("_lo") + F.col("bucket") * F.col("_width")).alias("high"),
        "n",
    )


def _change(current: Column, previous: Column) -> Column:
    return F.try_divide((current - previous).cast("double"), previous.cast("double"))


def volume_drift(df: DataFrame, day: str, threshold: float = 0.05) -> DataFrame:
    """Rows per day, relative change to the previous day present, and whether it exceeds the threshold.

    The window runs over one row per day, not over the table.
    """
    return volume_changes(df.groupBy(F.col(day).alias("dag")).agg(F.count(F.lit(1)).alias("n_records")), threshold)


def volume_changes(days: DataFrame, threshold: float = 0.05) -> DataFrame:
    """`volume_drift` from a frame (dag, n_records) with one row per day."""
    previous = F.lag("n_records").over(Window.partitionBy(F.lit(0)).orderBy("dag"))
    change = days.withColumn("n_previous", previous).withColumn(
        "change", _change(F.col("n_records"), F.col("n_previous"))
    )
    return change.withColumn("flagged", F.coalesce(F.abs("change") > threshold, F.lit(False)))


def null_drift(df: DataFrame, day: str, columns: Sequence[str], id_column: str, threshold: float = 0.01) -> DataFrame:
    """(metric, dag, value, previous, flagged): null fraction per column, and distinct ids per day.

    A null fraction is flagged when it rises by more than the threshold, the id count when it falls.
    """
    fractions: Mapping[str, Column] = {c: F.avg(F.col(c).isNull().cast("double")) for c in columns}
    daily = df.groupBy(F.col(day).alias("dag")).agg(
        *[f.alias(f"null:{c}") for c, f in fractions.items()],
        F.count_distinct(id_column).cast("double").alias(f"distinct:{id_column}"),
    )
    return metric_changes(daily.unpivot("dag", [c for c in daily.columns if c != "dag"], "metric", "value"), threshold)


def metric_changes(long: DataFrame, threshold: float = 0.01) -> DataFrame:
    """`null_drift` from a frame (dag, metric, value) with one row per day and metric."""
    previous = F.lag("value").over(Window.partitionBy("metric").orderBy("dag"))
    compared = long.withColumn("previous", previous)
    rise = F.col("value") - F.col("previous")
    bad = F.when(F.col("metric").startswith("null:"), rise > threshold).otherwise(rise < 0)
    return compared.withColumn("flagged", F.coalesce(bad, F.lit(False)))
