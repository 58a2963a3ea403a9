"""Column profiles that add up: stored sketches per load day, merged for any range of days.

A day's entry for a column holds exact counts, smallest and largest value, a HyperLogLog sketch of the values, a
quantile sketch of their numbers and a sketch of the most frequent ones. All have a fixed size. A profile of a month
merges thirty entries for each column and reads no rows of the table; a day that is delivered again replaces its entries.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polderlake.operators.profiling import metric_changes, volume_changes
from polderlake.session import stored

#: Size parameters. The standard error of distinct counts is about 1.04 / sqrt(2 ** HLL_BITS); ranks are off by about
#: 1.65 / KLL_SIZE; counts of frequent values by about rows / (0.75 * TOP_ITEMS).
HLL_BITS = 12
KLL_SIZE = 400
TOP_ITEMS = 2048
DISTINCT_ERROR = 0.05
RANK_ERROR = 0.02
DAY = "sketch_day"


def _entry(df: DataFrame, name: str) -> dict[str, Column]:
    """One column's aggregates, as text for all types; the quantile sketch only has finite numbers."""
    value, kind = F.col(f"`{name}`"), df.schema[name].dataType
    text = value.cast("string")
    numeric = isinstance(kind, T.NumericType)
    number = value.cast("double") if numeric else F.lit(None).cast("double")
    number = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    return {
        "n_records": F.count(F.lit(1)),
        "n_null": F.count_if(value.isNull()),
        "min_value": F.min(value).cast("string"),
        "max_value": F.max(value).cast("string"),
        "min_number": F.min(number),
        "max_number": F.max(number),
        "distinct_sketch": F.hll_sketch_agg(text, HLL_BITS),
        "quantile_sketch": F.call_function("kll_sketch_agg_double", number, F.lit(KLL_SIZE)),
        "top_sketch": F.expr(f"approx_top_k_accumulate(cast(`{name}` as string), {TOP_ITEMS}) filter (where `{name}` is not null)"),
    }


def sketch_days(df: DataFrame, columns: Sequence[str], day: str) -> DataFrame:
    """(sketch_day, column_name, counts and sketches) for each day and column, from one scan.

    What is shuffled are partial sketches: one set for each task and day, whatever the rows.
    """
    entries = {name: _entry(df, name) for name in columns}
    wide = df.groupBy(F.col(day).alias(DAY)).agg(*[made.alias(f"{name}:{field}") for name, fields in entries.items() for field, made in fields.items()])
    rows = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(isinstance(df.schema[name].dataType, T.NumericType)).alias("numeric"),
            *[F.col(f"`{name}:{field}`").alias(field) for field in fields],
        )
        for name, fields in entries.items()
    ]
    return wide.select(DAY, F.explode(F.array(*rows)).alias("e")).select(DAY, "e.*")


def store_sketches(df: DataFrame, columns: Sequence[str], day: str, path: str) -> None:
    """Add the days of `df` to the stored sketches; days that are there already are replaced as a whole."""
    made = stored(sketch_days(df, columns, day))
    made.repartition(DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def read_sketches(spark: SparkSession, path: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """The entries from `first` to `last`, both included; other days' folders are not opened."""
    entries = spark.read.parquet(path).withColumn(DAY, F.col(DAY).cast("date"))
    if first is not None:
        entries = entries.where(F.col(DAY) >= F.lit(first))
    return entries if last is None else entries.where(F.col(DAY) <= F.lit(last))


def merged_entries(entries: DataFrame, *keys: str) -> DataFrame:
    """Entries with equal `keys` (`column_name`, and days or months, say) as one; merged ones can be merged again."""
    return entries.groupBy(*keys).agg(
        F.any_value("numeric").alias("numeric"),
        F.sum("n_records").alias("n_records"),
        F.sum("n_null").alias("n_null"),
        F.when(~F.any_value("numeric"), F.min("min_value")).otherwise(F.min_by("min_value", "min_number")).alias("min_value"),
        F.when(~F.any_value("numeric"), F.max("max_value")).otherwise(F.max_by("max_value", "max_number")).alias("max_value"),
        F.min("min_number").alias("min_number"),
        F.max("max_number").alias("max_number"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.call_function("kll_merge_agg_double", "quantile_sketch").alias("quantile_sketch"),
        F.call_function("approx_top_k_combine", "top_sketch").alias("top_sketch"),
    )


def sketch_profile(entries: DataFrame, top: int = 3, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The profile that `column_profile` makes of rows, from entries, with quartiles and the most frequent values.

    Counts, extremes and null fractions are exact. `n_distinct`, `quantiles` and `top_values` are estimates within the
    bounds of the module's parameters; a column without numbers has no quantiles.
    """
    whole = merged_entries(entries, "column_name")
    shares = F.array(*[F.lit(float(q)) for q in quantiles])
    counted = F.call_function("kll_sketch_get_n_double", "quantile_sketch") > 0
    return whole.select(
        "column_name",
        "n_records",
        "n_null",
        F.try_divide(F.col("n_null").cast("double"), F.col("n_records")).alias("null_fraction"),
        F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"),
        "min_value",
        "max_value",
        F.when(counted, F.call_function("kll_sketch_get_quantile_double", F.col("quantile_sketch"), shares)).alias("quantiles"),
        F.call_function("approx_top_k_estimate", F.col("top_sketch"), F.lit(top)).alias("top_values"),
    )


def sketch_volume_drift(entries: DataFrame, threshold: float = 0.05) -> DataFrame:
    """`volume_drift` from entries: rows per day are exact, and no row of the table is read."""
    days = entries.groupBy(F.col(DAY).alias("dag")).agg(F.max("n_records").alias("n_records"))
    return volume_changes(days, threshold)


def sketch_null_drift(entries: DataFrame, columns: Sequence[str], id_column: str | None = None, threshold: float = 0.01) -> DataFrame:
    """`null_drift` from entries: exact null fractions, and the estimated number of ids per day."""
    nulls = entries.where(F.col("column_name").isin(*columns)).select(
        F.col(DAY).alias("dag"), F.concat(F.lit("null:"), "column_name").alias("metric"), (F.col("n_null") / F.col("n_records")).alias("value")
    )
    if id_column is not None:
        ids = entries.where(F.col("column_name") == id_column).select(
            F.col(DAY).alias("dag"), F.lit(f"distinct:{id_column}").alias("metric"), F.hll_sketch_estimate("distinct_sketch").cast("double").alias("value")
        )
        nulls = nulls.unionByName(ids)
    return metric_changes(nulls, threshold)


def sketch_drift(entries: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(column_name, sketch_day, n_records, n_distinct, previous, flagged) per day: distinct values that fall or rise.

    The window runs over entries, one for each day and column.
    """
    daily = entries.select("column_name", DAY, "n_records", F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"))
    before = F.lag("n_distinct").over(Window.partitionBy("column_name").orderBy(DAY))
    change = F.try_divide(F.col("n_distinct") - F.col("previous"), F.col("previous").cast("double"))
    return daily.withColumn("previous", before).withColumn("flagged", F.coalesce(F.abs(change) > threshold, F.lit(False)))
