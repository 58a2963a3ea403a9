"""Exact percentiles per group, without gathering a group in one task.

Values are counted first (combined map-side), so repeated values travel once. The percentile is then
the value at which the running count reaches its position; the running count splits a group with
very many distinct values over tasks (`ranking.running_total`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polderlake.operators.ranking import HEAVY_ROWS, running_total
from polderlake.session import freeze


def histogram(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, value, n), stored: several aggregates read it, and `df` is computed once."""
    return freeze(df.groupBy(*groups, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n")))


def _interpolated(share: float) -> Column:
    """Between the two values around position share x (count - 1), counted from 0."""
    position = F.lit(share) * (F.col("_total") - 1)
    at = lambda index: F.max(F.when((F.col("_upto") - F.col("n") <= index) & (index < F.col("_upto")), F.col("value")))
    low, high = at(F.floor(position)).cast("double"), at(F.ceil(position)).cast("double")
    return low + (high - low) * F.max(position - F.floor(position))


def _discrete(share: float) -> Column:
    """The first value at which at least `share` of the rows have been seen."""
    needed = F.lit(Decimal(str(share))) * F.col("_total").cast("decimal(20,0)")
    return F.min(F.when(F.col("_upto").cast("decimal(20,0)") >= needed, F.col("value"))).cast("double")


def percentiles(
    counted: DataFrame,
    groups: Sequence[str],
    shares: Mapping[str, float],
    interpolate: bool = True,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """(groups, one double per share) from a histogram; null values are left out."""
    known = counted.filter(F.col("value").isNotNull())
    seen = running_total(known, groups, [F.col("value")], F.col("n"), "_upto", heavy_rows)
    totals = known.groupBy(*[F.col(g).alias(f"_of_{g}") for g in groups]).agg(F.sum("n").alias("_total"))
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups])
    choose = _interpolated if interpolate else _discrete
    return seen.join(totals, same).groupBy(*groups).agg(*[choose(share).alias(name) for name, share in shares.items()])
