"""Data-quality checks: failing rows, counts, and many checks in one pass over a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polderlake.functions.identifiers import has_account_checksum, is_nl_iban, is_payroll_number, is_valid_bsn

# ---- failing rows -------------------------------------------------------------------------------


def check_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def check_unique(df: DataFrame, column: str) -> DataFrame:
    """Non-null values that occur more than once, with their number of rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_records"))
    return counts.filter("n_records > 1")


def check_accepted_values(df: DataFrame, column: str, values: Sequence[Any]) -> DataFrame:
    return df.filter(~F.col(column).isin(*values))


def outside_range(column: Column, low: Any = None, high: Any = None) -> Column:
    """True below `low` or above `high`; a missing bound never fails, and null never fails."""
    below = column < low if low is not None else F.lit(False)
    above = column > high if high is not None else F.lit(False)
    return below | above


def check_accepted_range(df: DataFrame, column: str, low: Any = None, high: Any = None) -> DataFrame:
    return df.filter(outside_range(F.col(column), low, high))


def check_relationship(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose non-null key has no parent row."""
    parents = parent.select(F.col(parent_column).alias("_parent"))
    keyed = child.filter(F.col(column).isNotNull())
    return keyed.join(parents, keyed[column] == parents["_parent"], "left_anti")


def check_bsn(df: DataFrame, column: str) -> DataFrame:
    return df.filter(~is_valid_bsn(F.col(column)))


def check_iban(df: DataFrame, column: str) -> DataFrame:
    return df.filter(~is_nl_iban(F.col(column)))


def check_iban_modulus(df: DataFrame, column: str) -> DataFrame:
    """Accounts whose check digits don't fit, of any country; the pattern of one country is `check_iban`."""
    return df.filter(~has_account_checksum(F.col(column)))


def check_payroll_number(df: DataFrame, column: str) -> DataFrame:
    return df.filter(~is_payroll_number(F.col(column)))


def check_row_count(df: DataFrame, low: int = 1, high: int | None = None) -> DataFrame:
    """One row: the row count and whether it lies between the bounds."""
    within = ~outside_range(F.col("n_records"), low, high)
    return df.agg(F.count(F.lit(1)).alias("n_records")).withColumn("passed", within)


def check_column_min_max(
    df: DataFrame, column: str, statistic: str, low: Any = None, high: Any = None
) -> DataFrame:
    """One row: min or max of a column and whether it lies between the bounds (a null passes)."""
    aggregate = {"min": F.min, "max": F.max}[statistic]
    failed = F.coalesce(outside_range(F.col("value"), low, high), F.lit(False))
    return df.agg(aggregate(column).alias("value")).withColumn("passed", ~failed)


# ---- many checks at once ------------------------------------------------------------------------


@dataclass(frozen=True)
class RowCheck:
    """A check decided row by row; `fails` is true for a violating row."""

    name: str
    fails: Column


@dataclass(frozen=True)
class TableCheck:
    """A check decided by one aggregate, which yields the number of failures."""

    name: str
    failures: Column


@dataclass(frozen=True)
class FrameCheck:
    """A check that needs its own shuffle (uniqueness, relationship): the frame of failing rows."""

    name: str
    failing: DataFrame


def duplicates(column: str) -> Column:
    """Rows minus distinct values. Null rows count as duplicates of nothing and so as failures."""
    return F.count(F.lit(1)) - F.count_distinct(column)


def rows_to_long(df: DataFrame, names: Sequence[str], label: str, value: str) -> DataFrame:
    """One row of counts -> one row per count."""
    return df.unpivot([], list(names), label, value)


def run_check_suite(df: DataFrame, checks: Sequence[RowCheck | TableCheck | FrameCheck]) -> DataFrame:
    """(test_name, failures, status) per check.

    All row and table checks come from one scan and one aggregate row; only checks that need a
    shuffle of their own are separate jobs.
    """
    counts: list[Column] = []
    for check in checks:
        if isinstance(check, RowCheck):
            counts.append(F.count_if(check.fails).alias(check.name))
        elif isinstance(check, TableCheck):
            counts.append(F.coalesce(check.failures, F.lit(0)).cast("bigint").alias(check.name))
    names = [check.name for check in checks if not isinstance(check, FrameCheck)]
    parts = [rows_to_long(df.agg(*counts), names, "test_name", "failures")] if names else []
    for check in checks:
        if isinstance(check, FrameCheck):
            parts.append(check.failing.agg(F.lit(check.name).alias("test_name"), F.count(F.lit(1)).alias("failures")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumn("status", F.when(F.col("failures") > 0, "failed").otherwise("passed"))
