"""Row numbers and neighbours that stay exact when one key holds most of the rows.

A window sends all rows of a key to one task. That is the best plan while every key is of
ordinary size: one shuffle, one sort. For a key above `HEAVY_ROWS` rows the same numbers are made
from range-partitioned pieces: number the rows inside each piece, then add the row count of the
pieces before it. Which way a key goes is decided by counting, and the two results are united.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polderlake.session import freeze, stored

# A window task sorts and spills this many rows comfortably; the bound is per key.
HEAVY_ROWS = 5_000_000


def heavy_keys(df: DataFrame, keys: Sequence[str], heavy_rows: int) -> tuple[DataFrame | None, int]:
    """Keys above the limit (or None) and the number of rows they hold.

    The count is combined map-side, so a hot key travels as one partial count per task.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    above = freeze(counts.filter(F.col("_rows") > heavy_rows))
    held = above.agg(F.sum("_rows").alias("n")).first().n
    return (above.drop("_rows"), held) if held else (None, 0)


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The key columns under other names, so that a frame can be joined with its own summary."""
    return df.withColumnsRenamed({key: f"_key_{key}" for key in keys})


def _same_keys(keys: Sequence[str]) -> Column:
    """Null-safe equality, since a null key can be the hot one."""
    return reduce(and_, [F.col(key).eqNullSafe(F.col(f"_key_{key}")) for key in keys])


def split_by_weight(
    df: DataFrame,
    keys: Sequence[str],
    heavy_rows: int = HEAVY_ROWS,
    counted: DataFrame | None = None,
    at_most: int | None = None,
) -> tuple[DataFrame, DataFrame | None, int]:
    """(ordinary rows, rows of heavy keys or None, number of heavy rows).

    `counted` may name a frame that is cheaper to count and has at least as many rows per key, such
    as the input of the aggregate that made `df`. `at_most` may give a bound on all rows that is known without
    reading them: below the limit no key can be heavy, and nothing is counted. Without `counted` the rows are stored
    first, so that they are made once, however often they are read.
    """
    if at_most is not None and at_most <= heavy_rows:
        return df, None, 0
    if counted is None:
        df = stored(df)
    heavy, held = heavy_keys(df if counted is None else counted, keys, heavy_rows)
    if heavy is None:
        return df, None, 0
    # Spark broadcasts the keys if they are few enough, and splits skewed partitions if not.
    marked = _renamed(heavy, keys)
    return (
        df.join(marked, _same_keys(keys), "left_anti"),
        df.join(marked, _same_keys(keys), "left_semi"),
        held,
    )


def total_in_windows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: Column, name: str
) -> DataFrame:
    """Running total of `weight` by one window: one task per key."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(weight).over(window).cast("bigint"))


def number_in_windows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Row numbers by one window: one task per key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window).cast("bigint"))


def total_in_pieces(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    weight: Column,
    name: str,
    rows: int,
    piece_rows: int,
) -> DataFrame:
    """Running total from range-partitioned pieces of about `piece_rows` rows, `rows` being the row count."""
    pieces = max(2, ceil(rows / piece_rows))
    # Rows equal in every order column are told apart by a hash, so that they can be split as well.
    spread = F.xxhash64(*df.columns)
    placed = freeze(
        df.repartitionByRange(pieces, *keys, *order, spread).withColumns(
            {"_piece": F.spark_partition_id(), "_weight": weight}
        )
    )
    sizes = placed.groupBy(*keys, "_piece").agg(F.sum("_weight").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sizes.select(*keys, "_piece", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    # Pieces are contiguous in key order, so this has at most (pieces + heavy keys) rows.
    offsets = _renamed(earlier, [*keys, "_piece"])
    within = total_in_windows(placed, [*keys, "_piece"], order, F.col("_weight"), "_within")
    return within.join(offsets, _same_keys([*keys, "_piece"]), "inner").select(
        *df.columns, (F.col("_within") + F.col("_before")).cast("bigint").alias(name)
    )


def number_in_pieces(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, rows: int, piece_rows: int
) -> DataFrame:
    """Row numbers from pieces."""
    return total_in_pieces(df, keys, order, F.lit(1), name, rows, piece_rows)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    weight: Column,
    name: str,
    heavy_rows: int = HEAVY_ROWS,
    at_most: int | None = None,
) -> DataFrame:
    """`sum(weight) over (partition by keys order by order rows unbounded preceding)` as bigint."""
    ordinary, heavy, rows = split_by_weight(df, keys, heavy_rows, at_most=at_most)
    totals = total_in_windows(ordinary, keys, order, weight, name)
    if heavy is None:
        return totals
    return totals.unionByName(total_in_pieces(heavy, keys, order, weight, name, rows, heavy_rows))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    heavy_rows: int = HEAVY_ROWS,
    counted: DataFrame | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """`row_number() over (partition by keys order by order)` as bigint column `name`."""
    ordinary, heavy, rows = split_by_weight(df, keys, heavy_rows, counted, at_most)
    numbered = number_in_windows(ordinary, keys, order, name)
    if heavy is None:
        return numbered
    return numbered.unionByName(number_in_pieces(heavy, keys, order, name, rows, heavy_rows))


def with_neighbour(
    df: DataFrame, keys: Sequence[str], rank: str, step: int, columns: dict[str, str]
) -> DataFrame:
    """Add columns of the row `step` ranks away inside the same key (null at the edge).

    Joins on (key, rank): every pair is unique, so a hot key spreads over all tasks, which `lag`
    and `lead` would not do.
    """
    other = df.select(
        *[F.col(key).alias(f"_key_{key}") for key in keys],
        (F.col(rank) - step).alias(f"_key_{rank}"),
        *[F.col(source).alias(name) for name, source in columns.items()],
    )
    return df.join(other, _same_keys([*keys, rank]), "left").select(*df.columns, *columns)
