"""Compaction along a space-filling curve: rows that are near in several columns at once share files.

Each column is cut at its own quantiles, so a value's place is its rank, whatever the distribution. The bits of the
places are interleaved to one number, the row's position on the Morton curve. A file is a range of the curve that one
prefix of that number names: a box in all columns. Boxes are halved until each has the rows of one file, so dense regions
have small ones. The bounds of a file are narrow in every column, and a filter on any of them passes over most files.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polderlake.sources.tables import DEFAULT_FORMAT, write_path
from polderlake.sources.upkeep import same_content

#: Bits of a column's place on the curve; the cuts are this many quantiles.
RANK_BITS = 8
ACCURACY = 20_000
#: Bits of the curve that boxes may use; the driver holds one count for each cell of this grid.
GRID_BITS = 12


def orderable(df: DataFrame, name: str) -> Column:
    """A long or double that keeps the order of the column. Texts are ordered by their first seven bytes."""
    kind, value = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        digits = F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), 1, 7)), 14, "0")
        return F.conv(digits, 16, 10).cast("long")
    if isinstance(kind, T.BooleanType):
        return value.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp"))
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    raise ValueError(f"column {name!r} of type {kind.simpleString()} has no order to cluster by")


def cut_points(df: DataFrame, columns: Sequence[str], bits: int = RANK_BITS) -> DataFrame:
    """One row with an array of quantiles for each column: 2 ** bits - 1 numbers, from one scan with partial sketches."""
    shares = F.array(*[F.lit((i + 1) / (1 << bits)) for i in range((1 << bits) - 1)])
    return df.agg(*[F.percentile_approx(orderable(df, name), shares, F.lit(ACCURACY)).alias(name) for name in columns])


def place_among(value: Column, cuts: Column, bits: int = RANK_BITS) -> Column:
    """How many cuts are at or below the value, by halving: a fold with one comparison for each bit. A null comes first."""
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(bits))])
    found = F.aggregate(steps, F.lit(0), lambda place, step: F.when(F.element_at(cuts, place + step) <= value, place + step).otherwise(place))
    return F.when(value.isNull(), F.lit(0)).otherwise(found)


def morton(places: Sequence[Column], bits: int = RANK_BITS) -> Column:
    """The bits of all places interleaved, the highest bits first."""
    if bits * len(places) > 62:
        raise ValueError("the curve has at most 62 bits")
    number = F.lit(0).cast("long")
    for bit in range(bits):
        for i, place in enumerate(places):
            one = F.shiftright(place, bit).bitwiseAND(F.lit(1)).cast("long")
            number = number.bitwiseOR(F.shiftleft(one, bit * len(places) + i))
    return number


def boxes(counts: dict[int, int], bits: int, rows: float) -> list[tuple[int, int, int]]:
    """(first cell, last cell, files) of each box: halved while it has more than `rows` rows and more than one cell.

    A single cell beyond that, such as a value that most rows have, gets several files.
    """
    out = []
    todo = [(0, (1 << bits) - 1)]
    ordered = sorted(counts)
    sums = [0]
    for cell in ordered:
        sums.append(sums[-1] + counts[cell])
    while todo:
        low, high = todo.pop()
        n = sums[bisect_right(ordered, high)] - sums[bisect_left(ordered, low)]
        if n > rows and low < high:
            middle = (low + high) // 2
            todo += [(middle + 1, high), (low, middle)]
        elif n:
            out.append((low, high, max(1, ceil(n / rows)) if low == high else 1))
    return out


def along_curve(df: DataFrame, columns: Sequence[str], files: int, bits: int = RANK_BITS) -> DataFrame:
    """`df` in boxes of the curve, one partition each and about `files` of them, sorted along the curve.

    Rows of a cell that has more than one file are dealt out by a hash.
    """
    # 255 numbers for each column, whatever the table.
    cuts = cut_points(df, columns, bits).first()
    placed = df
    for name in columns:
        known = F.array(*[F.lit(x) for x in cuts[name]]) if cuts[name] else None
        placed = placed.withColumn(f"_place_{name}", F.lit(0) if known is None else place_among(orderable(df, name), known, bits))
    names = [f"_place_{name}" for name in columns]
    curve = placed.withColumn("_curve", morton([F.col(name) for name in names], bits)).drop(*names)
    grid = min(GRID_BITS, bits * len(columns))
    cell = F.shiftright("_curve", bits * len(columns) - grid).cast("int")
    counts = {row["cell"]: row["n"] for row in curve.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
    # Halving leaves boxes between a half and the whole of a file's rows.
    found = boxes(counts, grid, 1.4 * sum(counts.values()) / max(files, 1))
    first, spread, at = [0] * (1 << grid), [1] * (1 << grid), 0
    for low, high, n in found:
        first[low : high + 1], spread[low : high + 1] = [at] * (high - low + 1), [n] * (high - low + 1)
        at += n
    of_cell = lambda numbers: F.element_at(F.lit(numbers), cell + 1)
    hashed = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), of_cell(spread)).cast("int")
    dealt = curve.withColumn("_file", (of_cell(first) + hashed).cast("int")).repartitionById(max(at, 1), F.col("_file"))
    return dealt.sortWithinPartitions("_curve").drop("_curve", "_file")


def compact_clustered(spark: SparkSession, path: str, target: str, columns: Sequence[str], files: int, bits: int = RANK_BITS) -> DataFrame:
    """Rewrite a table beside itself in about `files` files along the curve of `columns`, and verify count and checksum."""
    before = spark.read.format(DEFAULT_FORMAT).load(path)
    write_path(along_curve(before, columns, files, bits), target, "errorifexists")
    after = spark.read.format(DEFAULT_FORMAT).load(target)
    same_content(before, after)
    return after


def file_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(file, n, smallest and largest value of each column): what a reader knows of a file before it opens it."""
    bounds = [f(name).alias(f"{label}_{name}") for name in columns for label, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"), *bounds)
