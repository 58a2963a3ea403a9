"""Treated and control persons of similar age, counted without forming the pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polderlake.operators.ranking import HEAVY_ROWS, running_total


def _histogram(df: DataFrame, keys: Sequence[str], number: str, size: str) -> DataFrame:
    return df.groupBy(*keys, number).agg(F.count(F.lit(1)).alias(size))


def matched_counts(
    treated: DataFrame, control: DataFrame, keys: Sequence[str], number: str = "leeftijd", distance: int = 2
) -> DataFrame:
    """Per key group and whole number of the treated: treated rows, and controls within `distance`.

    `|a - b| <= distance` on whole numbers equals a match with one of 2 x distance + 1 values. Both
    sides shrink to histograms first, so neither a hot key nor the pairs themselves are ever spread
    out: the work after the aggregates depends on distinct (keys, number) only.
    """
    left = _histogram(treated, keys, number, "n_treated")
    shifts = F.sequence(F.col(number) - distance, F.col(number) + distance)
    right = _histogram(control, keys, number, "_n").select(*keys, F.explode(shifts).alias(number), "_n")
    reachable = right.groupBy(*keys, number).agg(F.sum("_n").alias("n_controls"))
    return left.join(reachable, [*keys, number], "inner")


def matched_pairs(
    treated: DataFrame, control: DataFrame, keys: Sequence[str], number: str = "leeftijd", distance: int = 2
) -> DataFrame:
    """Number of (treated, control) pairs that agree on the keys and differ by at most `distance`."""
    groups = matched_counts(treated, control, keys, number, distance)
    pairs: Column = F.coalesce(F.sum(F.col("n_treated") * F.col("n_controls")), F.lit(0))
    return groups.agg(pairs.cast("bigint").alias("n_pairs"))


def matched_counts_real(
    treated: DataFrame,
    control: DataFrame,
    keys: Sequence[str],
    number: str,
    distance: float,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Per key group and number of the treated: treated rows, and controls within `distance`, for numbers of any kind.

    A sweep over both sides in one order. Controls add their count where they stand; a treated number asks twice, just
    before `number - distance` and just after `number + distance`, and the controls in reach are the difference of the
    two running counts. Neither the pairs nor a window of rows is formed, and a hot key is swept in pieces
    (`ranking.running_total`). Rows without a number or a key match nothing; numbers without a control are left out.
    """
    known = [F.col(name).isNotNull() for name in (*keys, number)]

    def counted(df: DataFrame) -> DataFrame:
        for test in known:
            df = df.where(test)
        return df.groupBy(*keys, F.col(number).alias("_number")).agg(F.count(F.lit(1)).alias("_n"))

    left, right = counted(treated), counted(control)
    reach = F.lit(distance)
    asks = F.explode(
        F.array(
            F.struct((F.col("_number") - reach).cast("double").alias("_at"), F.lit(0).alias("_turn"), F.lit(-1).alias("_sign")),
            F.struct((F.col("_number") + reach).cast("double").alias("_at"), F.lit(2).alias("_turn"), F.lit(1).alias("_sign")),
        )
    )
    asked = left.select(*keys, "_number", "_n", asks.alias("a")).select(*keys, "a._at", "a._turn", "a._sign", "_number", "_n", F.lit(0).cast("long").alias("_weight"))
    stood = right.select(
        *keys,
        F.col("_number").cast("double").alias("_at"),
        F.lit(1).alias("_turn"),
        F.lit(0).alias("_sign"),
        F.lit(None).cast(left.schema["_number"].dataType).alias("_number"),
        F.lit(None).cast("long").alias("_n"),
        F.col("_n").alias("_weight"),
    )
    order = [F.col("_at"), F.col("_turn")]
    swept = running_total(asked.unionByName(stood), keys, order, F.col("_weight"), "_upto", heavy_rows)
    found = swept.where("_sign <> 0").groupBy(*keys, F.col("_number").alias(number)).agg(
        F.max("_n").alias("n_treated"), F.sum(F.col("_sign") * F.col("_upto")).alias("n_controls")
    )
    return found.where("n_controls > 0")


def matched_pairs_real(
    treated: DataFrame, control: DataFrame, keys: Sequence[str], number: str, distance: float, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Number of (treated, control) pairs that agree on the keys and differ by at most `distance`."""
    groups = matched_counts_real(treated, control, keys, number, distance, heavy_rows)
    return groups.agg(F.coalesce(F.sum(F.col("n_treated") * F.col("n_controls")), F.lit(0)).cast("bigint").alias("n_pairs"))
