"""The difference of two tables, row by row, found through a tree of checksums.

Rows are dealt by the hash of their key. A node of the tree is a prefix of that hash and holds the number of its rows and
a checksum of them, in any order. Level by level only nodes that differ are opened, and in the end only rows of leaves
that differ are joined. Two equal tables exchange the checksums of the first level and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polderlake.session import freeze

#: Bits of the key's hash that each level of the tree looks at: 256 nodes, then up to 65,536, then up to a million.
LEVELS = (8, 16, 20)


def _hashed(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The rows with the hash of their key and two hashes of all compared columns."""
    own = [F.col(f"`{c}`") for c in columns]
    # Which columns are null goes into the hash: a null alone would leave it as it is.
    nulls = F.concat_ws("", *[F.when(c.isNull(), F.lit("0")).otherwise(F.lit("1")) for c in own])
    return df.select(
        *[F.col(f"`{c}`") for c in dict.fromkeys([*keys, *columns])],
        F.xxhash64(F.lit(7), *[F.col(f"`{k}`") for k in keys]).alias("_place"),
        F.xxhash64(nulls, *own).alias("_one"),
        F.xxhash64(F.lit(1), nulls, *own).alias("_two"),
    )


def _node(bits: int) -> Column:
    return F.shiftrightunsigned("_place", 64 - bits)


def node_checksums(hashed: DataFrame, bits: int) -> DataFrame:
    """(node, n, one, two): sums of the rows' hashes, combined before the shuffle; at most 2 ** bits rows."""
    total = lambda name: F.sum(F.col(name).cast("decimal(38,0)"))
    return hashed.groupBy(_node(bits).alias("node")).agg(F.count(F.lit(1)).alias("n"), total("_one").alias("one"), total("_two").alias("two"))


def differing_nodes(left: DataFrame, right: DataFrame, bits: int) -> DataFrame:
    """The nodes of one level whose rows are not the same on both sides."""
    a = node_checksums(left, bits).withColumnsRenamed({c: f"a_{c}" for c in ("n", "one", "two")})
    b = node_checksums(right, bits).withColumnsRenamed({c: f"b_{c}" for c in ("n", "one", "two")})
    same = [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in ("n", "one", "two")]
    return a.join(b, "node", "full").where(~reduce(and_, same)).select("node")


def _inside(hashed: DataFrame, nodes: DataFrame, bits: int) -> DataFrame:
    """The rows below the given nodes; Spark sends the nodes to the rows where they are few enough."""
    return hashed.join(nodes.select(F.col("node").alias("_open")), _node(bits) == F.col("_open"), "left_semi")


def layer_difference(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, levels: Sequence[int] = LEVELS
) -> DataFrame:
    """(keys, kind, n_left, n_right, changed) for every key whose rows differ between two layers.

    `kind` is `removed` (left only), `added` (right only) or `changed`; `changed` lists the columns that differ where
    the key has one row on each side, else it is null. Keys may repeat and may be null; rows are compared as bags.
    `columns` are those compared, by default all of `left`'s. Both tables are read once for each level that has
    differences above it and once for the join, and never written.
    """
    compared = list(columns if columns is not None else [c for c in left.columns if c not in keys])
    a, b = _hashed(left, keys, compared), _hashed(right, keys, compared)
    for bits in levels:
        nodes = freeze(differing_nodes(a, b, bits))
        if nodes.isEmpty():
            empty = a.limit(0)
            return _compared(empty, b.limit(0), keys, compared)
        a, b = _inside(a, nodes, bits), _inside(b, nodes, bits)
    return _compared(a, b, keys, compared)


def _bags(df: DataFrame, keys: Sequence[str], columns: Sequence[str], side: str) -> DataFrame:
    """One row for each key: how many rows it has, a checksum of them, and one of them."""
    total = lambda name: F.sum(F.col(name).cast("decimal(38,0)"))
    row = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.lit(None).cast("string")
    return df.groupBy(*[F.col(f"`{k}`").alias(f"{side}_{k}") for k in keys]).agg(
        F.count(F.lit(1)).alias(f"n_{side}"), total("_one").alias(f"{side}_one"), total("_two").alias(f"{side}_two"), F.any_value(row).alias(f"{side}_row")
    )


def _compared(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    left, right = _bags(a, keys, columns, "left"), _bags(b, keys, columns, "right")
    joined = left.join(right, reduce(and_, [F.col(f"left_{k}").eqNullSafe(F.col(f"right_{k}")) for k in keys]), "full")
    same = F.col("left_one").eqNullSafe(F.col("right_one")) & F.col("left_two").eqNullSafe(F.col("right_two")) & F.col("n_left").eqNullSafe(F.col("n_right"))
    kind = F.when(F.col("n_right").isNull(), "removed").when(F.col("n_left").isNull(), "added").otherwise("changed")
    names = [F.when(~F.col(f"left_row.{c}").eqNullSafe(F.col(f"right_row.{c}")), F.lit(c)) for c in columns]
    single = (F.col("n_left") == 1) & (F.col("n_right") == 1)
    return joined.where(~same).select(
        *[F.coalesce(f"left_{k}", f"right_{k}").alias(k) for k in keys],
        kind.alias("kind"),
        F.coalesce("n_left", F.lit(0)).alias("n_left"),
        F.coalesce("n_right", F.lit(0)).alias("n_right"),
        F.when(single, F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")).alias("changed"),
    )
