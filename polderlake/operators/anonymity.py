"""Publication of groups that hold at least k rows, each as little generalised as the lattice allows.

Every quasi-identifier has a ladder of generalisations, from the value itself to `*`. A node of the lattice picks a step
for each column. Nodes are tried from the least general on (by the sum of their steps, then by the steps in order): the
rows not published yet are grouped by the node, groups of k rows or more are published, all others go on to the next
node. What is left after the last node is suppressed and only counted. So no published group is below k, and each row
would have been in a group below k at every node before its own.

The work is done on a histogram of the values, and nodes at which not even all rows together reach k anywhere are passed
over; they are found with grouping sets in one scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polderlake.session import freeze

ALL = "*"
#: Nodes that are tried between two stored states.
STEPS_BETWEEN = 4

Ladder = Sequence[Column]


def lattice(ladders: Mapping[str, Ladder]) -> list[tuple[int, ...]]:
    """All nodes, the least general first."""
    return sorted(product(*[range(len(ladder)) for ladder in ladders.values()]), key=lambda node: (sum(node), node))


def _step(column: str, level: int) -> str:
    return f"{column}@{level}"


def _names(ladders: Mapping[str, Ladder], node: Sequence[int]) -> list[str]:
    return [_step(column, level) for column, level in zip(ladders, node, strict=True)]


def histogram_of(df: DataFrame, ladders: Mapping[str, Ladder]) -> DataFrame:
    """One row for each combination of values, with every step of every ladder as text, and its number of rows `n`."""
    steps = {_step(column, level): F.coalesce(value.cast("string"), F.lit("?")) for column, ladder in ladders.items() for level, value in enumerate(ladder)}
    return df.groupBy(*[value.alias(name) for name, value in steps.items()]).agg(F.count(F.lit(1)).alias("n"))


def promising_nodes(histogram: DataFrame, ladders: Mapping[str, Ladder], k: int) -> list[tuple[int, ...]]:
    """Nodes at which some group of all rows has k of them, in the order of the lattice; a number for each node."""
    nodes = lattice(ladders)
    sets = [[F.col(f"`{name}`") for name in _names(ladders, node)] for node in nodes]
    every = list(dict.fromkeys(name for node in nodes for name in _names(ladders, node)))
    totals = histogram.groupingSets(sets, *[F.col(f"`{name}`") for name in every]).agg(
        F.sum("n").alias("total"), *[F.grouping(F.col(f"`{name}`")).alias(f"out:{name}") for name in every]
    )
    used = totals.where(F.col("total") >= k).groupBy(*[F.col(f"`out:{name}`") for name in every]).count().collect()
    found = {frozenset(name for name in every if row[f"out:{name}"] == 0) for row in used}
    return [node for node in nodes if frozenset(_names(ladders, node)) in found]


def assigned(histogram: DataFrame, ladders: Mapping[str, Ladder], k: int) -> DataFrame:
    """The histogram with the `node` at which each combination is published (its steps, comma-joined), or null."""
    state = freeze(histogram.withColumn("node", F.lit(None).cast("string")))
    for at, node in enumerate(promising_nodes(state, ladders, k)):
        names = _names(ladders, node)
        waiting = state.where(F.col("node").isNull())
        groups = waiting.groupBy(*[F.col(f"`{name}`").alias(f"_{i}") for i, name in enumerate(names)]).agg(F.sum("n").alias("_total"))
        large = groups.where(F.col("_total") >= k).drop("_total").withColumn("_node", F.lit(",".join(map(str, node))))
        same = F.lit(True)
        for i, name in enumerate(names):
            same = same & (F.col(f"`{name}`") == F.col(f"_{i}"))
        state = state.join(large, same, "left").withColumn("node", F.coalesce("node", "_node")).drop("_node", *[f"_{i}" for i in range(len(names))])
        if at % STEPS_BETWEEN == STEPS_BETWEEN - 1:
            state = freeze(state)
    return state


def publish_k_anonymous(df: DataFrame, ladders: Mapping[str, Ladder], k: int) -> DataFrame:
    """(node, one generalised text per column, n) for each published group, and one row without a node for what is suppressed.

    `ladders` name the steps of each quasi-identifier as columns of `df`, the value itself first. A null value is `?`.
    Other columns are not published.
    """
    if k < 1 or not ladders:
        raise ValueError("a publication needs a column and a group size of one at least")
    state = assigned(histogram_of(df, ladders), ladders, k)
    shown = []
    for position, (column, ladder) in enumerate(ladders.items()):
        level = F.split("node", ",")[position].cast("int")
        chosen = F.lit(None).cast("string")
        for step in range(len(ladder)):
            chosen = F.when(level == step, F.col(f"`{_step(column, step)}`")).otherwise(chosen)
        shown.append(chosen.alias(column))
    return state.select("node", *shown, "n").groupBy("node", *ladders).agg(F.sum("n").alias("n"))
