"""Connected components of a table of links, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polderlake.session import freeze


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.

    Every node hooks onto its smallest neighbour, the chains of hooks are halved until all point at a root, and the links
    between roots go into the next round. Each table that is joined is a checkpoint, so a hot root is a skewed join that
    Spark splits. The number of rounds grows with the logarithm of the longest chain.
    """
    a, b = F.col(left), F.col(right)
    edges = freeze(links.where(a != b).select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct())
    found = edges.select(F.explode(F.array("low", "high")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        roots = _roots(freeze(edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root"))))
        found = freeze(_moved(found, "component", roots))
        moved = _moved(_moved(edges, "low", roots), "high", roots).where("low <> high")
        edges = freeze(moved.select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")).distinct())
    return found


def _moved(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """`df` with every value of `column` that is hooked onto a root replaced by that root."""
    hooks = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    joined = df.join(hooks, F.col(column) == F.col("_node"), "left")
    return joined.withColumn(column, F.coalesce("_root", column)).drop("_node", "_root")


def _roots(hooks: DataFrame) -> DataFrame:
    while True:
        onward = hooks.select(F.col("node").alias("_node"), F.col("root").alias("_onward"))
        halved = hooks.join(onward, F.col("root") == F.col("_node"), "left")
        hooks = freeze(halved.select("node", F.coalesce("_onward", "root").alias("root"), F.col("_onward").isNotNull().alias("moved")))
        if hooks.where("moved").isEmpty():
            return hooks.drop("moved")
        hooks = hooks.drop("moved")
