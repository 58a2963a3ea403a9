"""Matching at real distances and k-anonymous publication against brute force."""

from __future__ import annotations

import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from polderlake.operators import anonymity, matching

# ---- matching ------------------------------------------------------------------------------------------


def sides(seed):
    draw = random.Random(seed)

    def one(n):
        out = []
        for _ in range(n):
            key = draw.choice(["hot", "hot", "hot", "a", "b", None])
            out.append((key, draw.choice([None, round(draw.uniform(0, 50), 1), float(draw.randrange(50))]), "x"))
        return out

    return one(300), one(400)


def brute_counts(treated, control, distance):
    out = {}
    for (key, number), n in Counter((k, x) for k, x, _ in treated if k is not None and x is not None).items():
        near = sum(k == key and y is not None and number - distance <= y <= number + distance for k, y, _ in control)
        if near:
            out[key, number] = (n, near)
    return out


@pytest.mark.parametrize(("seed", "distance", "heavy_rows"), [(1, 2.5, 5_000_000), (2, 0.0, 5_000_000), (3, 0.3, 40), (4, 7.25, 25)])
def test_counts_in_reach_are_those_of_brute_force(spark, seed, distance, heavy_rows):
    treated, control = sides(seed)
    schema = "k string, x double, other string"
    a, b = spark.createDataFrame(treated, schema), spark.createDataFrame(control, schema)
    found = matching.matched_counts_real(a, b, ["k"], "x", distance, heavy_rows)
    wanted = brute_counts(treated, control, distance)
    assert {(r["k"], r["x"]): (r["n_treated"], r["n_controls"]) for r in found.collect()} == wanted
    pairs = matching.matched_pairs_real(a, b, ["k"], "x", distance, heavy_rows).first()[0]
    assert pairs == sum(n * m for n, m in wanted.values())


def test_whole_numbers_and_empty_sides(spark):
    a = spark.createDataFrame([("k", 30), ("k", 31), ("k", 31)], "k string, x int")
    b = spark.createDataFrame([("k", 29), ("k", 33), ("q", 30)], "k string, x int")
    found = {tuple(r) for r in matching.matched_counts_real(a, b, ["k"], "x", 2).collect()}
    assert found == {tuple(r) for r in matching.matched_counts(a, b, ["k"], "x", 2).select("k", "x", "n_treated", "n_controls").collect()}
    assert matching.matched_pairs_real(a.limit(0), b, ["k"], "x", 2).first()[0] == 0
    assert matching.matched_counts_real(a, b.limit(0), ["k"], "x", 2).count() == 0


def test_no_pairs_are_formed(spark):
    """Ten thousand on ten thousand at one age would be a hundred million pairs."""
    one = spark.range(10_000).select(F.lit("k").alias("k"), F.lit(40.5).alias("x"))
    plan = matching.matched_counts_real(one, one, ["k"], "x", 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    assert matching.matched_pairs_real(one, one, ["k"], "x", 1.0).first()[0] == 10**8


# ---- publication -----------------------------------------------------------------------------------------

LADDERS = {"age": lambda v: ("?" if v is None else str(v), "?" if v is None else str(v // 10 * 10), "*"), "sex": lambda v: (v or "?", "*")}


def persons(seed, n):
    draw = random.Random(seed)
    return [(draw.choice([None, *[int(draw.gauss(45, 12)) for _ in range(9)]]), draw.choice(["M", "M", "V", "V", "V", "X", None])) for _ in range(n)]


def ladders():
    age = F.col("age")
    return {"age": [age, F.floor(age / 10) * 10, F.lit("*")], "sex": [F.col("sex"), F.lit("*")]}


def brute_publication(rows, k):
    """Nodes in order; each publishes the groups of k rows or more among what is left."""
    nodes = sorted(product(range(3), range(2)), key=lambda n: (sum(n), n))
    left, out = list(rows), {}
    # A null has no band and is `*` at the last step only.
    show = lambda row, node: (LADDERS["age"](row[0])[node[0]], LADDERS["sex"](row[1])[node[1]])
    for node in nodes:
        groups = Counter(show(row, node) for row in left)
        for group, n in groups.items():
            if n >= k:
                out[",".join(map(str, node)), *group] = n
        left = [row for row in left if groups[show(row, node)] < k]
    if left:
        out[None, None, None] = len(left)
    return out


@pytest.mark.parametrize(("seed", "n", "k"), [(1, 300, 5), (2, 300, 40), (3, 30, 31), (4, 12, 3), (5, 200, 1)])
def test_publication_is_that_of_brute_force(spark, seed, n, k):
    rows = persons(seed, n)
    df = spark.createDataFrame([(*r, "secret") for r in rows], "age int, sex string, name string")
    found = anonymity.publish_k_anonymous(df, ladders(), k)
    assert found.columns == ["node", "age", "sex", "n"]
    table = {(r["node"], r["age"], r["sex"]): r["n"] for r in found.collect()}
    assert table == brute_publication(rows, k) and sum(table.values()) == n
    assert all(size >= k for (node, *_), size in table.items() if node is not None)
    assert table.get((None, None, None), 0) < k


def test_a_lower_node_would_be_below_k(spark):
    rows, k = persons(6, 250), 12
    df = spark.createDataFrame(rows, "age int, sex string")
    state = [r.asDict() for r in anonymity.assigned(anonymity.histogram_of(df, ladders()), ladders(), k).collect()]
    nodes = [",".join(map(str, node)) for node in anonymity.lattice(ladders())]
    place = {node: i for i, node in enumerate(nodes)}
    for row in state:
        own = place.get(row["node"], len(nodes))
        for earlier in nodes[:own]:
            steps = [f"{c}@{s}" for c, s in zip(ladders(), earlier.split(","), strict=True)]
            waiting = [r for r in state if place.get(r["node"], len(nodes)) >= place[earlier]]
            group = sum(r["n"] for r in waiting if all(r[s] == row[s] for s in steps))
            assert group < k


def test_nodes_without_a_large_group_are_passed_over(spark):
    df = spark.createDataFrame([(i, "M") for i in range(30)], "age int, sex string")
    assert anonymity.promising_nodes(anonymity.histogram_of(df, ladders()), ladders(), 10) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert anonymity.publish_k_anonymous(df.limit(0), ladders(), 10).count() == 0
    with pytest.raises(ValueError, match="group size"):
        anonymity.publish_k_anonymous(df, ladders(), 0)
