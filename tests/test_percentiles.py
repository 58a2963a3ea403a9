from __future__ import annotations

import random

import numpy as np
import pytest

from polderlake.operators.percentiles import histogram, percentiles


@pytest.mark.parametrize("heavy_rows", [4, 10_000])
@pytest.mark.parametrize("n", [1, 2, 20, 333])
def test_against_numpy(spark, heavy_rows, n):
    rng = random.Random(n)
    data = [("a" if rng.random() < 0.6 else None, rng.choice([rng.randrange(5), rng.randrange(50)])) for _ in range(n)]
    df = spark.createDataFrame([*data, ("a", None)], "g string, v int")
    counted = histogram(df, ["g"], "v")
    smooth = percentiles(counted, ["g"], {"q1": 0.25, "q2": 0.5, "q9": 0.9}, heavy_rows=heavy_rows).collect()
    steps = percentiles(counted, ["g"], {"q1": 0.07, "q2": 0.5, "q9": 0.95}, False, heavy_rows).collect()
    groups = {g for g, _ in data}
    assert {r.g for r in smooth} == groups == {r.g for r in steps}
    for row in smooth:
        values = [v for g, v in data if g == row.g]
        assert np.allclose([row.q1, row.q2, row.q9], np.quantile(values, [0.25, 0.5, 0.9]))
    for row in steps:
        values = [v for g, v in data if g == row.g]
        assert [row.q1, row.q2, row.q9] == list(np.quantile(values, [0.07, 0.5, 0.95], method="inverted_cdf"))


def test_groups_without_values(spark):
    df = spark.createDataFrame([("a", None)], "g string, v int")
    assert percentiles(histogram(df, ["g"], "v"), ["g"], {"q": 0.5}).count() == 0
