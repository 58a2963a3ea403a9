"""The split path must give the numbers of a plain window, whatever the key sizes and ties."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from polderlake.operators.ranking import heavy_keys, number_rows, split_by_weight, with_neighbour
from polderlake.plans import journey


def skewed(spark, n=600, seed=7):
    """One key (and the null key) holds most rows; values repeat, so order needs the last column."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{rng.randrange(40)}"
        data.append((key, rng.randrange(6), rng.randrange(4), i))
    return spark.createDataFrame(data, "key string, a int, b int, id int")


@pytest.mark.parametrize("heavy_rows", [3, 20, 100, 10_000])
@pytest.mark.parametrize("descending", [False, True])
def test_split_numbers_equal_window_numbers(spark, heavy_rows, descending):
    df = skewed(spark)
    order = [F.desc("a") if descending else F.asc("a"), F.asc("b"), F.asc("id")]
    expected = df.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    actual = number_rows(df, ["key"], order, "n", heavy_rows)
    assert sorted(map(str, actual.collect())) == sorted(map(str, expected.collect()))


def test_null_values_in_the_order_column(spark):
    df = spark.createDataFrame([("k", None if i % 4 == 0 else i % 5, i) for i in range(200)], "key string, a int, id int")
    order = [F.col("a"), F.col("id")]
    expected = df.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    actual = number_rows(df, ["key"], order, "n", 10)
    assert sorted(map(str, actual.collect())) == sorted(map(str, expected.collect()))


def test_two_keys(spark):
    df = skewed(spark).withColumn("other", F.col("b") % 2)
    order = [F.col("a"), F.col("id")]
    expected = df.withColumn("n", F.row_number().over(Window.partitionBy("key", "other").orderBy(*order)))
    actual = number_rows(df, ["key", "other"], order, "n", 25)
    assert sorted(map(str, actual.collect())) == sorted(map(str, expected.collect()))


def test_identical_rows_get_distinct_numbers(spark):
    df = spark.createDataFrame([("k", 1)] * 100, "key string, a int")
    numbers = [r.n for r in number_rows(df, ["key"], [F.col("a")], "n", 10).collect()]
    assert sorted(numbers) == list(range(1, 101))


def test_pieces_split_the_hot_key_over_tasks(spark):
    from polderlake.operators.ranking import number_in_pieces

    df = spark.range(1000).select(F.lit("k").alias("key"), F.col("id").alias("a"))
    numbered = number_in_pieces(df, ["key"], [F.col("a")], "n", 1000, 100)
    assert numbered.select((F.col("n") - 1 == F.col("a")).alias("ok")).filter("not ok").count() == 0


def test_every_key_above_the_limit_is_heavy(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("key"))
    heavy, held = heavy_keys(df, ["key"], 2)
    assert heavy.count() == 5000 and held == 20_000


def test_a_known_bound_saves_the_count(spark):
    df = skewed(spark)
    ordinary, heavy, rows = split_by_weight(df, ["key"], 10**6, at_most=10**6)
    assert ordinary is df and heavy is None and rows == 0
    assert split_by_weight(df, ["key"], 50, at_most=51)[1] is not None


def test_counted_frame_decides(spark):
    df = skewed(spark).dropDuplicates(["key", "a"])
    ordinary, heavy, rows = split_by_weight(df, ["key"], 50, counted=skewed(spark))
    assert heavy is not None and {r.key for r in heavy.select("key").distinct().collect()} == {"hot", None}
    assert ordinary.count() + heavy.count() == df.count()


def test_empty_input(spark):
    df = spark.createDataFrame([], "key string, a int")
    assert number_rows(df, ["key"], [F.col("a")], "n").count() == 0


def test_neighbour_equals_lag_and_lead(spark):
    df = number_rows(skewed(spark), ["key"], [F.col("id")], "n")
    window = Window.partitionBy("key").orderBy("n")
    expected = df.withColumn("before", F.lag("a").over(window)).withColumn("after", F.lead("a").over(window))
    joined = with_neighbour(with_neighbour(df, ["key"], "n", -1, {"before": "a"}), ["key"], "n", 1, {"after": "a"})
    assert sorted(map(str, joined.select(expected.columns).collect())) == sorted(map(str, expected.collect()))


def hot_journey(spark, n=500, seed=3):
    rng = random.Random(seed)
    kinds = [
        ("polisadm", "polisadm.ikv.start", None), ("polisadm", "polisadm.ikv.einde", None), ("zw", "zw.melding", None),
        ("ww", "ww.aanvraag.ingediend", "INGEDIEND"), ("wia", "wia.aanvraag.toegekend_wga", "TOEGEKEND_WGA"),
        ("crm", "crm.contact.mail", None),
    ]
    data = []
    for i in range(n):
        domein, kind, status = rng.choice(kinds)
        at = datetime(2024, 1, 1) + timedelta(days=rng.randrange(60))
        bsn = "900000001" if i % 2 else f"90000{rng.randrange(30):04d}"
        data.append((bsn, at, at.date(), domein, kind, "label", status, None, None, f"ref-{i}"))
    schema = (
        "bsn string, event_ts timestamp, event_date date, domein string, event_type string, event_label string, "
        "event_status string, regio_code string, numeric_value double, source_ref_id string"
    )
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("heavy_rows", [5, 60])
def test_phases_of_a_hot_person(spark, heavy_rows):
    events = hot_journey(spark)
    expected = journey.journey_phases(journey.journey_ranked(events)).collect()
    assert sorted(map(str, journey.phases_of_events(events, heavy_rows=heavy_rows).collect())) == sorted(map(str, expected))
    ranked = journey.journey_ranked(events, heavy_rows)
    assert sorted(map(str, journey.journey_phases(ranked, heavy_rows=heavy_rows).collect())) == sorted(map(str, expected))
