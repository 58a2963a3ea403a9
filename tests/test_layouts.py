"""Stored layouts and what is kept up by parts: plans, files that stay, and comparison with whole runs."""

from __future__ import annotations

import json
import os
import random
from collections import Counter
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from polderlake.operators import difference, membership, sketches
from polderlake.plans import clients, journey, journey_refresh, person_store, quality
from polderlake.sources import buckets, clustering, retention_files, tables
from polderlake.streaming import journey_stream

NOW = datetime(2024, 1, 31)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ---- buckets ---------------------------------------------------------------------------------------


def entities(spark):
    draw = random.Random(3)
    persons = [f"9{i:08d}" for i in range(400)]
    persona = [(b, f"v{i}", "a", draw.choice("MVX?"), date(1980, 1, 1), None, i, "1000AB", "w", "n") for i, b in enumerate(persons)]
    hot = persons[0]
    jobs = [(draw.choice([hot, hot, *persons[:300]]), draw.random() < 0.7, draw.choice([None, 100, 30_000])) for _ in range(3000)]
    ww = [(draw.choice(persons), draw.choice(["TOEGEKEND", "AFGEWEZEN", "IN_BEHANDELING"])) for _ in range(500)]
    wia = [(draw.choice(persons), draw.choice(["TOEGEKEND_WGA", "INGEDIEND"]), draw.choice([None, 40, 80])) for _ in range(300)]
    crm = [(draw.choice(persons), NOW - timedelta(days=draw.randrange(60))) for _ in range(900)]
    return {
        "persona": spark.createDataFrame(
            persona,
            "bsn string, voornaam string, achternaam string, geslacht string, geboortedatum date, straat string, huisnummer int, postcode string, woonplaats string, nationaliteit string",
        ),
        "employment": spark.createDataFrame(jobs, "bsn string, is_lopend boolean, loon_bruto_jaar int"),
        "ww": spark.createDataFrame(ww, "bsn string, status string"),
        "wia": spark.createDataFrame(wia, "bsn string, status string, arbeidsongeschikt_pct int"),
        "crm": spark.createDataFrame(crm, "bsn string, contact_ts timestamp"),
    }


@pytest.fixture(scope="module")
def store(spark):
    parts = entities(spark)
    person_store.write_person_store(parts, "persons_test", NOW)
    return parts, person_store.person_store(spark, "persons_test")


def test_bucketed_marts_equal_those_of_the_rows(spark, store, rows):
    parts, kept = store
    ordered = [parts[name] for name in ("persona", "employment", "ww", "wia", "crm")]
    assert rows(person_store.client_360(kept)) == rows(clients.client_360(*ordered, as_of=NOW))
    persona = clients.persona_pseudonymized(parts["persona"], "salt", date(2024, 1, 1))
    assert rows(person_store.effect_panel(kept, "salt", date(2024, 1, 1))) == rows(clients.effect_panel(persona, parts["ww"], parts["wia"], parts["employment"]))
    assert rows(clients.income_of(kept["jobs"])) == rows(clients.household_income(parts["employment"]))


def test_bucketed_marts_have_no_exchange(store):
    _, kept = store
    for mart in (person_store.client_360(kept), person_store.effect_panel(kept, "salt", date(2024, 1, 1))):
        plan = plan_of(mart)
        assert plan.count("SortMergeJoin") >= 3 and "Exchange" not in plan and "Bucketed: true" in plan


def test_the_report_on_a_bucketed_mart_only_gathers_totals(store):
    _, kept = store
    _, _, checks = quality._rules()["uc05"]
    report = person_store.client_360(kept).agg(*[violations.alias(name) for name, (_, violations) in checks.items()])
    plan = plan_of(report)
    assert "hashpartitioning" not in plan and plan.count("Exchange") == 1 and "SinglePartition" in plan


def test_each_bucket_is_one_file_and_a_hot_person_one_row(spark, store):
    _, kept = store
    for name in person_store.PARTS:
        files = kept[name].select(F.input_file_name().alias("f"), "bsn").groupBy("f").agg(F.count("*").alias("n"))
        assert files.count() <= 8
        assert kept[name].count() == kept[name].select("bsn").distinct().count()


def test_bucket_counts_are_powers_of_two():
    assert [buckets.bucket_count(n, 100) for n in (0, 1, 800, 801, 5000)] == [8, 8, 8, 16, 64]


# ---- membership ------------------------------------------------------------------------------------


def test_a_key_filter_never_loses_a_key(spark):
    known = spark.createDataFrame([(f"k{i}",) for i in range(3000)] + [(None,)], "k string")
    held = membership.key_filter(known, "k", bits=membership.filter_bits(3001))
    assert held.may_hold(known, "k").where("NOT _held").count() == 0
    other = spark.createDataFrame([(f"x{i}",) for i in range(3000)], "k string")
    assert held.may_hold(other, "k").where("_held").count() < 60
    assert held.may_hold(known.limit(0), "k").count() == 0
    empty = membership.key_filter(known.limit(0), "k", bits=4096)
    assert empty.may_hold(known, "k").where("_held").count() == 0
    assert membership.filter_bits(10**12) == membership.FILTER_BITS


# ---- journey by delivery -----------------------------------------------------------------------------

TYPES = ["polisadm.ikv.start", "polisadm.ikv.einde", "zw.melding", "ww.aanvraag.toegekend", "crm.contact.web", "wajong.dossier.geopend"]


def journey_events(spark, persons, n, seed, first=0):
    draw = random.Random(seed)
    made = []
    for i in range(n):
        at = datetime(2020, 1, 1) + timedelta(hours=draw.randrange(20_000))
        made.append((draw.choice(persons), at, at.date(), draw.choice(["a", "b"]), draw.choice(TYPES), "label", None, None, None, f"r{first + i}"))
    schema = "bsn string, event_ts timestamp, event_date date, domein string, event_type string, event_label string, event_status string, regio_code string, numeric_value double, source_ref_id string"
    return spark.createDataFrame(made, schema)


def files_below(path) -> dict[str, int]:
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


@pytest.mark.parametrize("heavy_rows", [5_000_000, 40])
def test_deliveries_give_the_phases_of_all_events(spark, tmp_path, rows, heavy_rows):
    store = journey_refresh.JourneyStore(str(tmp_path / "j"), buckets=8)
    people = [f"p{i}" for i in range(60)]
    parts = [journey_events(spark, people, 500, 1), journey_events(spark, people[:6], 60, 2, 500), journey_events(spark, ["new1", "p3"], 20, 3, 560)]
    told = None
    for i, part in enumerate(parts):
        touched = journey_refresh.deliver(part, store, f"d{i}", heavy_rows=heavy_rows)
        told = part if told is None else told.unionByName(part)
        assert 0 < len(touched) <= 8
        assert rows(journey_refresh.read_phases(spark, store).drop("bucket")) == rows(journey.phases_of_events(told))


def test_untouched_buckets_keep_their_files(spark, tmp_path, rows):
    store = journey_refresh.JourneyStore(str(tmp_path / "j"), buckets=16)
    first = journey_events(spark, [f"p{i}" for i in range(80)], 600, 4)
    journey_refresh.deliver(first, store, "one")
    before = files_below(store.phases)
    second = journey_events(spark, ["p5", "p6"], 10, 5, 600)
    touched = journey_refresh.deliver(second, store, "two")
    after = files_below(store.phases)
    assert 1 <= len(touched) <= 2
    for file, time in before.items():
        inside = int(file.split("bucket=")[1].split("/")[0]) in touched
        assert (after.get(file) == time) != inside
    # The same delivery once more changes nothing, an empty one neither.
    journey_refresh.deliver(second, store, "two")
    assert journey_refresh.deliver(second.limit(0), store, "three") == []
    assert rows(journey_refresh.read_phases(spark, store).drop("bucket")) == rows(journey.phases_of_events(first.unionByName(second)))


def test_a_delivery_that_is_sent_again_replaces_itself(spark, tmp_path, rows):
    store = journey_refresh.JourneyStore(str(tmp_path / "j"), buckets=4)
    first = journey_events(spark, [f"p{i}" for i in range(20)], 200, 6)
    journey_refresh.deliver(first, store, "one")
    journey_refresh.deliver(journey_events(spark, ["q1", "q2", "p1"], 30, 7, 200), store, "two")
    corrected = journey_events(spark, ["p1"], 12, 8, 300)
    journey_refresh.deliver(corrected, store, "two")
    assert rows(journey_refresh.read_phases(spark, store).drop("bucket")) == rows(journey.phases_of_events(first.unionByName(corrected)))


# ---- phases on a stream --------------------------------------------------------------------------------


def test_stream_of_phases_equals_the_fold_and_survives_restarts(spark, tmp_path, rows):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "log", "checkpoint"))
    events = journey_events(spark, [f"p{i}" for i in range(12)], 300, 9).where("event_ts < timestamp '2022-01-01'")
    arrival = F.date_add(F.to_date("event_ts"), F.pmod(F.xxhash64("source_ref_id"), F.lit(9)).cast("int"))
    for low, high in (("2019-01-01", "2020-08-01"), ("2020-08-01", "2021-03-01"), ("2021-03-01", "2030-01-01")):
        events.where((arrival >= low) & (arrival < high)).write.mode("append").parquet(source)
        journey_stream.phase_stream(spark.readStream.schema(events.schema).parquet(source), target, checkpoint, "10 days", trigger_seconds=None).awaitTermination()
    open_before = journey_stream.current_phases(spark.read.parquet(target))
    assert open_before.where("is_lopend").count() > 0
    clock = journey_events(spark, ["clock"], 1, 1).withColumn("event_ts", F.lit("2023-01-01").cast("timestamp")).withColumn("event_type", F.lit("crm.contact.web"))
    clock.write.mode("append").parquet(source)
    for _ in range(2):  # the second run finds nothing new
        journey_stream.phase_stream(spark.readStream.schema(events.schema).parquet(source), target, checkpoint, "10 days", trigger_seconds=None).awaitTermination()
    assert rows(journey_stream.current_phases(spark.read.parquet(target))) == rows(journey.phases_of_events(events))
    late = journey_events(spark, ["p1"], 1, 1).withColumn("event_ts", F.lit("2020-02-02").cast("timestamp")).withColumn("event_type", F.lit("zw.melding"))
    late.write.mode("append").parquet(source)
    journey_stream.phase_stream(spark.readStream.schema(events.schema).parquet(source), target, checkpoint, "10 days", trigger_seconds=None).awaitTermination()
    assert rows(journey_stream.current_phases(spark.read.parquet(target))) == rows(journey.phases_of_events(events)), "later than the watermark"


def test_persons_share_state_keys_and_are_folded_alone(spark, tmp_path, rows):
    """Many persons and one with more openings than an element of state holds: keys grow with the groups, not the persons."""
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "log", "checkpoint"))
    one = journey_events(spark, ["hot"], 2 * journey_stream.CHUNK + 500, 21, 10_000).withColumn("event_type", F.when(F.rand(3) < 0.5, "zw.melding").otherwise("polisadm.ikv.start"))
    events = journey_events(spark, [f"p{i}" for i in range(150)], 900, 20).unionByName(one)
    events = events.withColumn("source_ref_id", F.when(F.col("source_ref_id").endswith("7"), None).otherwise(F.col("source_ref_id"))).localCheckpoint()
    early = F.col("event_ts") < "2020-06-01"
    # The clock names no person and opens no phase; it still moves the watermark.
    end = events.agg((F.max("event_ts") + F.expr("INTERVAL 40 DAYS")).alias("event_ts"))
    clock = end.select(*[F.col(c) if c == "event_ts" else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns])
    keys = []
    for part in (events.where(early), events.where(~early), clock):
        part.write.mode("append").parquet(source)
        query = journey_stream.phase_stream(spark.readStream.schema(events.schema).parquet(source), target, checkpoint, "10 days", trigger_seconds=None, groups=3)
        query.awaitTermination()
        keys.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert rows(journey_stream.current_phases(spark.read.parquet(target))) == rows(journey.phases_of_events(events))
    assert max(keys) < 50, "fewer than the persons"


def test_a_clock_without_a_person_closes_the_last_openings(spark, tmp_path, rows):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "log", "checkpoint"))
    events = journey_events(spark, ["p1", "p2"], 60, 22).withColumn("event_type", F.lit("zw.melding"))
    clock = events.agg((F.max("event_ts") + F.expr("INTERVAL 60 DAYS")).alias("event_ts"))
    full = clock.select(*[F.col(c) if c == "event_ts" else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns])
    last = events.orderBy(F.desc("event_ts")).limit(1).withColumns({"bsn": F.lit("p3"), "source_ref_id": F.lit("last")})
    whole = events.unionByName(last).localCheckpoint()
    for part in (whole, full):
        part.write.mode("append").parquet(source)
        journey_stream.phase_stream(spark.readStream.schema(events.schema).parquet(source), target, checkpoint, trigger_seconds=None).awaitTermination()
    assert rows(journey_stream.current_phases(spark.read.parquet(target))) == rows(journey.phases_of_events(whole))


# ---- sketches ------------------------------------------------------------------------------------------


def sketch_rows(spark, n=20_000):
    return spark.range(n).select(
        F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 20).cast("int")).alias("dag"),
        F.concat(F.lit("v"), (F.col("id") * 7919 % 9000).cast("string")).alias("many"),
        F.when(F.col("id") % 3 == 0, "often").when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("w"), F.col("id") % 40)).alias("few"),
        F.when(F.col("id") % 11 > 0, F.col("id") * 37 % 5000).alias("number"),
        F.lit(None).cast("double").alias("nothing"),
    )


def test_merged_sketches_are_within_their_bounds(spark, tmp_path):
    path, df = str(tmp_path / "s"), sketch_rows(spark)
    names = ["many", "few", "number", "nothing"]
    for low in (1, 8, 15):
        sketches.store_sketches(df.where((F.dayofmonth("dag") >= low) & (F.dayofmonth("dag") < low + 7)), names, "dag", path)
    first, last = date(2024, 1, 3), date(2024, 1, 17)
    found = {r["column_name"]: r for r in sketches.sketch_profile(sketches.read_sketches(spark, path, first, last), top=2).collect()}
    own = df.where(F.col("dag").between(first, last))
    for name in names:
        values = [r[0] for r in own.select(name).collect()]
        known = sorted(v for v in values if v is not None)
        row = found[name]
        assert (row["n_records"], row["n_null"]) == (len(values), len(values) - len(known))
        assert abs(row["n_distinct"] - len(set(known))) <= sketches.DISTINCT_ERROR * len(set(known)) + 1
        assert (row["min_value"], row["max_value"]) == ((str(known[0]), str(known[-1])) if known else (None, None))
        if name == "number":
            for share, value in zip((0.25, 0.5, 0.75), row["quantiles"], strict=True):
                under, upto = sum(v < value for v in known) / len(known), sum(v <= value for v in known) / len(known)
                assert under - sketches.RANK_ERROR <= share <= upto + sketches.RANK_ERROR
        else:
            assert row["quantiles"] is None
    assert found["few"]["top_values"][0]["item"] == "often"
    most = Counter(r[0] for r in own.select("few").collect())["often"]
    assert abs(found["few"]["top_values"][0]["count"] - most) <= 20_000 / (0.75 * sketches.TOP_ITEMS)


def test_a_day_that_comes_again_replaces_its_sketches(spark, tmp_path):
    path, df = str(tmp_path / "s"), sketch_rows(spark, 2000)
    sketches.store_sketches(df, ["few"], "dag", path)
    before = files_below(path)
    sketches.store_sketches(df.where(F.col("dag") == "2024-01-05").limit(10), ["few"], "dag", path)
    after = files_below(path)
    assert {f for f in before if before[f] != after.get(f)} == {f for f in before if "2024-01-05" in f}
    entries = sketches.read_sketches(spark, path)
    assert entries.where("sketch_day = '2024-01-05'").first()["n_records"] == 10
    assert entries.agg(F.sum("n_records")).first()[0] == 1910


def test_profiles_read_no_rows_and_can_be_merged_twice(spark, tmp_path):
    df = sketch_rows(spark, 5000)
    path = str(tmp_path / "s")
    sketches.store_sketches(df, ["many", "number"], "dag", path)
    entries = sketches.read_sketches(spark, path)
    halves = sketches.merged_entries(entries.withColumn("half", F.dayofmonth("sketch_day") <= 10), "column_name", "half").drop("half")
    one = {r["column_name"]: r["n_records"] for r in sketches.sketch_profile(halves).collect()}
    assert one == {"many": 5000, "number": 5000}
    assert plan_of(sketches.sketch_profile(entries)).count("Scan parquet") == 1 and all(path in f for f in entries.inputFiles())
    few = sketches.read_sketches(spark, path, date(2024, 1, 2), date(2024, 1, 3))
    assert "PartitionFilters: [isnotnull" in plan_of(few)


def test_drift_flags_days_with_other_values(spark):
    rows = [(date(2024, 1, 1 + d), f"v{i}") for d in range(4) for i in range(50 if d == 2 else 200)]
    entries = sketches.sketch_days(spark.createDataFrame(rows, "dag date, v string"), ["v"], "dag")
    flags = {r["sketch_day"].day: r["flagged"] for r in sketches.sketch_drift(entries).collect()}
    assert flags == {1: False, 2: False, 3: True, 4: True}


# ---- files along a curve -----------------------------------------------------------------------------


def test_places_and_curve(spark):
    rows = spark.createDataFrame([(x,) for x in (None, -1.0, 0.0, 0.5, 1.0, 2.5, 9.0)], "x double")
    cuts = F.array(*[F.lit(float(c)) for c in (0, 1, 1, 2, 3, 4, 5)])
    found = [r[0] for r in rows.select(clustering.place_among(F.col("x"), cuts, 3)).collect()]
    assert found == [0, 0, 1, 1, 3, 4, 7]
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(4)], "a int, b int")
    wanted = {(a, b): (a & 1) | (b & 1) << 1 | (a >> 1 & 1) << 2 | (b >> 1 & 1) << 3 for a in range(4) for b in range(4)}
    assert {(r[0], r[1]): r[2] for r in pairs.select("a", "b", clustering.morton([F.col("a"), F.col("b")], 2)).collect()} == wanted
    with pytest.raises(ValueError, match="62 bits"):
        clustering.morton([F.col("a")] * 8, 8)


def test_filters_on_either_column_open_few_files(spark, tmp_path):
    draw = random.Random(5)
    rows = [(draw.choice([None, draw.randrange(10**6)]) if i % 50 == 0 else int(draw.paretovariate(1) * 100), f"{draw.randrange(10**5):05d}", i) for i in range(20_000)]
    path, target = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame(rows, "skewed long, name string, id long").repartition(5).write.parquet(path)
    after = clustering.compact_clustered(spark, path, target, ["skewed", "name"], 64)
    bounds = clustering.file_bounds(after, ["skewed", "name"]).collect()
    assert 48 <= len(bounds) <= 100 and sum(b["n"] for b in bounds) == 20_000
    assert max(b["n"] for b in bounds) <= 1.5 * 20_000 / 64
    for name, low, high in (("skewed", 200, 215), ("name", "50000", "52000")):
        opened = sum(b[f"min_{name}"] is not None and b[f"min_{name}"] <= high and b[f"max_{name}"] >= low for b in bounds)
        assert 4 * opened <= len(bounds), name


def test_boxes_hold_all_cells_once():
    draw = random.Random(1)
    counts = {c: draw.randrange(1, 400) for c in draw.sample(range(256), 90)} | {77: 5000}
    found = clustering.boxes(counts, 8, 300)
    held = [c for low, high, _ in found for c in range(low, high + 1) if c in counts]
    assert sorted(held) == sorted(counts)
    for low, high, files in found:
        n = sum(counts.get(c, 0) for c in range(low, high + 1))
        assert n <= 300 * files and (files == 1 or low == high) and (high - low + 1) & (high - low) == 0
    assert clustering.boxes({}, 8, 10) == []


def test_a_value_that_most_rows_have_fills_several_files(spark, tmp_path):
    df = spark.range(8000).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("x"), F.lit("same").alias("y"), "id")
    tables.write_path(df, str(tmp_path / "a"))
    after = clustering.compact_clustered(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["x", "y"], 16)
    assert max(r["n"] for r in clustering.file_bounds(after, ["x"]).collect()) < 1200
    empty = df.limit(0)
    tables.write_path(empty, str(tmp_path / "c"))
    assert clustering.compact_clustered(spark, str(tmp_path / "c"), str(tmp_path / "d"), ["x"], 4).count() == 0


# ---- retention by file ---------------------------------------------------------------------------------


def dated_table(spark, path, partition_by=()):
    days = [(date(2000, 1, 1) + timedelta(days=i * 20) if i % 37 else None, i, "a b" if i % 2 else "c=d") for i in range(400)]
    df = spark.createDataFrame(days, "dag date, id long, soort string")
    tables.write_path(df.repartitionByRange(8, "id"), path, partition_by=partition_by)
    return df


@pytest.mark.parametrize(("partition_by", "store"), [((), ""), (("soort",), ""), (("soort",), "file:"), (("soort",), "file://")])
def test_only_files_with_expired_rows_are_replaced(spark, tmp_path, rows, partition_by, store):
    place = str(tmp_path / "t")
    path = store + place
    df = dated_table(spark, path, partition_by)
    counts = {r["file"]: r for r in retention_files.file_counts(spark, path, "dag", 10, date(2020, 1, 1)).collect()}
    before = files_below(place)
    done = retention_files.retain_by_file(spark, path, "dag", 10, date(2020, 1, 1))
    after = files_below(place)
    left = spark.read.schema(df.schema).option("basePath", path).parquet(path)
    assert rows(left.select("id", "dag", "soort")) == rows(df.where("dag >= '2010-01-01' or dag is null").select("id", "dag", "soort"))
    clean = [f for f in before if all(not (os.path.basename(f) == os.path.basename(c) and r["n_expired"]) for c, r in counts.items())]
    assert clean and all(after[f] == before[f] for f in clean) and done.rewritten_files > 0
    assert done.deleted_rows == df.where("dag < '2010-01-01'").count()
    assert retention_files.retain_by_file(spark, path, "dag", 10, date(2020, 1, 1)) == retention_files.FileRetention(0, 0, 0)
    assert files_below(place) == after and not os.path.exists(f"{place}/_retention")


@pytest.mark.parametrize("step", [0, 1, 2])
def test_a_lost_run_is_finished_by_the_next(spark, tmp_path, rows, monkeypatch, step):
    path = str(tmp_path / "t")
    df = dated_table(spark, path)
    with monkeypatch.context() as broken:
        broken.setattr(retention_files, "finish_retention", lambda *a: 0)
        retention_files.retain_by_file(spark, path, "dag", 10, date(2020, 1, 1))
    (journal,) = Path(path, "_retention").glob("*.json")
    steps = json.loads(journal.read_text())
    if step > 0:  # lost after the new files came, and after one old one went
        for source, target in steps["come"]:
            os.rename("/" + source.removeprefix("file:").lstrip("/"), "/" + target.removeprefix("file:").lstrip("/"))
    if step > 1:
        os.remove("/" + steps["go"][0].removeprefix("file:").lstrip("/"))
    assert retention_files.finish_retention(spark, path) == 1 and retention_files.finish_retention(spark, path) == 0
    assert rows(spark.read.schema(df.schema).parquet(path)) == rows(df.where("dag >= '2010-01-01' or dag is null"))


# ---- difference of layers --------------------------------------------------------------------------------


def found_difference(left, right, keys=("k",), **how):
    return sorted((tuple(r[k] for k in keys), r["kind"], r["n_left"], r["n_right"], r["changed"]) for r in difference.layer_difference(left, right, list(keys), **how).collect())


@pytest.mark.parametrize("levels", [(8, 16, 20), (2,), (1, 3)])
def test_planted_changes_are_found(spark, levels):
    rows = [(i, f"a{i % 7}", None if i % 5 else i) for i in range(3000)]
    other = [r for r in rows if r[0] not in (10, 11)]
    other = [(k, "new", v) if k == 100 else (k, a, None) if k == 200 else (k, a, v) for k, a, v in other] + [(5000, "x", 1), (300, "a6", 300)]
    schema = "k int, a string, v int"
    found = found_difference(spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema), levels=levels)
    assert found == [((10,), "removed", 1, 0, None), ((11,), "removed", 1, 0, None), ((100,), "changed", 1, 1, ["a"]), ((200,), "changed", 1, 1, ["v"]), ((300,), "changed", 1, 2, None), ((5000,), "added", 0, 1, None)]


def test_equal_tables_exchange_checksums_only(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").alias("k"), F.xxhash64("id").alias("v"))
    monkeypatch.setattr(difference, "_inside", lambda *a: pytest.fail("rows were opened"))
    assert difference.layer_difference(df, df.repartition(7), ["k"]).count() == 0
    nodes = difference.node_checksums(difference._hashed(df, ["k"], ["v"]), 4)
    assert nodes.count() == 16 and "partial_sum" in plan_of(nodes)


def test_null_keys_swapped_nulls_and_bags(spark):
    schema = "k string, a string, b string"
    one = spark.createDataFrame([(None, "x", None), ("p", "x", None), ("q", "1", "1"), ("q", "1", "1")], schema)
    two = spark.createDataFrame([(None, "x", None), ("p", None, "x"), ("q", "1", "1")], schema)
    assert found_difference(one, two) == [(("p",), "changed", 1, 1, ["a", "b"]), (("q",), "changed", 2, 1, None)]
    assert found_difference(one, one) == [] and found_difference(one.limit(0), two.limit(0)) == []
    assert found_difference(one, two, columns=["a"], keys=("k",)) == [(("p",), "changed", 1, 1, ["a"]), (("q",), "changed", 2, 1, None)]
