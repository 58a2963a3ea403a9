"""Streams: routing, restart, uploads, alerts equal to batch."""

from __future__ import annotations

import json
import random
from dataclasses import replace
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from polderlake.operators.alerts import RATE_RULES, RateRule, alerts, classify_log_events
from polderlake.sources.csv_files import CsvColumn
from polderlake.streaming import alert_stream, bronze, csv_drop


def put(root, stream, name, *payloads):
    folder = Path(root, *stream.split("."), "dt=2024-01-01")
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"payload": p}, ensure_ascii=False) + "\n" for p in payloads))


def drain(spark, root, base, checkpoint, report=None):
    enriched = bronze.bronze_enrich(bronze.raw_jsonl_stream(spark, root), root)
    bronze.route_streams(enriched, base, "org", checkpoint, None, report).awaitTermination()


def test_routing_and_restart(spark, tmp_path):
    root, base, checkpoint = (str(tmp_path / n) for n in ("raw", "bronze", "checkpoint"))
    put(root, "org.persona.created", "a.jsonl", {"n": 1}, {"n": 2})
    put(root, "org.wia.aanvraag.ingediend", "a.jsonl", {"n": 3})
    put(root, "org.short", "a.jsonl", {"n": 4})
    put(root, "other.a.b", "a.jsonl", {"n": 5})
    put(root, "org.persona.created", "notes.txt", {"n": 6})
    seen = []
    drain(spark, root, base, checkpoint, lambda i, df: seen.extend((r.stream, r["count"]) for r in df.collect()))
    assert sorted(seen) == [("org.persona.created", 2), ("org.short", 1), ("org.wia.aanvraag.ingediend", 1), ("other.a.b", 1)]
    assert sorted(p.name for p in Path(base).glob("table_name=*")) == ["table_name=persona_created", "table_name=wia_aanvraag_ingediend"]
    drain(spark, root, base, checkpoint)  # nothing new
    put(root, "org.persona.created", "b.jsonl", {"n": 7})
    drain(spark, root, base, checkpoint)
    table = bronze.bronze_table(spark, base, "persona_created")
    numbers = sorted(int(r[0]) for r in table.select(F.get_json_object("payload", "$.payload.n")).collect())
    assert numbers == [1, 2, 7]
    assert set(table.columns) == {"payload", "source_file", "source_ts", "ingestion_ts", "event_date"}


def test_repeated_batch_leaves_no_duplicates(spark, tmp_path):
    base = str(tmp_path / "bronze")
    batch = spark.createDataFrame([("x", "org.a.b"), ("y", "org.a.b")], "payload string, stream string").withColumn(
        "event_date", F.to_date(F.lit("2024-01-01"))
    )
    for _ in range(2):
        bronze.route_batch(batch, 5, base, "org")
    bronze.route_batch(batch, 6, base, "org")
    assert bronze.bronze_table(spark, base, "a_b").count() == 4


def test_a_fresh_checkpoint_or_a_second_query_adds_rows(spark, tmp_path):
    base = str(tmp_path / "bronze")
    for n, root in enumerate(("raw", "raw", "other")):
        put(str(tmp_path / root), "org.persona.created", f"f{n}.jsonl", {"n": n})
        drain(spark, str(tmp_path / root), base, str(tmp_path / f"checkpoint{n}"))
    table = bronze.bronze_table(spark, base, "persona_created")
    numbers = sorted(int(r[0]) for r in table.select(F.get_json_object("payload", "$.payload.n")).collect())
    assert numbers == [0, 0, 1, 2], "the second checkpoint reads both files of the first folder again"
    assert not list(Path(base).rglob("batch_id=*"))


def test_empty_batch_writes_nothing(spark, tmp_path):
    bronze.route_batch(spark.createDataFrame([], "payload string, stream string, event_date date"), 0, str(tmp_path / "b"), "org")
    assert not (tmp_path / "b").exists()


COLUMNS = (CsvColumn("id", "integer", min=1), CsvColumn("kind", "varchar", required=False))


def watch(spark, tmp_path):
    csv_drop.watch_incoming(
        spark, str(tmp_path / "incoming"), str(tmp_path / "done"), COLUMNS, str(tmp_path / "bronze"),
        str(tmp_path / "checkpoint"), trigger_seconds=None,
    ).awaitTermination()


def test_uploads_are_taken_once_and_archived(spark, tmp_path):
    (tmp_path / "incoming").mkdir()
    for i in range(3):
        (tmp_path / "incoming" / f"u{i}.csv").write_text(f"kind,id\na,{i + 1}\nb,{i + 10}\n")
    watch(spark, tmp_path)
    watch(spark, tmp_path)
    df = spark.read.parquet(str(tmp_path / "bronze"))
    assert sorted(r.id for r in df.collect()) == [1, 2, 3, 10, 11, 12]
    (tmp_path / "incoming" / "late.csv").write_text("id,kind\n99,z\n")
    watch(spark, tmp_path)
    assert spark.read.parquet(str(tmp_path / "bronze")).count() == 7
    assert list((tmp_path / "done").rglob("*.csv"))


def test_broken_upload_stops_the_stream(spark, tmp_path):
    (tmp_path / "incoming").mkdir()
    (tmp_path / "incoming" / "bad.csv").write_text("id,kind\n0,z\n")
    with pytest.raises(Exception, match="min:id"):
        watch(spark, tmp_path)
    assert (tmp_path / "incoming" / "bad.csv").exists() and not (tmp_path / "bronze").exists()


def test_empty_upload_stops_the_stream(spark, tmp_path):
    (tmp_path / "incoming").mkdir()
    (tmp_path / "incoming" / "empty.csv").write_text("")
    with pytest.raises(Exception, match="non_empty"):
        watch(spark, tmp_path)
    assert (tmp_path / "incoming" / "empty.csv").exists()


def test_upload_with_a_header_alone_is_empty(spark, tmp_path):
    (tmp_path / "incoming").mkdir()
    (tmp_path / "incoming" / "head.csv").write_text("id,kind\n")
    (tmp_path / "incoming" / "good.csv").write_text("id,kind\n1,a\n")
    with pytest.raises(Exception, match="head.csv: non_empty"):
        watch(spark, tmp_path)


def test_a_thousand_uploads_with_two_headers(spark, tmp_path):
    (tmp_path / "incoming").mkdir()
    for i in range(1000):
        text = f"id,kind\n{i + 1},k{i}\n" if i % 2 else f"kind,id\nk{i},{i + 1}\n"
        (tmp_path / "incoming" / f"u {i}.csv").write_text(text)
    watch(spark, tmp_path)
    df = spark.read.parquet(str(tmp_path / "bronze"))
    assert sorted((r.id, r.kind) for r in df.collect()) == [(i + 1, f"k{i}") for i in range(1000)]
    (tmp_path / "incoming" / "more.csv").write_text("id,kind\n5000,z\n")
    csv_drop.watch_incoming(
        spark, str(tmp_path / "incoming"), str(tmp_path / "done"), COLUMNS, str(tmp_path / "bronze"),
        str(tmp_path / "fresh"), trigger_seconds=None,
    ).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "bronze")).where("id = 5000").count() == 1
    assert spark.read.parquet(str(tmp_path / "bronze")).where("id <= 1000").count() >= 1000


def quarantine(spark, tmp_path):
    csv_drop.watch_with_quarantine(
        spark, str(tmp_path / "incoming"), str(tmp_path / "done"), COLUMNS, str(tmp_path / "bronze"), str(tmp_path / "refused"),
        str(tmp_path / "checkpoint"), trigger_seconds=None,
    ).awaitTermination()


def test_refused_lines_go_aside_with_their_reasons(spark, tmp_path):
    (tmp_path / "incoming").mkdir()
    (tmp_path / "incoming" / "a.csv").write_text('id,kind\r\n1,a\r\n0,b\r\nx,c\r\n,d\r\n5,"e,""f"""\r\n6,g,h\r\n7\r\n\r\n')
    (tmp_path / "incoming" / "b.csv").write_text("\ufeffkind,id\nz,9\n")
    (tmp_path / "incoming" / "c.csv").write_text("id,kind\n")
    (tmp_path / "incoming" / "d.csv").write_text("kind\nq\n")
    quarantine(spark, tmp_path)
    quarantine(spark, tmp_path)
    good = spark.read.parquet(str(tmp_path / "bronze"))
    assert sorted((r.id, r.kind) for r in good.collect()) == [(1, "a"), (5, 'e,"f"'), (9, "z")]
    bad = spark.read.parquet(str(tmp_path / "refused"))
    found = sorted((r.source_file.rsplit("/", 1)[1], r.line, tuple(r.refused_for)) for r in bad.collect() if r.line is not None)
    assert found == [
        ("a.csv", ",d", ("required:id",)), ("a.csv", "0,b", ("min:id",)), ("a.csv", "6,g,h", ("fields",)), ("a.csv", "7", ("fields",)),
        ("a.csv", "x,c", ("type:id",)), ("d.csv", "q", ("missing:id",)),
    ]
    assert [r.source_file.rsplit("/", 1)[1] for r in bad.where("line is null").collect()] == ["c.csv"]
    assert len(list((tmp_path / "done").rglob("*.csv"))) == 0 or (tmp_path / "done").exists()


def test_a_batch_repeated_on_another_day_adds_nothing(spark, tmp_path, monkeypatch):
    """The time is the batch's: a run that was lost between the two tables is repeated with it."""
    paths = []
    for i in range(3):
        paths.append(str(tmp_path / f"u{i}.csv"))
        Path(paths[-1]).write_text("id,kind\n" + "".join(f"{n - 2},k\n" for n in range(10 * i, 10 * i + 10)))
    good, bad, taken = str(tmp_path / "bronze"), str(tmp_path / "refused"), datetime(2024, 3, 1, 23, 59, 59)
    publish, calls = csv_drop.publish_batch, []

    def lost(*args):
        calls.append(args[1])
        if len(calls) == 2:
            raise OSError("lost")
        publish(*args)

    monkeypatch.setattr(csv_drop, "publish_batch", lost)
    for attempt in range(3):
        staged = csv_drop.staged_upload(spark, paths, COLUMNS)
        try:
            csv_drop.publish_upload(staged, COLUMNS, good, bad, "query", 4, taken)
        except OSError:
            assert attempt == 0
    accepted = [r.id for r in spark.read.parquet(good).collect()]
    refused = [r.line for r in spark.read.parquet(bad).collect()]
    assert sorted(accepted) == list(range(1, 28)) and sorted(refused) == ["-1,k", "-2,k", "0,k"]
    assert {str(r.event_date) for r in spark.read.parquet(good).collect()} == {"2024-03-01"}
    csv_drop.publish_upload(staged, COLUMNS, good, bad, "query", 5, taken)
    assert spark.read.parquet(good).count() == 54, "another batch has folders of its own"


def test_the_time_of_a_batch_is_kept_with_its_offsets(spark, tmp_path, monkeypatch):
    (tmp_path / "incoming").mkdir()
    (tmp_path / "incoming" / "a.csv").write_text("id,kind\n1,a\n")
    seen, take = [], csv_drop.publish_upload

    def failing(*args):
        seen.append(args[6])
        if len(seen) == 1:
            raise OSError("lost")
        take(*args)

    monkeypatch.setattr(csv_drop, "publish_upload", failing)
    with pytest.raises(Exception, match="lost"):
        watch(spark, tmp_path)
    watch(spark, tmp_path)
    assert len(seen) == 2 and seen[0] == seen[1]
    assert spark.read.parquet(str(tmp_path / "bronze")).count() == 1


def test_a_file_that_is_being_written_does_not_stop_the_stream(spark, tmp_path, monkeypatch):
    (tmp_path / "incoming").mkdir()
    (tmp_path / "incoming" / "a.csv").write_text("id,kind\n1,a\n")
    growing = tmp_path / "incoming" / "growing.csv"
    growing.write_text("")
    monkeypatch.setattr(csv_drop.time, "sleep", lambda s: growing.write_text("id,kind\n2,b\n"))
    assert csv_drop.files_without_content(spark, str(tmp_path / "incoming")) == []
    growing.write_text("")
    watch(spark, tmp_path)
    watch(spark, tmp_path)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "bronze")).collect()) in ([1], [1, 2])


# ---- alerts -----------------------------------------------------------------------------------------

LINES = "ts timestamp, namespace string, container string, message string"


def test_classification(spark, rows):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [
            (t, "n", "opa", '{"decision_id":"1","result":false}'), (t, "n", "opa", '{"decision_id":"2","result":true}'),
            (t, "n", "trino-worker", "Access Denied: x"), (t, "n", "opa", "Access Denied"),
            (t, "n", "trino", "java.lang.OutOfMemoryError and Access Denied"), (t, None, None, "java.lang.OutOfMemoryError"),
            (t, "n", "keycloak", "LOGIN_ERROR"), (t, "n", "csv-uploader", "upload_failed"), (t, "n", "x", None),
        ],
        LINES,
    )
    found = classify_log_events(df).groupBy("alert_event").count()
    assert rows(found) == [
        ("csv_upload_failed", 1), ("jvm_oom", 2), ("keycloak_login_error", 1), ("opa_deny", 1), ("trino_access_denied", 1)
    ]


def brute_force(lines, rules):
    """Minute by minute, straight from the wording of the rules."""
    start = min(line[0] for line in lines).replace(second=0, microsecond=0)
    fired = set()
    for rule in rules:
        hits = [line for line in lines if event_of(line) == rule.event]
        labels = {tuple(line[1 if n == "namespace" else 2] for n in rule.per) for line in hits}
        for label in labels:
            mine = [h[0] for h in hits if tuple(h[1 if n == "namespace" else 2] for n in rule.per) == label]
            above = set()
            for m in range(1, 300):
                end = start + timedelta(minutes=m)
                n = sum(end - timedelta(minutes=rule.minutes) <= t < end for t in mine)
                if n / (rule.minutes * 60.0) > rule.threshold:
                    above.add(m)
            for m in above:
                if all(m - k in above for k in range(rule.hold_minutes + 1)):
                    names = dict(zip(rule.per, label, strict=True))
                    fired.add((rule.alert, names.get("namespace"), names.get("container"), start + timedelta(minutes=m)))
    return fired


def event_of(line):
    return {"opa": "opa_deny", "java": "jvm_oom", "keycloak": "keycloak_login_error"}[line[2]]


MESSAGES = {"opa": '{"decision_id":"1","result":false}', "java": "java.lang.OutOfMemoryError", "keycloak": "LOGIN_ERROR"}
RULES = [
    replace(RATE_RULES[0], threshold=0.02),
    RATE_RULES[2],
    RateRule("Login", "keycloak_login_error", 15, 0.01, 10, "warning", ("namespace",)),
]


def log_lines(n=400, seed=5):
    rng = random.Random(seed)
    base = datetime(2024, 1, 1, 8, 0, 30)
    out = []
    for _ in range(n):
        container = rng.choice(list(MESSAGES))
        minute = rng.gauss(60, 25) if container != "java" else rng.randrange(120)
        out.append((base + timedelta(minutes=max(0.0, min(minute, 150.0)), seconds=rng.randrange(60)), rng.choice("ab"), container, MESSAGES[container]))
    return out


def as_set(df):
    return {(r.alert, r.namespace, r.container, r.fired_at) for r in df.collect()}


def test_batch_alerts_against_brute_force(spark):
    lines = log_lines()
    found = alerts(spark.createDataFrame(lines, LINES), RULES)
    expected = brute_force(lines, RULES)
    assert {a for a, *_ in expected} == {rule.alert for rule in RULES}
    assert as_set(found) == expected


def test_stream_alerts_equal_batch(spark, tmp_path):
    lines = log_lines()
    end = max(line[0] for line in lines)
    sentinel = [(end + timedelta(days=1), "a", "java", MESSAGES["java"])]
    source = str(tmp_path / "log")
    df = spark.createDataFrame(lines, LINES)
    df.unionByName(spark.createDataFrame(sentinel, LINES)).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(LINES).parquet(source)
    target = str(tmp_path / "alerts")
    for _ in range(2):  # the second start finds nothing new
        alert_stream.alert_stream(stream, target, str(tmp_path / "c"), RULES, trigger_seconds=None).awaitTermination()
    assert as_set(spark.read.parquet(target)) == as_set(alerts(df, RULES))
    assert spark.read.parquet(target).count() == alerts(df, RULES).count()
