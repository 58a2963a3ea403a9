from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from polderlake.plans import analyses, journey

RANKED = "bsn string, event_seq bigint, event_ts timestamp, event_type string, event_status string"


def ranked(spark, *events):
    return spark.createDataFrame(
        [("b", i, datetime.fromisoformat(day), kind, status) for i, (day, kind, status) in enumerate(events, 1)], RANKED
    )


def test_repeated_phase_is_one_island(spark, rows):
    df = ranked(
        spark,
        ("2024-01-01", "polisadm.ikv.start", None),
        ("2024-02-01", "polisadm.ikv.start", None),
        ("2024-02-10", "crm.contact.mail", None),
        ("2024-03-01", "zw.melding", None),
        ("2024-04-01", "polisadm.ikv.start", None),
    )
    found = rows(journey.journey_phases(df), "fase_volgnr", "fase", "duur_dagen", "is_lopend")
    assert found == [(1, "werknemer", 60, False), (2, "ziek", 31, False), (3, "werknemer", None, True)]


def test_equal_times_are_settled_by_sequence(spark, rows):
    df = ranked(spark, ("2024-01-01", "zw.melding", None), ("2024-01-01", "polisadm.ikv.start", None))
    assert rows(journey.journey_phases(df), "fase_volgnr", "fase", "duur_dagen") == [(1, "ziek", 0), (2, "werknemer", None)]


def test_no_phase_events_give_no_rows(spark):
    df = ranked(spark, ("2024-01-01", "crm.contact.mail", None), ("2024-01-02", "persoon.aangemaakt", None))
    assert journey.journey_phases(df).count() == 0


def test_one_event_is_an_open_phase(spark, rows):
    df = ranked(spark, ("2024-01-01", "wajong.dossier.geopend", None))
    assert rows(journey.journey_phases(df), "fase", "fase_eind_ts", "is_lopend") == [("wajong_actief", None, True)]


@pytest.mark.parametrize(
    ("event_type", "status", "phase"),
    [
        ("ww.aanvraag.ingediend", "INGEDIEND", "ww_aanvraag"),
        ("ww.aanvraag.in behandeling", "in behandeling", "ww_aanvraag"),
        ("ww.aanvraag.toegekend", "TOEGEKEND", "ww_uitkering"),
        ("ww.aanvraag.toegekend", "toegekend", "ww_uitkering"),
        ("ww.aanvraag.afgewezen", "AFGEWEZEN", "tussen_dienstverband"),
        ("wia.aanvraag.in_behandeling", "IN_BEHANDELING", "wia_in_behandeling"),
        ("wia.aanvraag.toegekend_wga", "TOEGEKEND_WGA", "wga"),
        ("wia.aanvraag.toegekend_iva", "toegekend", "iva"),
        ("wia.aanvraag.toegekend", "toegekend", None),
        ("crm.contact.mail", None, None),
    ],
)
def test_phase_rules(spark, event_type, status, phase):
    df = spark.createDataFrame([(event_type, status)], "t string, s string")
    assert df.select(journey.phase_of(F.col("t"), F.col("s"))).first()[0] == phase


def test_hosted_rules_join_the_granted_phases(spark):
    df = spark.createDataFrame(
        [("wia.aanvraag.toegekend_wga",), ("wia.aanvraag.toegekend_iva",), ("wia.aanvraag.toegekend",)], "t string"
    )
    found = df.select(journey.phase_of(F.col("t"), F.lit("x"), journey.PHASES_HOSTED).alias("p")).distinct().collect()
    assert [r.p for r in found] == ["wia_toegekend"]


def entities(spark, **given):
    schemas = {
        "persona": "bsn string, ingestion_source_ts timestamp, event_date date",
        "employment": "bsn string, ikv_id string, werkgever_naam string, aanvang_dienstverband date, "
        "einde_dienstverband date, loon_bruto_jaar int",
        "ww": "bsn string, aanvraag_id string, aanvraag_datum date, status string, reden_einde_dienstverband string",
        "zw": "bsn string, melding_id string, eerste_ziektedag date, duur_dagen int",
        "wia": "bsn string, aanvraag_id string, aanvraag_datum date, onderdeel string, regio_code string, status string, "
        "arbeidsongeschikt_pct int",
        "wajong": "bsn string, dossier_id string, regime string, arbeidsvermogen string, ingangsdatum date",
        "crm": "bsn string, contact_id string, kanaal string, onderwerp string, contact_ts timestamp, duur_seconden int",
    }
    return {name: spark.createDataFrame(given.get(name, []), schema) for name, schema in schemas.items()}


def test_event_texts(spark, rows):
    day = date(2024, 1, 1)
    events = journey.journey_events(
        entities(
            spark,
            employment=[("b", "i1", None, day, None, 100), ("b", "i2", "X", None, day, 5)],
            ww=[("b", "w1", day, None, None)],
            wia=[("b", "a1", day, "IVA", "AMS", "toegekend", 80), ("b", "a2", day, None, None, "TOEGEKEND_WGA", None)],
            zw=[("b", "z1", day, None)],
            crm=[("b", "c1", None, "WW", datetime(2024, 1, 1, 9), None)],
        )
    )
    assert rows(events, "source_ref_id", "event_type", "event_label", "numeric_value") == [
        ("a1", "wia.aanvraag.toegekend_iva", "WIA-aanvraag (IVA, status: toegekend, AO 80%)", 80.0),
        ("a2", "wia.aanvraag.toegekend_wga", "WIA-aanvraag (?, status: TOEGEKEND_WGA)", None),
        ("c1", "crm.contact.onbekend", "Klantcontact ? over WW", None),
        ("i1", "polisadm.ikv.start", "Dienstverband begonnen bij (onbekend)", 100.0),
        ("i2", "polisadm.ikv.einde", "Dienstverband beëindigd bij X", None),
        ("w1", "ww.aanvraag.onbekend", "WW-aanvraag (status: ?, reden: ?)", None),
        ("z1", "zw.melding", "Ziekmelding (duur ~0 dagen)", None),
    ]


def test_all_windows_share_one_shuffle_and_one_sort(spark):
    events = journey.journey_events(entities(spark, zw=[("b", "z1", date(2024, 1, 1), 3)]))
    for phases in (journey.phases_of_events(events), journey.journey_phases(journey.journey_ranked(events))):
        plan = phases._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
    plan = journey.phases_of_events(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [bsn") == 1


def test_transitions(spark, rows):
    phases = spark.createDataFrame(
        [("a", 1, "werknemer"), ("a", 2, "ziek"), ("a", 3, "werknemer"), ("b", 1, "werknemer"), ("b", 2, "ziek")],
        "bsn string, fase_volgnr bigint, fase string",
    )
    matrix = analyses.phase_transitions(phases, ["werknemer", "ziek", "iva"])
    assert rows(matrix, "fase", "werknemer", "ziek", "iva") == [("werknemer", 0, 2, 0), ("ziek", 1, 0, 0)]
