"""Client journey: events of all domains in one stream, ranked, and folded into phases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polderlake.operators.ranking import HEAVY_ROWS, number_in_pieces, number_rows, split_by_weight, with_neighbour
from polderlake.session import freeze

EVENT_COLUMNS = (
    "bsn", "event_ts", "event_date", "domein", "event_type", "event_label", "event_status",
    "regio_code", "numeric_value", "source_ref_id",
)


def _event(
    *,
    at: Column,
    domein: str,
    event_type: Column,
    label: Column,
    ref: str,
    status: Column | None = None,
    region: Column | None = None,
    value: Column | None = None,
    day: Column | None = None,
) -> list[Column]:
    """The ten event columns, in order."""
    text_null = F.lit(None).cast("string")
    return [
        F.col("bsn"),
        at.cast("timestamp").alias("event_ts"),
        (at.cast("date") if day is None else day).alias("event_date"),
        F.lit(domein).alias("domein"),
        event_type.alias("event_type"),
        label.alias("event_label"),
        (text_null if status is None else status).alias("event_status"),
        (text_null if region is None else region).alias("regio_code"),
        (F.lit(None) if value is None else value).cast("double").alias("numeric_value"),
        F.col(ref).alias("source_ref_id"),
    ]


def _or(name: str, default: str) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _type_suffix(name: str) -> Column:
    return F.lower(_or(name, "onbekend"))


def normal_status(status: Column) -> Column:
    """One spelling for `in behandeling` and `IN_BEHANDELING`."""
    return F.upper(F.replace(status, F.lit(" "), F.lit("_")))


def _employment_events(employment: DataFrame) -> DataFrame:
    """Start and end of an employment from one scan, as an exploded pair."""
    employer = _or("werkgever_naam", "(onbekend)")

    def half(day: str, kind: str, text: str, value: Column) -> Column:
        return F.struct(
            F.col(day).alias("day"),
            F.lit(kind).alias("kind"),
            F.concat(F.lit(text), employer).alias("label"),
            value.cast("double").alias("value"),
        )

    pair = F.array(
        half("aanvang_dienstverband", "polisadm.ikv.start", "Dienstverband begonnen bij ", F.col("loon_bruto_jaar")),
        half("einde_dienstverband", "polisadm.ikv.einde", "Dienstverband beëindigd bij ", F.lit(None)),
    )
    halves = employment.select("bsn", "ikv_id", F.explode(pair).alias("h")).filter(F.col("h.day").isNotNull())
    return halves.select(
        *_event(
            at=F.col("h.day"), domein="polisadm", event_type=F.col("h.kind"), label=F.col("h.label"),
            ref="ikv_id", value=F.col("h.value"),
        )
    )


def journey_events(entities: Mapping[str, DataFrame]) -> DataFrame:
    """Seven entities (persona, employment, ww, zw, wia, wajong, crm) as one event stream."""
    granted = F.when(normal_status(F.col("status")) == "TOEGEKEND", F.concat(F.lit("_"), F.lower(_or("onderdeel", "wga"))))
    degree = F.concat(F.lit(", AO "), F.col("arbeidsongeschikt_pct").cast("string"), F.lit("%"))
    branches = [
        entities["persona"].select(
            *_event(
                at=F.col("ingestion_source_ts"), day=F.col("event_date"), domein="persoon",
                event_type=F.lit("persoon.aangemaakt"), label=F.lit("Cliënt-record aangemaakt"), ref="bsn",
            )
        ),
        _employment_events(entities["employment"]),
        entities["ww"].select(
            *_event(
                at=F.col("aanvraag_datum"), domein="ww",
                event_type=F.concat(F.lit("ww.aanvraag."), _type_suffix("status")),
                label=F.concat(
                    F.lit("WW-aanvraag (status: "), _or("status", "?"), F.lit(", reden: "),
                    _or("reden_einde_dienstverband", "?"), F.lit(")"),
                ),
                status=F.col("status"), ref="aanvraag_id",
            )
        ),
        entities["zw"].select(
            *_event(
                at=F.col("eerste_ziektedag"), domein="zw", event_type=F.lit("zw.melding"),
                label=F.concat(
                    F.lit("Ziekmelding (duur ~"), F.coalesce("duur_dagen", F.lit(0)).cast("string"), F.lit(" dagen)")
                ),
                value=F.col("duur_dagen"), ref="melding_id",
            )
        ),
        entities["wia"].select(
            *_event(
                at=F.col("aanvraag_datum"), domein="wia",
                event_type=F.concat(F.lit("wia.aanvraag."), _type_suffix("status"), F.coalesce(granted, F.lit(""))),
                label=F.concat(
                    F.lit("WIA-aanvraag ("), _or("onderdeel", "?"), F.lit(", status: "), _or("status", "?"),
                    F.coalesce(degree, F.lit("")), F.lit(")"),
                ),
                status=F.col("status"), region=F.col("regio_code"), value=F.col("arbeidsongeschikt_pct"),
                ref="aanvraag_id",
            )
        ),
        entities["wajong"].filter(F.col("ingangsdatum").isNotNull()).select(
            *_event(
                at=F.col("ingangsdatum"), domein="wajong", event_type=F.lit("wajong.dossier.geopend"),
                label=F.concat(
                    F.lit("Wajong-dossier ("), _or("regime", "?"), F.lit(", arbeidsvermogen: "),
                    _or("arbeidsvermogen", "?"), F.lit(")"),
                ),
                ref="dossier_id",
            )
        ),
        entities["crm"].select(
            *_event(
                at=F.col("contact_ts"), domein="crm",
                event_type=F.concat(F.lit("crm.contact."), _type_suffix("kanaal")),
                label=F.concat(F.lit("Klantcontact "), _or("kanaal", "?"), F.lit(" over "), _or("onderwerp", "?")),
                value=F.col("duur_seconden"), ref="contact_id",
            )
        ),
    ]
    events = branches[0]
    for branch in branches[1:]:
        events = events.unionByName(branch)
    return events


EVENT_ORDER = ("event_ts", "domein", "event_type", "source_ref_id")


def _in_order(df: DataFrame) -> DataFrame:
    return df.select("bsn", "event_seq", *EVENT_COLUMNS[1:])


def journey_ranked(events: DataFrame, heavy_rows: int = HEAVY_ROWS, at_most: int | None = None) -> DataFrame:
    """`event_seq` numbers a person's events by time, domain, type (then source id, to settle ties).

    `at_most`: a bound on the number of events, if one is known.
    """
    order = [F.col(name) for name in EVENT_ORDER]
    return _in_order(number_rows(events, ["bsn"], order, "event_seq", heavy_rows, at_most=at_most))


# Which event opens which phase. A key ending in `.` matches by prefix and needs one of
# the pending statuses; other keys match the event type in full.
PENDING = ("INGEDIEND", "IN_BEHANDELING")
PHASES: dict[str, str] = {
    "polisadm.ikv.start": "werknemer",
    "polisadm.ikv.einde": "tussen_dienstverband",
    "zw.melding": "ziek",
    "ww.aanvraag.": "ww_aanvraag",
    "ww.aanvraag.toegekend": "ww_uitkering",
    "ww.aanvraag.afgewezen": "tussen_dienstverband",
    "wia.aanvraag.": "wia_in_behandeling",
    "wia.aanvraag.toegekend_wga": "wga",
    "wia.aanvraag.toegekend_iva": "iva",
    "wia.aanvraag.afgewezen": "tussen_dienstverband",
    "wajong.dossier.geopend": "wajong_actief",
}
PHASES_HOSTED: dict[str, str] = {
    **{key: phase for key, phase in PHASES.items() if not key.startswith("wia.aanvraag.toegekend")},
    "wia.aanvraag.toegekend": "wia_toegekend",
    "wia.aanvraag.toegekend_wga": "wia_toegekend",
    "wia.aanvraag.toegekend_iva": "wia_toegekend",
}


def phase_of(event_type: Column, status: Column, rules: Mapping[str, str] = PHASES) -> Column:
    """Phase opened by an event, null when it opens none."""
    chosen = None
    for key, phase in rules.items():
        test = event_type == key
        if key.endswith("."):
            test = event_type.startswith(key) & normal_status(status).isin(*PENDING)
        chosen = F.when(test, phase) if chosen is None else chosen.when(test, phase)
    return chosen


def _phase_row(start: Column, end: Column) -> list[Column]:
    return [
        F.col("bsn"),
        F.col("fase_volgnr").cast("bigint").alias("fase_volgnr"),
        F.col("fase"),
        F.col("trigger_event_type"),
        start.alias("fase_start_ts"),
        end.alias("fase_eind_ts"),
        F.date_diff(end.cast("date"), start.cast("date")).alias("duur_dagen"),
        end.isNull().alias("is_lopend"),
        "next_fase",
    ]


def _changes(before: str) -> Column:
    """The event opens another phase than the one before it."""
    return F.col(before).isNull() | (F.col(before) != F.col("fase"))


def _fold(openings: DataFrame, order: Sequence[str]) -> DataFrame:
    """Gaps and islands by windows that share key and order: one shuffle and one sort for all three."""
    by_time = Window.partitionBy("bsn").orderBy(*order)
    starts = openings.withColumn("_before", F.lag("fase").over(by_time)).filter(_changes("_before"))
    bounded = starts.withColumns(
        {
            "fase_volgnr": F.row_number().over(by_time),
            "_next": F.lead("event_ts").over(by_time),
            "next_fase": F.lead("fase").over(by_time),
        }
    )
    return bounded.select(*_phase_row(F.col("event_ts"), F.col("_next")))


def _fold_heavy(openings: DataFrame, order: Sequence[str], rows: int, heavy_rows: int) -> DataFrame:
    """The same for persons with very many events: numbered in pieces, neighbours found by join.

    Each step is stored, because the next one reads it more than once.
    """
    columns = [F.col(name) for name in order]
    numbered = freeze(number_in_pieces(openings, ["bsn"], columns, "_n", rows, heavy_rows))
    before = with_neighbour(numbered, ["bsn"], "_n", -1, {"_before": "fase"})
    starts = freeze(before.filter(_changes("_before")).drop("_before"))
    placed = freeze(number_rows(starts, ["bsn"], [F.col("_n")], "fase_volgnr", heavy_rows))
    after = with_neighbour(placed, ["bsn"], "fase_volgnr", 1, {"_next": "event_ts", "next_fase": "fase"})
    return after.select(*_phase_row(F.col("event_ts"), F.col("_next")))


def phase_steps(
    events: DataFrame,
    order: Sequence[str] = EVENT_ORDER,
    rules: Mapping[str, str] = PHASES,
    heavy_rows: int = HEAVY_ROWS,
    at_most: int | None = None,
) -> DataFrame:
    """Phases with the phase that follows each, from events that `order` puts in time order.

    Events that open no phase go before the shuffle.
    """
    openings = events.select(
        "bsn",
        *dict.fromkeys([*order, "event_ts"]),
        phase_of(F.col("event_type"), F.col("event_status"), rules).alias("fase"),
        F.col("event_type").alias("trigger_event_type"),
    ).filter(F.col("fase").isNotNull())
    ordinary, heavy, rows = split_by_weight(openings, ["bsn"], heavy_rows, at_most=at_most)
    phases = _fold(ordinary, order)
    return phases if heavy is None else phases.unionByName(_fold_heavy(heavy, order, rows, heavy_rows))


def journey_phases(
    ranked: DataFrame, rules: Mapping[str, str] = PHASES, heavy_rows: int = HEAVY_ROWS, at_most: int | None = None
) -> DataFrame:
    """Consecutive events of the same phase become one row per person, phase and period.

    Events that open no phase (contacts, record creation) do not end one either.
    """
    return phase_steps(ranked, ["event_seq"], rules, heavy_rows, at_most).drop("next_fase")


def phases_of_events(
    events: DataFrame, rules: Mapping[str, str] = PHASES, heavy_rows: int = HEAVY_ROWS, at_most: int | None = None
) -> DataFrame:
    """The same straight from the unranked events: a number per event is not needed to order them."""
    return phase_steps(events, EVENT_ORDER, rules, heavy_rows, at_most).drop("next_fase")
