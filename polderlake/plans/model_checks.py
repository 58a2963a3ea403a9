"""The checks declared for every staging model and mart, and one run of a model's suite."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polderlake.functions.identifiers import is_payroll_number, is_valid_bsn
from polderlake.operators.checks import FrameCheck, RowCheck, check_relationship, check_unique, outside_range, run_check_suite

Rule = tuple

NOT_NULL: Rule = ("not_null",)
UNIQUE: Rule = ("unique",)
BSN: Rule = ("bsn_valid",)
PAYROLL: Rule = ("lh_nummer_valid",)


def one_of(*values: str) -> Rule:
    return ("accepted_values", values)


def between(low: float | None = None, high: float | None = None) -> Rule:
    return ("accepted_range", low, high)


def refers_to(model: str, column: str) -> Rule:
    return ("relationship", model, column)


# Model -> column -> checks.
REGIONS = one_of("AMS", "RTM", "DHN", "UTR", "EHV", "GRO", "ZWO", "ARN", "BRD")
PROVIDERS = one_of("oci", "aws", "azure", "gcp")
CHARGES = one_of("Usage", "Purchase", "Tax", "Credit", "Adjustment")
MODELS: dict[str, dict[str, tuple[Rule, ...]]] = {
    "persona": {
        "bsn": (NOT_NULL, UNIQUE, BSN),
        "geslacht": (one_of("M", "V", "X"),),
        "geboortedatum": (NOT_NULL,),
    },
    "employment": {
        "ikv_id": (NOT_NULL, UNIQUE),
        "bsn": (NOT_NULL, BSN, refers_to("persona", "bsn")),
        "lh_nummer": (NOT_NULL, PAYROLL),
        "aanvang_dienstverband": (NOT_NULL,),
        "loon_bruto_jaar": (NOT_NULL, between(0, 500000)),
    },
    "ww": {
        "aanvraag_id": (NOT_NULL, UNIQUE),
        "bsn": (NOT_NULL, BSN),
        "aanvraag_datum": (NOT_NULL,),
        "reden_einde_dienstverband": (
            one_of("ontslag_werkgever", "einde_contract", "wederzijds_goedvinden", "eigen_initiatief"),
        ),
        "status": (one_of("INGEDIEND", "IN_BEHANDELING", "TOEGEKEND", "AFGEWEZEN"),),
    },
    "wia": {
        "aanvraag_id": (NOT_NULL, UNIQUE),
        "bsn": (NOT_NULL, BSN),
        "aanvraag_datum": (NOT_NULL,),
        "onderdeel": (one_of("WGA", "IVA"),),
        "regio_code": (REGIONS,),
        "status": (one_of("INGEDIEND", "IN_BEHANDELING", "TOEGEKEND_WGA", "TOEGEKEND_IVA", "AFGEWEZEN"),),
        "arbeidsongeschikt_pct": (between(0, 100),),
    },
    "wajong": {
        "dossier_id": (NOT_NULL, UNIQUE),
        "bsn": (NOT_NULL, BSN),
        "regime": (one_of("oude_Wajong", "Wajong_2010", "Wajong_2015"),),
        "arbeidsvermogen": (one_of("volledig", "gedeeltelijk", "duurzaam_geen"),),
    },
    "zw": {
        "melding_id": (NOT_NULL, UNIQUE),
        "bsn": (NOT_NULL, BSN),
        "duur_dagen": (between(0, 730),),
    },
    "crm": {
        "contact_id": (NOT_NULL, UNIQUE),
        "bsn": (NOT_NULL, BSN),
        "kanaal": (one_of("telefoon", "balie", "beeldbellen", "werkmap_bericht", "mail"),),
        "onderwerp": (one_of("WW", "WIA", "Wajong", "algemeen"),),
    },
    "fez": {
        "jaar": (NOT_NULL, between(2020, 2030)),
        "maand": (NOT_NULL, between(1, 12)),
        "wet": (one_of("WW", "WIA", "Wajong", "ZW", "TW", "WAO"),),
        "regio_code": (REGIONS,),
        "uitbetaald_bruto_eur": (between(0),),
    },
    "billing": {
        "billing_account_id": (NOT_NULL,),
        "billing_period_start": (NOT_NULL,),
        "billing_month": (NOT_NULL,),
        "charge_period_start": (NOT_NULL,),
        "charge_category": (NOT_NULL, CHARGES),
        "billing_currency": (NOT_NULL,),
        "billed_cost": (NOT_NULL,),
        "effective_cost": (NOT_NULL,),
        "provider": (NOT_NULL, PROVIDERS),
        "service_name": (NOT_NULL,),
        "event_date": (NOT_NULL,),
    },
    "satisfaction": {
        "meting_datum": (NOT_NULL,),
        "kanaal": (NOT_NULL, one_of("telefoon", "email", "balie", "web", "chat")),
        "doelgroep": (NOT_NULL,),
        "score": (NOT_NULL, between(1, 5)),
        "n_respondenten": (NOT_NULL, between(1)),
    },
    "journey_events": {
        "bsn": (NOT_NULL, BSN),
        "event_seq": (NOT_NULL, between(1)),
        "event_ts": (NOT_NULL,),
        "domein": (NOT_NULL, one_of("persoon", "polisadm", "ww", "zw", "wia", "wajong", "crm")),
        "event_type": (NOT_NULL,),
        "event_label": (NOT_NULL,),
    },
    "journey_phases": {
        "bsn": (NOT_NULL, BSN),
        "fase_volgnr": (NOT_NULL, between(1)),
        "fase": (
            NOT_NULL,
            one_of(
                "werknemer", "tussen_dienstverband", "ziek", "ww_aanvraag", "ww_uitkering", "wia_in_behandeling", "wga",
                "iva", "wajong_actief",
            ),
        ),
        "fase_start_ts": (NOT_NULL,),
        "duur_dagen": (between(0),),
        "is_lopend": (NOT_NULL,),
    },
    "tw_eligibility": {
        "bsn": (NOT_NULL, BSN),
        "inkomen_maand_eur": (NOT_NULL,),
        "norm_per_maand_eur": (NOT_NULL,),
        "gat_per_maand": (between(0),),
    },
    "satisfaction_monthly": {
        "maand": (NOT_NULL,),
        "kanaal": (NOT_NULL,),
        "n_respondenten": (NOT_NULL, between(1)),
        "gemid_score_gewogen": (NOT_NULL, between(1, 5)),
    },
    "effect_panel": {
        "bsn_pseudo": (NOT_NULL, UNIQUE),
        "leeftijd": (between(18, 100),),
        "huidige_status": (one_of("werkend", "WW", "WIA", "overig"),),
    },
    "dq_daily": {
        "rapport_datum": (NOT_NULL,),
        "n_ikvs": (NOT_NULL, between(0)),
        "n_bsn_buiten_test_bereik": (between(0, 0),),
    },
    "spend_monthly": {
        "billing_month": (NOT_NULL,),
        "provider": (NOT_NULL, PROVIDERS),
        "charge_category": (NOT_NULL, CHARGES),
        "effective_cost": (NOT_NULL,),
    },
    "top_resources": {
        "billing_month": (NOT_NULL,),
        "resource_id": (NOT_NULL,),
        "effective_cost": (NOT_NULL,),
        "rank_in_month": (NOT_NULL, between(1)),
    },
    "projection": {
        "jaar": (between(2026, 2030),),
        "maand": (between(1, 12),),
    },
    "wia_funnel": {
        "aanvraag_datum": (NOT_NULL,),
        "regio_code": (NOT_NULL,),
        "onderdeel": (one_of("WGA", "IVA"),),
        "status": (NOT_NULL,),
        "n_aanvragen": (between(0),),
    },
    "client_360": {
        "bsn": (NOT_NULL, UNIQUE, BSN),
        "voornaam": (NOT_NULL,),
        "achternaam": (NOT_NULL,),
        "geslacht": (one_of("M", "V", "X"),),
        "n_lopende_ww": (between(0),),
        "n_lopende_wia": (between(0),),
    },
}


def check_name(column: str, rule: Rule) -> str:
    return f"{column}_{rule[0]}"


def _fails(column: Column, rule: Rule) -> Column:
    """True for a row that breaks the rule. Only `not_null` speaks of missing values."""
    kind, *given = rule
    if kind == "not_null":
        return column.isNull()
    if kind == "accepted_values":
        return ~column.isin(*given[0])
    if kind == "accepted_range":
        return outside_range(column, *given)
    return ~{"bsn_valid": is_valid_bsn, "lh_nummer_valid": is_payroll_number}[kind](column)


def run_model_suite(model: str, df: DataFrame, parent: Callable[[str], DataFrame] | Mapping[str, DataFrame]) -> DataFrame:
    """(test_name, failures, status) for the declared checks of a model.

    All row checks come from one pass over the model; uniqueness and relationships each shuffle their own column.
    `parent` gives the models that relationships refer to.
    """
    found = parent.__getitem__ if isinstance(parent, Mapping) else parent
    checks: list[RowCheck | FrameCheck] = []
    for column, rules in MODELS[model].items():
        for rule in rules:
            name = check_name(column, rule)
            if rule == UNIQUE:
                checks.append(FrameCheck(name, check_unique(df.select(column), column)))
            elif rule[0] == "relationship":
                checks.append(FrameCheck(name, check_relationship(df.select(column), column, found(rule[1]), rule[2])))
            else:
                checks.append(RowCheck(name, _fails(F.col(column), rule)))
    return run_check_suite(df.select(*MODELS[model]), checks)
