"""Lookup tables and policy tables: a handful of rows each, written out here."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
REGIONS = (
    ("AMS", "Amsterdam", "Noord-Holland"),
    ("RTM", "Rotterdam", "Zuid-Holland"),
    ("DHN", "Den Haag", "Zuid-Holland"),
    ("UTR", "Utrecht", "Utrecht"),
    ("EHV", "Eindhoven", "Noord-Brabant"),
    ("GRO", "Groningen", "Groningen"),
    ("ZWO", "Zwolle", "Overijssel"),
    ("ARN", "Arnhem", "Gelderland"),
    ("BRD", "Breda", "Noord-Brabant"),
)
BENEFIT_TYPES = (
    ("WW", "Werkloosheidswet — uitkering bij werkloosheid", "WW"),
    ("WIA-WGA", "Werkhervatting Gedeeltelijk Arbeidsongeschikten", "WIA"),
    ("WIA-IVA", "Inkomensvoorziening Volledig Arbeidsongeschikten", "WIA"),
    ("WAJONG", "Wet arbeidsongeschiktheidsvoorziening jonggehandicapten", "Wajong"),
    ("ZW", "Ziektewet", "ZW"),
    ("TW", "Toeslagenwet — aanvulling tot sociaal minimum", "TW"),
    ("WAO", "Wet op de arbeidsongeschiktheidsverzekering (oude regeling)", "WAO"),
    ("WAZO", "Wet arbeid en zorg (zwangerschap/bevalling)", "WAZO"),
    ("IOW", "Wet inkomensvoorziening oudere werklozen", "IOW"),
)
LAWS = (
    ("WW", "Werkloosheidswet", "Wettelijke regeling voor werknemers die werkloos worden."),
    ("WIA", "Wet werk en inkomen naar arbeidsvermogen",
     "Wettelijke regeling bij langdurige arbeidsongeschiktheid (incl. WGA en IVA)."),
    ("Wajong", "Wet arbeidsongeschiktheidsvoorziening jonggehandicapten",
     "Voorziening voor jongeren met een arbeidshandicap."),
    ("ZW", "Ziektewet", "Vangnet bij ziekte voor mensen zonder werkgever (uitzendkrachten/eindigend dienstverband)."),
    ("TW", "Toeslagenwet", "Aanvulling op uitkering tot sociaal minimum."),
    ("WAO", "Wet op de arbeidsongeschiktheidsverzekering", "Oude WIA-voorganger; nog lopende uitkeringen."),
    ("WAZO", "Wet arbeid en zorg", "Zwangerschap-/bevallings-/ouderschapsverlof."),
    ("IOW", "Wet inkomensvoorziening oudere werklozen", "Vervolg-uitkering oudere werklozen."),
    ("SUWI", "Wet structuur uitvoeringsorganisatie werk en inkomen", "Stelselwet uitvoering werk en inkomen."),
    ("Wfsv", "Wet financiering sociale verzekeringen", "Premie-financiering sociale zekerheid."),
)
HOUSEHOLD_NORMS = (
    ("alleenstaand", 1300),
    ("alleenstaande_ouder", 1700),
    ("gehuwd_partners", 1900),
    ("samenwonend_inwonend_kind", 1800),
)
SCENARIO_INPUTS = (
    ("baseline", "Geen wijzigingen — referentie-projectie", "n/a", "n/a"),
    ("iva_afschaf_2027", "IVA afgeschaft per 2027", "iva_volume_factor_2027", "0.0"),
    ("ww_versoberen", "WW max 12 mnd ipv 24", "ww_max_duur_mnd", "12"),
    ("wajong_uitbreiden_doelgroep", "Wajong-doelgroep verbreed", "wajong_volume_factor", "1.15"),
    ("proactieve_tw_uitrol", "Proactieve TW-aanvulling actief", "tw_aanvraag_factor", "1.30"),
)

# What each role may read, for which purposes, and which columns it sees in clear text.
ROLES: dict[str, dict[str, Any]] = {
    "smoketest": {
        "catalogs": ["bronze", "silver", "gold", "system", "system_jdbc"], "schemas": None, "purposes": ["*"],
        "can_see_pii": True, "can_see_medical": False, "can_see_bankrekening": False, "break_glass": False,
    },
    "data_steward": {
        "catalogs": ["bronze", "silver", "gold"], "schemas": None,
        "purposes": ["sturingsinfo", "kwaliteitscontrole"],
        "can_see_pii": True, "can_see_medical": False, "can_see_bankrekening": False, "break_glass": False,
    },
    "data_engineer": {
        "catalogs": ["bronze"], "schemas": None, "purposes": ["primair_proces"],
        "can_see_pii": True, "can_see_medical": False, "can_see_bankrekening": True, "break_glass": False,
    },
    "wia_beoordelaar": {
        "catalogs": ["silver", "gold"], "schemas": ["wia", "uc01_wia_funnel"],
        "purposes": ["uitkering", "behandeling", "reintegratie"],
        "can_see_pii": True, "can_see_medical": True, "can_see_bankrekening": False, "break_glass": False,
    },
    "ww_handhaver": {
        "catalogs": ["silver", "gold"], "schemas": ["ww", "uc03_ww_risk"], "purposes": ["handhaving"],
        "can_see_pii": True, "can_see_medical": False, "can_see_bankrekening": True, "break_glass": False,
    },
    "wajong_arbeidsdeskundige": {
        "catalogs": ["sensitive", "silver", "gold"], "schemas": ["wajong", "uc02_wajong"],
        "purposes": ["reintegratie", "behandeling"],
        "can_see_pii": True, "can_see_medical": True, "can_see_bankrekening": False, "break_glass": False,
    },
    "crm_medewerker": {
        "catalogs": ["gold"], "schemas": ["uc05_client_360"], "purposes": ["klantcontact", "behandeling"],
        "can_see_pii": False, "can_see_medical": False, "can_see_bankrekening": False, "break_glass": False,
    },
    "fez_analist": {
        "catalogs": ["gold"], "schemas": ["uc06_lastprognose"], "purposes": ["actuarie", "beleid"],
        "can_see_pii": False, "can_see_medical": False, "can_see_bankrekening": False, "break_glass": False,
    },
    "smz_planner": {
        "catalogs": ["gold", "silver"], "schemas": ["uc08_smz_capaciteit", "smz"], "purposes": ["planning"],
        "can_see_pii": False, "can_see_medical": False, "can_see_bankrekening": False, "break_glass": False,
    },
    "proactief_dienstverlener": {
        "catalogs": ["gold"], "schemas": ["uc04_tw_eligibility"], "purposes": ["proactieve_dienstverlening"],
        "can_see_pii": True, "can_see_medical": False, "can_see_bankrekening": False, "break_glass": False,
    },
    "researcher": {
        "catalogs": ["sandbox"], "schemas": None, "purposes": ["statistisch_onderzoek"],
        "can_see_pii": False, "can_see_medical": False, "can_see_bankrekening": False, "break_glass": False,
    },
    "platform_admin": {
        "catalogs": ["bronze", "silver", "gold", "sensitive", "sandbox"], "schemas": None, "purposes": ["*"],
        "can_see_pii": True, "can_see_medical": True, "can_see_bankrekening": True, "break_glass": True,
    },
}
RESOURCE_PURPOSES: dict[str, list[str]] = {
    "gold.uc01_wia_funnel.*": ["sturingsinfo"],
    "gold.uc04_tw_eligibility.*": ["proactieve_dienstverlening"],
    "gold.uc05_client_360.*": ["klantcontact", "behandeling"],
    "gold.uc06_lastprognose.*": ["actuarie", "beleid"],
    "gold.uc07_dq_polisadm.*": ["primair_proces", "kwaliteitscontrole"],
    "gold.uc08_smz_capaciteit.*": ["planning"],
    "silver.wia.*": ["uitkering", "behandeling", "reintegratie"],
    "silver.ww.*": ["uitkering", "handhaving"],
    "silver.wajong.*": ["reintegratie", "behandeling"],
    "silver.crm.*": ["klantcontact", "behandeling"],
    "silver.fez.*": ["actuarie", "beleid"],
    "silver.polisadm.*": ["primair_proces", "kwaliteitscontrole"],
    "silver.persoon.*": ["primair_proces", "kwaliteitscontrole"],
    "silver.zw.*": ["uitkering"],
    "sensitive.wajong.*": ["reintegratie", "behandeling"],
}
BRONZE_PURPOSES = ["primair_proces"]


def lookup(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A typed table from rows written in the code; its size is known here, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame([tuple(row) for row in rows], schema))


def regions(spark: SparkSession) -> DataFrame:
    return lookup(spark, REGIONS, "code string, naam string, provincie string")


def benefit_types(spark: SparkSession) -> DataFrame:
    return lookup(spark, BENEFIT_TYPES, "code string, beschrijving string, wet string")


def laws(spark: SparkSession) -> DataFrame:
    return lookup(spark, LAWS, "code string, naam string, omschrijving string")


def household_norms(spark: SparkSession) -> DataFrame:
    return lookup(spark, HOUSEHOLD_NORMS, "huishoud_type string, norm_per_maand_eur int")


def scenario_inputs(spark: SparkSession) -> DataFrame:
    return lookup(spark, SCENARIO_INPUTS, "scenario_id string, beschrijving string, parameter string, waarde string")


def policy_roles(spark: SparkSession) -> DataFrame:
    flags = ("can_see_pii", "can_see_medical", "can_see_bankrekening", "break_glass")
    rows = [
        (name, r["catalogs"], r["schemas"], r["purposes"], *[r[flag] for flag in flags]) for name, r in ROLES.items()
    ]
    return lookup(
        spark,
        rows,
        "role string, catalogs array<string>, schemas array<string>, purposes array<string>, "
        + ", ".join(f"{flag} boolean" for flag in flags),
    )


def policy_purposes(spark: SparkSession, bronze_schema: str = "raw") -> DataFrame:
    """Resource glob -> purposes; the name of the bronze schema is the caller's."""
    rows = [*RESOURCE_PURPOSES.items(), (f"bronze.{bronze_schema}.*", BRONZE_PURPOSES)]
    return lookup(spark, rows, "resource string, purposes array<string>")
