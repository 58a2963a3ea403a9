"""Governed reads and access decisions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import marts
from catalog.oracle import oracle
from catalog.registry import query, rounded
from fixtures.domain import domain
from polderlake.operators import anonymity
from polderlake.operators import governance as gov
from polderlake.sources import lookups

JOURNEY = gov.JOURNEY_SCHEMA


@query("filter_region", oracle("wia", "select * from wia where regio_code = 'AMS'"))
def filter_region(spark: SparkSession, sf: str) -> DataFrame:
    return domain(spark, sf, "wia").filter(gov.filter_region("wia", ["wia_beoordelaar"], "ams"))


_OPT = "cast(substr(bsn,9,1) as int) % 3 = 0"


@query(
    "filter_opt_out",
    oracle("tw_eligibility", f"select bsn, {_OPT} as opt_out from tw_eligibility where not ({_OPT})"),
)
def filter_opt_out(spark: SparkSession, sf: str) -> DataFrame:
    rows = marts.tw_eligibility(spark, sf).select("bsn", F.expr(_OPT).alias("opt_out"))
    return rows.filter(gov.filter_opt_out("uc04_tw_eligibility"))


_PSEUDO = "case when leeftijd % 4 = 0 then null else bsn_pseudo end"


@query(
    "filter_pseudo_only",
    oracle("pseudonymized", f"select * from (select {_PSEUDO} as bsn_pseudo, leeftijd from pseudonymized) where bsn_pseudo is not null"),
)
def filter_pseudo_only(spark: SparkSession, sf: str) -> DataFrame:
    rows = marts.persona_pseudonymized(spark, sf).select(F.expr(_PSEUDO).alias("bsn_pseudo"), "leeftijd")
    return rows.filter(gov.filter_pseudo_only("uc09", "sandbox"))


@query(
    "governed_read_sandbox",
    oracle("pseudonymized", f"""select * from (select {_PSEUDO} as bsn_pseudo, leeftijd,
 cast(date_trunc('year', geboortedatum) as date) as geboortedatum from pseudonymized) where bsn_pseudo is not null"""),
)
def governed_read_sandbox(spark: SparkSession, sf: str) -> DataFrame:
    rows = marts.persona_pseudonymized(spark, sf).select(F.expr(_PSEUDO).alias("bsn_pseudo"), "leeftijd", "geboortedatum")
    return gov.governed_read(rows, "uc09", ["data_steward"], catalog="sandbox")


@query("filter_region_or_null", oracle("ranked", "select * from ranked where regio_code = 'AMS' or regio_code is null"))
def filter_region_or_null(spark: SparkSession, sf: str) -> DataFrame:
    return marts.ranked(spark, sf).filter(gov.filter_region_or_null(JOURNEY, ["wia_beoordelaar"], "AMS"))


@query(
    "filter_medical_events",
    oracle("ranked", "select * from ranked where not (domein='wia' and event_status in ('TOEGEKEND_WGA','TOEGEKEND_IVA'))"),
)
def filter_medical_events(spark: SparkSession, sf: str) -> DataFrame:
    return marts.ranked(spark, sf).filter(gov.filter_medical_events(JOURNEY, ["ww_handhaver"]))


@query(
    "mask_bsn",
    oracle(
        "persona",
        "select c_custkey, 'XXXXX' || substr(bsn,6,4) as crm, 'XXXXXX' || substr(bsn,7,3) as other, bsn as clear from persona",
    ),
)
def mask_bsn(spark: SparkSession, sf: str) -> DataFrame:
    return domain(spark, sf, "persona").select(
        "c_custkey",
        gov.mask_bsn(["crm_medewerker"]).alias("crm"),
        gov.mask_bsn(["researcher"]).alias("other"),
        F.col("bsn").alias("clear"),
    )


def _accounts(spark: SparkSession, sf: str) -> DataFrame:
    return domain(spark, sf, "persona").select(
        "c_custkey", "bsn", F.concat(F.lit("NL01BANK0"), F.col("bsn")).alias("iban"),
        F.concat(F.lit("F"), F.col("huisnummer").cast("string")).alias("diagnose"), "geboortedatum",
    )


_ACCOUNTS = """, a as (select c_custkey, bsn, 'NL01BANK0' || bsn as iban, 'F' || cast(huisnummer as varchar) as diagnose,
 geboortedatum from persona)"""


@query(
    "mask_bank_account",
    oracle(
        "persona",
        f"{_ACCOUNTS} select c_custkey, iban as handhaver, 'NLxx XXXX XXXX XXXX' as crm, iban as admin from a",
    ),
)
def mask_bank_account(spark: SparkSession, sf: str) -> DataFrame:
    rows = _accounts(spark, sf)

    def seen(role: str) -> Column:
        mask = gov.mask_bank_account([role])
        return F.col("iban") if mask is None else mask

    return rows.select(
        "c_custkey", seen("ww_handhaver").alias("handhaver"), seen("crm_medewerker").alias("crm"),
        seen("platform_admin").alias("admin"),
    )


@query(
    "mask_medical",
    oracle("persona", f"{_ACCOUNTS} select c_custkey, cast(null as varchar) as diagnose from a"),
)
def mask_medical(spark: SparkSession, sf: str) -> DataFrame:
    return gov.governed_read(_accounts(spark, sf).select("c_custkey", "diagnose"), "wajong", ["data_steward"])


@query(
    "mask_birth_year",
    oracle("persona", "select c_custkey, cast(date_trunc('year', geboortedatum) as date) as geboortedatum from persona"),
)
def mask_birth_year(spark: SparkSession, sf: str) -> DataFrame:
    rows = domain(spark, sf, "persona").select("c_custkey", "geboortedatum")
    return gov.governed_read(rows, "persoon", ["data_steward"])


@query(
    "mask_event_label",
    oracle("ranked", "select bsn, event_seq, domein || '.' || event_type as event_label from ranked"),
)
def mask_event_label(spark: SparkSession, sf: str) -> DataFrame:
    label = gov.mask_event_label(JOURNEY, ["data_steward"])
    return marts.ranked(spark, sf).select("bsn", "event_seq", label.alias("event_label"))


@query("mask_source_ref", oracle("ranked", "select bsn, event_seq, '***' as source_ref_id from ranked"))
def mask_source_ref(spark: SparkSession, sf: str) -> DataFrame:
    mask = gov.mask_source_ref(JOURNEY, ["fez_analist"])
    return marts.ranked(spark, sf).select("bsn", "event_seq", mask.alias("source_ref_id"))


@query(
    "governed_read",
    oracle(
        "ranked",
        """select * replace ('XXXXX' || substr(bsn,6,4) as bsn, domein || '.' || event_type as event_label)
 from ranked""",
    ),
)
def governed_read(spark: SparkSession, sf: str) -> DataFrame:
    return gov.governed_read(marts.ranked(spark, sf), JOURNEY, ["crm_medewerker"])


@query(
    "governed_read_two_roles",
    oracle(
        "ranked",
        """select * from ranked where (regio_code='AMS' or regio_code is null)
 and not (domein='wia' and event_status in ('TOEGEKEND_WGA','TOEGEKEND_IVA'))""",
    ),
)
def governed_read_two_roles(spark: SparkSession, sf: str) -> DataFrame:
    return gov.governed_read(marts.ranked(spark, sf), JOURNEY, ["wia_beoordelaar", "ww_handhaver"], "ams")


@query(
    "access_decisions",
    oracle(
        "access_requests",
        """, r as (select request_id, user_name, role, operation, schema_name, lower(purpose) as purpose,
 coalesce(grant_role = 'data_access:' || catalog_name || '.' || schema_name, false) as granted
 from access_requests), f as (select *,
 granted or case role when 'crm_medewerker' then schema_name = 'uc05_client_360'
  when 'wia_beoordelaar' then schema_name = 'uc01_wia_funnel' when 'data_steward' then true
  when 'fez_analist' then schema_name = 'uc06_lastprognose' when 'platform_admin' then true else false end as role_ok,
 case schema_name when 'uc05_client_360' then ['klantcontact','behandeling'] when 'uc01_wia_funnel' then ['sturingsinfo']
  when 'uc06_lastprognose' then ['actuarie','beleid'] else [] end as required,
 case role when 'crm_medewerker' then ['klantcontact','behandeling']
  when 'wia_beoordelaar' then ['uitkering','behandeling','reintegratie']
  when 'data_steward' then ['sturingsinfo','kwaliteitscontrole'] when 'fez_analist' then ['actuarie','beleid']
  when 'platform_admin' then ['*'] else ['statistisch_onderzoek'] end as own from r),
 g as (select *, len(required) = 0 or list_contains(own, '*') or (list_contains(required, purpose)
  and (granted or list_contains(own, purpose))) as purpose_ok from f)
select request_id, role_ok, purpose_ok, case when user_name = '' then false when operation = 'ExecuteQuery' then true
 when operation = 'InsertIntoTable' then role = 'platform_admin' else role_ok and purpose_ok end as allowed from g""",
    ),
)
def access_decisions(spark: SparkSession, sf: str) -> DataFrame:
    requests = domain(spark, sf, "access_requests").withColumn("roles", F.array("role", "grant_role"))
    return gov.access_decisions(requests, lookups.policy_roles(spark), lookups.policy_purposes(spark))


@query(
    "min_group_size",
    oracle(
        "effect_panel",
        """select huidige_status, geslacht, count(*) as n, round(avg(leeftijd),6) as gem_leeftijd from effect_panel
 group by all having count(*) >= 30""",
    ),
)
def min_group_size(spark: SparkSession, sf: str) -> DataFrame:
    groups = marts.effect_panel(spark, sf).groupBy("huidige_status", "geslacht").agg(
        F.count(F.lit(1)).alias("n"), F.avg("leeftijd").alias("gem_leeftijd")
    )
    return rounded(gov.min_group_size(groups, "n", 30), 6, "gem_leeftijd")


# ---- publication ------------------------------------------------------------------------------------

_K = 20
_LADDER_SQL = {
    "leeftijd": ("cast(leeftijd as varchar)", "cast(leeftijd // 5 * 5 as varchar)", "cast(leeftijd // 20 * 20 as varchar)", "'*'"),
    "geslacht": ("geslacht", "'*'"),
    "woonplaats": ("woonplaats", "substr(woonplaats, 1, 1)", "'*'"),
}


def _publication_sql() -> str:
    """Node after node: the groups that are large enough, and what goes on without them."""
    steps = {f"{c}{i}": text for c, ladder in _LADDER_SQL.items() for i, text in enumerate(ladder)}
    nodes = sorted(product(*[range(len(ladder)) for ladder in _LADDER_SQL.values()]), key=lambda node: (sum(node), node))
    parts = [f""", r0 as materialized (select {', '.join(f"coalesce({text}, '?') as {name}" for name, text in steps.items())}, count(*) as n
 from pseudonymized group by all)"""]
    shown = []
    for i, node in enumerate(nodes):
        names = [f"{c}{level}" for c, level in zip(_LADDER_SQL, node, strict=True)]
        cols = ", ".join(names)
        parts.append(f"g{i} as materialized (select {cols}, sum(n) as total from r{i} group by {cols} having sum(n) >= {_K})")
        parts.append(f"r{i + 1} as materialized (select r{i}.* from r{i} anti join g{i} using ({cols}))")
        aliased = ", ".join(f"{name} as {c}" for name, c in zip(names, _LADDER_SQL, strict=True))
        shown.append(f"select '{','.join(map(str, node))}' as node, {aliased}, cast(total as bigint) as n from g{i}")
    nulls = ", ".join(f"null as {c}" for c in _LADDER_SQL)
    shown.append(f"select null as node, {nulls}, cast(sum(n) as bigint) as n from r{len(nodes)} having sum(n) > 0")
    return ",\n".join(parts) + "\n" + "\nunion all ".join(shown)


@query("publish_k_anonymous", oracle("pseudonymized", _publication_sql()))
def publish_k_anonymous(spark: SparkSession, sf: str) -> DataFrame:
    """Age, sex and town of all persons in groups of 20 at least."""
    age = F.col("leeftijd")
    ladders = {
        "leeftijd": [age, F.floor(age / 5) * 5, F.floor(age / 20) * 20, F.lit(anonymity.ALL)],
        "geslacht": [F.col("geslacht"), F.lit(anonymity.ALL)],
        "woonplaats": [F.col("woonplaats"), F.substring("woonplaats", 1, 1), F.lit(anonymity.ALL)],
    }
    return anonymity.publish_k_anonymous(marts.persona_pseudonymized(spark, sf), ladders, _K)
