"""Staging, intermediate models, marts."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.oracle import oracle
from catalog.registry import query, rounded
from fixtures.domain import AS_OF_DATE, AS_OF_TS, SALT, domain, row_count, stamp_key
from polderlake.plans import billing, clients, finance, journey, quality, staging
from polderlake.session import kept_path, once
from polderlake.sources import lookups
from polderlake.sources.envelopes import envelope

LOAD_DATE = "2024-01-15"
AS_OF = date.fromisoformat(AS_OF_DATE)
AS_OF_TIME = datetime.fromisoformat(AS_OF_TS)


# ---- staging: domain rows -> envelope text -> staged columns ---------------------------------------


def bronze_events(
    df: DataFrame, event_type: str, fields: dict[str, str], at: Column | None = None, day: Column | None = None
) -> DataFrame:
    """Bronze rows whose payload holds the given fields as JSON."""
    source = {"timestamp": F.date_format("contact_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")} if "timestamp" in fields else {}
    payload = F.struct(*[source.get(name, F.col(name)).alias(name) for name in fields])
    load = F.to_date(F.lit(LOAD_DATE)) if day is None else day
    return df.select(
        envelope(payload, event_type).alias("payload"),
        (load.cast("timestamp") if at is None else at).alias("source_ts"),
        load.alias("event_date"),
    )


def staged(spark: SparkSession, sf: str, entity: str, view: str, **times: Column) -> DataFrame:
    bronze = bronze_events(domain(spark, sf, view), f"{entity}.created", staging.PAYLOADS[entity], **times)
    return getattr(staging, f"stg_{entity}")(bronze)


_TAIL = f"timestamp '{LOAD_DATE} 00:00:00' as ingestion_source_ts, date '{LOAD_DATE}' as event_date"


def _staging_sql(view: str, columns: str, tail: str = _TAIL) -> str:
    return oracle(view, f"select {columns}, {tail} from {view}")


query(
    "stg_persona",
    _staging_sql(
        "persona",
        "bsn, voornaam, achternaam, geslacht, geboortedatum, straat, huisnummer, postcode, woonplaats, nationaliteit",
        "ingestion_source_ts, event_date",
    ),
)(lambda spark, sf: staged(spark, sf, "persona", "persona", at=F.col("ingestion_source_ts"), day=F.col("event_date")))
query(
    "stg_employment",
    oracle(
        "ikv",
        f"""select ikv_id, bsn, lh_nummer, werkgever_naam, aanvang_dienstverband, einde_dienstverband, loon_bruto_jaar,
 einde_dienstverband is null as is_lopend, {_TAIL} from ikv""",
    ),
)(lambda spark, sf: staged(spark, sf, "employment", "ikv"))
query(
    "stg_ww",
    _staging_sql("ww", "aanvraag_id, bsn, aanvraag_datum, laatste_werkdag, reden_einde_dienstverband, status"),
)(lambda spark, sf: staged(spark, sf, "ww", "ww"))
query(
    "stg_wia",
    _staging_sql(
        "wia",
        "aanvraag_id, bsn, aanvraag_datum, eerste_ziektedag, onderdeel, regio_code, status, arbeidsongeschikt_pct",
    ),
)(lambda spark, sf: staged(spark, sf, "wia", "wia"))
query("stg_wajong", _staging_sql("wajong", "dossier_id, bsn, regime, arbeidsvermogen, ingangsdatum"))(
    lambda spark, sf: staged(spark, sf, "wajong", "wajong")
)
query("stg_zw", _staging_sql("zw", "melding_id, bsn, eerste_ziektedag, duur_dagen"))(
    lambda spark, sf: staged(spark, sf, "zw", "zw")
)
query("stg_crm", _staging_sql("crm", "contact_id, bsn, kanaal, onderwerp, contact_ts, duur_seconden"))(
    lambda spark, sf: staged(spark, sf, "crm", "crm")
)
query("stg_fez", _staging_sql("fez", "jaar, maand, wet, regio_code, uitbetaald_bruto_eur, aantal_uitkeringen"))(
    lambda spark, sf: staged(spark, sf, "fez", "fez")
)


@query("stg_satisfaction", oracle("stg_satisfaction", "select * from stg_satisfaction"))
def stg_satisfaction(spark: SparkSession, sf: str) -> DataFrame:
    return staging.stg_satisfaction(domain(spark, sf, "satisfaction"))


_BILLING_RENAMED = ", ".join(
    f"{name} as {staging.snake_case(name)}" for name, _, _ in staging.BILLING_COLUMNS if name not in ("Provider", "Tags")
)


def _billing(spark: SparkSession, sf: str) -> DataFrame:
    return staging.stg_billing(domain(spark, sf, "billing"))


def stored_billing(spark: SparkSession, sf: str) -> DataFrame:
    """The staged billing rows as a table of the marts' columns, which is made once and read by all marts on it.

    Rows are written where they are joined: sending them to files of even sizes cost more than all marts. Small row
    groups let several tasks read a table that few have written.
    """

    def make() -> str:
        path = kept_path(spark, "billing")
        _billing(spark, sf).select(*billing.MART_COLUMNS).write.option("parquet.block.size", 8 << 20).parquet(path)
        return path

    return spark.read.parquet(once(spark, stamp_key(sf, "billing"), make))


@query(
    "stg_billing",
    oracle(
        "billing",
        f"""select {_BILLING_RENAMED}, lower(Provider) as provider, Tags as tags_raw,
 cast(date_trunc('month', BillingPeriodStart) as date) as billing_month,
 cast(coalesce(ListCost, EffectiveCost) - EffectiveCost as decimal(18,6)) as savings_amount,
 json_extract_string(Tags, '$.environment') as tag_environment,
 json_extract_string(Tags, '$.application') as tag_application,
 json_extract_string(Tags, '$.cost_center') as tag_cost_center, ingestion_ts, source_file, event_date from billing""",
    ),
)
def stg_billing(spark: SparkSession, sf: str) -> DataFrame:
    return _billing(spark, sf)


@query(
    "payload_explode_odd_names",
    oracle("wia", "select aanvraag_id, cast(null as varchar) as VOIDED_AT, status as IS_VOID from wia"),
)
def payload_explode_odd_names(spark: SparkSession, sf: str) -> DataFrame:
    """Fields whose names hold the name of a type, one of them always null; the schema is inferred."""
    payload = F.to_json(F.struct("aanvraag_id", F.lit(None).cast("string").alias("VOIDED_AT"), F.col("status").alias("IS_VOID")), {"ignoreNullFields": "false"})
    bronze = domain(spark, sf, "wia").select(F.concat(F.lit('{"payload":'), payload, F.lit("}")).alias("payload"))
    return staging.explode_payload(bronze).select("aanvraag_id", "VOIDED_AT", "IS_VOID")


@query(
    "payload_explode",
    oracle(
        "wia",
        """select aanvraag_id, bsn, cast(aanvraag_datum as varchar) as aanvraag_datum,
 cast(eerste_ziektedag as varchar) as eerste_ziektedag, onderdeel, regio_code, status,
 cast(arbeidsongeschikt_pct as bigint) as arbeidsongeschikt_pct from wia""",
    ),
)
def payload_explode(spark: SparkSession, sf: str) -> DataFrame:
    return staging.explode_payload(bronze_events(domain(spark, sf, "wia"), "wia.created", staging.PAYLOADS["wia"]))


# ---- journey --------------------------------------------------------------------------------------

ENTITIES = {"persona": "persona", "employment": "ikv", "ww": "ww", "zw": "zw", "wia": "wia", "wajong": "wajong", "crm": "crm"}


def events(spark: SparkSession, sf: str) -> DataFrame:
    return journey.journey_events({entity: domain(spark, sf, view) for entity, view in ENTITIES.items()})


def most_events(spark: SparkSession, sf: str) -> int:
    """A bound on the events: one for a customer or a contact, and two for an order."""
    return sum(weight * row_count(spark, sf, name) for name, weight in (("customer", 1), ("orders", 2), ("events", 1)))


def phases(spark: SparkSession, sf: str) -> DataFrame:
    return journey.phases_of_events(events(spark, sf), at_most=most_events(spark, sf))


query("journey_events", oracle("events_all", "select * from events_all"))(events)


@query("journey_ranked", oracle("ranked", "select * from ranked"))
def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return journey.journey_ranked(events(spark, sf), at_most=most_events(spark, sf))


query("journey_phases", oracle("phases", "select * from phases"))(phases)


@query("journey_phases_hosted", oracle("phases_hosted", "select * from phases_hosted"))
def phases_hosted(spark: SparkSession, sf: str) -> DataFrame:
    """Without a known bound on the events: persons with very many are looked for, as on a table of unknown size."""
    return journey.phases_of_events(events(spark, sf), journey.PHASES_HOSTED)


# ---- persons --------------------------------------------------------------------------------------


@query("household_income", oracle("income", "select bsn, inkomen_jaar_eur, round(inkomen_maand_eur,6) as inkomen_maand_eur from income"))
def household_income(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clients.household_income(domain(spark, sf, "ikv")), 6, "inkomen_maand_eur")


@query("persona_pseudonymized", oracle("pseudonymized", "select * from pseudonymized"))
def persona_pseudonymized(spark: SparkSession, sf: str) -> DataFrame:
    return clients.persona_pseudonymized(domain(spark, sf, "persona"), SALT, AS_OF)


def tw_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    income = clients.household_income(domain(spark, sf, "ikv"))
    return clients.tw_eligibility(domain(spark, sf, "persona"), income, lookups.household_norms(spark))


@query(
    "tw_eligibility",
    oracle(
        "tw_eligibility",
        """select bsn, round(inkomen_maand_eur,6) as inkomen_maand_eur, norm_per_maand_eur,
 round(gat_per_maand,6) as gat_per_maand, huishoud_type_aanname, toelichting, opt_out from tw_eligibility""",
    ),
)
def tw_eligibility_rounded(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tw_eligibility(spark, sf), 6, "inkomen_maand_eur", "gat_per_maand")


@query("client_360", oracle("client_360", "select * from client_360"))
def client_360(spark: SparkSession, sf: str) -> DataFrame:
    parts = [domain(spark, sf, view) for view in ("persona", "ikv", "ww", "wia", "crm")]
    return clients.client_360(*parts, as_of=AS_OF_TIME)


@query("effect_panel", oracle("effect_panel", "select * from effect_panel"))
def effect_panel(spark: SparkSession, sf: str) -> DataFrame:
    parts = [domain(spark, sf, view) for view in ("ww", "wia", "ikv")]
    return clients.effect_panel(persona_pseudonymized(spark, sf), *parts)


# ---- finance --------------------------------------------------------------------------------------


def wia_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return finance.wia_funnel_daily(domain(spark, sf, "wia"))


@query(
    "wia_funnel_daily",
    oracle("wia_funnel", "select * replace (round(gemid_ao_pct,6) as gemid_ao_pct) from wia_funnel"),
)
def wia_funnel_daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(wia_funnel(spark, sf), 6, "gemid_ao_pct")


@query("benefit_projection_5y", oracle("projection", "select * from projection"))
def projection(spark: SparkSession, sf: str) -> DataFrame:
    return finance.benefit_projection(domain(spark, sf, "fez"))


@query(
    "scenario_results",
    oracle(
        "projection",
        """select jaar, maand, wet, regio_code,
 case when s.scenario_id='iva_afschaf_2027' and wet='WIA' and jaar>=2027 then 0
  when s.scenario_id='ww_versoberen' and wet='WW' then cast(floor(uitbetaald_bruto_eur_projection*0.5::double+0.5) as bigint)
  else uitbetaald_bruto_eur_projection end as uitbetaald_bruto_eur_projection,
 case when s.scenario_id='iva_afschaf_2027' and wet='WIA' and jaar>=2027 then 0
  when s.scenario_id='ww_versoberen' and wet='WW' then cast(floor(aantal_uitkeringen_projection*0.5::double+0.5) as bigint)
  else aantal_uitkeringen_projection end as aantal_uitkeringen_projection, s.scenario_id
from projection cross join (values ('baseline'),('iva_afschaf_2027'),('ww_versoberen')) s(scenario_id)""",
    ),
)
def scenario_results(spark: SparkSession, sf: str) -> DataFrame:
    return finance.scenario_results(projection(spark, sf), lookups.scenario_inputs(spark))


# ---- billing and satisfaction -----------------------------------------------------------------------

_MONEY = ("billed_cost", "effective_cost", "list_cost", "savings_amount", "usage_quantity")


def _money(df: DataFrame, *more: str) -> DataFrame:
    """Decimal totals as doubles, rounded like the comparison text."""
    return rounded(df, 4, *[name for name in (*_MONEY, *more) if name in df.columns])


def _money_sql(mart: str, *columns: str) -> str:
    replaced = ", ".join(f"round({name},4) as {name}" for name in columns)
    return oracle(mart, f"select * replace ({replaced}) from {mart}")


@query("spend_monthly", _money_sql("spend_monthly", *_MONEY))
def spend_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return _money(billing.spend_monthly(stored_billing(spark, sf)))


@query("service_breakdown", _money_sql("breakdown", "effective_cost", "billed_cost", "usage_quantity"))
def service_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return _money(billing.service_breakdown(stored_billing(spark, sf)))


_COMMITMENT = ("committed_spend", "on_demand_spend", "dynamic_spend", "total_spend", "savings_amount",
               "commitment_coverage_pct", "effective_discount_pct")


@query("commitment_utilization", _money_sql("commitment", *_COMMITMENT))
def commitment_utilization(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(billing.commitment_utilization(stored_billing(spark, sf)), 4, *_COMMITMENT)


@query("savings", _money_sql("savings", "list_cost", "effective_cost", "savings_amount", "savings_pct"))
def savings(spark: SparkSession, sf: str) -> DataFrame:
    return _money(billing.savings(stored_billing(spark, sf)), "savings_pct")


@query("top_resources", _money_sql("top_resources", "effective_cost", "billed_cost", "usage_quantity"))
def top_resources(spark: SparkSession, sf: str) -> DataFrame:
    return _money(billing.top_resources(stored_billing(spark, sf), at_most=row_count(spark, sf, "lineitem")))


def satisfaction(spark: SparkSession, sf: str) -> DataFrame:
    return billing.satisfaction_monthly(stg_satisfaction(spark, sf))


@query(
    "satisfaction_monthly",
    oracle(
        "satisfaction_monthly",
        """select * replace (round(gemid_score_gewogen,6) as gemid_score_gewogen,
 round(gemid_score_ongew,6) as gemid_score_ongew) from satisfaction_monthly""",
    ),
)
def satisfaction_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(satisfaction(spark, sf), 6, "gemid_score_gewogen", "gemid_score_ongew")


# ---- quality reports --------------------------------------------------------------------------------


@query("dq_daily_report", oracle("dq_daily", "select * from dq_daily"))
def dq_daily(spark: SparkSession, sf: str) -> DataFrame:
    return quality.dq_daily_report(domain(spark, sf, "ikv"))


@query("dq_violations", oracle("dq_violations", "select * from dq_violations"))
def dq_violations(spark: SparkSession, sf: str) -> DataFrame:
    return quality.dq_violations(
        {
            "uc01": wia_funnel(spark, sf),
            "uc04": tw_eligibility(spark, sf),
            "uc05": client_360(spark, sf),
            "uc06": projection(spark, sf),
            "uc07": dq_daily(spark, sf),
            "uc09": effect_panel(spark, sf),
            "uc_klant_tev": satisfaction(spark, sf),
        }
    )


@query("dq_overview", oracle("dq_overview", "select * from dq_overview"))
def dq_overview(spark: SparkSession, sf: str) -> DataFrame:
    return quality.dq_overview(dq_violations(spark, sf))


def raw_billing_marts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The cloud-cost marts as the library returns them."""
    rows = stored_billing(spark, sf)
    return {
        "spend_monthly": billing.spend_monthly(rows),
        "breakdown": billing.service_breakdown(rows),
        "commitment": billing.commitment_utilization(rows),
        "savings": billing.savings(rows),
        "top_resources": billing.top_resources(rows, at_most=row_count(spark, sf, "lineitem")),
    }
