"""Models with one row per person."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polderlake.functions.identifiers import pseudonymize
from polderlake.functions.numbers import first_of_year, full_years

# Statuses that count as granted or open.
WIA_GRANTED = ("TOEGEKEND_WGA", "TOEGEKEND_IVA")
WW_OPEN = ("TOEGEKEND", "IN_BEHANDELING")


def household_income(employment: DataFrame) -> DataFrame:
    """Yearly and monthly pay per person over running employments."""
    yearly = (
        employment.filter("is_lopend")
        .groupBy("bsn")
        .agg(F.coalesce(F.sum("loon_bruto_jaar"), F.lit(0)).cast("bigint").alias("inkomen_jaar_eur"))
    )
    return yearly.withColumn("inkomen_maand_eur", F.col("inkomen_jaar_eur") / F.lit(12.0))


def persona_pseudonymized(persona: DataFrame, salt: str, as_of: date | Column) -> DataFrame:
    """Salted identifier, age in full years at `as_of`, and birth year next to the person's columns."""
    today = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return persona.select(
        "bsn",
        pseudonymize(F.col("bsn"), salt).alias("bsn_pseudo"),
        "voornaam",
        "achternaam",
        "geslacht",
        "geboortedatum",
        full_years(F.col("geboortedatum"), today).alias("leeftijd"),
        first_of_year(F.col("geboortedatum")).alias("geboortejaar"),
        "woonplaats",
        "postcode",
        "nationaliteit",
    )


def tw_eligibility(persona: DataFrame, income: DataFrame, norms: DataFrame, household: str = "alleenstaand") -> DataFrame:
    """Persons whose monthly income is below the norm of one household type."""
    norm = norms.filter(F.col("huishoud_type") == household).select("norm_per_maand_eur").scalar()
    with_income = persona.select("bsn").join(income.select("bsn", "inkomen_maand_eur"), "bsn", "left")
    return (
        with_income.select(
            "bsn",
            F.coalesce("inkomen_maand_eur", F.lit(0.0)).alias("inkomen_maand_eur"),
            norm.alias("norm_per_maand_eur"),
        )
        .filter(F.col("inkomen_maand_eur") < F.col("norm_per_maand_eur"))
        .select(
            "*",
            (F.col("norm_per_maand_eur") - F.col("inkomen_maand_eur")).alias("gat_per_maand"),
            F.lit(household).alias("huishoud_type_aanname"),
            F.lit("demo: huishoud_type via BRP-koppeling in productie").alias("toelichting"),
            F.lit(False).alias("opt_out"),
        )
    )


def _per_person(df: DataFrame, **aggregates: Column) -> DataFrame:
    """One aggregate row per person; partial sums are made before the shuffle, so a hot person is cheap."""
    return df.groupBy("bsn").agg(*[column.alias(name) for name, column in aggregates.items()])


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name)


def jobs_part(employment: DataFrame) -> DataFrame:
    """Running employments per person."""
    return _per_person(
        employment.filter("is_lopend"),
        n_dienstverbanden_lopend=F.count(F.lit(1)),
        totaal_loon_jaar=F.sum("loon_bruto_jaar"),
    )


def ww_part(ww: DataFrame) -> DataFrame:
    status = F.col("status")
    return _per_person(
        ww,
        n_lopende_ww=F.count_if(status.isin(*WW_OPEN)),
        n_ww_aanvragen=F.count(F.lit(1)),
        n_ww_toegekend=F.count_if(status == "TOEGEKEND"),
    )


def wia_part(wia: DataFrame) -> DataFrame:
    return _per_person(
        wia,
        max_ao_pct=F.max("arbeidsongeschikt_pct"),
        n_lopende_wia=F.count_if(F.col("status").isin(*WIA_GRANTED)),
        n_wia_aanvragen=F.count(F.lit(1)),
    )


def contacts_part(crm: DataFrame, as_of: datetime) -> DataFrame:
    """Contacts of the 30 days before `as_of` per person."""
    since = F.lit(as_of) - F.expr("INTERVAL 30 DAYS")
    return _per_person(crm.filter(F.col("contact_ts") >= since), n_klantcontacten_30d=F.count(F.lit(1)))


def client_360_of(persona: DataFrame, jobs: DataFrame, ww: DataFrame, wia: DataFrame, contacts: DataFrame) -> DataFrame:
    """The person's row beside the four parts, which have one row per person."""
    joined = persona
    for part in (jobs, ww, wia, contacts):
        joined = joined.join(part, "bsn", "left")
    return joined.select(
        "bsn", "voornaam", "achternaam", "geslacht", "geboortedatum", "straat", "huisnummer", "postcode",
        "woonplaats",
        _zero("n_dienstverbanden_lopend"),
        _zero("totaal_loon_jaar"),
        _zero("n_lopende_ww"),
        _zero("n_lopende_wia"),
        "max_ao_pct",
        _zero("n_klantcontacten_30d"),
    )


def client_360(
    persona: DataFrame, employment: DataFrame, ww: DataFrame, wia: DataFrame, crm: DataFrame, as_of: datetime
) -> DataFrame:
    """One row per person with counts from four domains, all joined on the same key."""
    return client_360_of(persona, jobs_part(employment), ww_part(ww), wia_part(wia), contacts_part(crm, as_of))


def effect_panel(pseudonymized: DataFrame, ww: DataFrame, wia: DataFrame, employment: DataFrame) -> DataFrame:
    """Pseudonymous panel: benefit and job history per person, without the citizen number."""
    return effect_panel_of(pseudonymized, ww_part(ww), wia_part(wia), jobs_part(employment))


def effect_panel_of(pseudonymized: DataFrame, ww: DataFrame, wia: DataFrame, jobs: DataFrame) -> DataFrame:
    """The panel from parts with one row per person."""
    joined = pseudonymized.select("bsn", "bsn_pseudo", "leeftijd", "geslacht")
    for part in (ww, wia, jobs):
        joined = joined.join(part, "bsn", "left")
    status = (
        F.when(F.col("n_dienstverbanden_lopend") > 0, "werkend")
        .when(F.col("n_ww_aanvragen") > 0, "WW")
        .when(F.col("n_wia_aanvragen") > 0, "WIA")
        .otherwise("overig")
    )
    return joined.select(
        "bsn_pseudo",
        "leeftijd",
        "geslacht",
        _zero("n_ww_aanvragen"),
        (F.coalesce("n_ww_toegekend", F.lit(0)) > 0).alias("ooit_ww_toegekend"),
        _zero("n_wia_aanvragen"),
        "max_ao_pct",
        F.coalesce("n_dienstverbanden_lopend", F.lit(0)).alias("dienstverbanden_lopend"),
        F.coalesce("totaal_loon_jaar", F.lit(0)).alias("loon_jaar_lopend"),
        status.alias("huidige_status"),
    )


def income_of(jobs: DataFrame) -> DataFrame:
    """`household_income` from the running employments per person."""
    yearly = jobs.select("bsn", F.coalesce("totaal_loon_jaar", F.lit(0)).cast("bigint").alias("inkomen_jaar_eur"))
    return yearly.withColumn("inkomen_maand_eur", F.col("inkomen_jaar_eur") / F.lit(12.0))
