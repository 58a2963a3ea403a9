"""Benefit funnel and benefit-load projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polderlake.functions.numbers import half_up_long
from polderlake.plans.clients import WIA_GRANTED


def wia_funnel_daily(wia: DataFrame) -> DataFrame:
    status = F.col("status")
    return wia.groupBy("aanvraag_datum", "regio_code", "onderdeel", "status").agg(
        F.count(F.lit(1)).alias("n_aanvragen"),
        F.avg("arbeidsongeschikt_pct").alias("gemid_ao_pct"),
        F.count_if(status == "IN_BEHANDELING").alias("n_in_behandeling"),
        F.count_if(status.isin(*WIA_GRANTED)).alias("n_toegekend"),
        F.count_if(status == "AFGEWEZEN").alias("n_afgewezen"),
    )


def benefit_projection(fez: DataFrame, first_year: int = 2026, last_year: int = 2030) -> DataFrame:
    """The mean month per law and region, repeated for every month of the projected years.

    This is a flat mean, not a trend. The rows are multiplied only after both aggregates, so the
    multiplier works on laws x regions.
    """
    months = fez.groupBy("jaar", "maand", "wet", "regio_code").agg(
        F.sum("uitbetaald_bruto_eur").alias("eur"), F.sum("aantal_uitkeringen").alias("n")
    )
    means = months.groupBy("wet", "regio_code").agg(F.avg("eur").alias("eur"), F.avg("n").alias("n"))
    years = means.withColumn("jaar", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))))
    return years.withColumn("maand", F.explode(F.sequence(F.lit(1), F.lit(12)))).select(
        "jaar",
        "maand",
        "wet",
        "regio_code",
        half_up_long(F.col("eur")).alias("uitbetaald_bruto_eur_projection"),
        half_up_long(F.col("n")).alias("aantal_uitkeringen_projection"),
        F.lit("baseline").alias("scenario_id"),
    )


# Scenario -> (law, first year, factor); a scenario without a rule keeps the baseline.
SCENARIOS: dict[str, tuple[str, int, float] | None] = {
    "baseline": None,
    "iva_afschaf_2027": ("WIA", 2027, 0.0),
    "ww_versoberen": ("WW", 0, 0.5),
}


def _under_scenario(value: Column) -> Column:
    changed = None
    for scenario, rule in SCENARIOS.items():
        if rule is None:
            continue
        law, year, factor = rule
        test = (F.col("scenario_id") == scenario) & (F.col("wet") == law) & (F.col("jaar") >= year)
        scaled = half_up_long(value * F.lit(factor))
        changed = F.when(test, scaled) if changed is None else changed.when(test, scaled)
    return changed.otherwise(value)


def scenario_results(projection: DataFrame, scenarios: DataFrame) -> DataFrame:
    """The projection once per known scenario that the lookup lists."""
    known = F.explode(F.array(*[F.lit(name) for name in SCENARIOS]))
    listed = scenarios.select("scenario_id").distinct()
    per_scenario = projection.drop("scenario_id").withColumn("scenario_id", known).join(listed, "scenario_id", "left_semi")
    eur, n = "uitbetaald_bruto_eur_projection", "aantal_uitkeringen_projection"
    return per_scenario.select(
        "jaar", "maand", "wet", "regio_code",
        _under_scenario(F.col(eur)).alias(eur),
        _under_scenario(F.col(n)).alias(n),
        "scenario_id",
    )
