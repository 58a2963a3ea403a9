"""Data-quality reports on the employment records and on the marts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polderlake.functions.identifiers import PAYROLL_FORMAT, TEST_RANGE_FORMAT
from polderlake.operators.checks import duplicates

PAY_LIMIT = 250_000


def dq_daily_report(employment: DataFrame) -> DataFrame:
    """Counts of suspicious employment records per load day."""
    return employment.groupBy(F.col("event_date").alias("rapport_datum")).agg(
        F.count(F.lit(1)).alias("n_ikvs"),
        F.count_distinct("bsn").alias("n_unieke_bsns"),
        F.count_if("is_lopend").alias("n_lopend"),
        F.count_if(~F.col("bsn").rlike(TEST_RANGE_FORMAT)).alias("n_bsn_buiten_test_bereik"),
        F.count_if(F.col("loon_bruto_jaar").isNull()).alias("n_loon_null"),
        F.count_if(F.col("loon_bruto_jaar") > PAY_LIMIT).alias("n_loon_boven_250k"),
        F.count_if(~F.col("lh_nummer").rlike(PAYROLL_FORMAT)).alias("n_lh_format_fout"),
    )


def _null(name: str) -> Column:
    return F.count_if(F.col(name).isNull())


def _not_in(name: str, *values: str) -> Column:
    return F.count_if(~F.col(name).isin(*values))


def _outside(name: str, low: float, high: float) -> Column:
    return F.count_if((F.col(name) < low) | (F.col(name) > high))


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


# Use cases, their titles, and the checks with their severities.
def _rules() -> dict[str, tuple[str, Column, dict[str, tuple[str, Column]]]]:
    """Per mart: name of the use case, number of records, and check -> (severity, violations)."""
    rows = F.count(F.lit(1))
    return {
        "uc01": ("WIA Funnel", rows, {
            "aanvraag_datum_not_null": ("high", _null("aanvraag_datum")),
            "status_not_null": ("high", _null("status")),
            "n_aanvragen_non_negative": ("high", F.count_if(F.col("n_aanvragen") < 0)),
            "onderdeel_in_WGA_IVA": ("medium", _not_in("onderdeel", "WGA", "IVA")),
        }),
        "uc04": ("TW Eligibility", rows, {
            "bsn_not_null": ("critical", _null("bsn")),
            "inkomen_not_null": ("high", _null("inkomen_maand_eur")),
            "gat_per_maand_non_negative": ("high", F.count_if(F.col("gat_per_maand") < 0)),
        }),
        "uc05": ("Client 360", rows, {
            "bsn_not_null": ("critical", _null("bsn")),
            "bsn_unique": ("critical", duplicates("bsn")),
            "voornaam_not_null": ("high", _null("voornaam")),
            "geslacht_in_M_V_X": ("medium", _not_in("geslacht", "M", "V", "X")),
        }),
        "uc06": ("Lastprognose", rows, {
            "jaar_in_2026_2030": ("high", _outside("jaar", 2026, 2030)),
            "maand_in_1_12": ("high", _outside("maand", 1, 12)),
        }),
        "uc07": ("DQ Polisadm", _total("n_ikvs"), {
            "bsn_buiten_test_bereik": ("critical", _total("n_bsn_buiten_test_bereik")),
            "lh_format_fout": ("high", _total("n_lh_format_fout")),
            "loon_null": ("medium", _total("n_loon_null")),
            "loon_boven_250k": ("medium", _total("n_loon_boven_250k")),
        }),
        "uc09": ("Reint Effect", rows, {
            "bsn_pseudo_not_null": ("critical", _null("bsn_pseudo")),
            "bsn_pseudo_unique": ("critical", duplicates("bsn_pseudo")),
            "leeftijd_in_18_100": ("high", _outside("leeftijd", 18, 100)),
            "huidige_status_in_set": ("medium", _not_in("huidige_status", "werkend", "WW", "WIA", "overig")),
        }),
        "uc_klant_tev": ("Klanttevredenheid", rows, {
            "maand_not_null": ("high", _null("maand")),
            "kanaal_not_null": ("high", _null("kanaal")),
            "n_respondenten_min_1": ("high", F.count_if(F.col("n_respondenten") < 1)),
            "gemid_score_in_1_5": ("high", _outside("gemid_score_gewogen", 1, 5)),
        }),
    }


def dq_violations(marts: Mapping[str, DataFrame]) -> DataFrame:
    """One row per check over seven marts; each mart is read once, whatever its number of checks."""
    result = None
    for code, (title, records, checks) in _rules().items():
        counts = marts[code].agg(
            records.cast("bigint").alias("n_records"),
            *[violations.cast("bigint").alias(name) for name, (_, violations) in checks.items()],
        )
        severity = F.element_at(F.create_map(*[F.lit(x) for n, (s, _) in checks.items() for x in (n, s)]), F.col("check_name"))
        long = counts.unpivot("n_records", list(checks), "check_name", "n_violations").select(
            F.lit(code).alias("uc_code"),
            F.lit(title).alias("uc_name"),
            "check_name",
            severity.alias("severity"),
            "n_violations",
            "n_records",
        )
        result = long if result is None else result.unionByName(long)
    return result


def dq_overview(violations: DataFrame) -> DataFrame:
    """Score and traffic light per use case."""
    of = lambda level: F.sum(F.when(F.col("severity") == level, F.col("n_violations")).otherwise(0))
    totals = violations.groupBy("uc_code", "uc_name").agg(
        F.max("n_records").alias("n_records"),
        F.count(F.lit(1)).alias("n_checks"),
        F.sum("n_violations").alias("n_violations"),
        of("critical").alias("n_violations_critical"),
        of("high").alias("n_violations_high"),
        of("medium").alias("n_violations_medium"),
        F.count_if(F.col("n_violations") > 0).alias("n_failing_checks"),
    )
    evaluations = F.col("n_records") * F.col("n_checks")
    score = F.when(evaluations == 0, F.lit(100.0)).otherwise(
        F.round(F.lit(100.0) - F.try_divide(F.col("n_violations").cast("double"), evaluations) * 100.0, 2)
    )
    light = (
        F.when(F.col("n_violations_critical") > 0, "rood")
        .when(F.col("n_violations_high") > 0, "oranje")
        .when(F.col("n_violations_medium") > 0, "geel")
        .otherwise("groen")
    )
    return totals.select(
        "uc_code",
        "uc_name",
        "n_records",
        "n_checks",
        (F.col("n_checks") - F.col("n_failing_checks")).alias("n_passing_checks"),
        "n_failing_checks",
        "n_violations",
        "n_violations_critical",
        "n_violations_high",
        "n_violations_medium",
        score.alias("dq_score_pct"),
        light.alias("dq_status"),
    )
