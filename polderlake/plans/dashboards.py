"""The chart sets of the dashboards, as data for `chart_query`."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polderlake.operators.charts import Chart, Filter, Metric, chart_query


def _count(column: str) -> Metric:
    return Metric(column, "COUNT", "value")


def _distinct(column: str) -> Metric:
    return Metric(column, "COUNT_DISTINCT", "value")


def _sum(column: str) -> Metric:
    return Metric(column, "SUM", "value")


def _avg(column: str) -> Metric:
    return Metric(column, "AVG", "value")


def _kpi(metric: Metric) -> Chart:
    return Chart([metric])


def _split(metric: Metric, *by: str, limit: int = 1000, where: tuple[Filter, ...] = ()) -> Chart:
    return Chart([metric], by, filters=where, row_limit=limit)


def _line(metric: Metric, at: str, grain: str, *by: str, where: tuple[Filter, ...] = ()) -> Chart:
    return Chart([metric], by, at, grain, where)


_USAGE = (Filter("charge_category", "==", "Usage"),)

# Dashboard -> chart -> (mart, chart). The first metric of a chart is named `value`.
DASHBOARDS: dict[str, dict[str, tuple[str, Chart]]] = {
    "wia_funnel": {
        "total": ("wia_funnel", _kpi(_sum("n_aanvragen"))),
        "per_day": ("wia_funnel", _line(_sum("n_aanvragen"), "aanvraag_datum", "P1D")),
        "per_status": ("wia_funnel", _split(_sum("n_aanvragen"), "status")),
    },
    "tw_eligibility": {
        "clients": ("tw_eligibility", _kpi(_count("bsn"))),
        "gap_per_month": ("tw_eligibility", _kpi(_sum("gat_per_maand"))),
        "mean_income": ("tw_eligibility", _kpi(_avg("inkomen_maand_eur"))),
    },
    "client_360": {
        "clients": ("client_360", _kpi(_count("bsn"))),
        "per_gender": ("client_360", _split(_count("bsn"), "geslacht")),
        "running_wia": ("client_360", _kpi(_sum("n_lopende_wia"))),
    },
    "projection": {
        "total": ("projection", _kpi(_sum("uitbetaald_bruto_eur_projection"))),
        "per_law": ("projection", _split(_sum("uitbetaald_bruto_eur_projection"), "wet")),
        "per_region": ("projection", _split(_sum("aantal_uitkeringen_projection"), "regio_code")),
    },
    "dq_employment": {
        "records": ("dq_daily", _kpi(_sum("n_ikvs"))),
        # A sum of daily distinct counts; a person seen on two days counts twice.
        "daily_distinct_summed": ("dq_daily", _kpi(_sum("n_unieke_bsns"))),
        "outside_test_range": ("dq_daily", _kpi(_sum("n_bsn_buiten_test_bereik"))),
    },
    "effect_panel": {
        "participants": ("effect_panel", _kpi(_count("bsn_pseudo"))),
        "per_status": ("effect_panel", _split(_count("bsn_pseudo"), "huidige_status")),
        "per_gender": ("effect_panel", _split(_count("bsn_pseudo"), "geslacht")),
    },
    "dq_overview": {
        "use_cases": ("dq_overview", _kpi(_distinct("uc_code"))),
        "violations": ("dq_overview", _kpi(_sum("n_violations"))),
        "critical": ("dq_overview", _kpi(_sum("n_violations_critical"))),
        "mean_score": ("dq_overview", _kpi(_avg("dq_score_pct"))),
        "score_per_use_case": ("dq_overview", _split(_avg("dq_score_pct"), "uc_name")),
        "violations_per_use_case": ("dq_overview", _split(_sum("n_violations"), "uc_name")),
        "status": ("dq_overview", _split(_count("uc_code"), "dq_status")),
    },
    "dq_violations": {
        "checks": ("dq_violations", _kpi(_count("check_name"))),
        "per_severity": ("dq_violations", _split(_sum("n_violations"), "severity")),
        "per_check": ("dq_violations", _split(_sum("n_violations"), "check_name", limit=20)),
        "all_checks": ("dq_violations", _split(_sum("n_violations"), "uc_name", "check_name", "severity")),
    },
    "journey": {
        "clients": ("journey_events", _kpi(_distinct("bsn"))),
        "events": ("journey_events", _kpi(_count("event_seq"))),
        "phases": ("journey_phases", _kpi(_count("fase_volgnr"))),
        "mean_duration": ("journey_phases", _kpi(_avg("duur_dagen"))),
        "events_per_month": ("journey_events", _line(_count("event_seq"), "event_ts", "P1M", "domein")),
        "phases_per_month": ("journey_phases", _line(_count("bsn"), "fase_start_ts", "P1M", "fase")),
        "per_domain": ("journey_events", _split(_count("event_seq"), "domein")),
        "per_phase": ("journey_phases", _split(_count("bsn"), "fase")),
        "per_region": (
            "journey_events",
            _split(_count("event_seq"), "regio_code", where=(Filter("regio_code", "IS NOT NULL"),)),
        ),
        "top_event_types": ("journey_events", _split(_count("event_seq"), "event_type", limit=10)),
        "duration_per_phase": ("journey_phases", _split(_avg("duur_dagen"), "fase", limit=20)),
        "busiest_clients": (
            "journey_events",
            Chart([_count("event_seq"), Metric("domein", "COUNT_DISTINCT", "Domeinen")], ["bsn"], row_limit=50),
        ),
    },
    "cloud_cost": {
        "effective_cost": ("spend_monthly", _kpi(_sum("effective_cost"))),
        "list_cost": ("spend_monthly", _kpi(_sum("list_cost"))),
        "savings": ("savings", _kpi(_sum("savings_amount"))),
        "mean_coverage": ("commitment", _kpi(_avg("commitment_coverage_pct"))),
        "cost_per_month": ("spend_monthly", _line(_sum("effective_cost"), "billing_month", "P1M", "provider", where=_USAGE)),
        "coverage_per_month": (
            "commitment", _line(_avg("commitment_coverage_pct"), "billing_month", "P1M", "service_category")
        ),
        "per_service_category": ("spend_monthly", _split(_sum("effective_cost"), "service_category", where=_USAGE)),
        "per_region": ("breakdown", _split(_sum("effective_cost"), "region")),
        "per_environment": ("breakdown", _split(_sum("effective_cost"), "environment")),
        "top_services": ("breakdown", _split(_sum("effective_cost"), "service_name", limit=10)),
        "per_application": ("breakdown", _split(_sum("effective_cost"), "application", limit=15)),
        "top_resources": (
            "top_resources",
            _split(
                _sum("effective_cost"),
                "resource_name", "resource_type", "service_name", "region", "application", "environment",
                limit=50, where=(Filter("rank_in_month", "<=", 50),),
            ),
        ),
    },
}


def dashboard(name: str, marts: Mapping[str, DataFrame]) -> DataFrame:
    """All charts of one dashboard as (chart, dimension, value) rows.

    The dimension joins the group columns with `|`. Several charts read the same mart, so pass
    stored marts (or frozen ones), as a dashboard would.
    """
    result = None
    for label, (mart, chart) in DASHBOARDS[name].items():
        rows = chart_query(marts[mart], chart)
        dims = [column for column in rows.columns if column not in {m.label for m in chart.metrics}]
        text = [F.coalesce(F.date_format(c, "yyyy-MM-dd") if c == chart.time_column else F.col(c), F.lit("")) for c in dims]
        tile = rows.select(
            F.lit(label).alias("chart"),
            (F.concat_ws("|", *text) if text else F.lit("")).alias("dimension"),
            F.col("value").cast("double").alias("value"),
        )
        result = tile if result is None else result.unionByName(tile)
    return result
