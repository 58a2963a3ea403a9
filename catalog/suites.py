"""The declared checks of every model as queries, one per model, and the SQL that counts the same failures."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from catalog import marts
from catalog.oracle import oracle
from catalog.registry import query
from catalog.validation import _DIGIT_SUM
from fixtures.domain import domain, row_count
from polderlake.plans import billing, model_checks

# Model -> its rows, and the relation that the comparison reads.
_STAGED = {"persona": "persona", "employment": "ikv", "ww": "ww", "wia": "wia", "wajong": "wajong", "zw": "zw", "crm": "crm", "fez": "fez"}
_MARTS = {
    "billing": (marts._billing, "stg_billing"),
    "satisfaction": (marts.stg_satisfaction, "stg_satisfaction"),
    "journey_events": (marts.ranked, "ranked"),
    "journey_phases": (marts.phases, "phases"),
    "tw_eligibility": (marts.tw_eligibility, "tw_eligibility"),
    "satisfaction_monthly": (marts.satisfaction, "satisfaction_monthly"),
    "effect_panel": (marts.effect_panel, "effect_panel"),
    "dq_daily": (marts.dq_daily, "dq_daily"),
    "spend_monthly": (lambda spark, sf: billing.spend_monthly(marts.stored_billing(spark, sf)), "spend_monthly"),
    "top_resources": (
        lambda spark, sf: billing.top_resources(marts.stored_billing(spark, sf), at_most=row_count(spark, sf, "lineitem")),
        "top_resources",
    ),
    "projection": (marts.projection, "projection"),
    "wia_funnel": (marts.wia_funnel, "wia_funnel"),
    "client_360": (marts.client_360, "client_360"),
}


def _rows(model: str, spark: SparkSession, sf: str) -> DataFrame:
    return domain(spark, sf, _STAGED[model]) if model in _STAGED else _MARTS[model][0](spark, sf)


def _sql(model: str, relation: str) -> str:
    digits = "regexp_full_match(bsn, '[1-9][0-9]{{8}}')"
    parts = []
    for column, rules in model_checks.MODELS[model].items():
        for rule in rules:
            kind, *given = rule
            if kind == "unique":
                text = f"(select count(*) from (select {column} from {relation} where {column} is not null group by all having count(*) > 1))"
            elif kind == "relationship":
                text = f"(select count(*) from {relation} where {column} not in (select {given[1]} from {_STAGED[given[0]]}))"
            else:
                low, high = (given + [None])[:2] if kind == "accepted_range" else (None, None)
                bounds = [f"{column} < {low}" if low is not None else "", f"{column} > {high}" if high is not None else ""]
                bad = {
                    "not_null": f"{column} is null",
                    "accepted_values": f"{column} not in {tuple(given[0]) if kind == 'accepted_values' else ()}",
                    "accepted_range": " or ".join(b for b in bounds if b),
                    "bsn_valid": f"case when {digits} then ({_DIGIT_SUM}) % 11 <> 0 else bsn is not null end",
                    "lh_nummer_valid": f"not regexp_full_match({column}, '[0-9]{{{{9}}}}L[0-9]{{{{2}}}}')",
                }[kind]
                text = f"(select count(*) from {relation} where {bad})"
            parts.append(f"select '{model_checks.check_name(column, rule)}' as test_name, {text} as failures")
    return f", r as ({' union all '.join(parts)}) select test_name, failures, if(failures > 0, 'failed', 'passed') as status from r".replace("{{", "{").replace("}}", "}")


def _suite(model: str, spark: SparkSession, sf: str) -> DataFrame:
    return model_checks.run_model_suite(model, _rows(model, spark, sf), lambda other: _rows(other, spark, sf))


for _model in model_checks.MODELS:
    _relation = _STAGED.get(_model) or _MARTS[_model][1]
    _names = " ".join(dict.fromkeys([_relation, *(_STAGED[rule[1]] for rules in model_checks.MODELS[_model].values() for rule in rules if rule[0] == "relationship")]))
    query(f"run_check_suite_{_model}", oracle(_names, _sql(_model, _relation)))(partial(_suite, _model))
