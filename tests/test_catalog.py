"""The registered queries hold together: same keys, one flagship, and plans that read only what they need."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["bsn", "fase_volgnr", "fase"] and df.count() > 0


@pytest.mark.parametrize(
    ("name", "unread"),
    [("wia_funnel_daily", "o_totalprice"), ("spend_monthly", "l_tax"), ("classify_log_events", "value"), ("household_income", "o_orderpriority")],
)
def test_unused_columns_are_not_read(spark, name, unread):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    schemas = [line.split("ReadSchema:")[1] for line in plan.splitlines() if "ReadSchema:" in line]
    assert schemas and not any(f"{unread}:" in schema for schema in schemas)


def test_no_cross_products_in_the_marts(spark):
    for name in ("client_360", "effect_panel", "tw_eligibility", "scenario_results", "matched_pairs", "check_relationship"):
        plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
