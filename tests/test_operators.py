"""Checks, marts, matching, regression, upkeep, charts."""

from __future__ import annotations

import random
from datetime import date, datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import marts
from polderlake.operators import checks, matching, profiling, regression
from polderlake.operators.charts import Chart, Filter, Metric, chart_query
from polderlake.plans import analyses, billing, clients, finance, quality, staging
from polderlake.sources import envelopes, lookups, tables, upkeep

# ---- checks -----------------------------------------------------------------------------------------


def test_checks_ignore_nulls(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 5), (None, None), (None, 9), ("b", 2)], "k string, n int")
    assert rows(checks.check_unique(df, "k")) == [("a", 2)]
    assert rows(checks.check_accepted_values(df, "k", ["a"])) == [("b", 2)]
    assert rows(checks.check_accepted_range(df, "n", low=2)) == [("a", 1)]
    assert rows(checks.check_accepted_range(df, "n", high=5), "n") == [(9,)]
    assert checks.check_not_null(df, "k").count() == 2
    parent = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    assert rows(checks.check_relationship(df, "k", parent, "id")) == [("b", 2)]


def test_suite_reads_the_table_once_for_row_rules(spark):
    df = spark.range(100).withColumn("n", F.col("id") % 7)
    suite = checks.run_check_suite(
        df, [checks.RowCheck("a", F.col("n") > 5), checks.RowCheck("b", F.col("n") < 0), checks.TableCheck("c", checks.duplicates("n"))]
    )
    plan = suite._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 100") == 1
    assert {r.test_name: (r.failures, r.status) for r in suite.collect()} == {
        "a": (14, "failed"), "b": (0, "passed"), "c": (93, "failed")
    }


def test_violations_read_each_mart_once(spark):
    df = spark.createDataFrame([(None, "X", 1, "WGA")], "aanvraag_datum date, status string, n_aanvragen bigint, onderdeel string")
    title, records, rules = quality._rules()["uc01"]
    counted = df.agg(records.alias("n"), *[c.alias(n) for n, (_, c) in rules.items()]).first()
    assert counted.aanvraag_datum_not_null == 1 and counted.status_not_null == 0 and counted.onderdeel_in_WGA_IVA == 0


# ---- marts ------------------------------------------------------------------------------------------


def billing_rows(spark, *rows_):
    base = {
        "billing_month": date(2024, 1, 1), "provider": "oci", "service_category": "c", "charge_category": "Usage",
        "billing_currency": "EUR", "effective_cost": Decimal("10"), "billed_cost": Decimal("10"), "list_cost": None,
        "savings_amount": Decimal("0"), "usage_quantity": Decimal("1"), "pricing_category": "Committed",
        "commitment_discount_id": "d", "resource_id": "r", "sub_account_id": "s",
        "resource_name": "n", "resource_type": "t", "service_name": "sn", "region": "eu", "tag_application": None,
        "tag_environment": None, "tag_cost_center": None, "sub_account_name": None, "usage_unit": None,
    }
    types = {**{k: "string" for k in base}, "billing_month": "date"} | {
        k: "decimal(18,6)" for k in ("effective_cost", "billed_cost", "list_cost", "savings_amount", "usage_quantity")
    }
    data = [tuple({**base, **r}.values()) for r in rows_]
    return spark.createDataFrame(data, ", ".join(f"{k} {types[k]}" for k in base))


def test_discount_ratio_without_base_is_null(spark):
    row = billing.commitment_utilization(billing_rows(spark, {"savings_amount": Decimal("-10")})).first()
    assert row.commitment_coverage_pct == 1.0 and row.effective_discount_pct is None


def test_no_spend_gives_zero_ratios(spark):
    row = billing.commitment_utilization(billing_rows(spark, {"effective_cost": Decimal("0")})).first()
    assert (row.commitment_coverage_pct, row.effective_discount_pct) == (0.0, 0.0)


@pytest.mark.parametrize("heavy_rows", [2, 1000])
def test_resources_are_ranked_by_cost_then_id(spark, heavy_rows):
    df = billing_rows(
        spark, {"resource_id": "b"}, {"resource_id": "a"}, {"resource_id": None, "sub_account_id": "x", "effective_cost": Decimal("30")},
        {"resource_id": "c", "charge_category": "Tax", "effective_cost": Decimal("99")},
    )
    found = {r.resource_id: r.rank_in_month for r in billing.top_resources(df, heavy_rows).collect()}
    assert found == {"account-level:x": 1, "a": 2, "b": 3}


def test_projection_is_a_flat_mean(spark):
    fez = spark.createDataFrame(
        [(2024, 1, "WW", "AMS", 10, 1), (2024, 1, "WW", "AMS", 5, 1), (2024, 2, "WW", "AMS", 20, 1)],
        "jaar int, maand int, wet string, regio_code string, uitbetaald_bruto_eur int, aantal_uitkeringen int",
    )
    projected = finance.benefit_projection(fez)
    assert projected.count() == 60
    assert {(r.uitbetaald_bruto_eur_projection, r.aantal_uitkeringen_projection) for r in projected.collect()} == {(18, 2)}
    scenarios = finance.scenario_results(projected, lookups.scenario_inputs(spark))
    assert {(r.scenario_id, r.uitbetaald_bruto_eur_projection) for r in scenarios.collect()} == {
        ("baseline", 18), ("iva_afschaf_2027", 18), ("ww_versoberen", 9)
    }


def test_unlisted_scenarios_are_left_out(spark):
    fez = spark.createDataFrame([(2024, 1, "WIA", "AMS", 10, 1)], "jaar int, maand int, wet string, regio_code string, uitbetaald_bruto_eur int, aantal_uitkeringen int")
    listed = spark.createDataFrame([("iva_afschaf_2027",), ("proactieve_tw_uitrol",)], "scenario_id string")
    found = finance.scenario_results(finance.benefit_projection(fez), listed)
    assert {(r.scenario_id, r.jaar >= 2027, r.uitbetaald_bruto_eur_projection) for r in found.collect()} == {
        ("iva_afschaf_2027", False, 10), ("iva_afschaf_2027", True, 0)
    }


def test_eligibility_edges(spark, rows):
    persona = spark.createDataFrame([("at",), ("below",), ("none",)], "bsn string")
    income = spark.createDataFrame([("at", 1300.0), ("below", 1299.5)], "bsn string, inkomen_maand_eur double")
    found = clients.tw_eligibility(persona, income, lookups.household_norms(spark))
    assert rows(found, "bsn", "gat_per_maand") == [("below", 0.5), ("none", 1300.0)]


def test_contact_window_boundary(spark):
    persona = spark.createDataFrame(
        [("b", "v", "a", "M", date(1980, 1, 1), "s", 1, "p", "w")],
        "bsn string, voornaam string, achternaam string, geslacht string, geboortedatum date, straat string, huisnummer int, postcode string, woonplaats string",
    )
    empty = lambda schema: spark.createDataFrame([], schema)
    crm = spark.createDataFrame([("b", datetime(2024, 1, 1)), ("b", datetime(2023, 12, 31, 23, 59))], "bsn string, contact_ts timestamp")
    row = clients.client_360(
        persona, empty("bsn string, is_lopend boolean, loon_bruto_jaar int"), empty("bsn string, status string"),
        empty("bsn string, status string, arbeidsongeschikt_pct int"), crm, datetime(2024, 1, 31),
    ).first()
    assert (row.n_klantcontacten_30d, row.n_lopende_ww, row.max_ao_pct, row.totaal_loon_jaar) == (1, 0, None, 0)


# ---- staging ----------------------------------------------------------------------------------------


def bronze(spark, *payloads):
    return spark.createDataFrame(
        [(p, datetime(2024, 1, 1), date(2024, 1, 1)) for p in payloads], "payload string, source_ts timestamp, event_date date"
    )


def test_bad_payloads_become_null_and_are_counted(spark, rows):
    df = bronze(
        spark, '{"payload":{"melding_id":"a","duur_dagen":"x","eerste_ziektedag":"2024-01-05"}}',
        '{"payload":{"melding_id":"b","duur_dagen":7,"eerste_ziektedag":"soon"}}', "not json", '{"payload":{"melding_id":"c"}}',
    )
    assert rows(staging.stg_zw(df), "melding_id", "duur_dagen") == [(None, None), ("a", None), ("b", 7), ("c", None)]
    counts = {r.field: r.n_bad for r in staging.count_bad_casts(df, staging.PAYLOADS["zw"]).collect()}
    assert counts == {"melding_id": 0, "bsn": 0, "eerste_ziektedag": 1, "duur_dagen": 1}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        staging.decode_payload(df, staging.PAYLOADS["zw"], strict=True).collect()


def test_running_employment_has_no_end(spark, rows):
    df = bronze(spark, '{"payload":{"ikv_id":"a","einde_dienstverband":null}}', '{"payload":{"ikv_id":"b","einde_dienstverband":"2024-01-01"}}')
    assert rows(staging.stg_employment(df), "ikv_id", "is_lopend") == [("a", True), ("b", False)]


def test_contact_time_in_iso_form(spark):
    df = bronze(spark, '{"payload":{"contact_id":"a","timestamp":"2025-06-15T14:05:00Z"}}')
    assert staging.stg_crm(df).first().contact_ts == datetime(2025, 6, 15, 14, 5)


def test_inferred_schema_covers_rare_fields(spark):
    payloads = ['{"payload":{"a":%d}}' % i for i in range(300)] + ['{"payload":{"rare":"x","a":null}}', "broken"]
    df = staging.explode_payload(bronze(spark, *payloads).repartition(5))
    assert dict(df.dtypes) == {"a": "bigint", "rare": "string"}
    assert df.filter("rare = 'x'").count() == 1 and df.count() == 302


def test_events_are_parsed_once(spark):
    plan = staging.stg_persona(bronze(spark, "{}"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_few_fields_can_be_decoded(spark, rows):
    df = bronze(spark, '{"payload":{"bsn":"1","voornaam":"v"}}')
    assert rows(staging.decode_payload(df, {"bsn": "string"}), "bsn") == [("1",)]


def test_snake_case():
    names = {name: staging.snake_case(name) for name, *_ in staging.BILLING_COLUMNS}
    assert len(names) == 49
    assert names["CommitmentDiscountId"] == "commitment_discount_id"
    assert names["oci_BilledQuantityOverage"] == "oci_billed_quantity_overage"


def test_envelopes_survive_the_file(spark, tmp_path):
    texts = ['plain "quoted"', "tab\there", "line\nbreak", "  spaces  ", "back\\slash", "ünïcode", "", None, "a,b;c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    envelopes.write_envelopes(envelopes.wrap_rows(df, "x.y"), str(tmp_path), "org.x.y", "2024-01-01")
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(str(tmp_path / "org/x/y/dt=2024-01-01"))
    parsed = lines.select(F.from_json("value", "payload struct<i:int,t:string>").alias("e")).select("e.payload.*")
    assert {r.i: r.t for r in parsed.collect()} == dict(enumerate(texts))


# ---- matching, regression, profiles -------------------------------------------------------------------


def test_matched_pairs_against_brute_force(spark):
    rng = random.Random(2)
    people = [(rng.choice("ab") if rng.random() > 0.1 else None, rng.randrange(18, 40), rng.random() < 0.4) for _ in range(300)]
    df = spark.createDataFrame(people, "k string, leeftijd int, treated boolean")
    found = matching.matched_pairs(df.filter("treated"), df.filter("not treated"), ["k"]).first().n_pairs
    expected = sum(
        1 for a in people for b in people if a[2] and not b[2] and a[0] is not None and a[0] == b[0] and abs(a[1] - b[1]) <= 2
    )
    assert found == expected > 0


def test_no_matches(spark):
    df = spark.createDataFrame([("a", 20)], "k string, leeftijd int")
    assert matching.matched_pairs(df, df.filter("false"), ["k"]).first().n_pairs == 0


def test_two_feature_regression_against_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2)) * [10, 3] + [40, 1e4]
    y = 3 + x @ [2.0, -0.5] + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    row = regression.regression_two_features(df, "y", "a", "b").first()
    beta = np.linalg.lstsq(np.c_[np.ones(200), x], y, rcond=None)[0]
    assert np.allclose([row.intercept, row.coef_1, row.coef_2], beta, rtol=1e-6)


def test_logit_recovers_odds(spark):
    # Two groups: 30 of 100 and 60 of 100 succeed, so the coefficient is the log odds ratio.
    data = [("a", i < 30) for i in range(100)] + [("b", i < 60) for i in range(100)]
    df = spark.createDataFrame(data, "g string, hit boolean").withColumn("zero", F.rand(1))
    table = {r.feature: r for r in regression.logistic_effect(df, "hit", [], ["g"]).collect()}
    assert set(table) == {"g_b", "const"}
    assert table["const"].coefficient == pytest.approx(np.log(30 / 70), abs=1e-6)
    assert table["g_b"].coefficient == pytest.approx(np.log((60 / 40) / (30 / 70)), abs=1e-6)
    assert table["g_b"].std_error == pytest.approx(np.sqrt(1 / 30 + 1 / 70 + 1 / 60 + 1 / 40), abs=1e-4)


def test_histogram_edges(spark, rows):
    df = spark.createDataFrame([(0.0,), (0.5,), (10.0,), (None,)], "v double")
    assert rows(profiling.value_distribution(df, "v", 2), "bucket", "n") == [(1, 2), (2, 1)]
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert rows(profiling.value_distribution(same, "v", 4), "bucket", "low", "high", "n") == [(1, 3.0, 3.0, 2)]


def test_sample_is_repeatable(spark):
    df = spark.range(10_000)
    one = {r.id for r in profiling.sample_by_key(df, "id", 5).collect()}
    two = {r.id for r in profiling.sample_by_key(df.repartition(7), "id", 5).collect()}
    assert one == two and 350 < len(one) < 650


def test_drift_flags(spark, rows):
    data = [(1, "a")] * 100 + [(2, None)] * 2 + [(2, "a")] * 98 + [(3, "b")] * 106
    df = spark.createDataFrame(data, "d int, k string")
    assert [r.flagged for r in profiling.volume_drift(df, "d").orderBy("dag").collect()] == [False, False, True]
    found = profiling.null_drift(df, "d", ["k"], "k").filter("flagged")
    assert rows(found, "metric", "dag") == [("null:k", 2)]


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([("ziek", d, False) for d in (10, 20, 30, 40)] + [("ziek", None, True)], "fase string, duur_dagen int, is_lopend boolean")
    row = analyses.phase_duration_stats(df).first()
    assert (row.n, row.p25, row.mediaan, row.p75, row.max_dagen, row.lopend) == (4, 17.5, 25.0, 32.5, 40, 1)


# ---- charts -----------------------------------------------------------------------------------------


def test_chart_filters_order_and_limit(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 3), (None, 9)], "k string, n int")
    chart = Chart([Metric("n", "SUM", "s")], ["k"], filters=(Filter("n", "<=", 3), Filter("k", "IS NOT NULL")), row_limit=2)
    assert [(r.k, r.s) for r in chart_query(df, chart).collect()] == [("a", 3), ("b", 3)]
    plan = chart_query(df, chart)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    with pytest.raises(KeyError):
        chart_query(df, Chart([Metric("n", "SUM", "s")], filters=(Filter("n", "LIKE", 3),)))


# ---- tables and upkeep ------------------------------------------------------------------------------


def test_retention_boundary_day_is_kept(spark, rows):
    df = spark.createDataFrame([(date(2024, 1, 31),), (date(2024, 1, 30),), (None,)], "d date")
    assert rows(upkeep.retention_survivors(df, "d", 2, date(2026, 1, 31))) == [(None,), (date(2024, 1, 31),)]


def test_expired_folders_go_and_others_are_untouched(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, date(2020, 1, 1)), (2, date(2024, 1, 31)), (3, date(2025, 1, 1))], "n int, event_date date")
    tables.write_path(df, path, partition_by=["event_date"])
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert upkeep.drop_expired_partitions(spark, path, "event_date", 2, date(2026, 1, 31)) == ["2020-01-01"]
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [2, 3]
    assert all(p.stat().st_mtime_ns == t for p, t in before.items() if "2020" not in str(p))


def test_rewrite_and_switch(spark, tmp_path):
    table = "upkeep_db.t"
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    df = spark.createDataFrame([(1, date(2020, 1, 1), "x"), (2, date(2025, 1, 1), "y")], "n int, d date, p string")
    tables.write_path(df, old, partition_by=["p"])
    tables.register_location(spark, table, old)
    upkeep.rewrite_survivors(spark, old, new, "d", 2, date(2026, 1, 1), ["p"])
    assert spark.table(table).count() == 2
    upkeep.switch_location(spark, table, new)
    assert [r.n for r in spark.table(table).collect()] == [2]


def test_compaction_keeps_rows_and_splits_a_hot_partition(spark, tmp_path):
    path, target = str(tmp_path / "a"), str(tmp_path / "b")
    df = spark.range(3000).select("id", F.when(F.col("id") < 2900, "hot").otherwise("cold").alias("p"), F.sha2(F.col("id").cast("string"), 512).alias("t"))
    tables.write_path(df.repartition(12), path, partition_by=["p"])
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100KB")
    try:
        after = upkeep.compact_path(spark, path, target, ["p"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {r.p: r.n for r in after.groupBy("p").agg(F.count_distinct("_metadata.file_path").alias("n")).collect()}
    assert after.count() == 3000 and files["cold"] == 1 and 1 < files["hot"] < 12


def test_compaction_notices_a_difference(spark):
    one = spark.createDataFrame([(1,), (1,)], "n int")
    two = spark.createDataFrame([(1,), (2,)], "n int")
    with pytest.raises(ValueError, match="differs"):
        upkeep.same_content(one, two)


def test_replaced_table_and_append(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, p string")
    tables.write_table(df, "write_db.t", "overwrite", ["p"])
    tables.write_table(df.filter("n = 1"), "write_db.t", "overwrite", ["p"])
    assert spark.table("write_db.t").count() == 1
    tables.write_table(df, "write_db.t", "append", ["p"])
    assert spark.table("write_db.t").count() == 3


def test_freshness(spark, rows):
    now = datetime(2024, 1, 10, 12)
    df = spark.createDataFrame([(datetime(2024, 1, 10, 11, 50), date(2024, 1, 10))], "source_ts timestamp, event_date date")
    slas = [upkeep.SourceSla("s", "streaming", 300), upkeep.SourceSla("r", "streaming", 900), upkeep.SourceSla("e", "streaming", 300), upkeep.SourceSla("b", "batch", 300)]
    empty = df.filter("false")
    found = upkeep.bronze_freshness({"s": df, "r": df, "e": empty, "b": empty}, slas, now)
    assert rows(found, "source", "status", "lag_seconds") == [("b", "ok", None), ("e", "stale", None), ("r", "ok", 600), ("s", "late", 600)]


def test_spend_and_savings_count_resources_apart_from_their_sums(spark, rows):
    df = billing_rows(
        spark, {"resource_id": "a"}, {"resource_id": "a"}, {"resource_id": None}, {"resource_id": "b", "provider": None},
        {"resource_id": None, "provider": None, "billing_month": None},
    )
    for mart in (billing.spend_monthly(df), billing.savings(df)):
        found = rows(mart, "billing_month", "provider", "effective_cost", "n_charges", "n_resources")
        month = date(2024, 1, 1)
        assert sorted(found, key=str) == sorted(
            [(month, "oci", Decimal("30"), 3, 1), (month, None, Decimal("10"), 1, 1), (None, None, Decimal("10"), 1, 0)], key=str
        )
        plan = mart._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert not [line for line in plan if "resource_id" in line.split("],")[0] and "Aggregate" in line and "sum(" in line]


def test_stored_billing_holds_what_the_marts_read(spark):
    assert set(marts.stored_billing(spark, "/root/testdata/sf0.001").columns) == set(billing.MART_COLUMNS)
