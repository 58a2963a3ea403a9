"""Keys of the fixture at any size, typed schemas, uploads with several headers, retention, free-form chart filters."""

from __future__ import annotations

from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fixtures.domain import domain
from polderlake.functions.identifiers import is_valid_bsn
from polderlake.operators import governance as gov
from polderlake.operators.charts import Chart, Metric, SqlFilter, chart_query
from polderlake.plans import model_checks, staging
from polderlake.sources import csv_files, upkeep

SMALL = "/root/testdata/sf0.001"


def customers(spark, folder, keys):
    rows = [(k, f"c{k}", 0, "AUTO") for k in keys]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(0, "X")], "n_nationkey int, n_name string").write.parquet(f"{folder}/nation.parquet")
    return domain(spark, str(folder), "persona")


def test_persons_beyond_ten_million_stay_apart(spark, tmp_path):
    keys = [1, 1234567, *range(12345670, 12345680), 9_999_999, 10_000_000, 10_000_001, 99_999_999]
    persons = customers(spark, tmp_path, keys)
    assert persons.count() == persons.select("bsn").distinct().count() == len(keys)
    assert persons.where(F.length("bsn") != 9).count() == 0


def test_no_number_is_given_twice(spark, tmp_path):
    with pytest.raises(Exception, match="no number left"):
        customers(spark, tmp_path, [1, 100_000_000]).collect()


def test_every_order_reaches_an_entity(spark):
    ids = {"ikv": "ikv_id", "ww": "aanvraag_id", "wia": "aanvraag_id", "zw": "melding_id", "wajong": "dossier_id"}
    seen = None
    for view, name in ids.items():
        one = domain(spark, SMALL, view).select(F.element_at(F.split(name, "-"), -1).cast("bigint").alias("o_orderkey"))
        seen = one if seen is None else seen.union(one)
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").select("o_orderkey")
    assert orders.join(seen, "o_orderkey", "left_anti").count() == 0 and seen.count() == orders.count()


def test_a_number_is_worked_out_once(spark):
    df = spark.createDataFrame([("111222333",), ("123456782",), ("012345672",), ("12345678",), ("abc",), (None,)], "bsn string")
    assert [r[0] for r in df.select(is_valid_bsn(F.col("bsn"))).collect()] == [True, True, False, False, False, None]
    plan = df.filter(is_valid_bsn(F.concat("bsn", F.lit(""))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(") == 1


@pytest.mark.parametrize(
    ("merged", "typed"),
    [
        ("OBJECT<VOIDED_AT: STRING, X_VOID: VOID, n: BIGINT>", "STRUCT<VOIDED_AT: STRING, X_VOID: STRING, n: BIGINT>"),
        ("OBJECT<VOID: VOID, o: OBJECT<a: ARRAY<VOID>>>", "STRUCT<VOID: STRING, o: STRUCT<a: ARRAY<STRING>>>"),
        ("OBJECT<`a, VOID`: VOID, `OBJECT<`: STRING>", "STRUCT<`a, VOID`: STRING, `OBJECT<`: STRING>"),
        ("VOID", "STRING"),
    ],
)
def test_only_types_are_replaced(merged, typed):
    assert staging.typed_schema(merged) == typed


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("x,y\n1,one\n")
    (tmp_path / "c.csv").write_text("y,extra,x\ntwo,?,2\n")
    (tmp_path / "d.csv").write_text("x,y\n3,three\n")
    columns = (csv_files.CsvColumn("x", "integer"), csv_files.CsvColumn("y", "varchar"))
    rows = csv_files.read_csv(spark, str(tmp_path), columns, file_column="file").collect()
    assert sorted((r.x, r.y) for r in rows) == [(1, "one"), (2, "two"), (3, "three")]
    (tmp_path / "e.csv").write_text("x\n4\n")
    with pytest.raises(ValueError, match="missing columns"):
        csv_files.read_csv(spark, str(tmp_path), columns)


def test_sandbox_by_catalog_or_prefix():
    assert gov.filter_pseudo_only("uc09", "sandbox") is not None and gov.filter_pseudo_only("sandbox_uc09") is not None
    assert gov.filter_pseudo_only("uc09", "gold") is None and gov.filter_pseudo_only("uc09") is None
    assert len(gov.row_filters("uc09", [], catalog="sandbox")) == 1


def test_masks_keep_the_type(spark):
    df = spark.createDataFrame([(1, ["a"])], "icd10 int, diagnose array<string>")
    assert gov.governed_read(df, "wajong", ["data_steward"]).dtypes == df.dtypes


def test_retention_applies_each_kind_of_rule(spark, tmp_path):
    rows = spark.createDataFrame([(1, date(2010, 1, 1)), (2, date(2025, 1, 1)), (3, None)], "id int, day date")
    paths = {name: str(tmp_path / name) for name in ("folders", "rewritten", "dry", "manual", "young")}
    for name, path in paths.items():
        rows.write.partitionBy(*(["day"] if name == "folders" else [])).parquet(path)
    rules = [upkeep.RetentionRule(n, "day", 7, dry_run=n == "dry") for n in ("folders", "rewritten", "dry")]
    rules += [upkeep.RetentionRule("manual", None, 7), upkeep.RetentionRule("young", "day", 100)]
    report, now = upkeep.enforce_retention(spark, paths, rules, date(2026, 1, 1))
    assert {r.table_name: (r.action, r.n_deleted) for r in report.collect()} == {
        "folders": ("delete", 1), "rewritten": ("delete", 1), "dry": ("dry_run", 1), "manual": ("manual", None), "young": ("delete", 0)
    }
    left = {name: spark.read.schema("id int, day date").parquet(path).count() for name, path in now.items()}
    assert left == {"folders": 2, "rewritten": 2, "dry": 3, "manual": 3, "young": 3}


def test_chart_with_a_condition_in_sql(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 7)], "k string, v int")
    chart = Chart([Metric("v", "SUM", "total")], ["k"], filters=[SqlFilter("v > 1 and k in ('a', 'b')")])
    assert [tuple(r) for r in chart_query(df, chart).collect()] == [("b", 7), ("a", 5)]


def test_declared_checks_find_planted_faults(spark):
    good = ("1", "123456782", "2024-01-01", "WGA", "AMS", "INGEDIEND", 50)
    rows = [good, ("1", *good[1:]), ("2", "123456780", None, "X", None, "?", 101), (None, None, "d", None, "ams", None, None)]
    df = spark.createDataFrame(rows, "aanvraag_id string, bsn string, aanvraag_datum string, onderdeel string, regio_code string, status string, arbeidsongeschikt_pct int")
    got = {r.test_name: r.failures for r in model_checks.run_model_suite("wia", df, {}).collect()}
    assert got == {
        "aanvraag_id_not_null": 1, "aanvraag_id_unique": 1, "bsn_not_null": 1, "bsn_bsn_valid": 1, "aanvraag_datum_not_null": 1,
        "onderdeel_accepted_values": 1, "regio_code_accepted_values": 1, "status_accepted_values": 1, "arbeidsongeschikt_pct_accepted_range": 1,
    }


def test_scratch_is_cleared(spark):
    from polderlake.session import clear_scratch, stored

    clear_scratch(spark)
    kept = stored(spark.range(3))
    path = kept.inputFiles()[0].removeprefix("file://")
    assert kept.count() == 3 and Path(path).exists()
    assert clear_scratch(spark) == 1 and not Path(path).exists()
