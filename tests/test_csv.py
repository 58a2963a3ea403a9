from __future__ import annotations

import gzip
from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from catalog import ingest
from polderlake import session
from polderlake.sources import csv_files, tables
from polderlake.sources.csv_files import CsvColumn, CsvFormat

COLUMNS = (
    CsvColumn("id", "integer"),
    CsvColumn("day", "date"),
    CsvColumn("at", "timestamp", required=False),
    CsvColumn("cost", "decimal", required=False, min=0),
    CsvColumn("note", "varchar", required=False),
)


@pytest.fixture
def upload(tmp_path):
    def write(text, name="u.csv", encoding="utf-8"):
        path = tmp_path / name
        path.write_bytes(text.encode(encoding))
        return str(path)

    return write


HEADER = "id,day,at,cost,note\n"


def test_declared_order_and_types(spark, upload):
    path = upload("extra,note,cost,at,day,id\nq,hello,1.5,2024-01-01 10:00:00,2024-01-02,7\n")
    df = csv_files.read_csv(spark, path, COLUMNS)
    assert df.dtypes == [("id", "bigint"), ("day", "date"), ("at", "timestamp"), ("cost", "decimal(18,6)"), ("note", "string")]
    assert tuple(df.first()) == (7, date(2024, 1, 2), datetime(2024, 1, 1, 10), Decimal("1.500000"), "hello")


@pytest.mark.parametrize(
    ("text", "micros"),
    [
        ("2024-01-01T10:00:00.123456Z", 123456), ("2024-01-01T10:00:00.5Z", 500000), ("2024-01-01T10:00:00Z", 0),
        ("2024-01-01T10:00:00.250", 250000), ("2024-01-01T10:00:00", 0), ("2024-01-01 10:00:00", 0),
    ],
)
def test_timestamp_forms(spark, upload, text, micros):
    df = csv_files.read_csv(spark, upload(HEADER + f"1,2024-01-01,{text},,\n"), COLUMNS)
    assert df.first().at == datetime(2024, 1, 1, 10, 0, 0, micros)


@pytest.mark.parametrize("token", ["", "NULL", "null", "NA"])
def test_null_texts(spark, upload, token):
    row = csv_files.read_csv(spark, upload(HEADER + f"1,2024-01-01,{token},{token},{token}\n"), COLUMNS).first()
    assert (row.at, row.cost, row.note) == (None, None, None)


@pytest.mark.parametrize(
    "line",
    ["x,2024-01-01,,,", "1,01-01-2024,,,", "1,2024-02-30,,,", "1,2024-01-01,yesterday,,", "1,2024-01-01,,1.23456789,", "1.5,2024-01-01,,,"],
)
def test_bad_values_fail_or_become_null(spark, upload, line):
    path = upload(HEADER + line + "\n")
    with pytest.raises(Exception, match="not a"):
        csv_files.read_csv(spark, path, COLUMNS).collect()
    assert None in tuple(csv_files.read_csv(spark, path, COLUMNS, strict=False).first())[:4]


def test_missing_column(spark, upload):
    with pytest.raises(ValueError, match="missing columns"):
        csv_files.read_csv(spark, upload("id,at\n1,\n"), COLUMNS)


def test_unknown_type(spark, upload):
    with pytest.raises(ValueError, match="unknown column type"):
        csv_files.read_csv(spark, upload("a\n1\n"), [CsvColumn("a", "money")]).collect()


def test_no_header_other_delimiter_and_encoding(spark, upload):
    path = upload("7;2024-01-02;;;caf\u00e9\n", encoding="iso-8859-1")
    row = csv_files.read_csv(spark, path, COLUMNS, CsvFormat(";", False, "iso-8859-1")).first()
    assert (row.id, row.note) == (7, "caf\u00e9")


def test_quoted_delimiter_and_quotes(spark, upload):
    row = csv_files.read_csv(spark, upload(HEADER + '1,2024-01-01,,,"a, ""b"""\n'), COLUMNS).first()
    assert row.note == 'a, "b"'


def test_constraints(spark, upload):
    df = csv_files.read_csv(spark, upload(HEADER + "1,2024-01-01,,-2,\n,2024-01-01,,3,\n"), COLUMNS)
    report = {r.rule: r.n_violations for r in csv_files.constraint_report(df, COLUMNS).collect()}
    assert report == {"non_empty": 0, "required:id": 1, "required:day": 0, "min:cost": 1}
    with pytest.raises(ValueError, match="required:id: 1; min:cost: 1"):
        csv_files.assert_constraints(df, COLUMNS)


def test_empty_upload(spark, upload):
    with pytest.raises(ValueError, match="non_empty"):
        csv_files.assert_constraints(csv_files.read_csv(spark, upload(HEADER), COLUMNS), COLUMNS)


def test_ingest_guards_its_prefix(spark, tmp_path):
    with pytest.raises(ValueError, match="not below"):
        csv_files.ingest_csv(spark, "/other/x.csv", "/incoming", COLUMNS, str(tmp_path / "b"))
    assert not csv_files.within_prefix("/incoming-other/x.csv", "/incoming")


def test_ingest_appends_with_audit_columns(spark, upload, tmp_path):
    bronze = str(tmp_path / "bronze")
    for name in ("a.csv", "b.csv"):
        path = upload(HEADER + "1,2024-01-01,,2,\n", name)
        csv_files.ingest_csv(spark, path, str(tmp_path), COLUMNS, bronze, load_date=date(2024, 3, 1))
    df = spark.read.parquet(bronze)
    assert df.count() == 2 and {r.event_date for r in df.collect()} == {date(2024, 3, 1)}
    assert {r.source_file.rsplit("/", 1)[-1] for r in df.collect()} == {"a.csv", "b.csv"}


@pytest.mark.parametrize("at, text", list(enumerate(["2024-01-02T03:04:05.000006Z", "2024-01-02t03:04:05z", "2024-01-02T03:04:05.000006", "2024-01-02T03:04:05", "2024-01-02 03:04:05"])))
def test_one_pattern_is_tried_on_a_timestamp(spark, at, text):
    """A pattern that doesn't fit costs an exception for each text."""
    tried = spark.range(1).select(*[csv_files._may_fit(F.lit(text), pattern) for pattern in csv_files.TIMESTAMP_PATTERNS]).first()
    assert tried.index(True) == at
    assert spark.range(1).select(csv_files._parsed(CsvColumn("at", "timestamp"), F.lit(text)).isNotNull()).first()[0]


def test_headers_are_found_without_a_sort_of_the_lines(spark, upload):
    """A compressed file is one block: all its lines were sorted, and spilled, to find the first."""
    path = upload(HEADER + "1,2024-01-01,,2,\n")
    plan = csv_files._headers(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan


def test_compressed_uploads_with_other_headers(spark, tmp_path):
    texts = {"a": HEADER + "1,2024-01-01,,2,x\n", "b": "note,cost,at,day,id\ny,3,,2024-01-02,2\n", "c": HEADER + "3,2024-01-03,,4,z\n", "d": ""}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv.gz").write_bytes(gzip.compress(text.encode()))
    groups = csv_files.files_by_header(spark, str(tmp_path))
    assert [[file.rsplit("/", 1)[-1] for file in group] for group in groups] == [["a.csv.gz", "c.csv.gz"], ["b.csv.gz"]]
    rows = csv_files.read_csv(spark, str(tmp_path), COLUMNS).collect()
    assert sorted((r.id, r.day.day, r.cost, r.note) for r in rows) == [(1, 1, 2, "x"), (2, 2, 3, "y"), (3, 3, 4, "z")]


def _files(folder):
    return sorted(str(file.relative_to(folder)) for file in folder.rglob("*.parquet"))


def test_an_upload_is_written_once(spark, upload, tmp_path):
    """The typed rows were stored beside bronze, and then written again."""
    bronze, scratch = tmp_path / "bronze", list(session._SCRATCH)
    csv_files.ingest_csv(spark, upload(HEADER + "1,2024-01-01,,2,\n"), str(tmp_path), COLUMNS, str(bronze), load_date=date(2024, 3, 1))
    assert session._SCRATCH == scratch
    assert [file.split("/")[0] for file in _files(bronze)] == ["event_date=2024-03-01"]
    assert (bronze / "_SUCCESS").exists() and not list(bronze.glob("_pending*"))


@pytest.mark.parametrize(("text", "error"), [("1,2024-01-01,,-2,\n,2024-01-01,,3,\n", "required:id: 1; min:cost: 1"), ("", "non_empty: 1"), ("x,2024-01-01,,-2,\n", "not a integer")])
def test_a_refused_upload_leaves_bronze_as_it_was(spark, upload, tmp_path, text, error):
    bronze = tmp_path / "bronze"
    csv_files.ingest_csv(spark, upload(HEADER + "1,2024-01-01,,2,\n"), str(tmp_path), COLUMNS, str(bronze), load_date=date(2024, 3, 1))
    before = _files(bronze)
    with pytest.raises(Exception, match=error):
        csv_files.ingest_csv(spark, upload(HEADER + text, "v.csv"), str(tmp_path), COLUMNS, str(bronze), load_date=date(2024, 3, 1))
    assert _files(bronze) == before and not list(bronze.glob("_pending*"))


def test_files_that_cannot_all_be_moved_are_taken_back(spark, tmp_path):
    path = tmp_path / "table"
    tables.write_path(spark.range(1).withColumn("day", F.lit("a")), str(path), partition_by=["day"])
    (path / "day=c").write_text("no folder")
    before, pending = _files(path), tables.pending_path(str(path))
    tables.write_path(spark.range(3).withColumn("day", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") + 1).cast("int"))), pending, partition_by=["day"])
    with pytest.raises(Exception):
        tables.adopt_path(spark, pending, str(path))
    tables.drop_path(spark, pending)
    assert _files(path) == before


def test_the_billing_upload_is_compressed(spark, tmp_path):
    """As plain text the upload took most of the query's disk."""
    line = {"l_orderkey": [2, 3, 2], "l_partkey": [1, 1, 2], "l_suppkey": [1, 1, 1], "l_linenumber": [1, 2, 3], "l_quantity": [1.0, 2.0, 3.0], "l_extendedprice": [10.0, 20.0, 30.0],
            "l_discount": [0.0, 0.5, 0.0], "l_returnflag": ["A", "N", "R"], "l_shipdate": [datetime(1996, 1, 2), datetime(1996, 1, 3), datetime(1996, 2, 3)]}
    made = {
        "lineitem": line, "supplier": {"s_suppkey": [1], "s_name": ["s"], "s_nationkey": [7]},
        "part": {"p_partkey": [1, 2], "p_name": ["a, \"b\"", ""], "p_brand": ["x", "y"], "p_type": ["t", "t"]}, "nation": {"n_nationkey": [7], "n_name": ["N"]},
    }
    for name, columns in made.items():
        pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
    known = len(session._SCRATCH)
    rows = ingest.billing_upload_to_spend(spark, str(tmp_path)).collect()
    assert sorted((r.billing_month.isoformat(), r.n_charges, float(r.billed_cost)) for r in rows) == [("1996-01-01", 1, 10.0), ("1996-01-01", 1, 10.0), ("1996-02-01", 1, 30.0)]
    upload = next(path for path in session._SCRATCH[known:] if "/billing-csv-" in path)
    files = spark.read.format("binaryFile").load(upload).select("path").collect()
    assert files and all(file.path.endswith(".csv.gz") for file in files)
