from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from polderlake.functions.identifiers import account_check_digits, bsn_check_digit, has_account_checksum, is_nl_iban, is_payroll_number, is_valid_bsn, pseudonymize
from polderlake.functions.numbers import full_years, half_up_long, ratio
from polderlake.functions.streams import stream_of_path, table_of_stream, without_scheme


def one(spark, value, expression, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize("bsn", ["111222333", "123456782"])
def test_valid_numbers(spark, bsn):
    assert one(spark, bsn, is_valid_bsn) is True


@pytest.mark.parametrize("bsn", ["000000000", "111111111", "12345", "1234567890", "abcdefghi", "012345678", "", "12345678a", "123456782\n"])
def test_invalid_numbers(spark, bsn):
    assert one(spark, bsn, is_valid_bsn) is False


def test_null_number_is_not_judged(spark):
    assert one(spark, None, is_valid_bsn) is None


def test_check_digit_against_brute_force(spark):
    rng = random.Random(11)
    prefixes = ["9" + "".join(str(rng.randrange(10)) for _ in range(7)) for _ in range(1000)]
    df = spark.createDataFrame([(p,) for p in prefixes], "p string")
    digit = bsn_check_digit(F.col("p"))
    got = df.select("p", digit.alias("d"), is_valid_bsn(F.concat("p", digit.cast("string"))).alias("ok")).collect()
    for row in got:
        rest = sum(w * int(c) for w, c in zip(range(9, 1, -1), row.p, strict=True)) % 11
        assert row.d == (None if rest == 10 else rest)
        assert row.ok is (None if row.d is None else True)


@pytest.mark.parametrize("prefix", ["1234567", "1234567x", "123456789"])
def test_check_digit_of_malformed_prefix(spark, prefix):
    assert one(spark, prefix, bsn_check_digit) is None


@pytest.mark.parametrize(
    ("account", "good"), [("NL01BANK0123456789", True), ("NL1BANK0123456789", False), ("DE01BANK0123456789", False), ("NL01bank0123456789", False)]
)
def test_iban(spark, account, good):
    assert one(spark, account, is_nl_iban) is good


@pytest.mark.parametrize(("number", "good"), [("123456789L01", True), ("12345678L01", False), ("123456789l01", False)])
def test_payroll_number(spark, number, good):
    assert one(spark, number, is_payroll_number) is good


def test_pseudonym_is_upper_hex_of_value_and_salt(spark):
    import hashlib

    assert one(spark, "123", lambda c: pseudonymize(c, "salt")) == hashlib.sha256(b"123salt").hexdigest().upper()
    assert one(spark, None, lambda c: pseudonymize(c, "salt")) is None


@pytest.mark.parametrize(("value", "expected"), [(2.5, 3), (3.5, 4), (2.4, 2), (-0.5, 0), (None, None)])
def test_half_up(spark, value, expected):
    assert one(spark, value, half_up_long, "double") == expected


def test_full_years_do_not_round_up(spark):
    df = spark.createDataFrame([("2000-12-31",), ("2000-01-01",), ("2000-01-02",)], "d string")
    years = df.select(full_years(F.to_date("d"), F.lit("2026-01-01").cast("date"))).collect()
    assert [r[0] for r in years] == [25, 26, 25]


def test_ratio_by_zero_is_null(spark):
    assert spark.range(1).select(ratio(F.lit(1), F.lit(0))).first()[0] is None


@pytest.mark.parametrize(
    ("path", "stream"),
    [
        ("s3a://raw/org/a/b/dt=2024-01-01/x.jsonl", "org.a.b"),
        ("s3a://raw/org/a/dt=2024-01-01/y/dt=2/x.jsonl", "org.a"),
        ("s3a://raw/org/a/b/x.jsonl", None),
        ("s3a://other/org/a/dt=2024-01-01/x.jsonl", None),
        ("", None),
        (None, None),
    ],
)
def test_stream_of_path(spark, path, stream):
    assert one(spark, path, lambda c: stream_of_path(c, "s3a://raw/")) == stream


@pytest.mark.parametrize(
    ("stream", "table"),
    [("org.a.b", "a_b"), ("org.a.b.c", "a_b_c"), ("org.a", None), ("x.a.b", None), ("", None), (None, None)],
)
def test_table_of_stream(spark, stream, table):
    assert one(spark, stream, lambda c: table_of_stream(c, "org")) == table


@pytest.mark.parametrize(
    ("path", "plain"),
    [("file:///a/b", "/a/b"), ("file:/a/b", "/a/b"), ("/a/b", "/a/b"), ("hdfs://host:9000/a", "/host:9000/a"), ("s3a://x/a", "/x/a")],
)
def test_without_scheme(path, plain):
    assert without_scheme(path) == plain


@pytest.mark.parametrize("root", ["file:/raw/in", "file:///raw/in/", "/raw/in"])
def test_root_forms(spark, root):
    assert one(spark, "file:///raw/in/org/a/b/dt=1/x.jsonl", lambda c: stream_of_path(c, root)) == "org.a.b"


def modulus(text):
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


ACCOUNTS = ["NL91ABNA0417164300", "GB82WEST12345698765432", "DE89370400440532013000", "MT84MALT011000012345MTLCAST001S", "NL91ABNA0417164301", "NL19ABNA0417164300", "NO9386011117947"]


@pytest.mark.parametrize("account", ACCOUNTS)
def test_account_checksum(spark, account):
    assert one(spark, account, has_account_checksum) is (modulus(account) == 1)
    rest = spark.createDataFrame([(account[:2], account[4:])], "c string, r string")
    digits = rest.select(account_check_digits(F.col("c"), F.col("r"))).first()[0]
    assert modulus(account[:2] + digits + account[4:]) == 1


@pytest.mark.parametrize("account", ["", "NL91", "nl91abna0417164300", "NL91 ABNA 0417 1643 00", "NL91ABNA0417164300\n", "9191ABNA0417164300", "NL91ABNA0417164300" * 2, "NLXXABNA0417164300", "NL91ÀBNA0417164300"])
def test_odd_accounts_have_no_checksum(spark, account):
    assert one(spark, account, has_account_checksum) is False


def test_a_missing_account_is_not_judged(spark):
    assert one(spark, None, has_account_checksum) is None
