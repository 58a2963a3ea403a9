"""Rules on identifying numbers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the eleven test, formats of account and payroll numbers.
BSN_WEIGHTS = (9, 8, 7, 6, 5, 4, 3, 2, -1)
BSN_FORMAT = "^[0-9]{9}$"
TEST_RANGE_FORMAT = "^9[0-9]{8}$"
IBAN_FORMAT = "^NL[0-9]{2}[A-Z]{4}[0-9]{10}$"
PAYROLL_FORMAT = "^[0-9]{9}L[0-9]{2}$"


def weighted_digit_sum(digits: Column, weights: tuple[int, ...]) -> Column:
    """Sum of weight x digit over text of exactly `len(weights)` digits; null for other text.

    The text becomes a number once and the digits come from whole-number arithmetic.
    """
    powers = [10**place for place in reversed(range(len(weights)))]

    def total(number: Column) -> Column:
        terms = [
            F.lit(weight) * (F.call_function("div", number, F.lit(power)) % 10)
            for weight, power in zip(weights, powers, strict=True)
        ]
        return reduce(add, terms)

    return _with(digits.try_cast("int"), total)


def _with(value: Column, rule: Callable[[Column], Column]) -> Column:
    """`rule(value)` with `value` worked out once, however often the rule names it."""
    return F.get(F.transform(F.array(value), rule), F.lit(0))


def is_valid_bsn(bsn: Column) -> Column:
    """Nine digits, no leading zero, weighted sum divisible by 11. Null stays null."""

    def valid(text: Column) -> Column:
        remainder = weighted_digit_sum(text, BSN_WEIGHTS) % 11
        # The length is tested as well, because `$` also matches before a line end.
        shaped = (F.length(text) == 9) & text.rlike(BSN_FORMAT) & ~text.startswith("0")
        return F.when(text.isNotNull(), shaped & F.coalesce(remainder == 0, F.lit(False)))

    return _with(bsn, valid)


def bsn_check_digit(prefix: Column) -> Column:
    """Ninth digit for an 8-digit prefix; null when the remainder is 10 or the prefix is malformed."""
    remainder = weighted_digit_sum(prefix, BSN_WEIGHTS[:8]) % 11
    return F.when((F.length(prefix) == 8) & prefix.rlike("^[0-9]{8}$") & (remainder < 10), remainder.cast("int"))


def is_nl_iban(account: Column) -> Column:
    return account.rlike(IBAN_FORMAT)


def remainder_97(text: Column) -> Column:
    """The remainder by 97 of a text of digits and capital letters, A being 10 and Z 35; null if it has anything else.

    The number is never built: each character extends the remainder of those before it.
    """

    def extended(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        digit = F.when(code.between(48, 57), rest * 10 + code - 48)
        return F.when(code.between(65, 90), rest * 100 + code - 55).otherwise(digit) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), extended)


def has_account_checksum(account: Column) -> Column:
    """Modulus 97: with the country and check digits moved behind the rest, the account's number leaves 1. Null stays null."""

    def valid(text: Column) -> Column:
        shaped = F.length(text).between(5, 34) & text.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & ~text.endswith("\n")
        turned = F.concat(F.substr(text, F.lit(5)), F.substring(text, 1, 4))
        return F.when(text.isNotNull(), shaped & F.coalesce(remainder_97(turned) == 1, F.lit(False)))

    return _with(account, valid)


def account_check_digits(country: Column, rest: Column) -> Column:
    """The two check digits of an account number; null if the parts hold other than digits and capital letters."""
    return F.lpad((F.lit(98) - remainder_97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0")


def is_payroll_number(number: Column) -> Column:
    return number.rlike(PAYROLL_FORMAT)


def pseudonymize(value: Column, salt: str) -> Column:
    """Upper-case hex SHA-256 of the text followed by the salt; null stays null."""
    return F.upper(F.sha2(F.concat(value.cast("string"), F.lit(salt)), 256))
