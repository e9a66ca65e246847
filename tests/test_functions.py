"""Column functions against their stated cases."""

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom import contract as K
from tallyloom.functions import dates, keys, money, text

ALL = (r"X\d+$", r"-\d+$", r"R$")


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression.alias("r")).collect()]


@pytest.mark.parametrize(
    ("patterns", "cases"),
    [
        (
            ALL,
            {
                "9298046X1": "9298046",
                "9298046X3": "9298046",
                "46661-1": "46661",
                "46661R": "46661",
                "46661-1R": "46661",
                "SIN12200241": "SIN12200241",
                "X1200241": "X1200241",
                "100": "100",
                "  12X3 \n": "12",
                "   ": "",
                "": "",
                None: None,
                "ARRRRRRR": "A",
                "SIN7-1-2-3-4-5-6-7-8X9": "SIN7",
            },
        ),
        ((r"X\d+$", r"-\d+$"), {"46661R": "46661R", "46661-1": "46661"}),
        ((r"R$", r"-\d+$"), {"46661-1R": "46661", "46661R-1": "46661"}),
        ((), {"46661-1": "46661-1"}),
    ],
)
def test_normalize_number(spark, patterns, cases):
    fixed = column(spark, list(cases), text.normalize_number(F.col("c"), patterns))
    by_column = F.array(*map(F.lit, patterns)) if patterns else F.array().cast("array<string>")
    assert column(spark, list(cases), text.normalize_number_by(F.col("c"), by_column)) == fixed
    for got, (raw, wanted) in zip(fixed, cases.items()):
        assert got == wanted, raw


def brute_force(number, patterns):
    """The rule in words: a suffix goes if something stays in front of it, until none goes."""
    if not number:
        return number
    value, before = number.strip(), None
    while value != before:
        before = value
        for pattern in patterns:
            hit = re.search(pattern, value)
            if hit and hit.start():
                value = value[: hit.start()]
    return value


def test_suffixes_that_can_go_at_once():
    assert text.all_suffixes(ALL) is not None and text.all_suffixes([r"-\d+$", "R$"]) is not None
    for mixed in (["AB$", "B$"], ["-[0-9-]+$"], ["X[0-9R]*$", "R$"], ["[XY][0-9]$"], [r"-\d+"], [r"(-\d)+$"], []):
        assert text.all_suffixes(mixed) is None


def test_order_of_suffixes_matters_where_they_overlap(spark):
    values = ["xAB", "xB", "B", "AB", "xABAB", "xA", "x-1\n", "A-2\n-1", "A \n-1R"]
    for patterns in (["B$", "AB$"], ["AB$", "B$"]):
        assert column(spark, values, text.normalize_number(F.col("c"), patterns)) == [brute_force(v, patterns) for v in values]
    lines = ["A-2\n-1", "A \n-1R", "A-1", "A-1R\n"]
    assert column(spark, lines, text.normalize_number(F.col("c"), ALL)) == [brute_force(v, ALL) for v in lines]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="X1-2RA9", max_size=9), min_size=50, max_size=120))
def test_normalize_number_random(spark, values):
    assert column(spark, values, text.normalize_number(F.col("c"), ALL)) == [brute_force(v, ALL) for v in values]


def test_is_numeric_agrees_with_float(spark):
    values = [
        "1", "1.", ".5", "1e3", "1E-3", "+2", "-0", " 48.75 ", "1_000", "1__0", "_1", "1_", "inf", "-Infinity", "NaN",
        "1d", "1f", "0x10", "", " ", ".", "e5", "1,000", "$5", "N/A", "--1", "1e", "1e5.5", "infinit",
    ]

    def accepted(value):
        try:
            float(value)
        except ValueError:
            return False
        return True

    assert column(spark, values, text.is_numeric(F.col("c"))) == [accepted(v) for v in values]


def test_canonical_amount(spark):
    cases = {
        "48.75": "48.75", "48.750": "48.75", "48.7": "48.70", "1e3": "1000.00", "1_000": "1000.00", " 5 ": "5.00",
        "N/A": "N/A", "": "", None: None, "$1,234.56": "$1,234.56",
    }
    assert column(spark, list(cases), money.canonical_amount(F.col("c"))) == list(cases.values())


def test_parse_money(spark):
    cases = {
        "$1,234.56": "1234.56", "(12.50)": "12.50", "-3.1": "-3.10", "1-2": None, "": None, "abc": None, None: None,
        "12345678901.00": None,
    }
    got = column(spark, list(cases), money.parse_money(F.col("c")).cast("string"))
    assert got == list(cases.values())


@pytest.mark.parametrize(
    ("a", "b", "equal"),
    [
        ("100.00", "100.005", True), ("100.00", "100.02", False), (None, "1", False), ("1", None, False),
        ("48.75", "48.76", True), ("100.00", "100.01", False),
    ],
)
def test_amount_equal_in_binary_doubles(spark, a, b, equal):
    row = spark.range(1).select(
        money.amount_equal(F.lit(a).cast("decimal(12,3)"), F.lit(b).cast("decimal(12,3)"), 0.01).alias("r")
    )
    assert row.first().r is equal
    if a and b:
        assert equal == (abs(float(a) - float(b)) <= 0.01)


def test_credit_needs_a_larger_amount(spark):
    rows = spark.sql("SELECT cast(a AS decimal(12,2)) a, cast(b AS decimal(12,2)) b FROM VALUES (100, 85), (85, 100), (5, 5), (NULL, 1) t(a, b)")
    got = [None if r[0] is None else str(r[0]) for r in rows.select(money.credit_of(F.col("a"), F.col("b"))).collect()]
    assert got == ["15.00", None, None, None]


def test_dates(spark):
    values = ["05/01/2026", "5/1/2026", "2026-05-01", "02/30/2026", "soon", None]
    parsed = column(spark, values, dates.parse_date(F.col("c"), "MM/dd/yyyy").cast("string"))
    assert parsed == ["2026-05-01", None, None, None, None, None]
    assert column(spark, values, text.looks_like_date(F.col("c"))) == [True, True, True, True, False, None]


@pytest.mark.parametrize("value", ["plain", "it's", 'say "hi"', "both ' and \"", "back\\slash", "line\nbreak\ttab", "", None])
def test_quoted_is_repr(spark, value):
    assert column(spark, [value], text.quoted(F.col("c"))) == [repr(value)]


def test_error_buckets(spark):
    cases = {
        None: "UNKNOWN_ERROR", "": "UNKNOWN_ERROR", "Missing API key": "MISSING_API_KEY",
        "set the ENVIRONMENT VARIABLE": "MISSING_API_KEY", "Transport error: http 500": "TRANSPORT_ERROR",
        "Response was not valid JSON": "PARSE_ERROR", "Unexpected response shape": "PARSE_ERROR",
        "HTTP 503 on attempt 4": "HTTP_ERROR", "an http 503": "UNKNOWN_ERROR",
    }
    assert column(spark, list(cases), text.error_bucket(F.lit(False), F.col("c"))) == list(cases.values())
    assert set(column(spark, list(cases), text.error_bucket(F.lit(True), F.col("c")))) == {K.STATUS_SUCCESS}


def test_header_value_and_conforms(spark):
    values = ["a\nShop -  Main Street  \nb", "Shop - ", "none", None]
    assert column(spark, values, text.header_value(F.col("c"), "Shop - (.*)")) == ["Main Street", "", None, None]
    numbers = ["SIN12", "sin12", "SIN12R", "xSIN12", None]
    assert column(spark, numbers, text.conforms(F.col("c"), r"^SIN\d+$")) == [True, True, False, False, None]


def test_ids_are_stable_and_mark_nulls(spark):
    rows = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    parts = [F.col(c) for c in "xyz"]
    ids = [r[0] for r in rows.select(keys.stable_id("k", *parts)).collect()]
    assert len(set(ids)) == 2
    merged = {r[0] for r in rows.select(keys.record_id("k", *parts)).collect()}
    assert len(merged) == 1  # the record id skips NULLs by contract
    numbers = column(spark, [str(i) for i in range(500)], keys.hash_number(42, "salt", F.col("c")))
    assert min(numbers) >= 0 and max(numbers) < 2**32 and len(set(numbers)) == 500
    assert math.isclose(sum(numbers) / 500 / 2**31, 1, abs_tol=0.1)


def test_number_shown(spark):
    given = ["0", "0.5", "0.90", "0.00001", "0.0005", "-0.000123", "1.5e-7", "12", None, "high"]
    expected = ["0", "0.5", "0.9", "1e-05", "0.0005", "-0.000123", "1.5e-07", "12", None, None]
    assert column(spark, given, text.number_shown(F.col("c"))) == expected
