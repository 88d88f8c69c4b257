from decimal import Decimal

import pytest

from colloquy.operators import units as U


@pytest.mark.parametrize(
    "raw,value,want",
    [
        ("(2,922,231)", None, "-2922231"), ("67.393", 67393.0, "67393"), ("23,8", None, "23.8"), ("0.085", None, "0.085"), ("1.403,8", None, "1403.8"),
        ("1\xa0259.5", None, "1259.5"), ("−0.02", None, "-0.02"), ("12,34,567", None, "1234567"), ("£4.98", None, "4.98"), ("6 375 720 000", None, "6375720000"),
    ],
)
def test_numbers(raw, value, want):
    assert U.read_number(raw, value) == Decimal(want)


@pytest.mark.parametrize(
    "args,want",
    [
        (("rwa", "£129.8", None, "MM", "£129.8 MM", "x"), ("gbp_m", 129800)),
        (("total_income", "0.31", 0.31, "€Mrd.", "0.31 €Mrd.", ""), ("eur_m", 310000)),
        (("credit_impairment", "23,8", 23.8, "JPY oku", "23,8 JPY oku", ""), ("jpy_m", 2380000)),
        (("rwa", "28.6", 28.6, "₹lakh", "", ""), ("inr_m", 2860)),
        (("cost_of_risk", "1.44", None, "per cent", "", ""), ("bp", 144000)),
        (("cet1_ratio", "158.7", None, "‰", "", ""), ("pct", 15870)),
        (("net_margin", "0.0290", None, "decimal", "", ""), ("pct", 2900)),
        (("headcount", "37.8", 37.8, "'000 FTE", "", ""), ("fte", 37800000)),
        (("headcount", "62.7", 62.7, None, "62.7", "Headcount in thousands: 62.7, Q1 2020."), ("fte", 62700000)),
        (("rwa", "4,890.0", None, None, "4,890.0", "Table in GBP millions. Risk-weighted assets 4,890.0 full year 2013."), ("gbp_m", 4890000)),
        (("rwa", "55.210", 55210.0, None, "55.210", "(all figures in thousands of euros) Risk-weighted assets: 55.210."), ("eur_m", 55210)),
        (("rwa", "916.919.000", None, "INR", "", ""), ("inr_m", 916919)),
        (("total_income", "121,943,000", None, "units", "121,943,000", "Presentation currency CHF. Total income was 121,943,000."), ("chf_m", 121943)),
        (("rwa", "2,42", None, None, "2,42", "Risk-weighted assets stood at 2,42 in 2019."), None),
        (("cost_of_risk", "0.37", 0.37, None, "0.37", "The cost of risk was 0.37 in 2019."), None),
        ((None, "4", 4.0, "bn", "4 bn", ""), None), (("rwa", None, None, "£bn", None, None), None), (("rwa", "", None, "", "", ""), None),
        (("rwa", "5", 5.0, "x" * 5000, "5", "y" * 50000), None),
    ],
)
def test_claims(args, want):
    assert U.convert(*args) == want


def test_ambiguous_letters_follow_the_field():
    assert U.segment("m", "money").factor == 10**6
    assert U.segment("CHFm", "money").currency == "chf"
    assert U.segment("km^2").dim in ("metre", "")
    assert U.segment("") is U.NONE and U.segment("zzz") is U.NONE


def test_operator_counts_repeats_once_and_takes_empty_tables(spark):
    schema = "claim_id long, metric string, value_raw string, value double, unit string, span string, context string, common_unit string"
    rows = [(1, "rwa", "£1", 1.0, "bn", "£1 bn", "", "x")] * 2 + [(None, "rwa", "£1", 1.0, "bn", "", "", None), (2, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in U.common_units(df).collect()] == [(1, "gbp_m", 1000000)]
    assert U.common_units(df.limit(0)).count() == 0


def test_windows_of_a_context_are_ranked_by_their_cuts():
    assert U.offered("(all figures in billions of sterling) Income: # after 6 one-off items.", "money")[0] == "billions of sterling"
    assert U.offered("Headcount in full-time equivalents: #, in June", "heads") == ("full-time equivalents",)
    assert U.offered("The capital ratio (‰): # in Q4 2024, up 5%", "ratio")[0] == "‰"
    assert U.offered("In 12 months the book of m metres in Leeds fell", "money") == () and U.offered("", "money") == ()
