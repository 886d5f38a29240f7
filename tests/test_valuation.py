"""Which source a metric is believed from, on small pages."""

import datetime
import math

import pytest

from tessera.operators import opportunity as V

DETAILS = "k int, quote_date date, quote double, eps double, bvps double, p_vp double, p_l double, div_yield double, shares double, min_52 double, max_52 double"
STATUS = "k int, price double, s_eps double, s_bvps double, s_p_vp double, s_p_l double, dividends double, s_yield double, s_min_52 double, s_max_52 double"
DAY = datetime.date(2024, 7, 1)


@pytest.fixture(scope="module")
def got(spark):
    n = None
    details = spark.createDataFrame([(1, DAY, 10.0, 2.0, 5.0, n, n, 3.0, 100.0, 8.0, n), (2, DAY, n, n, n, 1.5, n, 0.0, n, n, n), (3, DAY, 10.0, -1.0, 0.0, n, n, 7.0, n, n, n)], DETAILS)
    status = spark.createDataFrame([(1, 11.0, 9.0, 9.0, 4.0, n, 9.0, 2.0, 7.0, 12.0), (2, 20.0, 4.0, n, n, n, 1.2, 9.0, n, n), (4, n, n, n, n, n, n, 6.0, n, n)], STATUS)
    paid = spark.createDataFrame([(1, DAY - datetime.timedelta(365), n, 0.5), (1, DAY - datetime.timedelta(366), DAY, 5.0), (1, n, DAY, 0.25), (1, n, n, 9.0), (2, DAY - datetime.timedelta(400), n, 1.0), (4, DAY, n, 3.0)], "k int, ex_date date, payment_date date, value double")
    rows = V.valuation(details, status, V.trailing_dividends(paid, details, "k"), "k").collect()
    assert len(rows) == 4 * 12
    return {(r["k"], r["metric"]): (r["value"], r["source"], r["state"], r["reason"]) for r in rows}


@pytest.mark.parametrize(
    ("key", "value", "source"),
    [
        ((1, "current_price"), 10.0, "details"), ((2, "current_price"), 20.0, "status"), ((1, "price_to_book"), 4.0, "status"), ((2, "price_to_book"), 1.5, "details"), ((1, "price_to_earnings"), 5.0, "details"), ((2, "price_to_earnings"), 5.0, "status"),
        ((1, "dividends_12m"), 0.75, "details"), ((2, "dividends_12m"), 1.2, "status"), ((3, "dividends_12m"), 0.0, "details"), ((1, "dividend_yield_12m"), 7.5, "details"), ((3, "dividend_yield_12m"), 0.0, "details"), ((4, "dividend_yield_12m"), 6.0, "details"),
        ((1, "bazin_price"), 12.5, "details"), ((1, "graham_price"), math.sqrt(225), "details"), ((3, "price_to_earnings"), -10.0, "details"), ((1, "min_52_weeks"), 8.0, "details"), ((1, "max_52_weeks"), 12.0, "status"), ((1, "shares_outstanding"), 100.0, "details"),
    ],
)
def test_believed(got, key, value, source):
    assert got[key] == (pytest.approx(value), source, "valid", None)


@pytest.mark.parametrize(("key", "reason"), [((3, "graham_price"), "earnings and book value above zero are needed"), ((3, "price_to_book"), "no book value a share"), ((4, "current_price"), "no price"), ((4, "dividends_12m"), "no trailing dividends"), ((2, "shares_outstanding"), "no share count")])
def test_missing(got, key, reason):
    assert got[key] == (None, None, "missing", reason)


def test_no_rows(spark):
    nothing = spark.createDataFrame([], DETAILS)
    paid = spark.createDataFrame([], "k int, ex_date date, payment_date date, value double")
    assert V.valuation(nothing, spark.createDataFrame([], STATUS), V.trailing_dividends(paid, nothing, "k"), "k").count() == 0


def test_official_values_overrule_pages_and_distributions_have_middles(spark):
    n, back = None, lambda days: DAY - datetime.timedelta(days)
    details = spark.createDataFrame([(1, DAY, 10.0, 2.0, 5.0, 7.0, n, 3.0, n, n, n, 50.0, n), (2, DAY, -1.0, n, 5.0, 7.0, n, n, n, n, n, n, 9.0), (3, DAY, 10.0, n, 5.0, n, n, n, n, n, n, n, n)], DETAILS + ", traded_value double, market_value double")
    status = spark.createDataFrame([(4, 8.0, n, 2.0, n, n, n, n, n, n)], STATUS)
    reports = [(1, back(40), 99.0), (1, back(9), 2.0), (1, back(9), 4.0), (2, back(3), 4.0), (3, n, 4.0), (4, back(1), n), (5, back(2), 6.0), (n, back(2), 6.0)]
    paid = [(1, back(30 * m), float(v), s) for m, v, s in ((1, 5, "a"), (2, 1, "b"), (3, 9, "a"), (4, 2, "c"), (5, 2, "c"), (6, 4, "c"), (7, 80, "d"))] + [(2, back(k), 1.0, "a") for k in range(3)] + [(6, DAY, 2.0, "x"), (6, n, 3.0, "x"), (n, DAY, 3.0, "x")]
    nothing = spark.createDataFrame([], "k int, ex_date date, payment_date date, value double")
    found = V.asset_metrics(details, status, V.trailing_dividends(nothing, details, "k"), spark.createDataFrame(reports, "k int, as_of date, nav_per_share double"), spark.createDataFrame(paid, "k int, ex_date date, value double, source string"), "k").collect()
    got = {(r["k"], r["metric"]): (r["value"], r["as_of"], r["source"], r["reason"]) for r in found}
    assert len(found) == len(got) == 6 * 17 and {k for k, _ in got} == {1, 2, 3, 4, 5, 6}
    assert got[1, "book_value_per_share"] == (4.0, back(9), "reports", n) and got[1, "price_to_book"] == (2.5, back(9), "reports,details", n) and got[1, "current_price"] == (10.0, DAY, "details", n)
    assert got[2, "price_to_book"] == (n, n, n, "no price") and got[3, "price_to_book"] == (2.0, DAY, "details", n) and got[4, "book_value_per_share"] == (n, n, n, "no book value a share") and got[4, "price_to_book"][3] == "no price"
    assert got[1, "average_daily_traded_value"] == (50.0, DAY, "details", n) and got[1, "market_capitalization"][3] == "no market value" and got[2, "market_capitalization"][0] == 9.0
    assert got[1, "latest_distribution"] == (5.0, back(30), "a", n) and got[1, "median_distribution_3m"] == (5.0, back(30), "a,b", n) and got[1, "median_distribution_6m"] == (3.0, back(30), "a,b,c", n)
    assert got[2, "median_distribution_3m"][:2] == (1.0, DAY) and got[2, "median_distribution_6m"] == (n, n, n, "fewer than 6 distributions") and got[6, "latest_distribution"] == (2.0, DAY, "x", n)
    assert got[5, "book_value_per_share"] == (6.0, back(2), "reports", n) and got[5, "latest_distribution"] == (n, n, n, "no distribution") and got[6, "current_price"] == (n, n, n, "no price")
