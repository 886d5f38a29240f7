"""Market documents and stock facts on small rows."""

import datetime
import json
from decimal import Decimal

import pytest

from tessera.operators.stock_facts import stock_facts
from tessera.sources import market_documents as M


def docs(spark, *values):
    return spark.createDataFrame([(n, v if v is None or isinstance(v, str) else json.dumps(v)) for n, v in enumerate(values)], "k long, doc string")


def test_quotes(spark):
    told = {"results": [{"data": {"longName": " Apple ", "currency": "BRL", "regularMarketPrice": 172.76, "regularMarketTime": "2026-07-03T20:00:00Z", "marketCap": 5}}]}
    got = M.quotes(docs(spark, told, {"results": [{"data": {"regularMarketPrice": "-", "longName": "x"}}]}, {"results": []}, "broken", None), "k", "doc").orderBy("k").collect()
    assert [(r["k"], r["price"], r["currency"], r["exchange"], r["description"]) for r in got] == [(0, Decimal("172.76"), "BRL", "B3", "Apple"), (1, None, None, None, "x")]
    assert got[0]["quoted_at"] == datetime.datetime(2026, 7, 3, 20) and got[0]["market_capitalization"] == 5


def test_overviews_and_profiles(spark):
    d = docs(spark, {"Description": "Co", "Country": "USA", "EPS": "6.1", "PERatio": "None"}, {"Note": "limit"}, {"Error Message": "no"}, "[]", None)
    (r,) = M.overviews(d, "k", "doc").collect()
    assert (r["description"], r["earnings_per_share"], r["price_to_earnings"], r["sector"]) == ("Co", Decimal("6.1"), None, None)
    assert M.foreign_instruments(M.overviews(d, "k", "doc"), "k").first()["name"] == "Co"
    fund = {"net_assets": "1000", "net_asset_value": "-", "inception_date": "2010-09-07", "sectors": [{"sector": "TECH", "weight": "0.3"}, {"name": "X", "weight": "-"}], "holdings": [{"symbol": "AAPL", "weight": "0.07"}, {"symbol": "B", "weight": "-"}, {"symbol": "", "weight": "1"}]}
    p = M.fund_profiles(docs(spark, fund, {"net_assets": 1}), "k", "doc").orderBy("k").collect()
    assert (p[0]["net_assets"], p[0]["nav"], p[0]["inception_date"]) == (1000, None, datetime.date(2010, 9, 7))
    assert [(s["name"], s["weight"]) for s in p[0]["sectors"]] == [("TECH", Decimal("0.3"))] and [h["symbol"] for h in p[0]["holdings"]] == ["AAPL"]
    assert p[1]["sectors"] == [] and p[1]["holdings"] == []


def test_stock_facts(spark):
    names = "revenue gross_profit ebit ebitda net_income equity total_assets operating_cash_flow free_cash_flow net_debt gross_debt current_assets current_liabilities financial_result shares public_eps public_bvps".split()
    row = dict.fromkeys(names, 10.0) | {"revenue": 100.0, "equity": 50.0, "financial_result": -2.0, "public_eps": 2.0, "current_liabilities": None}
    years = [row | {"revenue": 100.0 * 1.1**n, "net_income": v} for n, v in enumerate((-5.0, 10.0, 10.0, 20.0, 10.0, 10.0))]
    schema = "k long, period_end date, " + ", ".join(f"{n} double" for n in names)
    annual = spark.createDataFrame([(1, datetime.date(2015 + n, 12, 31), *(y[c] for c in names)) for n, y in enumerate(years)] + [(2, datetime.date(2020, 12, 31), *(None for _ in names))], schema)
    latest = annual.where("period_end = '2020-12-31'").drop("period_end")
    macro = spark.createDataFrame([(y, 0.05, 0.05 if y < 2018 else 0.13) for y in range(2014, 2021)], "yr int, inflation double, selic double")
    got = {(r["k"], r["fact"]): r["value"] for r in stock_facts(latest, annual, macro, "k").collect()}
    close = {
        "net_margin": 10 / 161.051, "return_on_equity": 0.2, "interest_coverage": 5.0, "current_ratio": None, "accrual_ratio": 0.0, "revenue_cagr": 1.1 ** (5 / (1827 / 365.25)) - 1, "earnings_cagr": None,
        "positive_earnings_frequency": 5 / 6, "roe_5y_median": 0.2, "roe_above_15_frequency": 1.0, "share_dilution": 0.0, "earnings_per_share_consistency_error": 0.5, "stress_profitability_frequency": 1.0,
        "positive_real_revenue_growth_frequency": 1.0, "revenue_real_cagr": (1.1 / 1.05) ** (4 / (1461 / 365.25)) - 1, "roe_vs_selic_spread": 0.2 - 0.05,  # of 0.15, 0.15, 0.27, 0.07, 0.07
    }
    assert {k: got[1, k] for k in close} == {k: v if v is None else pytest.approx(v) for k, v in close.items()}
    assert len(got) == 66 and {v for (k, _), v in got.items() if k == 2} == {None}
