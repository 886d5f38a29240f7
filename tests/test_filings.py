"""Filings and profiles: the values that the formats and rules define, on small documents."""

import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions import profiles as P
from tessera.operators.institutions import conglomerate_codes, first_filled_quarter
from tessera.sources import filings

Y23, Y24 = ("2023-01-01", "2023-12-31"), ("2024-01-01", "2024-12-31")


def entry(value, end, start=None, filed="2025-02-01", form="10-K", accn="0001"):
    return {"val": value, "end": end, "filed": filed, "form": form, "accn": accn} | ({"start": start} if start else {})


def years(first, second):
    return [entry(first, Y23[1], Y23[0]), entry(second, Y24[1], Y24[0], accn="0002")]


def issuer():
    usd = {
        "Revenues": years(1, 1), "RevenueFromContractWithCustomerExcludingAssessedTax": years(100, 120), "OperatingIncomeLoss": years(20, 25), "DepreciationDepletionAndAmortization": years(5, 6),
        "NetIncomeLoss": [*years(10, 12), entry(99, *reversed(Y24), filed="2025-04-01", form="10-K/A", accn="0000")], "NetCashProvidedByUsedInOperatingActivities": years(11, 14), "PaymentsToAcquirePropertyPlantAndEquipment": years(3, 4),
        "StockholdersEquity": [entry(80, Y23[1]), entry(100, Y24[1], filed="2025-03-01"), entry(500, "2025-06-30")], "CashAndCashEquivalentsAtCarryingValue": [entry(20, Y24[1])], "LongTermDebtCurrent": [entry(10, Y24[1])], "LongTermDebtNoncurrent": [entry(40, Y24[1])],
    }
    tags = {tag: {"units": {"USD": rows, "AUD": []}} for tag, rows in usd.items()}
    tags["EarningsPerShareDiluted"] = {"units": {"USD/shares": years("1", "1.2"), "A": []}}
    tags["EntityCommonStockSharesOutstanding"] = {"units": {"shares": [entry(10, Y24[1], form="10-Q")]}}
    tags["Quarterly"] = {"units": {"USD": [{"val": "x"}]}}
    return json.dumps({"entityName": "Issuer", "facts": {"us-gaap": tags, "ifrs-full": {"Revenue": {"units": {"EUR": years(7, 8)}}}}})


@pytest.fixture(scope="module")
def docs(spark):
    euro = json.dumps({"facts": {"ifrs-full": {"Revenue": {"units": {"EUR": [entry(7, Y24[1], Y24[0], form="6-K"), entry(3, Y24[1], "2024-10-01", form="6-K"), {"end": Y24[1]}, entry("x", Y24[1])]}}}}})
    return spark.createDataFrame([("a", issuer()), ("b", euro), ("c", "{"), ("d", None), ("e", "{}")], "k string, doc string")


def test_statements(docs):
    seen = filings.observations(docs, "k", "doc")
    rows = {(r["k"], str(r["end"])): r for r in filings.annual_statements(seen, "k").collect()}
    assert set(rows) == {("a", "2023-12-31"), ("a", "2024-12-31"), ("b", "2024-12-31")}
    last = rows["a", "2024-12-31"]
    assert (last["revenue"], last["net_income"], last["free_cash_flow"], last["ebitda"]) == (120, 99, 10, 31)
    assert rows["b", "2024-12-31"]["revenue"] == 7 and rows["b", "2024-12-31"]["free_cash_flow"] is None
    assert [r["k"] for r in filings.annual_statements(seen, "k", 1).orderBy("k").collect()] == ["a", "b"]


def test_balances(docs):
    rows = {r["k"]: r for r in filings.latest_balances(filings.observations(docs, "k", "doc"), "k").collect()}
    assert (rows["a"]["equity"], rows["a"]["gross_debt"], rows["a"]["net_debt"], rows["a"]["shares"]) == (100, 50, 30, 10)
    assert rows["b"]["as_of"] == datetime.date(2024, 12, 31) and rows["b"]["equity"] is None and rows["b"]["shares"] is None
    assert {r["k"]: r["currency"] for r in filings.currencies(docs, "k", "doc").collect()} == {"a": "USD", "b": "EUR", "c": "USD", "d": "USD", "e": "USD"}


@pytest.mark.parametrize(
    ("sector", "name", "wanted"),
    [("Intermediários Financeiros", None, "bank"), (None, "Bco Alfa", "bank"), ("Previdência e Seguros", "X", "insurer"), ("Petróleo", "Gas", "commodity"), ("Saneamento", None, "utility"), (None, None, "industrial"), ("Varejo", "Loja", "industrial")],
)
def test_stock_profile(spark, sector, name, wanted):
    assert spark.createDataFrame([(sector, name)], "a string, b string").select(P.stock_profile(F.col("a"), F.col("b"))).first()[0] == wanted


def test_financial_sector(spark):
    rows = spark.createDataFrame([("Serviços Financeiros",), ("Seguradoras",), ("Previdência",), ("Varejo",), (None,)], "s string")
    assert [r[0] for r in rows.select(P.is_financial(F.col("s"))).collect()] == [True, True, True, False, False]


def test_fund_and_etf_profiles(spark):
    etfs = spark.createDataFrame([("Bitcoin fund", [], [1.0]), ("x", ["Treasury"], []), ("x", ["Equity"], [70.0, 30.0]), ("x", None, [0.5, 0.5]), (None, None, None)], "d string, t array<string>, w array<double>")
    assert [r[0] for r in etfs.select(P.etf_profile(F.col("d"), F.col("t"), F.col("w"))).collect()] == ["crypto", "fixed_income", "thematic", "broad", "broad"]
    funds = spark.createDataFrame([("fi_infra", 1.0, 0.0, 1.0), ("fiagro", None, None, None), ("fiagro", 2.0, 1.0, 4.0), ("fii", 5.0, 5.0, 10.0), ("fii", 1.0, 6.0, 10.0), ("fii", 1.0, 1.0, 0.0)], "k string, p double, c double, t double")
    assert [r[0] for r in funds.select(P.fund_profile(*map(F.col, "kpct"))).collect()] == ["fi_infra", "fiagro_credit", "fiagro_land", "brick", "paper", "hybrid"]


def test_instrument_types(spark):
    bulletin = spark.createDataFrame([(None, "FI-INFRA X", ""), ("FUNDS", "FIAGRO", ""), ("x", "IT NOW ETF", "b"), ("BDR", "", ""), ("FUNDS", "CI", "FUNDO IMOBILIARIO"), ("FUNDS", "CI", "x"), ("x", "UNT N2", ""), ("CASH", "PETR PN N2", ""), ("x", "y", "z"), ("x", "ETFS", "z")], "a string, b string, c string")
    assert [r[0] for r in bulletin.select(P.bulletin_type(*map(F.col, "abc"))).collect()] == ["fi_infra", "fiagro", "etf", "bdr", "fii", "fund", "unit", "stock", "unknown", "unknown"]
    directory = spark.createDataFrame([("bdr", "x", "A34"), ("fund", "ETF x", "A11"), ("fund", "Fundo de Índice", "A11"), ("fund", "Alfa", "ALFA11"), ("fund", "Alfa", "ALFA12"), ("stock", None, "PETR4"), (None, "Alfa Unit", "A"), (None, None, "PETR4")], "a string, b string, c string")
    assert [r[0] for r in directory.select(P.directory_type(*map(F.col, "abc"))).collect()] == ["bdr", "etf", "etf", "fii", "unknown", "stock", "unit", "unknown"]


def test_institutions(spark):
    banks = spark.createDataFrame([("1", "P1", "B", "Banco Alfa"), ("9", "P1", "C", "Alfa - Prudencial"), ("8", "P1", "C", "Alfa"), ("2", "P2", "B", "Beta"), ("3", None, "B", "Gama")], "code string, prudential string, td string, name string")
    assert {r["code"]: r["conglomerate"] for r in conglomerate_codes(banks, "code", "prudential", "td", "name").collect()} == {"1": "8", "9": "8", "8": "8", "2": "2", "3": "3"}
    values = spark.createDataFrame([("8", 202409, Decimal(1)), ("8", 202406, Decimal(2)), ("2", 202103, Decimal(3))], "code string, quarter int, value decimal(10,2)")
    got = first_filled_quarter(spark.createDataFrame([("8", 202503), ("2", 202412), ("x", 202412)], "code string, asked int"), values, "code", "asked", "quarter", ["value"], newest=202412)
    assert {(r["code"], r["quarter"], r["value"]) for r in got.collect()} == {("8", 202409, Decimal(1)), ("2", None, None), ("x", None, None)}
