"""Directories in their three shapes, and names lent to receipts."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import directories as S


@pytest.mark.parametrize(("function", "given", "wanted"), [(S.cik, "CIK320193", "0000320193"), (S.cik, " 12 ", "0000000012"), (S.cik, "12345678901", None), (S.cik, "x", None), (S.cik, None, None), (S.foreign_ticker, " aapl ", "AAPL"), (S.foreign_ticker, "AAPL34", None), (S.foreign_ticker, "BRK.B", "BRK.B"), (S.foreign_ticker, "a b", None), (S.foreign_ticker, "", None), (S.receipt_underlying, "nvdc34", "NVDA"), (S.receipt_underlying, "XXXX34", None)])
def test_codes(spark, function, given, wanted):
    assert spark.createDataFrame([(given,)], "t string").select(function(F.col("t"))).first()[0] == wanted


def test_shapes(spark):
    documents = [
        {"fields": ["cik", "name", "ticker", "exchange"], "data": [[320193, "Apple", "AAPL", "Nasdaq"], [1, "Local", "PETR4", "B3"], [2, "Short", "SHRT"]]},
        {"data": [{"ticker": "MSFT", "cik_str": 789019, "companyName": " Microsoft ", "country": "UK"}, {"ticker": "AAPL", "cik": "9"}, {"ticker": "NONE"}]},
        {"0": {"ticker": "nvda", "cik_str": 1045810, "title": "NVIDIA"}, "1": {"ticker": "x y", "cik": 1}},
        [{"ticker": "IBM", "cik": "CIK51143", "class": "A"}],
    ]
    docs = spark.createDataFrame([*((k, json.dumps(d)) for k, d in enumerate(documents)), (7, None), (8, "{"), (9, "[]"), (10, "{}")], "n int, doc string")
    rows = {r["ticker"]: tuple(r)[1:] for r in S.ticker_directory(docs, "doc", "n").collect()}
    assert rows == {
        "AAPL": ("0000320193", "Apple", "Nasdaq", "US", None), "SHRT": ("0000000002", "Short", None, "US", None), "MSFT": ("0000789019", "Microsoft", None, "UK", None),
        "NVDA": ("0001045810", "NVIDIA", None, "US", None), "IBM": ("0000051143", None, None, "US", "A"),
    }


def test_underlying_names(spark):
    rows = [("NVDC34", "NVDC34", "nvda", None), ("NVDA", "NVIDIA Corp", None, None), ("AAPL34", "x", "AAPL", "own"), ("AAPL", "aapl", None, None), ("A1AP34", None, "AAPL", None)]
    df = spark.createDataFrame(rows, "ticker string, name string, underlying string, underlying_name string")
    got = {r["ticker"]: r["underlying_name"] for r in S.with_underlying_names(df, "ticker", "name", "underlying", "underlying_name").collect()}
    assert got == {"NVDC34": "NVIDIA Corp", "NVDA": None, "AAPL34": "own", "AAPL": None, "A1AP34": None}
