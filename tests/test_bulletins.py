"""Local directories and bulletins on small documents."""

import datetime
import json

from tessera.sources import bulletins as B


def test_local_directory(spark):
    values = [{"stocks": [{"stock": "petr4", "name": "Petrobras", "type": "stock"}, 5, {"stock": "AAPL34", "type": "bdr", "name": "Apple"}, {"stock": "HGLG11", "type": "fund"}, {"stock": "PETR4", "name": "Again"}, {"stock": "no spaces here"}]}, [{"symbol": "BOVA11", "assetType": "ETF", "country": "US"}], {"a": [{"code": "XPCA11", "name": "Fiagro X"}], "n": 1, "b": [{"ticker": "VALE3", "isin": " I "}]}]
    docs = spark.createDataFrame([(n, json.dumps(v)) for n, v in enumerate(values)] + [(7, "broken"), (8, None)], "n long, doc string")
    got = {r["ticker"]: r for r in B.local_directory(docs, "doc", "n").collect()}
    assert {k: r["instrument_type"] for k, r in got.items()} == {"PETR4": "stock", "AAPL34": "bdr", "HGLG11": "fii", "BOVA11": "etf", "XPCA11": "fiagro", "VALE3": "unknown"}
    assert (got["PETR4"]["name"], got["AAPL34"]["underlying_ticker"], got["BOVA11"]["country"], got["VALE3"]["isin"], got["VALE3"]["exchange"]) == ("Petrobras", "AAPL", "US", "I", "B3")


def test_bulletins(spark):
    def doc(*rows):
        names = ["RptDt", "TckrSymb", "SgmtNm", "SctyCtgyNm", "CrpnNm", "ISIN"]
        return json.dumps({"table": {"columns": [{"name": n} for n in names], "values": rows}})

    day = datetime.date(2026, 7, 3)
    docs = spark.createDataFrame([(day, doc(["2026-07-03", "JURO11", "FORWARD", "FUNDS", "x", "I"], ["2026-07-03", "JURO11", "CASH", "FUNDS", "FI-INFRA  JURO", "BR1"], ["2026-07-03", "JURO11", "CASH", "FUNDS", "later", "BR2"])), (day - datetime.timedelta(1), doc(["2026-07-02", "JURO11", "CASH", "FUNDS", "old", "BR0"])), (None, doc()), (day, None)], "day date, doc string")
    rows = B.bulletin_instruments(docs, "day", "doc")
    assert {(r["day"], r["name"], r["instrument_type"], r["isin"]) for r in rows.collect()} == {(day, "FI-INFRA JURO", "fi_infra", "BR1"), (day - datetime.timedelta(1), "old", "fund", "BR0")}
    at = {1: day, 2: day + datetime.timedelta(1), 3: day + datetime.timedelta(7), 4: day + datetime.timedelta(8)}
    asked = spark.createDataFrame([(n, " juro11", d) for n, d in at.items()] + [(5, "AAPL", day), (6, None, day)], "n int, ticker string, at date")
    got = {r["n"]: r["isin"] for r in B.latest_instruments(asked, rows, "ticker", "at").collect()}
    assert got == {1: "BR0", 2: "BR1", 3: "BR1", 4: None, 5: None, 6: None}
