"""All facts of companies against plain Python on made-up companies, and the cases that have none."""

import datetime
import random
import statistics

import pytest

from tessera.operators import company_facts as C
from tessera.operators.distributions import dividend_facts

NAMES = "revenue gross_profit ebit ebitda net_income equity total_assets operating_cash_flow free_cash_flow net_debt gross_debt current_assets current_liabilities financial_result shares public_eps public_bvps".split()
LATEST = "k long, period_end date, " + ", ".join(f"{n} double" for n in NAMES)
SECTORS, MARKET = "k long, sector string, name string", "k long, traded_value double, market_capitalization double, as_of date, source string"
BANKS = "k long, basel_ratio double, core_capital_ratio double, regulatory_leverage_ratio double, high_risk_credit_ratio double, capital_as_of date, credit_as_of date"
PAID, EARNED, MACRO = "k long, ex_date date, value double, source string", "k long, period_end date, net_income double, shares_outstanding double", "yr int, inflation double, selic double"
END = datetime.date(2020, 12, 31)


def table(spark, latest, sectors=(), market=(), banks=(), paid=(), annual=None, macro=()):
    frame = spark.createDataFrame(list(latest), LATEST)
    years = frame if annual is None else spark.createDataFrame(list(annual), LATEST)
    dividends = dividend_facts(spark.createDataFrame(list(paid), PAID), spark.createDataFrame([], EARNED), "k")
    return C.company_facts(frame, years, spark.createDataFrame(list(macro), MACRO), "k", sectors=spark.createDataFrame(list(sectors), SECTORS), market=spark.createDataFrame(list(market), MARKET), dividends=dividends, banks=spark.createDataFrame(list(banks), BANKS))


def row(k, **given):
    return (k, END, *(given.get(n) for n in NAMES))


def test_peers_count_the_company_and_profiles_cross_sectors(spark):
    dice = random.Random(1)
    sectors = [(k, dice.choice(["A", "A", "B", "", None]), dice.choice(["Banco", "Seguros", "Obras"])) for k in range(80)]
    some = lambda *values: dice.choice(values)
    latest = {k: {"net_income": some(None, -5.0, dice.random()), "equity": some(-1.0, 0.0, None, 2.0 + dice.random(), 3.0), "total_assets": some(None, 0.0, 9.0 + k), "revenue": some(None, -3.0, 10.0 + k, 50.0)} for k in range(80)}
    got = {(r["k"], r["fact"]): (r["profile"], r["value"], r["reason"]) for r in table(spark, [row(k, **v) for k, v in latest.items()], sectors).collect()}
    kind = {k: {"Banco": "bank", "Seguros": "insurer"}.get(name, "industrial") for k, _, name in sectors}
    place = {k: sector or "" for k, sector, _ in sectors}
    base = [k for k in latest if (latest[k]["equity"] or 0) > 0 and place[k]]
    ratio = lambda a, b: a / b if a is not None and b else None
    for k in latest:
        peers = [x for x in base if (kind[x] == kind[k] if kind[k] in C.OWN_PROFILE else place[x] == place[k])]
        for fact, (a, b) in C.COMPARED.items():
            sample = [v for v in (ratio(latest[x][a], latest[x][b]) for x in peers) if v is not None and v > 0]
            wanted = ratio(ratio(latest[k][a], latest[k][b]), statistics.median(sample) if len(sample) >= 3 else None)
            out = wanted is not None and not -10 <= wanted <= 20
            why = "fewer than 3 positive peers" if len(sample) < 3 else C.NOT_STATED if wanted is None else C.IMPLAUSIBLE if out else None
            assert got[k, fact] == (kind[k], pytest.approx(wanted) if why is None else None, why)
        total = sum(latest[x]["revenue"] for x in peers if (latest[x]["revenue"] or 0) > 0)
        share = ratio(latest[k]["revenue"], total) if len(peers) >= 3 else None
        assert got[k, "listed_sector_revenue_share"][1] == (pytest.approx(share) if share is not None and 0 <= share <= 1 else None)


def test_every_company_has_each_fact_once_with_its_reason(spark):
    whole = dict.fromkeys(NAMES, 10.0) | {"revenue": 100.0, "financial_result": -2.0, "gross_profit": 500.0}
    years = [(1, datetime.date(y, 12, 31), *((whole | {"revenue": 100.0 * 1.1 ** (y - 2015), "shares": 10.0})[n] for n in NAMES)) for y in range(2015, 2021)]
    banks = [(1, 0.15, 1.2, None, 0.1, END, datetime.date(2020, 9, 30)), (3, 0.15, 0.1, 0.1, 0.1, END, END)]
    found = table(
        spark, [row(1, **whole), row(2), row(3, **whole), row(None, **whole)], [(1, "A", "Banco X"), (2, "A", "Bco Y"), (3, "A", "Obras")], [(1, 5.0, None, END, "quotes")], banks,
        [(1, datetime.date(2019, 5, 1), 1.0, "x"), (1, datetime.date(2020, 5, 1), 0.0, "y"), (3, END, -1.0, "x")], years, [(y, 0.1, 0.05) for y in (2017, 2018, 2018, 2020)],
    )
    rows = found.collect()
    got = {(r["k"], r["fact"]): r for r in rows}
    assert len(rows) == len(got) == 3 * 48
    assert (got[1, "gross_margin"]["reason"], got[1, "net_margin"]["value"], got[1, "net_margin"]["as_of"], got[1, "free_cash_flow_margin"]["confidence"]) == (C.IMPLAUSIBLE, 0.1, END, 0.65)
    # Prices rise in 2017, 2018 and 2020 alone, revenue in every year from 2016 on.
    assert got[1, "revenue_real_cagr"]["value"] == pytest.approx((1.1**4 / 1.1**3) ** (365.25 / 1461) - 1) and got[1, "revenue_real_cagr"]["source"] == "statements,rates"
    assert got[1, "roe_vs_selic_spread"]["value"] == pytest.approx(0.95) and got[3, "revenue_cagr"]["reason"] == "fewer than 3 observations"
    assert (got[1, "basel_ratio"]["value"], got[1, "core_capital_ratio"]["reason"], got[1, "regulatory_leverage_ratio"]["reason"], got[3, "basel_ratio"]["reason"], got[2, "basel_ratio"]["reason"]) == (0.15, C.IMPLAUSIBLE, C.NOT_STATED, C.NO_BANK, C.NO_BANK)
    assert (got[1, "daily_traded_value"]["value"], got[1, "market_capitalization"]["reason"], got[2, "daily_traded_value"]["reason"]) == (5.0, C.NOT_STATED, C.NOT_STATED)
    assert (got[1, "dividend_history_years"]["value"], got[1, "dividend_payment_frequency"]["value"], got[1, "dividend_history_years"]["source"]) == (2.0, 0.5, "x,y")
    assert {got[k, f]["reason"] for k in (2, 3) for f in C.DIVIDENDS} == {"no distributions"} and {r["status"] for r in rows if r["k"] == 2} == {"missing"}
    for r in rows:
        valid = r["status"] == "valid"
        assert (r["value"] is not None, r["confidence"] > 0, r["source"] is not None, r["reason"] is None) == (valid,) * 4, r
    told = {r["k"]: r for r in C.company_summary(found, "k").collect()}
    assert told[1]["sources"] == ["bank reports", "pages", "quotes", "rates", "statements", "x", "y"] and told[1]["known"] + told[1]["missing"] == 48 and told[1]["least_confidence"] == 0.65
    assert told[1]["warnings"] == [f"{f}: {C.IMPLAUSIBLE}" for f in ("core_capital_ratio", "gross_margin")] and told[2]["warnings"] == [C.NO_CAPITAL] and (told[2]["sources"], told[2]["least_confidence"]) == (["statements"], None)


def test_no_companies(spark):
    found = table(spark, [])
    assert found.count() == 0 and C.company_summary(found, "k").count() == 0


def test_fixed_lists_name_known_facts(spark):
    names = {r["fact"] for r in table(spark, [row(1)]).collect()}
    assert len(names) == 48 and set(C.RANGES) <= names
