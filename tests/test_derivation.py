"""Measures by rules, twelve months by alignment, and told values, on small statements."""

import datetime
import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.operators import derivation as D
from tessera.operators import provenance as V

ACCOUNTS = "k int, code string, label string, value decimal(20,4), place int"


def one(spark, *rows, sector=None, **more):
    table = spark.createDataFrame([(1, c, x, Decimal(v), n) for n, (c, x, v) in enumerate(rows)], ACCOUNTS)
    wide = D.measures(table, ["k"]).withColumn("sector", F.lit(sector).cast("string"))
    wide = wide.withColumns({"depreciation": F.lit(more.get("depreciation")).cast("double"), "stated_shares": F.lit(more.get("shares")).cast("double")})
    return D.derived(wide).first()


def test_industrial_figures(spark):
    rows = [("3.01", "Receita", "1000"), ("3.05", "EBIT", "200"), ("3.11", "Lucro", "90"), ("1.01.01", "Caixa", "50"), ("2.01.04", "E", "30"), ("2.02.01", "E", "70"), ("6.01", "Op", "120"), ("6.02", "Inv", "-40"), ("3.01", "again", "7")]
    got = one(spark, *rows, sector="Comércio", depreciation=25.0)
    wanted = {"revenue": 1000, "ebitda": 225, "gross_debt": 100, "net_debt": 50, "capex": 40, "free_cash_flow": 80, "cash_and_equivalents": 50, "gross_profit": None, "equity": None}
    assert {k: got[k] for k in wanted} == wanted
    bank = one(spark, *rows, sector="Intermediários Financeiros", depreciation=25.0)
    assert (bank["revenue"], bank["net_income"]) == (1000, 90) and all(bank[c] is None for c in ("ebit", "ebitda", "gross_debt", "net_debt", "capex", "free_cash_flow", "cash_and_equivalents", "depreciation"))


@pytest.mark.parametrize(
    ("rows", "income"),
    [
        ([("3.11", "Resultado", "5"), ("3.11.01", "Atribuído a Sócios da Empresa Controladora", "4")], 4),
        ([("3.11", "Resultado", "5"), ("3.11.01", "ATRIBUIDO A SOCIOS DA EMPRESA CONTROLADORA", "0")], 5),
        ([("3.11", "Resultado", "5"), ("7.08.04", "Atribuído a Sócios da Empresa Controladora", "4")], 5),
        ([("3.09", "Lucro/Prejuízo do Período", "3"), ("3.11.02", "Atribuído aos Sócios da Empresa Controladora", "2")], 2),
        ([("3.11", "Resultado", "0")], None),
        ([("3.11", "Lucro/Prejuízo do Período", "0")], 0),
        ([("30.11", "Lucro/Prejuízo do Período", "8")], None),
        ([("3.09", None, "3")], None),
    ],
)
def test_labels_before_codes_inside_their_group(spark, rows, income):
    assert one(spark, *rows)["net_income"] == income


def test_equity_of_own_holders_and_shares_by_earnings(spark):
    both = [("2.03", "Patrimônio Líquido Consolidado", "100"), ("2.03.09", "Participação dos Acionistas Não Controladores", "30")]
    assert one(spark, *both)["equity"] == 70
    assert one(spark, both[0], (*both[1][:2], "130"))["equity"] == 100
    eps = [("3.11", "x", "90"), ("3.99.01.01", "ON", "0"), ("3.99.01.02", "PN", "3")]
    assert one(spark, *eps)["shares_outstanding"] == 30 and one(spark, *eps, shares=12.0)["shares_outstanding"] == 12 and one(spark, *eps, shares=0.0)["shares_outstanding"] == 30
    assert one(spark, ("3.11", "x", "-90"), eps[2])["shares_outstanding"] is None


FIGURES = ", ".join(f"{c} double" for c in (*D.FLOWS, *D.BALANCES))


def periods(spark, *rows):
    """rows: company, end, annual, published, flow, balance."""
    day = datetime.date.fromisoformat
    table = [(k, day(end), annual, day(told) if told else None, *[flow] * len(D.FLOWS), *[balance] * len(D.BALANCES)) for k, end, annual, told, flow, balance in rows]
    return spark.createDataFrame(table, f"k int, period_end date, annual boolean, published_at date, {FIGURES}")


def test_twelve_months(spark):
    rows = [
        (1, "2023-03-31", False, "2023-05-01", 10.0, 1.0), (1, "2023-12-31", True, "2024-03-01", 50.0, 2.0), (1, "2024-03-31", False, "2024-05-01", 14.0, 3.0), (1, "2024-06-30", False, "2024-08-01", 30.0, 4.0),
        (2, "2024-02-29", False, None, 5.0, 1.0), (2, "2023-12-31", True, None, 9.0, 1.0), (2, "2023-02-28", False, None, 4.0, 1.0), (2, "2025-02-28", False, "2025-03-01", 6.0, 7.0), (2, "2024-12-31", True, "2025-02-01", 9.0, 1.0),
        (3, "2022-03-31", False, "2022-05-01", 1.0, 1.0), (3, "2024-03-31", False, "2024-05-01", 1.0, 1.0), (3, "2023-12-31", True, "2024-01-01", 1.0, 1.0),
        (4, "2023-12-31", True, "2024-03-01", 8.0, 1.0), (5, "2024-03-31", False, "2024-03-01", 8.0, 1.0), (6, "2023-12-31", False, "2024-01-01", 3.0, 1.0), (6, "2024-12-31", True, "2025-01-01", 4.0, 1.0),
        (7, "2023-03-31", False, "2023-05-01", 2.0, 1.0), (7, "2023-12-31", True, None, 6.0, 1.0), (7, "2024-03-31", False, "2024-05-01", None, 3.0),
    ]
    got = {(r["k"], str(r["period_end"])): (r["basis"], r["revenue"], r["equity"], r["published_at"] and str(r["published_at"])) for r in D.trailing_periods(periods(spark, *rows), "k").collect()}
    assert got[1, "2024-03-31"] == ("trailing", 54.0, 3.0, "2024-05-01") and got[1, "2023-12-31"] == ("annual", 50.0, 2.0, "2024-03-01")
    assert got[1, "2024-06-30"][0] == "no comparable" and got[1, "2023-03-31"] == ("no year", None, None, None)
    assert got[2, "2024-02-29"][0] == "no comparable" and got[2, "2025-02-28"][0] == "no comparable"
    assert got[3, "2024-03-31"][0] == "no comparable" and got[5, "2024-03-31"][0] == "no year" and got[4, "2023-12-31"][0] == "annual"
    assert got[6, "2024-12-31"][1] == 4.0 and got[7, "2024-03-31"] == ("trailing", None, 3.0, None)
    last = {r["k"]: r["basis"] for r in D.latest_trailing(periods(spark, *rows), "k").collect()}
    assert last == {1: "no comparable", 2: "no comparable", 3: "no comparable", 4: "annual", 5: "no year", 6: "annual", 7: "trailing"}
    assert D.trailing_periods(periods(spark), "k").count() == 0


def test_twelve_months_of_random_companies(spark):
    rng = random.Random(3)
    ends = [f"{y}-{md}" for y in range(2018, 2025) for md in ("03-31", "06-30", "09-30", "12-31")]
    rows = [(k, end, end.endswith("12-31") and rng.random() < 0.8, None, float(rng.randint(1, 99)), 1.0) for k in range(60) for end in ends if rng.random() < 0.7]
    own = {(k, end): (annual, flow) for k, end, annual, _, flow, _ in rows}
    for r in D.trailing_periods(periods(spark, *rows), "k").collect():
        k, end = r["k"], str(r["period_end"])
        annual, flow = own[k, end]
        years = [e for (c, e), (a, _) in own.items() if c == k and a and e < end]
        before = own.get((k, f"{int(end[:4]) - 1}{end[4:]}"))
        if annual:
            assert r["revenue"] == flow
        elif years and before and not before[0]:
            assert r["revenue"] == flow + own[k, max(years)][1] - before[1]
        else:
            assert r["revenue"] is None and r["basis"].startswith("no ")


def test_one_period_an_end(spark):
    rows = spark.createDataFrame([(1, "a", False, 0), (1, "a", True, 1), (1, "a", True, 2), (1, "b", False, 4), (1, "b", False, 3), (2, "a", False, 5)], "k int, period_end string, consolidated boolean, n int")
    assert sorted(r["n"] for r in D.unique_periods(rows, "k", F.col("n")).collect()) == [1, 3, 5]


def test_told_values_merge_in_any_order_and_grouping(spark):
    rng = random.Random(1)
    values = [(k, rng.choice([None, 1.0, 2.0]), rng.choice(["a", "b", "c"]), rng.randint(0, 2)) for k in range(30)]
    table = spark.createDataFrame(values, "n int, value double, source string, rank int")
    each = table.select("n", F.when(F.col("rank") == 0, V.told(F.col("value"), F.col("source"), 0)).when(F.col("rank") == 1, V.told(F.col("value"), F.col("source"), 1)).otherwise(V.told(F.col("value"), F.col("source"), 2)).alias("told"))
    whole = V.merged(each.withColumn("g", F.lit(0)), ["g"]).first()
    for parts in (2, 3, 7):
        halves = V.merged(each.withColumn("g", F.col("n") % parts), ["g"]).select(F.lit(0).alias("g"), "told")
        assert V.merged(halves, ["g"]).first()["told"] == whole["told"]
    present = min((rank, source, value) for _, value, source, rank in values if value is not None)
    assert (whole["told"]["rank"], whole["told"]["source"], whole["told"]["value"]) == present and not whole["told"]["missing"]
    a, b, c = (V.told(F.lit(x).cast("double"), s, r) for x, s, r in ((None, "a", 0), (5, "b", 2), (6, "c", 1)))
    found = {tuple(spark.range(1).select(V.prefer(*p).alias("t")).first()["t"]) for p in itertools.permutations((a, b, c))}
    assert found == {(False, 1, "c", 6.0, 1.0, None)}


@pytest.mark.parametrize(("args", "shares"), [((100, 2, 300, 6), 50), ((100, 2, 300, 5.5), (50 + 300 / 5.5) / 2), ((100, 2, 300, 3), 50), ((-1, 2, 300, 3), 100), ((100, None, None, 3), None), ((100, 2, 300, 0), 50)])
def test_implied_shares(spark, args, shares):
    assert spark.range(1).select(V.implied_shares(*(F.lit(x).cast("double") for x in args)).alias("x")).first()["x"] == (None if shares is None else pytest.approx(shares))


@pytest.mark.parametrize(("reported", "reference", "factor"), [(1000, 1020, 1), (1000, 1.05, 0.001), (1000, 1_050_000, 1000), (1000, 1200, 1), (1000, 500_000, 1), (0, 5, 1), (5, None, 1), (None, 5, 1)])
def test_unit_factor(spark, reported, reference, factor):
    assert spark.range(1).select(V.unit_factor(F.lit(reported).cast("double"), F.lit(reference).cast("double")).alias("x")).first()["x"] == factor


def test_history_on_the_basis_of_the_last_year(spark):
    rows = [("a", 2018, 100.0), ("a", 2019, 205.0), ("a", 2021, 210.0), ("a", 2022, 21.0), ("b", 2020, 0.0), ("b", 2021, 7.0), ("c", 2020, 100.0), ("c", 2021, 130.0)]
    got = {(r["k"], r["yr"]): r["shares"] for r in V.split_normalised(spark.createDataFrame(rows, "k string, yr int, shares double"), "k", "yr", "shares").collect()}
    assert got == pytest.approx({("a", 2018): 20.0, ("a", 2019): 20.5, ("a", 2021): 21.0, ("a", 2022): 21.0, ("b", 2020): 0.0, ("b", 2021): 7.0, ("c", 2020): 100.0, ("c", 2021): 130.0})


def test_snapshot_prefers_implies_and_scales(spark):
    flows = {c: 100.0 for c in (*D.FLOWS, *D.BALANCES)}
    def company(k, **more):
        base = {"k": k, "period_end": datetime.date(2024, 12, 31), "basis": "annual", "match": "high", "market_shares": None, "capital_shares": None, "earnings_per_share": None, "book_value_per_share": None, "dividends_per_share": None, "public_source": "page"}
        return {**base, **flows, **more}

    schema = f"k int, period_end date, basis string, match string, market_shares double, capital_shares double, earnings_per_share double, book_value_per_share double, dividends_per_share double, public_source string, {FIGURES}"
    rows = [company(1, market_shares=7.0, capital_shares=7000.0), company(2, earnings_per_share=2.0, capital_shares=9.0), company(3, capital_shares=9.0, match="medium"), company(4, basis="no year", **{c: None for c in flows})]
    got = {(r["k"], r["field"]): (r["value"], r["source"], r["confidence"], r["status"], r["reason"]) for r in V.snapshot(spark.createDataFrame(rows, schema), ["k"]).collect()}
    assert len(got) == 4 * 11
    assert got[1, "shares_outstanding"] == (7.0, "market", 0.95, "valid", None) and got[2, "shares_outstanding"] == (50.0, "implied", 0.95, "valid", None)
    assert got[3, "shares_outstanding"] == (9.0, "statements", 0.8, "valid", None) and got[4, "revenue_ttm"] == (None, None, 0.0, "missing", "no year")
    assert got[1, "earnings_per_share"] == (None, None, 0.0, "missing", "not published") and got[2, "earnings_per_share"][1] == "page"
