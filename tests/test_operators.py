"""Functions and operators on small hand-written rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import text as X
from tessera.operators import frames as R
from tessera.operators.matching import company_match, institution_match
from tessera.operators.search import merge_directories


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (X.br_decimal, "R$ 1.234,50", Decimal("1234.5")), (X.br_decimal, "12,5%", Decimal("12.5")), (X.br_decimal, "n/d", None), (X.plain_decimal, " 1.5 ", Decimal("1.5")), (X.comma_decimal, "1,5", Decimal("1.5")),
        (X.magnitude_decimal, "2.5B", Decimal("2500000000")), (X.magnitude_decimal, "(3 M)", Decimal("-3000000")), (X.br_date, "3/2/2024", "2024-02-03"), (X.br_date, "x", None), (X.iso_date, "2024-02-03T00:00", "2024-02-03"), (X.header_date, "Dec 31, 2023", "2023-12-31"),
        (X.period_date, "202402", "2024-02-01"), (X.label_key, "Patrimônio Líquido (R$)", "patrimonio_liquido_r"), (X.label_key, "***", "campo"), (X.fold, "ação", "ACAO"), (X.squeeze, " a \n b ", "a b"), (X.null_like, " N/D ", True), (X.digits, "12.3-4", "1234"),
        (X.ticker, " petr4 ", "PETR4"), (X.ticker, "a b", None), (X.market, "PETR4", "b3"), (X.market, "AAPL", "foreign"), (X.market, "", "unknown"),
    ],
)
def test_text(spark, function, given, wanted):
    got = spark.createDataFrame([(given,)], "t string").select(function(F.col("t"))).first()[0]
    assert (str(got) if hasattr(got, "isoformat") else got) == wanted


def test_division_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, -2.0), (1.0, 4.0), (None, 4.0), (1.0, None)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = df.select(N.ratio_positive(a, b), N.ratio_nonzero(a, b), N.sum_any(a, b), N.minus_optional(a, b)).collect()
    assert [tuple(r) for r in got] == [(None, None, 1.0, 1.0), (None, -0.5, -1.0, 3.0), (0.25, 0.25, 5.0, -3.0), (None, None, 4.0, None), (None, None, 1.0, 1.0)]


def test_asof_takes_the_latest_at_or_before(spark):
    targets = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3)], "k string, at int, id int")
    series = spark.createDataFrame([("a", 2, 20.0), ("a", 5, 50.0), ("a", 6, 60.0)], "k string, t int, v double")
    got = {r["id"]: (r["matched_at"], r["v"]) for r in R.asof_latest(targets, series, ["k"], "at", "t", ["v"]).collect()}
    assert got == {1: (5, 50.0), 2: (None, None), 3: (None, None)}


def test_frames(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 5.0), ("a", 3, 20.0)], "k string, t int, v double")
    assert [r["drawdown"] for r in R.with_drawdown(df, ["k"], [F.col("t").asc()], "v").orderBy("t").collect()] == [0.0, 0.5, 0.0]
    assert [r["later"] for r in R.reverse_product(df, ["k"], [F.col("t").asc()], "v", "later").orderBy("t").collect()] == [100.0, 20.0, 1.0]
    assert [r["t"] for r in R.last_n(df, ["k"], [F.col("t").desc()], 2).orderBy("t").collect()] == [2, 3]


def test_matching_rejects_ambiguity(spark):
    left = spark.createDataFrame([(1, "Banco Alfa S.A."), (2, "Beta Energia"), (3, "Gama")], "l int, name string")
    right = spark.createDataFrame([(10, "BANCO ALFA"), (20, "Beta Energia Participacoes"), (21, "Beta Energia Holding"), (30, "Delta")], "r int, name string")
    assert {tuple(r) for r in company_match(left, right, "l", "r", "name").collect()} == {(1, 10, 1)}
    best = {r["l"]: r["r"] for r in institution_match(left, right, "l", "r", "name").collect()}
    assert best[1] == 10 and best[2] in (20, 21) and 3 not in best


def test_merge_directories_prefers_confidence(spark):
    rows = spark.createDataFrame([("X", 1, "low", "old", None), ("X", 2, "high", None, "tech"), ("Y", 3, "medium", "y", None)], "k string, pos int, confidence string, name string, sector string")
    got = {r["k"]: (r["name"], r["sector"]) for r in merge_directories(rows, ["k"], "pos", "confidence").collect()}
    assert got == {"X": ("old", "tech"), "Y": ("y", None)}


def test_company_tiers(spark):
    left = spark.createDataFrame([(1, "Grupo Alfa S.A."), (2, "Beta Energia Sul"), (3, "Gama Minas Norte"), (4, "Delta Sul"), (5, "Delta"), (6, None), (7, "Zeta Energia Holding"), (8, "Eta Rio Mar")], "l int, name string")
    right = spark.createDataFrame([(10, "Alfa Participacoes"), (20, "Beta Energia Sul Leste"), (21, "Beta Energia"), (30, "Gama Minas"), (31, "Gama Minas Ltda"), (40, "Sul"), (41, "Delta"), (42, "Delta SA"), (70, "Zeta Energia Grupo"), (80, "Eta Rio Mar Leste"), (81, "Eta Mar"), (82, "Energia Sul Norte"), (90, None)], "r int, name string")
    # 2 shares most with 20; 3 meets two equal names; 4 shares a token only; 5 has two exact ones; 8 shares three with 80, two with 81
    assert {tuple(r) for r in company_match(left, right, "l", "r", "name").collect()} == {(1, 10, 2), (2, 20, 3), (7, 70, 2), (8, 80, 3)}


def test_exact_median(spark):
    rows = [("a", float(k * 7919 % 30011)) for k in range(30011)] + [("b", 1.0), ("b", 4.0), ("c", None), (None, 3.0)] + [("d", 5.0)] * 2000 + [("d", float(k)) for k in range(100)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: (r["n"], r["m"]) for r in R.exact_median(df, ["k"], "v", "m").collect()}
    assert got == {"a": (30011, 15005.0), "b": (2, 2.5), None: (1, 3.0), "d": (2100, 5.0)}
    even = spark.createDataFrame([("a", float(k)) for k in range(50000)], "k string, v double")
    assert R.exact_median(even, ["k"], "v", "m").first()["m"] == 24999.5


def test_institution_scores(spark):
    left = spark.createDataFrame([(1, "Bco Alfa S.A."), (2, "bco alfa s.a."), (3, "Caixa"), (4, None), (5, "Banco Gama")], "l int, name string")
    right = spark.createDataFrame([(9, "BANCO ALFA S.A."), (8, "Banco Alfa S.A."), (7, "Banco Beta"), (6, None)], "r int, name string")
    got = {r["l"]: (r["r"], r["score"]) for r in institution_match(left, right, "l", "r", "name").collect()}
    assert got[1] == got[2] == (8, 1.0) and set(got) == {1, 2, 5} and got[5][0] == 7
