"""Fund archives and distributions on small members; the values are those the formats define."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.operators import distributions as D
from tessera.sources import fund_reports as S

DAY = datetime.date(2026, 6, 1)
MEMBERS = {
    "inf_mensal_fii_geral_2026.csv": ["CNPJ_Fundo_Classe;Data_Referencia;Nome_Fundo_Classe;Codigo_ISIN;Quantidade_Cotas_Emitidas;Data_Funcionamento;Segmento_Atuacao;Nome_Administrador", "07.583.627/0001-61;2026-06-01;PENINSULA FII;BRXPMLCTF000;100;2019-01-01;Tijolo;OLD ADMIN", "28.757.546/0001-00;2026-06-01;XP MALLS FII;BRXPMLCTF000;1;2017-12-15;Old;Old", '28.757.546/0001-00;2026-06-01;XP MALLS FII;BRXPMLCTF000;20000000;2017-12-15;"Shoppings; ""and"" more";XP ADMINISTRADORA', "", "1;2026-06-01"],
    "inf_mensal_fii_complemento_2026.csv": ["CNPJ_Fundo_Classe;Data_Referencia;Valor_Patrimonial_Cotas;Percentual_Dividend_Yield_Mes;Percentual_Rentabilidade_Patrimonial_Mes;Percentual_Rentabilidade_Efetiva_Mes;Patrimonio_Liquido;Total_Numero_Cotistas;Percentual_Despesas_Taxa_Administracao", "07.583.627/0001-61;2026-06-01;900,00;0,0010;0,0020;0,0030;90000;10;0,0009", "28.757.546/0001-00;2026-06-01;102,50;0,0095;0,0120;0,0140;2050000000;150000;0,0006", "28.757.546/0001-00;2026-05-01;0;;;;;;", "28.757.546/0001-00;x;5;;;;;;"],
    "inf_mensal_fii_ativo_passivo_2026.csv": ["CNPJ_Fundo_Classe;Data_Referencia;Total_Necessidades_Liquidez;Total_Investido;Valores_Receber;Total_Passivo;Direitos_Bens_Imoveis;Imoveis_Renda_Acabados;CRI;Disponibilidades;Titulos_Publicos", "28.757.546/0001-00;2026-06-01;75000000;2000000000;125000000;150000000;1800000000;1800000000;100000000;50000000;25000000"],
}


@pytest.fixture(scope="module")
def lines(spark):
    rows = [("a.zip", name, k, n, texts[0], text) for k, (name, texts) in enumerate(MEMBERS.items()) for n, text in enumerate(texts)]
    return spark.createDataFrame(rows, "archive string, member string, member_no int, line_no long, header string, text string")


def test_monthly_reports(spark, lines):
    general, complement, assets = S.quoted(S.first_member(lines, "geral"), S.GENERAL), S.quoted(S.first_member(lines, "complemento"), S.COMPLEMENT), S.quoted(S.first_member(lines, "ativo_passivo"), S.ASSETS)
    wanted = spark.createDataFrame([("XPML11", "BRXPMLCTF000", "XP MALLS FDO INV IMOB FII RESP LIM"), ("LEGACY", "brxpmlctf0XX", "Peninsula"), ("NONE11", "BROTHER00000", "x"), ("NULL11", None, None)], "ticker string, isin string, name string")
    assert {tuple(r) for r in S.matched_funds(general, wanted, "ticker", "isin", "name").collect()} == {("XPML11", "28757546000100"), ("LEGACY", "07583627000161")}
    rows = {r["fund"]: r for r in S.portfolio_shares(S.monthly_reports(complement, general, assets)).collect()}
    r = rows["28757546000100"]
    assert set(rows) == {"28757546000100", "07583627000161"} and r["as_of"] == DAY
    numbers = {"nav_per_share": "102.5", "monthly_distribution_yield": "0.0095", "monthly_nav_return": "0.012", "monthly_effective_return": "0.014", "net_assets": "2050000000", "issued_shares": "20000000", "shareholder_count": "150000", "administration_fee_ratio": "0.0072", "total_assets": "2200000000", "total_liabilities": "150000000", "property_assets": "1800000000", "credit_assets": "100000000", "liquid_assets": "75000000"}
    assert {k: Decimal(v) for k, v in numbers.items()} == {k: r[k] for k in numbers}
    assert (r["inception_date"], r["segment"], r["administrator"]) == (datetime.date(2017, 12, 15), 'Shoppings; "and" more', "XP ADMINISTRADORA")
    assert rows["07583627000161"]["total_assets"] is None and rows["07583627000161"]["property_share"] is None and float(r["credit_share"]) == pytest.approx(1 / 22)


def test_month_ends(spark):
    daily = spark.createDataFrame([("a", 0, k, *row) for k, row in enumerate([("1-1", "2026-07-01", "99"), ("1-1", "2026-07-24", "99,75"), ("1-1", "2026-07-24", "5"), ("1-1", "2026-07-30", "0"), ("1-1", "2026-08-02", "x"), (None, "2026-07-01", "1")])], "archive string, member_no int, line_no long, CNPJ_FUNDO_CLASSE string, DT_COMPTC string, VL_QUOTA string")
    assert [tuple(r) for r in S.month_ends(daily).collect()] == [("11", datetime.date(2026, 7, 24), Decimal("99.75"))]


def test_distributions(spark):
    days = [datetime.date(2024, 1, k) for k in (1, 2, 3)]
    events = spark.createDataFrame([("x", days[0], days[2], Decimal(1), "Dividendo", 1), ("x", None, days[1], Decimal(2), None, 2), ("x", days[2], None, Decimal(3), "Amortização", 3), ("x", days[2], None, Decimal(-1), "d", 4), ("x", None, None, Decimal(1), "d", 5), ("x", days[0], None, Decimal(7), "d", 6)], "k string, ex_date date, payment_date date, value decimal(10,2), kind string, n int")
    stated = spark.createDataFrame([("x", days[0], Decimal(9), 0), ("x", days[2], Decimal(4), 0)], "k string, ex_date date, value decimal(10,2), n int")
    got = {(r["ex_date"], r["value"], r["source"]) for r in D.merged_distributions(stated, events, ["k"], "n").collect()}
    assert got == {(days[0], 7, "events"), (days[1], 2, "events"), (days[2], 4, "stated")}
    at = F.lit("2024-01-02").cast("date")
    assert {p: sorted(r["n"] for r in D.in_period(events, p, at).collect()) for p in ("all", "past", "future", "upcoming_ex_date")} == {"all": [1, 2, 3, 4, 5, 6], "past": [2], "future": [1], "upcoming_ex_date": [3, 4]}


def test_agro_reports(spark):
    head = "CNPJ_Classe;Nome_Classe;Data_Referencia;Codigo_ISIN;Valor_Patrimonial_Cotas;Dividend_Yield_Mes;Rentabilidade_Patrimonial_Mes;Rentabilidade_Efetiva_Mes"
    texts = [head, "11.111.111/0001-11;AGRO UM;2026-06-01;BRAGRO000001;9,5;1,2;0,5;0,7", "11.111.111/0001-11;AGRO UM;2026-06-01;BRAGRO000001;10,5;1,1;;x", "22.222.222/0001-22;AGRO DOIS;2026-06-01;BRAGRO000009;0;1;1;1", "33.333.333/0001-33;OUTRO;x;BRAGRO000001;1;1;1;1"]
    members = {"inf_mensal_fiagro_subclasse_202606.csv": [head, "9;NO;2026-06-01;BRAGRO000001;1;1;1;1"], "inf_mensal_fiagro_202606.csv": texts}
    rows = [("a.zip", name, k, n, t[0], text) for k, (name, t) in enumerate(members.items()) for n, text in enumerate(t)]
    read = S.agro_rows(spark.createDataFrame(rows, "archive string, member string, member_no int, line_no long, header string, text string"))
    wanted = spark.createDataFrame([("AGRO11", "BRAGRO0000XX", "Agro Um")], "ticker string, isin string, name string")
    assert [tuple(r) for r in S.matched_funds(read, wanted, "ticker", "isin", "name").collect()] == [("AGRO11", "11111111000111")]
    (r,) = S.agro_reports(read).collect()
    assert (r["fund"], r["as_of"], r["nav_per_share"], r["monthly_distribution_yield"], r["monthly_nav_return"], r["monthly_effective_return"], r["net_assets"]) == ("11111111000111", DAY, Decimal("10.5"), Decimal("0.011"), None, None, None)
