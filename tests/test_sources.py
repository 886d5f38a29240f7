"""Readers over small archives built here; the values are those the source formats define."""

import datetime
import io
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.sources.archives import archive_lines
from tessera.sources.fixed_width import quotes
from tessera.sources.json_tables import monthly_series, value_table
from tessera.sources.statements import periods, registry, share_capital

HEADER = "CNPJ_CIA;DT_REFER;DT_RECEB;VERSAO;DENOM_CIA;CD_CVM;GRUPO_DFP;MOEDA;ESCALA_MOEDA;ORDEM_EXERC;DT_INI_EXERC;DT_FIM_EXERC;CD_CONTA;DS_CONTA;VL_CONTA;ST_CONTA_FIXA"


def row(code, value, label="Conta", order="ÚLTIMO", scale="MIL", version="1", received="2025-03-26", end="2024-12-31"):
    return f"11.111.111/0001-11;2024-12-31;{received};{version};EMPRESA TESTE S.A.;001;DF Consolidado;REAL;{scale};{order};2024-01-01;{end};{code};{label};{value};S"


@pytest.fixture
def archive(spark, tmp_path):
    def build(members):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, lines in members.items():
                z.writestr(name, "\n".join(lines).encode("latin-1"))
        (tmp_path / "a.zip").write_bytes(data.getvalue())
        (tmp_path / "b.zip").write_bytes(b"no archive")
        return archive_lines(spark, str(tmp_path), r"(?i).*\.(csv|txt)")

    return build


def test_periods(archive):
    lines = archive({
        "dfp_DRE_con_2024.csv": [HEADER, row("3.01", "1000.0000000000"), row("3.01", "5"), row("3.01", "7", order="PENÚLTIMO"), row("6.01", "-30", label="Depreciação e amortização"), row("6.02", "-40", label="Amortização"), row("3.99.01.01", "2780"), row("3.99.02.01", "2.78"), "ragged;row"],
        "dfp_DRE_ind_2024.csv": [HEADER, row("3.01", "1", scale="UNIDADE", version="9")],
        "dfp_2024.csv": ["CNPJ_CIA;DT_REFER;VERSAO;DENOM_CIA;CD_CVM;DT_RECEB", "11.111.111/0001-11;2024-12-31;1;X;001;2025-03-28"],
    })
    (got,) = periods(lines).collect()
    assert (got["company"], got["consolidated"], got["published_at"], got["depreciation"]) == ("11111111000111", True, datetime.date(2025, 3, 26), Decimal(30000))
    assert got["accounts"] == {"3.01": Decimal(1_000_000), "6.01": Decimal(-30000), "6.02": Decimal(-40000), "3.99.01.01": Decimal("2.78"), "3.99.02.01": Decimal("2.78")}
    (alone,) = periods(lines, prefer_consolidated=False).collect()
    assert not alone["consolidated"] and alone["accounts"] == {"3.01": Decimal(1)}


def test_publication_date_from_the_filing_member(archive):
    lines = archive({"dfp_DRE_con_2024.csv": [HEADER, row("3.01", "1", received="")], "dfp_2024.csv": ["CNPJ_CIA;DT_REFER;VERSAO;DENOM_CIA;CD_CVM;DT_RECEB", "11.111.111/0001-11;2024-12-31;1;X;001;2025-03-28"]})
    assert periods(lines).first()["published_at"] == datetime.date(2025, 3, 28)


@pytest.mark.parametrize(("rows", "total", "outstanding"), [(["2024-12-31;1;X;700;300;1000;0;0;100"], 1000, 900), (["2024-12-31;1;X;;;1250;0;0;50"], 1250, 1200), (["2023-12-31;1;X;500;0;500;0;0;0", "2024-12-31;1;X;800;0;800;0;0;0"], 800, 800), (["2024-12-31;1;X;100;0;100;0;0;500"], 100, 100)])
def test_share_capital(archive, rows, total, outstanding):
    header = "CNPJ_CIA;DT_REFER;VERSAO;DENOM_CIA;QT_ACAO_ORDIN_CAP_INTEGR;QT_ACAO_PREF_CAP_INTEGR;QT_ACAO_TOTAL_CAP_INTEGR;QT_ACAO_ORDIN_TESOURO;QT_ACAO_PREF_TESOURO;QT_ACAO_TOTAL_TESOURO"
    lines = archive({"dfp_composicao_capital_2024.csv": [header, *(f"11.111.111/0001-11;{r}" for r in rows)]})
    got = share_capital(lines.withColumn("text", F.col("text"))).first()
    assert (got["total"], got["outstanding"]) == (total, outstanding)


def test_registry(archive):
    lines = archive({"cad.csv": ["CNPJ_CIA;DENOM_SOCIAL;DENOM_COMERC;CD_CVM;SETOR_ATIV;SIT", "11.111.111/0001-11;A S.A.; ;001;Bancos;ATIVO", ";;;;;"]})
    (got,) = registry(lines).collect()
    assert (got["corporate_name"], got["trade_name"], got["sector"]) == ("A S.A.", None, "Bancos")


def test_quotes(archive):
    def line(ticker, market, price, factor, day="20200528"):
        return ("01" + day + "02" + ticker.ljust(12) + market).ljust(108) + f"{price:013d}".ljust(102) + f"{factor:07d}".ljust(35)

    lines = archive({"COTAHIST_A2020.TXT": ["00HEADER", line("AZUL4", "010", 1234, 1), line("AZUL4", "020", 9999, 1), line("LOTE3", "010", 150000, 1000), line("ZERO3", "010", 0, 1), line("BAD3", "010", 5, 1, "20201332")]})
    got = {r["ticker"]: (r["reference_date"], r["price"]) for r in quotes(lines).collect()}
    assert got == {"AZUL4": (datetime.date(2020, 5, 28), Decimal("12.34")), "LOTE3": (datetime.date(2020, 5, 28), Decimal("1.5"))}


def test_json_tables(spark):
    doc = '{"table": {"columns": [{"name": "TckrSymb"}, {"name": "ISIN"}], "values": [["JURO11", "BR1"], ["X", null]]}}'
    assert [(r["TckrSymb"], r["ISIN"], r["None"]) for r in value_table(spark.createDataFrame([(doc,)], "j string"), "j", ["TckrSymb", "ISIN", "None"]).collect()] == [("JURO11", "BR1", None), ("X", None, None)]
    series = spark.createDataFrame([('[{"data": "01/01/2024", "valor": "1,00"}, {"data": "01/02/2024", "valor": "2"}, {"data": "x", "valor": "3"}]',)], "j string")
    assert monthly_series(series, "j").agg(F.product(1 + F.col("value").cast("double")) - 1).first()[0] == pytest.approx(0.0302)


@pytest.mark.parametrize(("f", "text", "value"), [
    (X.br_decimal, "1.268.860.000", Decimal(1268860000)), (X.br_decimal, "42,74", Decimal("42.74")), (X.br_decimal, "-3,80%", Decimal("-3.80")), (X.br_decimal, "R$ 0,1044", Decimal("0.1044")), (X.br_decimal, "-", None), (X.br_decimal, "1e5", None), (X.br_decimal, "$ 40,12", Decimal("40.12")),
    (X.magnitude_decimal, "$ 40,12 Bilhões R$ 200,6 Bilhões", Decimal(40120000000)), (X.magnitude_decimal, "12,5 Mil", Decimal(12500)), (X.magnitude_decimal, "3,1 Milhões", Decimal(3100000)), (X.magnitude_decimal, "1 Trilhão", Decimal(10**12)),
    (X.br_date, "03/07/2026", datetime.date(2026, 7, 3)), (X.br_date, "03/07/85", datetime.date(1985, 7, 3)), (X.br_date, "3/7/24", datetime.date(2024, 7, 3)), (X.label_key, "Últ balanço processado", "ult_balanco_processado"), (X.null_like, "Indisponível", True),
    (X.name_tokens, "BCO do Brasil S.A.", ["BANCO", "BRASIL"]), (X.name_tokens, "CIA S/A", ["CIA", "SA"]),
])
def test_functions(spark, f, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0] == value


def test_inferred_by_label(spark):
    got = spark.createDataFrame([("10,5", "Cotação"), ("10,5", "Ações"), ("5% a.", "x"), ("5 %", "x")], "t string, l string").select(X.inferred(F.col("t"), F.col("l"))["value_type"]).collect()
    assert [r[0] for r in got] == ["money", "number", "text", "percent"]
