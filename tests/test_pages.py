"""Pages and price files: the values that their formats define."""

import datetime
from decimal import Decimal

from tessera.sources import company_pages as C
from tessera.sources import prices as P
from tessera.sources import statement_pages as S
from tessera.sources.html import _listed, elements, shown, tables

DAY = datetime.date


def pages(spark, *html):
    return spark.createDataFrame([(n, h) for n, h in enumerate(html)], "page long, html string")


def number(value):
    return None if value is None else Decimal(value).normalize()


def test_elements(spark):
    rows = _listed("<table><tr><td>a<td>b<tr><th>c<table><tr><td>in</table>d</table><br>e<script>if (a<b) x</script>")
    tags = [r["tag"] for r in rows]
    assert tags == ["table", "tr", "td", "#text", "td", "#text", "tr", "th", "#text", "table", "tr", "td", "#text", "#text", "br", "#text", "script"]
    assert [r["row"] for r in rows if r["tag"] in ("td", "th")] == [1, 1, 6, 10] and rows[7]["last"] == 13 and rows[9]["table"] == 0 and rows[11]["table"] == 9
    from pyspark.sql import functions as F

    read = elements(pages(spark, "<p>a &amp; b", None, ""), "html").select("page", F.size("elements").alias("n"), shown(F.get("elements", F.lit(0))).alias("text"), tables(lambda e: F.lit(True)).alias("t")).orderBy("page").collect()
    assert [(r["n"], r["text"], r["t"]) for r in read] == [(2, "a & b", []), (0, None, []), (0, None, [])]


DETAILS = """<!-- detalhes.php --><table class="w728">
  <tr><td class="label"><span class="txt">Papel</span></td><td class="data"><span class="txt">test3</span></td><td class="label"><span class="help">?</span><span class="txt">Cotação</span></td><td class="data">42,74</td></tr>
  <tr><td class="label">Tipo</td><td class="data">-</td><td class="label">Alone</td><td class="label">Data últ cot</td><td class="data">03/07/2026</td></tr></table>
<table class="w728 b"><tr><td class="nivel1" colspan="2">Oscilações</td><td class="nivel1" colspan="4">Indicadores</td></tr>
  <tr><td colspan="2" class="x"></td><td class="nivel2" colspan="2">Últ 12</td><td class="nivel2" colspan="2">Últ 3</td></tr>
  <tr><td class="label">Dia</td><td class="data">-3,80%</td><td class="label">LPA</td><td class="data">1,5</td><td class="label">VPA</td><td class="data">2</td></tr>
  <tr><td class="nivel1" colspan="6">Outros</td></tr><tr><td class="label">Fim</td><td class="data">x</td><td class="label"></td><td class="data">9</td></tr></table>
<table class="other"><tr><td class="label">No</td><td class="data">1</td></tr></table>"""


def test_details(spark):
    fields = C.detail_fields(pages(spark, DETAILS, DETAILS.replace("detalhes", ""), None), "page", "html")
    got = {r["label"]: r for r in fields.collect()}
    assert {k: v["section"] for k, v in got.items()} == {"Papel": "Identity", "Cotação": "Identity", "Tipo": "Identity", "Data últ cot": "Identity", "Dia": "Oscilações", "LPA": "Indicadores - Últ 12", "VPA": "Indicadores - Últ 3", "Fim": "Outros"}
    assert (got["Cotação"]["value_type"], number(got["Dia"]["value_decimal"]), got["Dia"]["value_type"], got["Tipo"]["value_type"]) == ("money", Decimal("-3.8"), "percent", "null")
    (one,) = C.company_details(fields, "page").collect()
    assert (one["ticker"], number(one["quote"]), one["quote_date"], one["asset_type"], number(one["earnings_per_share"]), one["sector"]) == ("TEST3", Decimal("42.74"), DAY(2026, 7, 3), None, Decimal("1.5"), None)


def test_payments(spark):
    row = "<tr><td>{}</td><td>{}</td><td>{}</td><td>{}</td></tr>"
    fund = "<p>proventos</p><table id=resultado><thead><tr><th>Última Data Com</th><th>Tipo</th><th>Data de Pagamento</th><th>Valor</th></tr></thead><tbody>" + row.format("30/06/2026", "Rendimento", "14/07/2026", "0,10") + row.format("31/05/2026", "", "-", "R$ 0,1044") + "<tr><td>short</td></tr></tbody></table>"
    share = "Proventos <table id='resultado'><tr><td>01/02/2025</td><td>1,5</td><td>JCP</td><td>02/03/2025</td><td>1</td></tr></table><table id='resultado'><tr><td>a<td>b<td>c<td>d</table>"
    got = C.payments(pages(spark, fund, share, "<table id=resultado></table>"), "page", "html").orderBy("page", "place").collect()
    assert [(r["page"], r["ex_date"], r["payment_date"], number(r["value"]), r["type"], number(r["shares_ratio"])) for r in got] == [(0, DAY(2026, 6, 30), DAY(2026, 7, 14), Decimal("0.1"), "Rendimento", None), (0, DAY(2026, 5, 31), None, Decimal("0.1044"), None, None), (1, DAY(2025, 2, 1), DAY(2025, 3, 2), Decimal("1.5"), "JCP", 1)]
    assert got[1]["raw"]["payment_date"] == "-"


def test_profiles(spark):
    html = """<div title="Valor atual do ativo"><strong class="value">97,89</strong></div><div title="Valor mínimo das últimas 52 semanas"><i></i><span class="sub-value">R$ 87,93</span></div>
      <div title="Valor atual do ativo"><strong class="value">-</strong></div><div><div><h3 data-key="P_L">P/L</h3></div><div><strong class="v value">4,00</strong></div></div>
      <div><h3 class="title">CNPJ</h3><strong class="value">11.111.111/0001-11</strong></div>
      <div id="earning-section"><input id="results" value='[{"et":"Rendimento","ed":"10/06/2026","v":0.1},{"et":"RENDIMENTO","ed":"x","v":1},{"et":"Amortização","ed":"10/05/2026","v":2},{"et":"Rendimento","ed":"09/05/2026","v":0}]'></div>"""
    docs = pages(spark, html, "", None)
    got = C.profiles(docs, "page", "html").orderBy("page").collect()
    assert [number(got[0][c]) for c in ("current_price", "min_52_weeks", "max_52_weeks", "price_to_earnings", "price_to_book")] == [Decimal("97.89"), Decimal("87.93"), None, 4, None]
    assert got[0]["fund"] == "11111111000111" and len(got) == 3 and got[1]["fund"] is None
    assert {(r["ex_date"], number(r["value"])) for r in C.embedded_distributions(docs, "page", "html").collect()} == {(DAY(2026, 6, 10), Decimal("0.1")), (DAY(2026, 5, 9), 0)}


def test_statement_pages(spark):
    script = 'x data:{datekey:["2024-12-31","2023-12-31"],revenue:[200,100.5],gp:[1],opinc:[],netinccmn:[20,-],epsdil:[2,1]} y'
    table = "<table><tr><th>Period Ending</th><th>Dec 31, 2024</th><th><div>Dec 31, 2023</div></th><th>TTM</th></tr><tr><td>Operating  Cash Flow</td><td>1,234.5</td><td>-</td><td>9</td></tr></table>"
    balance = "<h3>Ativos</h3><b class='value'>no</b><h3 class=a>Patrimônio Líquido</h3><strong class=\"x value\"> 1.234,50 </strong>" + "<h3>Valor de mercado</h3>" + " " * 900 + '<i class="value">5</i>'
    reit = '<div class="cell"><span class="name">Ativos</span><div class="value"><span>$ 40,12 Bilhões R$ 40.123.970.000</span></div></div><div class="cell"><span class="name">Outro</span></div>'
    docs = pages(spark, script + table + balance + reit, table.replace("Period", "No"), reit)
    income = S.annual_income(docs, "page", "html")
    assert [(r["period_end"], number(r["revenue"]), number(r["gross_profit"]), r["ebit"], number(r["net_income"])) for r in income.orderBy("period_end").collect()] == [(DAY(2023, 12, 31), Decimal("100.5"), None, None, None), (DAY(2024, 12, 31), 200, 1, None, 20)]
    cash = S.operating_cash_flow(docs, "page", "html")
    assert [(r["page"], r["period_end"], number(r["operating_cash_flow"])) for r in cash.collect()] == [(0, DAY(2024, 12, 31), Decimal("1234500000").normalize())]
    balances, totals = S.labelled_balances(docs, "page", "html"), S.listed_totals(docs, "page", "html")
    assert [(number(r["equity"]), number(r["total_assets"]), r["market_capitalization"]) for r in balances.orderBy("page").collect()] == [(Decimal("1234.5"), Decimal("1234.5"), None), (None, None, None), (None, None, None)]
    assert [number(r["total_assets"]) for r in totals.orderBy("page").collect()] == [Decimal("40120000000").normalize(), None, Decimal("40120000000").normalize()]
    last = S.page_statements(income, cash, balances, totals, "page").orderBy("period_end").collect()[-1]
    assert (number(last["equity"]), number(last["operating_cash_flow"]), len(last)) == (Decimal("1234.5"), Decimal("1234500000").normalize(), 15)


def test_prices(spark, tmp_path):
    from tessera.sources.archives import text_lines

    (tmp_path / "db.txt").write_bytes("Preamble\n\nCódigo@Nome@PU@Fim\nabcd11@X@1.064,248862@\nABCD11 @X@2,5@\nNONE@X@--@\nND@X@N/D@\nBAD@X@invalid@\nZERO@X@0@\nSHORT\n".encode("latin-1"))
    file = P.debenture_prices(text_lines(spark, str(tmp_path)))
    assert [(r["identifier"], number(r["price"])) for r in file.collect()] == [("ABCD11", Decimal("2.5"))]
    head = "<tr><th>Data de Referência</th><th>Código</th><th>PU</th></tr>"
    html = f"<table class='custom-anbi-ui-table'><tr><th>Other</th></tr></table><table class='a custom-anbi-ui-table'>{head}<tr><td>03/07/2026</td><td> cra1 </td><td>1.039,26916663</td></tr><tr><td>x</td><td>A</td><td>1</td></tr><tr><td>02/07/2026</td><td>B</td><td>-1</td></tr></table><table class='custom-anbi-ui-table'>{head}<tr><td>03/07/2026</td><td>Z</td><td>1</td></tr></table>"
    table = P.certificate_prices(pages(spark, html, None), "page", "html")
    assert [(r["reference_date"], r["identifier"], number(r["price"])) for r in table.collect()] == [(DAY(2026, 7, 3), "CRA1", Decimal("1039.26916663"))]
    line = '[0,0,"{}",3,4,5,6,7,8,{},10,{},{}]'
    rows = [line.format("a1", 1, 2, '"102.5"'), line.format("B2", '"1.234,50"', '"--"', "null"), line.format("C3", 0, -1, "true"), '[0,0,"D4"]', line.format("", 1, 1, 1), line.format("B2", 7, 0, '"x"')]
    docs = spark.createDataFrame([(1, '{"table": {"values": [' + ",".join(rows) + "]}}"), (2, "broken"), (3, None)], "doc long, json string")
    trades = P.trade_prices(docs, "doc", "json")
    assert {r["identifier"]: number(r["price"]) for r in trades.collect()} == {"A1": Decimal("102.5"), "B2": 7}
    assert P.wanted(trades, spark.createDataFrame([(" a1 ",), ("a1",)], "code string"), "code").count() == 1


def test_plain_markup_is_listed_as_the_parser_lists_it():
    import random

    from tessera.sources.html import _parsed, _plain

    rng, fast = random.Random(7), 0
    plain = ["<table>", "</table>", "<tr>", '<td class="a b">', "<TD colspan='2'>", "</td>", "<th>", "<p>", "</p>", "<br/>", "<img src='x' />", "text", " a\n", "<div>", "</div>", "<ul>", "<li>", "<!-- c -->", "<!DOCTYPE html>", "<thead>", "</tbody>", "<span/>", "</x>"]
    other = ["&amp;", "<td class=x>", "a<b", "<script>if(a<b)</script>", "<title>x</title>", "< p>", "<!-- <td> -->", "&lt", "<", "</"]
    for n in range(3000):
        html = "".join(rng.choice(plain if n % 3 or rng.random() < 0.9 else other) for _ in range(rng.randrange(30)))
        read, told = _plain(html), _parsed(html)
        told._close(0)
        assert [{k: v for k, v in r.items() if k != "attrs"} | {"attrs": list(r["attrs"])} for r in told.rows] == _listed(html)
        fast += read is not None
    assert 2000 <= fast < 3000


def test_pages_of_one_file_are_dealt_out_and_parsed_once(spark):
    from pyspark.sql import functions as F

    from tessera.sources import html as H

    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("page"), F.concat(F.lit("<p>a<p>"), F.col("id").cast("string")).alias("html"))
    read = elements(docs, "html", "page").select("page", F.spark_partition_id().alias("task"), F.get("elements", F.lit(3))["text"].alias("text")).collect()
    assert sorted((r["page"], r["text"]) for r in read) == sorted((n, str(n)) for n in range(400)) and len({r["task"] for r in read}) >= 4
    held, H.BATCH_ELEMENTS = H.BATCH_ELEMENTS, 5
    try:
        assert sorted((r["page"], len(r["elements"])) for r in elements(docs, "html").collect()) == [(n, 4) for n in range(400)]
    finally:
        H.BATCH_ELEMENTS = held
    for made in (C.detail_fields(docs, "page", "html"), C.payments(docs, "page", "html"), C.profiles(docs, "page", "html")):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_cells_that_are_header_and_label(spark):
    both = '<!-- detalhes --><table class="w728"><tr><td class="nivel1 label">Both</td><td class="data">5</td></tr><tr><td class="label">Under</td><td class="data">6</td></tr></table>'
    got = {(r["label"], r["section"], r["raw_value"]) for r in C.detail_fields(pages(spark, both), "page", "html").collect()}
    assert got == {("Both", "Both", "5"), ("Under", "Both", "6")}
