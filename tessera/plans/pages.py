"""Pages and price documents as queries over the star-schema tables, each with the SQL it must agree with.

Parts, customers and suppliers each have a page, written here from their rows and read back from its HTML or JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.filings import ORACLE, QUERIES
from tessera.plans.queries import _ORDERS, _SUPPLIER_YEARS, _r, _t, customer_orders, query, supplier_years
from tessera.sources import company_pages, prices, statement_pages
from tessera.sources.html import attribute, elements, inside

__all__ = ["ORACLE", "QUERIES"]  # those of all modules


def _write(template: str, **values: Column) -> Column:
    """The template with its {names} replaced, as strings."""
    parts, rest = [], template
    for name, value in values.items():
        before, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(before), value.cast("string")]
    return F.concat(*parts, F.lit(rest))


def _comma(value: Column, places: int = 2) -> Column:
    return F.translate(value.cast(f"decimal(28,{places})").cast("string"), ".", ",")


_PART_PAGE = """<!-- detalhes --><table class="w728"><tr><td class="label"><span class="help">?</span><span class="txt">Papel</span></td><td class="data">{key}</td>
<td class="label">Nome</td><td class="data"><span class="txt">{name}</span></td></tr></table>
<table class="w728"><tr><td class="nivel1" colspan="2">Market</td><td class="nivel1" colspan="2">Indicators</td></tr><tr><td colspan="2"></td><td class="nivel2" colspan="2">Last</td></tr>
<tr><td class="label">Cotação</td><td class="data">{price}</td><td class="label">Tamanho</td><td class="data">{size}</td></tr></table>"""


@query("""
    SELECT p_partkey, 'Identity' AS section, 'papel' AS label_key, 'text' AS value_type, NULL::DOUBLE AS number, 'P' || p_partkey || 'A' AS value_text FROM part
    UNION ALL SELECT p_partkey, 'Identity', 'nome', 'text', NULL, p_name FROM part
    UNION ALL SELECT p_partkey, 'Market', 'cotacao', 'money', round(p_retailprice, 2), NULL FROM part
    UNION ALL SELECT p_partkey, 'Indicators - Last', 'tamanho', 'percent', p_size, NULL FROM part
""")
def detail_pages(spark, sf_dir):
    """Labels, values and their types, in sections named by two levels of headers."""
    html = _write(_PART_PAGE, key=F.concat(F.lit("P"), F.col("p_partkey"), F.lit("A")), name=F.col("p_name"), price=_comma(F.col("p_retailprice")), size=F.concat("p_size", F.lit("%")))
    fields = company_pages.detail_fields(_t(spark, sf_dir, "part").select("p_partkey", html.alias("html")), "p_partkey", "html")
    return fields.select("p_partkey", "section", "label_key", "value_type", _r(F.col("value_decimal"), 2).alias("number"), "value_text")


@query("SELECT p_partkey, 'P' || p_partkey || 'A' AS ticker, p_name AS company_name, round(p_retailprice, 2) AS quote, NULL::VARCHAR AS sector FROM part")
def detail_records(spark, sf_dir):
    """One record a page, of its first fields with known labels."""
    html = _write(_PART_PAGE, key=F.concat(F.lit("p"), F.col("p_partkey"), F.lit("A")), name=F.col("p_name"), price=_comma(F.col("p_retailprice")), size=F.concat("p_size", F.lit("%")))
    fields = company_pages.detail_fields(_t(spark, sf_dir, "part").select("p_partkey", html.alias("html")), "p_partkey", "html")
    return company_pages.company_details(fields, "p_partkey").select("p_partkey", "ticker", "company_name", _r(F.col("quote"), 2).alias("quote"), "sector")


@query(f"SELECT o_custkey, day AS ex_date, day + 30 AS payment_date, CAST(total AS DOUBLE) AS value, o_orderstatus AS type, day + 30 > DATE '1998-06-01' AS is_future_payment FROM ({_ORDERS})")
def payment_pages(spark, sf_dir):
    """Payments of each page's table, whose columns its headers order; a later payment is a future one."""
    shown = F.date_format("day", "dd/MM/yyyy")
    row = _write("<tr><td>{day}</td><td>{kind}</td><td>{paid}<td>{value}</tr>", day=shown, kind=F.col("o_orderstatus"), paid=F.date_format(F.date_add("day", 30), "dd/MM/yyyy"), value=_comma(F.col("total")))
    rows = F.array_join(F.collect_list(row), "")
    html = F.concat(F.lit("proventos<table id='resultado'><thead><tr><th>Data</th><th>Tipo</th><th>Data de Pagamento</th><th>Valor</th></tr></thead>"), rows, F.lit("</table>"))
    read = company_pages.payments(customer_orders(spark, sf_dir).groupBy("o_custkey").agg(html.alias("html")), "o_custkey", "html")
    return read.select("o_custkey", "ex_date", "payment_date", F.col("value").cast("double").alias("value"), "type", F.coalesce(F.col("payment_date") > F.lit("1998-06-01").cast("date"), F.lit(False)).alias("is_future_payment"))


def _years_newest_first(value: str, end: Column) -> Column:
    """Values of a supplier's years, newest first, each followed by ``end``."""
    listed = F.sort_array(F.collect_list(F.struct("yr", F.col(value).cast("decimal(28,2)").cast("string").alias("v"))), asc=False)
    return F.array_join(F.transform(listed, lambda y: F.concat(F.coalesce(y["v"], F.lit("-")), end)), "")


def _statement_pages(spark, sf_dir) -> DataFrame:
    """A supplier's page: arrays of its years, a cash-flow table, and balances for even suppliers, listed totals for odd ones."""
    years = supplier_years(spark, sf_dir).withColumn("gross", F.col("gross").cast("decimal(28,2)"))
    comma, cell = F.lit(","), F.lit("</td><td>")
    newest = F.sort_array(F.collect_list("yr"), asc=False)
    dates = F.array_join(F.transform(newest, lambda y: F.concat(F.lit('"'), y, F.lit('-12-31"'))), ",")
    heads = F.array_join(F.transform(newest, lambda y: F.concat(F.lit("Dec 31, "), y, cell)), "")
    last = F.max_by("gross", "yr")
    even = _write('<h3>Patrimônio líquido</h3><div><strong class="value">{v}</strong></div>', v=_comma(last))
    odd = _write('<div class="cell"><span class="name">Patrimônio líquido</span><div class="value"><span>$ {v} Mil R$ 9,00</span></div></div>', v=_comma(last))
    page = F.concat(F.lit("data:{datekey:["), dates, F.lit("],revenue:["), _years_newest_first("revenue", comma), F.lit("],opinc:["), _years_newest_first("tax", comma), F.lit("]}<table><tr><th>Period Ending</th><td>"), heads, F.lit("</td></tr><tr><td>Operating Cash Flow</td><td>"), _years_newest_first("qty", cell), F.lit("</td></tr></table>"), F.when(F.col("l_suppkey") % 2 == 0, even).otherwise(odd))
    return years.groupBy("l_suppkey").agg(page.alias("html"))


@query(f"""
    WITH y AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY yr DESC) AS recency FROM ({_SUPPLIER_YEARS}))
    SELECT l_suppkey, yr, round(CAST(CAST(revenue AS DECIMAL(28,2)) AS DOUBLE), 1) + 0.0 AS revenue, round(CAST(CAST(tax AS DECIMAL(28,2)) AS DOUBLE), 1) + 0.0 AS ebit, NULL::DOUBLE AS net_income,
        round(CAST(qty AS DOUBLE) * 1000000, 1) + 0.0 AS operating_cash_flow, CASE WHEN recency = 1 THEN round(CAST(gross AS DOUBLE) * CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 1000 END, 1) + 0.0 END AS equity
    FROM y WHERE recency <= 5
""")
def statement_page_years(spark, sf_dir):
    """Five years of each page's arrays with their cash flow, and the balance at the last of them."""
    pages = _statement_pages(spark, sf_dir)
    args = (pages, "l_suppkey", "html")
    read = statement_pages.page_statements(statement_pages.annual_income(*args), statement_pages.operating_cash_flow(*args), statement_pages.labelled_balances(*args), statement_pages.listed_totals(*args), "l_suppkey")
    return read.select("l_suppkey", F.year("period_end").alias("yr"), *(_r(F.col(c), 1).alias(c) for c in ("revenue", "ebit", "net_income", "operating_cash_flow", "equity")))


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE round(c_acctbal, 2) + 0.0 END AS current_price, CAST(c_nationkey AS DOUBLE) AS price_to_earnings, lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS fund FROM customer
""")
def profile_pages(spark, sf_dir):
    """Values by title and by indicator, and the fund's number."""
    shown = F.when(F.col("c_custkey") % 3 == 0, F.lit("-")).otherwise(_comma(F.col("c_acctbal")))
    html = _write(
        '<div title="Valor atual do ativo"><h3>x</h3><strong class="value">R$ {price}</strong></div><div><div><h3 data-key="p_l">P/L</h3></div><div><strong class="value">{pe}</strong></div></div><div><h3 class="title">CNPJ</h3><strong class="value">{fund}</strong></div>',
        price=shown, pe=F.col("c_nationkey"), fund=F.lpad(F.col("c_custkey").cast("string"), 14, "0"),
    )
    read = company_pages.profiles(_t(spark, sf_dir, "customer").select("c_custkey", html.alias("html")), "c_custkey", "html")
    return read.select("c_custkey", _r(F.col("current_price"), 2).alias("current_price"), _r(F.col("price_to_earnings"), 2).alias("price_to_earnings"), "fund")


@query(f"SELECT l_suppkey, make_date(yr, 12, 31) AS reference_date, 'S' || l_suppkey AS identifier, round(CAST(CAST(revenue AS DECIMAL(28,4)) AS DOUBLE), 2) + 0.0 AS price FROM ({_SUPPLIER_YEARS}) WHERE revenue > 0")
def certificate_pages(spark, sf_dir):
    """Prices by date of each page's table; rows repeat with a former price, of which the last counts."""
    def row(price: Column) -> Column:
        return _write("<tr><td>31/12/{yr}</td><td> s{key} </td><td>{price}</td></tr>", yr=F.col("yr"), key=F.col("l_suppkey"), price=price)

    rows = F.array_join(F.collect_list(F.concat(row(F.lit("1,5")), row(_comma(F.col("revenue"), 4)))), "")
    html = F.concat(F.lit('<table class="custom-anbi-ui-table"><tr><th>Data de Referência</th><th>Código</th><th>PU</th></tr>'), rows, F.lit("</table>"))
    pages = supplier_years(spark, sf_dir).groupBy("l_suppkey").agg(html.alias("html"))
    return prices.certificate_prices(pages, "l_suppkey", "html").withColumn("price", _r(F.col("price"), 2))


@query(f"""
    SELECT l_suppkey, 'S' || l_suppkey || '-' || yr AS identifier, round(CAST(CASE WHEN yr % 2 = 0 THEN CAST(revenue AS DECIMAL(28,2)) ELSE CAST(gross AS DECIMAL(28,2)) END AS DOUBLE), 1) + 0.0 AS price
    FROM ({_SUPPLIER_YEARS}) WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)
""")
def trade_documents(spark, sf_dir):
    """The first positive price of each trade in a document's rows, for the codes that are asked for."""
    best = F.when(F.col("yr") % 2 == 0, F.concat(F.lit('"'), _comma(F.col("revenue")), F.lit('"'))).otherwise(F.lit('"--"'))
    row = _write('[0,1,"s{key}-{yr}",3,4,5,6,7,8,{low},10,0,{top}]', key=F.col("l_suppkey"), yr=F.col("yr"), low=F.col("gross").cast("decimal(28,2)"), top=best)
    years = supplier_years(spark, sf_dir)
    docs = years.groupBy("l_suppkey").agg(F.concat(F.lit('{"table": {"values": ['), F.array_join(F.collect_list(row), ","), F.lit("]}}")).alias("doc"))
    asked = years.join(_t(spark, sf_dir, "supplier").where("s_nationkey < 20").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat(F.lit(" s"), "l_suppkey", F.lit("-"), "yr").alias("code"))
    found = prices.wanted(prices.trade_prices(docs, "l_suppkey", "doc"), asked, "code")
    return found.select("l_suppkey", "identifier", _r(F.col("price"), 1).alias("price"))


_TEXTLESS = "regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs')"


@query(f"""
    WITH p AS (SELECT page_id, {_TEXTLESS} AS h FROM pages)
    SELECT page_id, len(regexp_extract_all(h, '<a [^>]*href=')) AS links, len(regexp_extract_all(h, '<li>')) AS items, len(regexp_extract_all(h, '<p[ >]')) AS paragraphs,
        len(regexp_extract_all(list_aggregate(regexp_extract_all(h, '(?s)<nav>.*?</nav>'), 'string_agg', ''), '<a [^>]*href=')) AS nav_links, len(regexp_extract_all(h, '<(b|i|em|strong)>')) AS marked FROM p
""")
def page_elements(spark, sf_dir):
    """Elements of every crawled page, and the links inside its navigation, by the parser."""
    read = elements(_t(spark, sf_dir, "pages").select("page_id", "html"), "html")
    linked = lambda e: (e["tag"] == "a") & attribute(e, "href").isNotNull()
    number = lambda *tags: F.size(F.filter("elements", lambda e: e["tag"].isin(*tags)))
    in_nav = F.aggregate(F.filter("elements", lambda e: e["tag"] == "nav"), F.lit(0), lambda a, e: a + F.size(inside(e, linked)))
    return read.select("page_id", F.size(F.filter("elements", linked)).alias("links"), number("li").alias("items"), number("p").alias("paragraphs"), in_nav.alias("nav_links"), number("b", "i", "em", "strong").alias("marked"))
