"""Pages of company statements: arrays in scripts, a cash-flow table, labelled balances and listed totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import header_date, lower_key, magnitude_decimal, page_decimal, squeeze
from tessera.sources.html import cells, elements, has_class, inside, joined, tables

# The block of arrays and its length, arrays and labels by measure, the years that count, and how far a value may stand.
BLOCK, BLOCK_LENGTH, YEARS, NEAR = "data:{datekey", 4000, 5, 900
SERIES = {"revenue": "revenue", "gross_profit": "gp", "ebit": "opinc", "net_income": "netinccmn", "earnings_per_share": "epsdil"}
BALANCES = {"total_assets": "ativos", "current_assets": "ativo circulante", "gross_debt": "divida bruta", "net_debt": "divida liquida", "cash_and_equivalents": "disponibilidade", "equity": "patrimonio liquido", "market_capitalization": "valor de mercado"}
TOTALS = {"equity": "patrimonio liquido", "total_assets": "ativos"}
PERIODS, CASH_FLOW, MILLION = "period ending", "operating cash flow", 1_000_000
CELL_DATE = r"[A-Z][a-z]{2} \d{1,2}, \d{4}"


def _array(block: Column, name: str) -> Column:
    items = F.transform(F.split(F.regexp_extract(block, rf"\b{name}:\[([^\]]*)\]", 1), ","), lambda i: F.regexp_replace(F.trim(i), '^"+|"+$', ""))
    return F.filter(items, lambda i: i != "")


def annual_income(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, period_end and the measures of the first five dates of the embedded arrays; a shorter array has nulls at its end."""
    at = F.locate(BLOCK, F.col(html))
    read = pages.where(at > 0).select(key, F.substring(F.col(html), at, F.lit(BLOCK_LENGTH)).alias("block"))
    dates = F.slice(F.filter(F.transform(_array(F.col("block"), "datekey"), lambda d: F.try_to_date(d, "yyyy-MM-dd")), lambda d: d.isNotNull()), 1, YEARS)
    rows = read.select(key, "block", F.posexplode(dates).alias("place", "period_end"))
    return rows.select(key, "period_end", *(page_decimal(F.get(_array(F.col("block"), code), F.col("place"))).alias(name) for name, code in SERIES.items()))


def operating_cash_flow(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, period_end, operating_cash_flow: of the first table, stated in millions; of equal dates the last column counts."""
    read = cells(elements(pages.select(key, html), html, key), key, F.slice(tables(lambda e: F.lit(True)), 1, 1)).withColumn("_label", lower_key(F.col("joined")))
    named = read.where((F.col("cell_no") == 0) & F.col("_label").isin(PERIODS, CASH_FLOW)).groupBy(key, F.col("_label").alias("_line")).agg(F.min("row").alias("row"))
    amount = (F.translate("joined", ",", "").try_cast("decimal(28,10)") * MILLION).cast("decimal(38,10)")
    columns = read.where("cell_no > 0").join(named, [key, "row"]).groupBy(key, "cell_no").agg(
        F.max(F.when(F.col("_line") == PERIODS, header_date(F.regexp_extract("joined", CELL_DATE, 0)))).alias("period_end"), F.max(F.when(F.col("_line") == CASH_FLOW, amount)).alias("amount")
    )
    return columns.where("period_end is not null and amount is not null").groupBy(key, "period_end").agg(F.max_by("amount", "cell_no").alias("operating_cash_flow"))


def labelled_balances(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row a page: for each label the first number that stands near behind a title with that label; built-in functions only."""
    title = rf"(?s)<h3[^>]*>([^<]+)</h3>(?=(.{{0,{NEAR}}}))"
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(title), F.lit(1)).alias("label"), F.regexp_extract_all(html, F.lit(title), F.lit(2)).alias("tail"))
    values = F.transform(pairs, lambda p: F.struct(lower_key(p["label"]).alias("label"), page_decimal(squeeze(F.regexp_extract(p["tail"], r'class="[^"]*\bvalue\b[^"]*"[^>]*>([^<]+)<', 1))).alias("value")))
    read = pages.select(key, values.alias("_values"))
    return read.select(key, *(F.get(F.filter("_values", lambda p: (p["label"] == label) & p["value"].isNotNull()), F.lit(0))["value"].alias(name) for name, label in BALANCES.items()))


def listed_totals(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row a page: totals of its cells, the first amount alone, by its magnitude word; the last valid cell of a label counts."""
    told = elements(pages.select(key, html), html, key)

    def name(x: Column) -> Column:
        return ((x["tag"] == "span") & (has_class(x, "name") | has_class(x, "d-flex"))) | has_class(x, "title")

    def value(x: Column) -> Column:
        held = F.exists("elements", lambda a: (a["tag"] == "div") & has_class(a, "value") & (a["node"] < x["node"]) & (x["node"] <= a["last"]))
        return ((x["tag"] == "span") & (has_class(x, "value") | held)) | has_class(x, "detail-value")

    def read(e: Column) -> Column:
        return F.struct(lower_key(joined(F.get(inside(e, name), F.lit(0)))).alias("label"), magnitude_decimal(joined(F.get(inside(e, value), F.lit(0)))).alias("value"))

    found = told.select(key, F.transform(F.filter("elements", lambda e: (e["tag"] == "div") & has_class(e, "cell")), read).alias("_values"))
    return found.select(key, *(F.try_element_at(F.filter("_values", lambda p: (p["label"] == label) & p["value"].isNotNull()), F.lit(-1))["value"].alias(measure) for measure, label in TOTALS.items()))


def page_statements(income: DataFrame, cash: DataFrame, balances: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """The years of each page with their cash flow, and its balances, or where it has none at all the listed totals, at its last year."""
    none = F.coalesce(*(F.col(c) for c in BALANCES)).isNull()
    both = balances.join(totals.select(key, *(F.col(c).alias(f"_{c}") for c in TOTALS)), key, "full")
    chosen = both.withColumns({c: F.when(none, F.col(f"_{c}")).otherwise(F.col(c)) for c in TOTALS}).drop(*(f"_{c}" for c in TOTALS))
    at = income.groupBy(key).agg(F.max("period_end").alias("period_end"))
    return income.join(cash, [key, "period_end"], "left").join(at.join(chosen, key), [key, "period_end"], "left")
