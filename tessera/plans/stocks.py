"""Stock facts and market documents as queries over the star-schema tables, each with the SQL it must agree with.

A supplier stands for a company: its years' sums, and differences of them that change their sign, for the measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.stock_facts import RATIOS, stock_facts
from tessera.plans.pages import ORACLE, QUERIES
from tessera.plans.queries import _ORDERS, _RATES, _SUPPLIER_YEARS, _r, _rates, _t, customer_orders, query, supplier_years
from tessera.sources import bulletins, market_documents

__all__ = ["ORACLE", "QUERIES"]  # those of all modules

# Each measure as an expression that both engines read, over a supplier's yearly sums as doubles.
_MEASURES = {
    "revenue": "revenue", "gross_profit": "revenue - discount", "ebit": "tax * 1.3 - discount", "ebitda": "tax * 1.3", "net_income": "tax * 1.4 - discount", "equity": "qty * 100", "total_assets": "gross",
    "operating_cash_flow": "tax - discount * 0.5", "free_cash_flow": "tax - discount", "net_debt": "discount - tax", "gross_debt": "discount", "current_assets": "gross / 2", "current_liabilities": "CASE WHEN l_suppkey % 4 <> 0 THEN qty END",
    "financial_result": "CASE WHEN l_suppkey % 2 = 0 THEN -tax ELSE tax END", "shares": "qty", "public_eps": "CASE WHEN l_suppkey % 3 <> 0 THEN tax / qty END", "public_bvps": "99.0",
}

_ANNUAL = "SELECT l_suppkey, yr, make_date(yr, 12, 31) AS period_end, " + ", ".join(f"{e} AS {m}" for m, e in _MEASURES.items()) + f" FROM (SELECT l_suppkey, yr, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in ('gross', 'revenue', 'discount', 'tax', 'qty'))} FROM ({_SUPPLIER_YEARS}))"
_MACRO = f"SELECT yr, product(1 + rate) - 1 AS inflation, avg(rate) * 12 + CASE WHEN yr IN (1998, 2000) THEN 0.08 ELSE 0.0 END AS selic FROM ({_RATES}) GROUP BY yr"


def _annual(spark, sf_dir) -> DataFrame:
    sums = supplier_years(spark, sf_dir).select("l_suppkey", "yr", *(F.col(c).cast("double").alias(c) for c in ("gross", "revenue", "discount", "tax", "qty")))
    return sums.select("l_suppkey", F.expr("make_date(yr, 12, 31)").alias("period_end"), *(F.expr(e).cast("double").alias(m) for m, e in _MEASURES.items()))


def _yearly_macro(spark, sf_dir) -> DataFrame:
    shift = F.when(F.col("yr").isin(1998, 2000), 0.08).otherwise(0.0)
    means = _rates(spark, sf_dir).groupBy("yr").agg((F.product(1 + F.col("rate")) - 1).alias("inflation"), F.avg("rate").alias("mean"))
    return means.select("yr", "inflation", (F.col("mean") * 12 + shift).alias("selic"))


def _obs(value: str, where: str = "TRUE") -> str:
    return f"count({value}) FILTER ({where})"


def _sql_growth(value: str, where: str = "TRUE", last: str = "") -> str:
    seen = f"FILTER ({value} IS NOT NULL AND {where})"
    first, end, days = f"arg_min({value}, yr) {seen}", f"arg_max({value}, yr) {seen}{last}", f"datediff('day', min(period_end) {seen}, max(period_end) {seen})"
    return f"CASE WHEN {_obs(value, where)} >= 3 AND {first} > 0 AND {end} > 0 AND {days} > 0 THEN pow(({end}) / ({first}), 365.25 / {days}) - 1 END"


def _sql_gated(value: str, made: str, where: str = "TRUE", least: int = 3) -> str:
    return f"CASE WHEN {_obs(value, where)} >= {least} THEN {made} FILTER ({value} IS NOT NULL AND {where}) END"


def _sql_share(value: str, test: str, where: str = "TRUE", least: int = 3) -> str:
    return _sql_gated(value, f"avg(CASE WHEN {value} {test} THEN 1.0 ELSE 0.0 END)", where, least)


_YEARLY_SQL = {
    "revenue_cagr": _sql_growth("revenue"), "earnings_cagr": _sql_growth("net_income"), "net_margin_volatility": _sql_gated("net", "stddev_pop(net)"), "return_on_equity_volatility": _sql_gated("roe", "stddev_pop(roe)"),
    "positive_earnings_frequency": _sql_share("net_income", "> 0"), "positive_free_cash_flow_frequency": _sql_share("free_cash_flow", "> 0"), "share_dilution": _sql_growth("shares", "late"),
    "roe_5y_median": _sql_gated("roe", "median(roe)", "late"), "roe_above_15_frequency": _sql_share("roe", ">= 0.15", "late"), "cash_conversion_median": _sql_gated("cash", "median(cash)", "late"),
    "gross_margin_volatility": _sql_gated("gm", "stddev_pop(gm)", "late"), "operating_margin_volatility": _sql_gated("om", "stddev_pop(om)", "late"), "roe_vs_selic_spread": _sql_gated("spread", "median(spread)", "late"),
    "stress_profitability_frequency": _sql_share("net_income", "> 0", "late AND (yr IN (2015, 2016, 2020) OR coalesce(selic, 0) >= 0.12)", 2), "positive_real_revenue_growth_frequency": _sql_share("real", "> 0", "recency < 5"),
    "revenue_real_cagr": _sql_growth("revenue", "late", " / any_value(prices)"), "earnings_real_cagr": _sql_growth("net_income", "late", " / any_value(prices)"),
}
_LATEST_SQL = {name: f"{a} / nullif({b}, 0)" for name, (a, b, _) in RATIOS.items()} | {
    "accrual_ratio": "(net_income - operating_cash_flow) / nullif(total_assets, 0)", "interest_coverage": "ebit / CASE WHEN financial_result < 0 THEN abs(financial_result) END",
    "earnings_per_share_consistency_error": "CASE WHEN shares > 0 AND public_eps IS NOT NULL THEN abs(net_income / shares - public_eps) / greatest(abs(net_income / shares), abs(public_eps), 0.000001) END",
    "book_value_per_share_consistency_error": "CASE WHEN shares > 0 THEN abs(equity / shares - public_bvps) / greatest(abs(equity / shares), abs(public_bvps), 0.000001) END",
}


# Years with their ranks, rates and ratios (r), and the rows of all years (n).
_YEARS_SQL = f"""
    WITH a AS ({_ANNUAL}), m AS ({_MACRO}),
    n AS (SELECT a.*, row_number() OVER w AS recency, lag(revenue) OVER (PARTITION BY l_suppkey ORDER BY yr) AS prev FROM a WINDOW w AS (PARTITION BY l_suppkey ORDER BY yr DESC)),
    span AS (SELECT l_suppkey, min(yr) AS y0, max(yr) AS y1 FROM n WHERE recency <= 5 GROUP BY l_suppkey),
    p AS (SELECT l_suppkey, CASE WHEN count(*) >= 2 THEN product(1 + inflation) END AS prices FROM span JOIN m ON m.yr > y0 AND m.yr <= y1 GROUP BY l_suppkey),
    r AS (SELECT n.*, selic, prices, recency <= 5 AS late, net_income / nullif(equity, 0) AS roe, net_income / nullif(revenue, 0) AS net, gross_profit / nullif(revenue, 0) AS gm, ebit / nullif(revenue, 0) AS om, operating_cash_flow / nullif(net_income, 0) AS cash,
        net_income / nullif(equity, 0) - selic AS spread, CASE WHEN prev > 0 THEN revenue / prev / (1 + inflation) - 1 END AS real FROM n LEFT JOIN m USING (yr) LEFT JOIN p USING (l_suppkey)),"""


@query(f"""{_YEARS_SQL}
    y AS (SELECT l_suppkey, {', '.join(f'{e} AS {f}' for f, e in _YEARLY_SQL.items())} FROM r GROUP BY l_suppkey),
    l AS (SELECT l_suppkey, {', '.join(f'{e} AS {f}' for f, e in _LATEST_SQL.items())} FROM n WHERE recency = 1),
    w AS (SELECT l.*, y.* EXCLUDE (l_suppkey) FROM l JOIN y USING (l_suppkey))
    SELECT l_suppkey, fact, round(value, 5) + 0.0 AS value, CASE WHEN fact IN ('net_debt_to_ebitda', 'debt_to_equity', 'current_ratio', 'interest_coverage') THEN 'multiple' ELSE 'ratio' END AS unit, CASE WHEN value IS NULL THEN 'missing' ELSE 'valid' END AS status
    FROM w UNPIVOT INCLUDE NULLS (value FOR fact IN ({', '.join([*_LATEST_SQL, *_YEARLY_SQL])}))
""")
def stock_quality_facts(spark, sf_dir):
    """33 facts a company, of its latest year and of its years against yearly rates."""
    annual = _annual(spark, sf_dir)
    latest = annual.groupBy("l_suppkey").agg(*(F.max_by(m, "period_end").alias(m) for m in _MEASURES))
    return stock_facts(latest, annual, _yearly_macro(spark, sf_dir), "l_suppkey").withColumn("value", _r(F.col("value"), 5))


def _json(template: str, **values: Column) -> Column:
    parts, rest = [], template
    for name, value in values.items():
        before, rest = rest.split(f"<{name}>", 1)
        parts += [F.lit(before), value.cast("string")]
    return F.concat(*parts, F.lit(rest))


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN round(c_acctbal, 2) + 0.0 END AS price, CASE WHEN c_custkey % 5 <> 0 THEN 'BRL' END AS currency, CASE WHEN c_custkey % 5 <> 0 THEN 'B3' END AS exchange, c_name AS description, CAST(c_nationkey AS DOUBLE) AS market_capitalization
    FROM customer WHERE c_custkey % 7 <> 0
""")
def quote_documents(spark, sf_dir):
    """Quotes where there is a price; documents without data give no row."""
    c = F.col("c_custkey")
    full = _json('{"results": [{"data": {"longName": " <name> ", "regularMarketPrice": <price>, "marketCap": "<cap>"}}]}', name=F.col("c_name"), price=F.when(c % 5 == 0, F.lit('"-"')).otherwise(F.col("c_acctbal").cast("decimal(18,2)").cast("string")), cap=F.col("c_nationkey"))
    docs = _t(spark, sf_dir, "customer").select("c_custkey", F.when(c % 7 == 0, F.lit('{"results": []}')).otherwise(full).alias("doc"))
    read = market_documents.quotes(docs, "c_custkey", "doc")
    return read.select("c_custkey", _r(F.col("price"), 2).alias("price"), "currency", "exchange", "description", F.col("market_capitalization").cast("double").alias("market_capitalization"))


@query("""
    SELECT p_partkey, round(p_retailprice, 2) + 0.0 AS net_assets, DATE '2020-01-01' + p_size AS inception_date, p_brand AS holding, p_size / 100 AS weight, 1::BIGINT AS sectors FROM part WHERE p_partkey % 6 <> 0
""")
def fund_documents(spark, sf_dir):
    """Fund profiles with the holdings that have a weight; documents that tell of a failure give no row."""
    full = _json('{"net_assets": "<v>", "inception_date": "<d>", "sectors": [{"sector": "S", "weight": 1}, {"sector": "T", "weight": "-"}], "holdings": [{"symbol": "<b>", "weight": "<w>"}, {"symbol": "X", "weight": "None"}]}', v=F.col("p_retailprice").cast("decimal(18,2)"), d=F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")), b=F.col("p_brand"), w=(F.col("p_size") / 100).cast("decimal(8,2)"))
    docs = _t(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 6 == 0, F.lit('{"Note": "later"}')).otherwise(full).alias("doc"))
    read = market_documents.fund_profiles(docs, "p_partkey", "doc").select("p_partkey", "net_assets", "inception_date", F.size("sectors").cast("long").alias("sectors"), F.explode("holdings").alias("h"))
    return read.select("p_partkey", _r(F.col("net_assets"), 2).alias("net_assets"), "inception_date", F.col("h.symbol").alias("holding"), F.col("h.weight").cast("double").alias("weight"), "sectors")


_TYPES = ["stock", "bdr", "fund", "etf", "fiagro", "unit"]


@query(f"""
    SELECT 'P' || p_partkey AS ticker, p_name AS name, ([{', '.join(f"'{t}'" for t in _TYPES)}])[p_partkey % 6 + 1] AS raw_type, 'B3' AS exchange, 'BR' AS country,
        CASE p_partkey % 6 WHEN 2 THEN CASE WHEN p_partkey % 100 = 11 THEN 'fii' ELSE 'unknown' END ELSE ([{', '.join(f"'{t}'" for t in _TYPES)}])[p_partkey % 6 + 1] END AS instrument_type FROM part
""")
def local_directory_entries(spark, sf_dir):
    """Each part as an entry of a directory document, in three shapes; a later entry with its ticker does not count."""
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    entry = _json('{"stock": " p<key>", "type": "<kind>", "name": "<name>"}', key=F.col("p_partkey"), kind=kind, name=F.col("p_name"))
    both = F.concat(F.lit("["), entry, F.lit(', 7, {"ticker": "P'), F.col("p_partkey"), F.lit('", "type": "etf"}]'))
    doc = F.when(F.col("p_partkey") % 5 == 0, both).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit('{"other": '), both, F.lit(', "n": 1}'))).otherwise(F.concat(F.lit('{"stocks": '), both, F.lit("}")))
    docs = _t(spark, sf_dir, "part").select("p_partkey", doc.alias("doc"))
    return bulletins.local_directory(docs, "doc", "p_partkey").select("ticker", "name", "raw_type", "exchange", "country", "instrument_type")


@query(f"""
    WITH o AS (SELECT o_orderkey, day, 'C' || to_base(o_custkey % 46656, 36, 3) || '3' AS ticker FROM ({_ORDERS})), b AS (SELECT DISTINCT day AS seen, ticker FROM o)
    SELECT o_orderkey, CASE WHEN seen >= day - 7 THEN seen END AS seen, CASE WHEN seen >= day - 7 THEN 'I' || CAST(seen AS VARCHAR) END AS isin
    FROM (SELECT *, day - 1 AS until FROM o) x ASOF LEFT JOIN b ON x.ticker = b.ticker AND x.until >= b.seen
""")
def bulletin_lookup(spark, sf_dir):
    """For each order its customer's line of a bulletin in the seven days before; a document a customer and day."""
    code = F.concat(F.lit("C"), F.lpad(F.conv((F.col("o_custkey") % 46656).cast("string"), 10, 36), 3, "0"), F.lit("3"))
    orders = customer_orders(spark, sf_dir).select("o_orderkey", "day", code.alias("ticker"))
    doc = _json('{"table": {"columns": [{"name": "TckrSymb"}, {"name": "SgmtNm"}, {"name": "ISIN"}, {"name": "CrpnNm"}], "values": [["<a>", "FORWARD", "no", "x"], ["<b>", "CASH", "I<day>", "Co"]]}}', a=F.col("ticker"), b=F.col("ticker"), day=F.col("day"))
    rows = bulletins.bulletin_instruments(orders.select("day", "ticker").distinct().select("day", doc.alias("doc")), "day", "doc")
    found = bulletins.latest_instruments(orders.withColumnRenamed("day", "at"), rows.select("day", "ticker", "isin"), "ticker", "at")
    return found.select("o_orderkey", F.col("day").alias("seen"), "isin")
