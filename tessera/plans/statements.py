"""Statements of companies from account rows as queries over the star-schema tables, each with the SQL it must agree with.

A supplier files its quarters: sums from the year's first day to the quarter's end as accounts, in several charts. Some quarters are
missing, some suppliers file alone, some twice, and some close their first quarter on the last day of February.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import derivation as D
from tessera.operators import provenance as V
from tessera.plans.queries import _t, query

_NET = ("'Lucro/Prejuízo do Período'", "'Atribuído a Sócios da Empresa Controladora'", "'ATRIBUIDO AOS SOCIOS DA EMPRESA CONTROLADORA'")
# Code, label, value of each account a filing may have, as expressions that both engines read; a null value is no account.
_ACCOUNTS = [
    ("'1'", "'Ativo Total'", "gross"), ("'1.01'", "'Ativo Circulante'", "gross / 2"), ("'1.01.01'", "'Caixa'", "CASE WHEN k % 6 <> 1 THEN tax END"), ("'1.01.02'", "'Aplicações'", "CASE WHEN k % 6 > 2 THEN discount END"),
    ("'2.01'", "'Passivo Circulante'", "qty"), ("'2.01.04'", "'Empréstimos'", "CASE WHEN k % 5 <> 0 THEN discount * 2 END"), ("'2.02.01'", "'Empréstimos'", "CASE WHEN k % 5 > 2 THEN tax * 3 END"),
    ("'2.03'", "'Patrimônio Líquido'", "CASE WHEN k % 9 = 0 THEN 0 * qty ELSE qty * 100 END"), ("'2.07'", "'PATRIMONIO LIQUIDO CONSOLIDADO'", "CASE WHEN k % 9 < 2 THEN qty * 90 END"), ("'2.07.09'", "'Participação dos Sócios Não Controladores'", "CASE WHEN k % 3 = 0 THEN qty * (k % 100) END"),
    ("'3.01'", "'Receita'", "revenue"), ("'3.03'", "'Resultado Bruto'", "revenue - discount"), ("'3.05'", "'EBIT'", "tax * 1.5 - discount"), ("'3.06'", "'Financeiro'", "CASE WHEN k % 2 = 0 THEN -tax END"),
    ("'3.11'", f"CASE WHEN k % 3 = 0 THEN {_NET[0]} ELSE 'Resultado' END", "tax * 1.4 - discount"), ("'3.11.01'", f"CASE WHEN k % 3 = 1 THEN {_NET[1]} ELSE {_NET[2]} END", "CASE WHEN k % 3 = 1 THEN tax * 1.2 - discount WHEN k % 3 = 2 THEN 0 * tax END"),
    ("'7.08.04'", _NET[1], "gross"), ("'3.99.01.01'", "'ON'", "CASE WHEN k % 4 = 0 THEN 0 * tax ELSE tax / qty END"), ("'3.99.01.02'", "'PN'", "tax / qty * 2"),
    ("'6.01'", "'Caixa Operacional'", "CASE WHEN k % 13 <> 0 THEN tax - discount * 0.5 END"), ("'6.02'", "'Caixa de Investimento'", "CASE WHEN k % 3 = 0 THEN discount ELSE -discount END"),
]

_QUARTERS = """
    SELECT l_suppkey AS k, year(l_shipdate) AS yr, quarter(l_shipdate) AS q, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS gross, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS revenue,
           sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS discount, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * CAST(l_tax AS DECIMAL(4,2))) AS tax, sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty
    FROM lineitem GROUP BY 1, 2, 3"""
_SUMS = ("gross", "revenue", "discount", "tax", "qty")
_END = "CASE WHEN k % 10 = 3 AND q = 1 THEN last_day(make_date(yr, 2, 1)) ELSE last_day(make_date(yr, q * 3, 1)) END"
_SECTOR = "CASE WHEN s_nationkey % 5 = 0 THEN 'Intermediários Financeiros' WHEN s_nationkey % 5 = 1 THEN NULL ELSE 'Comércio' END"

# Periods with a quarter's filings; consolidated or not; each with the year's sums up to its end.
_FILED = f"""
    SELECT k, yr, period_start, period_end, consolidated, CASE WHEN k % 7 = 0 AND q = 2 THEN NULL ELSE period_end + 45 END AS published_at, {", ".join(f"{c} * CASE WHEN consolidated OR k % 4 = 1 THEN 1.0 ELSE 0.5 END AS {c}" for c in _SUMS)}
    FROM (SELECT k, yr, q, make_date(yr, 1, 1) AS period_start, {_END} AS period_end, {", ".join(f"CAST(sum({c}) OVER (PARTITION BY k, yr ORDER BY q) AS DOUBLE) AS {c}" for c in _SUMS)} FROM ({_QUARTERS})) CROSS JOIN (SELECT true AS consolidated UNION ALL SELECT false)
    WHERE (k + yr * 4 + q) % 11 <> 0 AND CASE WHEN k % 4 = 0 THEN true WHEN k % 4 = 1 THEN NOT consolidated ELSE consolidated END"""


def _labelled(name: str, labels: tuple[str, ...], group: str) -> str:
    """The value under the first of the labels, in DuckDB's words."""
    rank = "CASE upper(strip_accents(label)) " + " ".join(f"WHEN upper(strip_accents('{x}')) THEN {k + 1}" for k, x in enumerate(labels)) + " ELSE 0 END"
    return f"arg_min(value, {rank} * 1000 + place) FILTER ({rank} > 0 AND code LIKE '{group}%') AS {name}"


_RULES = {r.name: r for r in D.RULES}
_BY_CODE = {"revenue": "3.01", "gross_profit": "3.03", "ebit": "3.05", "financial_result": "3.06", "total_assets": "1", "current_assets": "1.01", "current_liabilities": "2.01", "cash": "1.01.01", "investments": "1.01.02", "short_term_debt": "2.01.04", "long_term_debt": "2.02.01", "operating_cash_flow": "6.01", "investing": "6.02", "net_code": "3.11", "equity_code": "2.03"}
_INDUSTRIAL = "CASE WHEN coalesce(sector, '') NOT LIKE '%Financeir%' THEN {} END"
_ACCOUNT_ROWS = "SELECT k, yr, period_start, period_end, consolidated, published_at, code, label, value, place FROM (SELECT *, unnest([" + ", ".join(f"{{'code': {c}, 'label': {x}, 'value': CAST({v} AS DOUBLE), 'place': {n}}}" for n, (c, x, v) in enumerate(_ACCOUNTS)) + f"], recursive := true) FROM ({_FILED})) WHERE value IS NOT NULL"

_PERIODS = f"""
    WITH a AS ({_ACCOUNT_ROWS}),
    m AS (SELECT k, yr, period_start, period_end, consolidated, published_at, {", ".join(f"max(value) FILTER (code = '{c}') AS {n}" for n, c in _BY_CODE.items())},
            {_labelled("net_label", _RULES["net_income"].labels, "3.")}, {_labelled("equity_label", _RULES["whole_equity"].labels, "2.")}, {_labelled("outside", _RULES["outside_equity"].labels, "")},
            coalesce(max(value) FILTER (code = '3.99.01.01' AND value > 0), max(value) FILTER (code = '3.99.01.02' AND value > 0)) AS eps, max(value) FILTER (code = '7.08.04') / 50 AS worn
          FROM a GROUP BY k, yr, period_start, period_end, consolidated, published_at),
    s AS (SELECT s_suppkey AS k, {_SECTOR} AS sector FROM supplier),
    c AS (SELECT l_suppkey AS k, year(l_shipdate) AS yr, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS stated FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1, 2),
    w AS (SELECT m.*, sector, stated, coalesce(CASE WHEN net_label <> 0 THEN net_label END, CASE WHEN net_code <> 0 THEN net_code END, net_label) AS net_income, coalesce(CASE WHEN equity_label <> 0 THEN equity_label END, CASE WHEN equity_code <> 0 THEN equity_code END, equity_label) AS whole FROM m LEFT JOIN s USING (k) LEFT JOIN c USING (k, yr)),
    i AS (SELECT k, period_end, period_start, consolidated, published_at, stated, eps, net_income, whole, outside, revenue, total_assets, sector, {", ".join(f"{_INDUSTRIAL.format(n)} AS {n}" for n in ("gross_profit", "ebit", "financial_result", "current_assets", "current_liabilities", "cash", "investments", "short_term_debt", "long_term_debt", "operating_cash_flow", "investing", "worn"))} FROM w)
    SELECT k, sector, period_end, consolidated, published_at, coalesce(date_diff('day', period_start, period_end) >= 300, true) AS annual, revenue, gross_profit, ebit, CASE WHEN ebit IS NOT NULL OR worn IS NOT NULL THEN coalesce(ebit, 0) + coalesce(worn, 0) END AS ebitda, financial_result, net_income,
        CASE WHEN whole - outside > 0 THEN whole - outside ELSE whole END AS equity, total_assets, current_assets, current_liabilities, CASE WHEN cash IS NOT NULL OR investments IS NOT NULL THEN coalesce(cash, 0) + coalesce(investments, 0) END AS cash_and_equivalents, short_term_debt, long_term_debt,
        CASE WHEN short_term_debt IS NOT NULL OR long_term_debt IS NOT NULL THEN coalesce(short_term_debt, 0) + coalesce(long_term_debt, 0) END AS gross_debt, gross_debt - coalesce(cash_and_equivalents, 0) AS net_debt, operating_cash_flow, CASE WHEN investing < 0 THEN -investing WHEN investing IS NOT NULL THEN 0 END AS capex,
        operating_cash_flow - coalesce(capex, 0) AS free_cash_flow, worn AS depreciation, coalesce(CASE WHEN stated <> 0 THEN stated END, CASE WHEN net_income > 0 THEN net_income / eps END) AS shares_outstanding
    FROM i QUALIFY row_number() OVER (PARTITION BY k, period_end ORDER BY consolidated DESC) = 1"""

_FIGURES = (*D.FLOWS, *D.BALANCES)


def _account_rows(spark, sf_dir) -> DataFrame:
    """Account rows of all filings, as the two engines' common expressions say."""
    li = _t(spark, sf_dir, "lineitem")
    money = lambda c, scale=18: F.col(c).cast(f"decimal({scale},2)")
    price, share, rate = money("l_extendedprice"), money("l_discount", 4), money("l_tax", 4)
    quarters = li.groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("yr"), F.quarter("l_shipdate").alias("q")).agg(F.sum(price).alias("gross"), F.sum(price * (1 - share)).alias("revenue"), F.sum(price * share).alias("discount"), F.sum(price * (1 - share) * rate).alias("tax"), F.sum(money("l_quantity")).alias("qty"))
    ends = quarters.selectExpr("k", "yr", "q", "make_date(yr, 1, 1) AS period_start", f"{_END} AS period_end", *(f"CAST(sum({c}) OVER (PARTITION BY k, yr ORDER BY q) AS DOUBLE) AS {c}" for c in _SUMS))
    filed = ends.where("(k + yr * 4 + q) % 11 <> 0").selectExpr("*", "explode(CASE WHEN k % 4 = 0 THEN array(true, false) WHEN k % 4 = 1 THEN array(false) ELSE array(true) END) AS consolidated")
    filed = filed.selectExpr("k", "yr", "period_start", "period_end", "consolidated", "CASE WHEN k % 7 = 0 AND q = 2 THEN NULL ELSE date_add(period_end, 45) END AS published_at", *(f"{c} * CASE WHEN consolidated OR k % 4 = 1 THEN 1.0D ELSE 0.5D END AS {c}" for c in _SUMS))
    rows = F.array(*(F.struct(F.expr(c).alias("code"), F.expr(x).alias("label"), F.expr(v).cast("double").alias("value"), F.lit(n).alias("place")) for n, (c, x, v) in enumerate(_ACCOUNTS)))
    return filed.select("k", "yr", "period_start", "period_end", "consolidated", "published_at", F.inline(rows)).where("value is not null")


def _periods(spark, sf_dir) -> DataFrame:
    rows = _account_rows(spark, sf_dir)
    keys = ["k", "yr", "period_start", "period_end", "consolidated", "published_at"]
    worn = D.Rule("value_added", ("7.08.04",))
    measured = D.measures(rows, keys, (*D.RULES, worn)).withColumn("depreciation", F.col("value_added") / 50).drop("value_added")
    sector = _t(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", f"{_SECTOR} AS sector")
    stated = _t(spark, sf_dir, "lineitem").where("l_suppkey % 2 = 0").groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("yr")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("stated_shares"))
    whole = measured.join(sector, "k", "left").join(stated, ["k", "yr"], "left")
    figures = D.derived(whole).withColumn("annual", D.is_annual(F.col("period_start"), F.col("period_end")))
    return D.unique_periods(figures, "k", F.col("period_start"))


def _rounded(*columns: str) -> str:
    return ", ".join(f"floor({c} * 1000 + 0.5) / 1000 AS {c}" for c in columns)


def _r3(c: str) -> Column:
    """Thousandths, halves up, in the same steps as the SQL: sums of prices end in halves of a thousandth."""
    return (F.floor(F.col(c) * 1000 + 0.5) / 1000).alias(c)


@query(f"SELECT k, sector, period_end, consolidated, published_at, annual, {_rounded(*_FIGURES)} FROM ({_PERIODS})")
def derived_measures(spark, sf_dir):
    """All figures of every filed period, from account rows by the rule table, one period by company and end."""
    return _periods(spark, sf_dir).select("k", "sector", "period_end", "consolidated", "published_at", "annual", *map(_r3, _FIGURES))


_TRAILING = f"""
    SELECT k, sector, p.period_end, CASE WHEN p.annual THEN 'annual' WHEN y.k IS NULL THEN 'no year' WHEN s.k IS NULL THEN 'no comparable' ELSE 'trailing' END AS basis,
        CASE WHEN p.annual THEN p.published_at WHEN p.published_at IS NOT NULL AND y.published_at IS NOT NULL AND s.published_at IS NOT NULL THEN greatest(p.published_at, y.published_at, s.published_at) END AS published_at,
        {", ".join(f"CASE WHEN p.annual THEN p.{c} ELSE p.{c} + y.{c} - s.{c} END AS {c}" for c in D.FLOWS)}, {", ".join(f"CASE WHEN p.annual OR (y.k IS NOT NULL AND s.k IS NOT NULL) THEN p.{c} END AS {c}" for c in D.BALANCES)}
    FROM p LEFT JOIN p AS s ON NOT p.annual AND NOT s.annual AND s.k = p.k AND year(s.period_end) = year(p.period_end) - 1 AND month(s.period_end) = month(p.period_end) AND day(s.period_end) = day(p.period_end)
    ASOF LEFT JOIN (SELECT * FROM p WHERE annual) AS y ON y.k = p.k AND y.period_end < p.period_end"""


def _qualified(sql: str) -> str:
    return sql.replace("SELECT k, sector, p.period_end", "SELECT p.k, p.sector, p.period_end")


@query(f"WITH p AS ({_PERIODS}) SELECT k, period_end, basis, published_at, {_rounded(*_FIGURES)} FROM ({_qualified(_TRAILING)})")
def trailing_statements(spark, sf_dir):
    """The twelve months up to every filed period: flows by alignment of three periods, balances as they stand, publication as the last of them."""
    found = D.trailing_periods(_periods(spark, sf_dir), "k")
    return found.select("k", "period_end", "basis", "published_at", *map(_r3, _FIGURES))


# What is published of a company elsewhere: a market's count of its shares for some, in other units than its capital for others.
_PUBLIC = "CASE WHEN k % 3 = 0 THEN shares * 1.02 END AS market_shares, CASE WHEN k % 8 = 1 THEN shares / 1000 WHEN k % 8 <> 2 THEN shares END AS capital_shares, CASE WHEN k % 5 <> 0 THEN net_income / nullif(shares, 0) * CASE WHEN k % 10 = 1 THEN 2 ELSE 1 END END AS earnings_per_share, CASE WHEN k % 5 <> 1 THEN equity / nullif(shares, 0) * 1.05 END AS book_value_per_share, CASE WHEN k % 6 = 0 THEN 0.5D END AS dividends_per_share, CASE WHEN k % 2 = 0 THEN 'high' ELSE 'medium' END AS match, 'indicators' AS public_source".replace("0.5D", "CAST(0.5 AS DOUBLE)")
_SNAPSHOT_FIELDS = {"revenue_ttm": "revenue", "ebit_ttm": "ebit", "ebitda_ttm": "ebitda", "net_income_ttm": "net_income", "free_cash_flow_ttm": "free_cash_flow", "equity": "equity", "net_debt": "net_debt"}


def _told_sql(field: str, value: str, source: str, why: str) -> str:
    return f"SELECT k, '{field}' AS field, {value} AS value, {source} AS source, sure, {why} AS reason, period_end FROM u"


@query(f"""
    WITH p AS ({_PERIODS}), t AS (SELECT *, coalesce(shares_outstanding, total_assets / 10) AS shares FROM ({_qualified(_TRAILING)}) QUALIFY row_number() OVER (PARTITION BY k ORDER BY period_end DESC) = 1),
    b AS (SELECT *, {_PUBLIC} FROM t),
    j AS (SELECT *, CASE WHEN net_income > 0 AND earnings_per_share > 0 THEN net_income / earnings_per_share END AS by_income, CASE WHEN equity > 0 AND book_value_per_share > 0 THEN equity / book_value_per_share END AS by_equity FROM b),
    v AS (SELECT *, CASE WHEN by_income IS NULL THEN by_equity WHEN by_equity IS NULL THEN by_income WHEN greatest(by_income, by_equity) / least(by_income, by_equity) > 1.2 THEN by_income ELSE (by_income + by_equity) / 2 END AS implied FROM j),
    f AS (SELECT *, coalesce(market_shares, implied) AS ref, abs(capital_shares * 0.001 - ref) AS off0, abs(capital_shares - ref) AS off1, abs(capital_shares * 1000 - ref) AS off2, CASE WHEN off0 <= off1 AND off0 <= off2 THEN 0.001 WHEN off1 <= off2 THEN 1.0 ELSE 1000.0 END AS nearest FROM v),
    u AS (SELECT *, CASE WHEN capital_shares > 0 AND ref > 0 AND abs(capital_shares * nearest - ref) / ref <= 0.1 THEN nearest ELSE 1.0 END AS factor, CASE WHEN match = 'high' THEN 0.95 ELSE 0.8 END AS sure FROM f),
    r AS ({" UNION ALL ".join(_told_sql(f, m, "'statements'", "CASE WHEN basis IN ('annual', 'trailing') THEN 'not in the statements' ELSE basis END") for f, m in _SNAPSHOT_FIELDS.items())}
          UNION ALL {" UNION ALL ".join(_told_sql(m, m, "public_source", "'not published'") for m in ("earnings_per_share", "book_value_per_share", "dividends_per_share"))}
          UNION ALL {_told_sql("shares_outstanding", "coalesce(market_shares, implied, capital_shares * factor)", "CASE WHEN market_shares IS NOT NULL THEN 'market' WHEN implied IS NOT NULL THEN 'implied' ELSE 'statements' END", "'market has none'")})
    SELECT k, field, floor(value * 1000 + 0.5) / 1000 AS value, CASE WHEN value IS NOT NULL THEN source END AS source, CAST(CASE WHEN value IS NULL THEN 0 ELSE sure END AS DOUBLE) AS confidence, CASE WHEN value IS NULL THEN 'missing' ELSE 'valid' END AS status, CASE WHEN value IS NULL THEN reason END AS reason, period_end AS reference_date FROM r
""")
def reconciled_snapshots(spark, sf_dir):
    """The latest twelve months of every company as fields with value, source, confidence and reason; shares reconciled between three sources."""
    latest = D.latest_trailing(_periods(spark, sf_dir), "k").withColumn("shares", F.coalesce("shares_outstanding", F.col("total_assets") / 10))
    public = latest.selectExpr("*", _PUBLIC.split(", CASE")[0], *(f"CASE{x}" for x in _PUBLIC.split(", CASE")[1:-1]), *(x for x in f"CASE{_PUBLIC.split(', CASE')[-1]}".split(", ")))
    return V.snapshot(public, ["k"]).withColumn("value", _r3("value"))
