"""All facts of companies, and a row that sums them up, as queries over the star-schema tables, each with the SQL it must agree with.

A supplier is a company, as for the stock facts; some are banks or insurers, some have no sector, no market value, no dividends or no bank report.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import company_facts as C
from tessera.operators.stock_facts import RATIOS
from tessera.plans.funds import dividend_fact_table
from tessera.plans.peers import _SECTOR
from tessera.plans.queries import ORACLE, _r, _t, query
from tessera.plans.stocks import _LATEST_SQL, _MEASURES, _YEARLY_SQL, _YEARS_SQL, _annual, _yearly_macro

_COMPANIES = f"SELECT s_suppkey AS k, {_SECTOR} AS sector, concat(CASE s_suppkey % 5 WHEN 0 THEN 'Banco ' WHEN 1 THEN 'Seguros ' ELSE 'Companhia ' END, s_suppkey) AS name FROM {{supplier}}"
_MARKET = "SELECT s_suppkey AS k, s_acctbal * 1000 AS traded_value, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal * 100000 END AS market_capitalization, make_date(1998, 12, 1 + CAST(s_suppkey % 20 AS INT)) AS as_of, CASE WHEN s_suppkey % 3 = 0 THEN 'quotes,pages' ELSE 'quotes' END AS source FROM {supplier} WHERE s_suppkey % 4 <> 0"
_BANKS = """SELECT s_suppkey AS k, CASE WHEN s_suppkey % 20 <> 5 THEN (s_suppkey % 35) / CAST(30 AS DOUBLE) END AS basel_ratio, (s_suppkey % 25) / CAST(30 AS DOUBLE) AS core_capital_ratio, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 11) / CAST(40 AS DOUBLE) END AS regulatory_leverage_ratio,
    make_date(1998, 9, 30) AS capital_as_of, (s_suppkey % 9) / CAST(50 AS DOUBLE) AS high_risk_credit_ratio, make_date(1998, 6, 30) AS credit_as_of FROM {supplier} WHERE s_suppkey % 15 <> 10"""

# What a fact observes, and in which years.
_SEEN = {
    "revenue_cagr": ("revenue", "TRUE"), "earnings_cagr": ("net_income", "TRUE"), "net_margin_volatility": ("net", "TRUE"), "return_on_equity_volatility": ("roe", "TRUE"), "positive_earnings_frequency": ("net_income", "TRUE"), "positive_free_cash_flow_frequency": ("free_cash_flow", "TRUE"),
    "share_dilution": ("shares", "late"), "roe_5y_median": ("roe", "late"), "roe_above_15_frequency": ("roe", "late"), "cash_conversion_median": ("cash", "late"), "gross_margin_volatility": ("gm", "late"), "operating_margin_volatility": ("om", "late"), "revenue_real_cagr": ("revenue", "late"), "earnings_real_cagr": ("net_income", "late"),
    "roe_vs_selic_spread": ("spread", "late"), "stress_profitability_frequency": ("net_income", "late AND (yr IN (2015, 2016, 2020) OR coalesce(selic, 0) >= 0.12)"), "positive_real_revenue_growth_frequency": ("real", "recency < 5"),
}


def _sql(name: str, value: str, unit: str, day: str, source: str, sure: float, need: str = "TRUE", why: str = "", otherwise: str = C.NOT_STATED) -> str:
    low, high = C.RANGES.get(name, (None, None))
    plausible = "" if low is None else f" WHEN NOT ({value}) BETWEEN CAST({low} AS DOUBLE) AND CAST({high} AS DOUBLE) THEN '{C.IMPLAUSIBLE}'"
    reason = f"CASE WHEN NOT coalesce({need}, false) THEN '{why}' WHEN ({value}) IS NULL THEN '{otherwise}'{plausible} END"
    return f"SELECT k, profile, '{name}' AS fact, CAST({value} AS DOUBLE) AS v, '{unit}' AS unit, {day} AS day, {source} AS told, {sure} AS sure, {reason} AS reason FROM g"


def _yearly_sql(name: str) -> str:
    least = 2 if name == "stress_profitability_frequency" else 3
    deflated = name in C.DEFLATED_FACTS
    otherwise = "no comparable positive values" if name in C.GROWING else C.NOT_STATED
    return _sql(name, name, "ratio", f"day_{name}", "'statements,rates'" if deflated else "'statements'", 0.88 if deflated else 0.9, f"n_{name} >= {least}", f"fewer than {least} observations", otherwise)


_STATED = {name: (unit, 0.65 if name == "free_cash_flow_margin" else 0.95) for name, (_, _, unit) in RATIOS.items()} | {"accrual_ratio": ("ratio", 0.95), "interest_coverage": ("multiple", 0.95)}
_FACTS = [
    *(_sql(n, n, unit, "period_end", "'statements'", sure) for n, (unit, sure) in _STATED.items()), *(_sql(n, n, "ratio", "period_end", "'statements,pages'", 0.9, otherwise="totals and values a share are not both stated") for n in C.AGAINST_PUBLIC), *map(_yearly_sql, _SEEN),
    *(_sql(n, f"({a} / nullif({b}, 0)) / nullif(mid_{n}, 0)", "multiple", "period_end", "'sector'", 0.8, f"mid_{n} IS NOT NULL", "fewer than 3 positive peers") for n, (a, b) in C.COMPARED.items()),
    _sql("listed_sector_revenue_share", "revenue / nullif(sector_revenue, 0)", "ratio", "period_end", "'sector'", 0.7, "members >= 3", "fewer than 3 peers"), *(_sql(n, c, "currency", "market_day", "market_source", 0.85) for n, c in (("daily_traded_value", "traded_value"), ("market_capitalization", "market_capitalization"))),
    *(_sql(n, n, "ratio", "capital_as_of", "'bank reports'", 0.98, "profile = 'bank' AND capital_as_of IS NOT NULL", C.NO_BANK) for n in C.CAPITAL), _sql("high_risk_credit_ratio", "high_risk_credit_ratio", "ratio", "credit_as_of", "'bank reports'", 0.78, "profile = 'bank' AND capital_as_of IS NOT NULL", C.NO_BANK),
]
_PAID = f"""SELECT k, profile, coalesce(d.fact, x.fact) AS fact, d.value, coalesce(d.unit, 'ratio') AS unit, d.as_of, d.source, coalesce(d.confidence, 0.0) AS confidence, coalesce(d.status, 'missing') AS status, CASE WHEN d.fact IS NULL THEN 'no distributions' ELSE d.reason END AS reason
    FROM (SELECT k, profile, unnest({list(C.DIVIDENDS)}) AS fact FROM g) AS x LEFT JOIN ({ORACLE["dividend_fact_table"]}) AS d USING (k, fact)"""


@query(f"""{_YEARS_SQL}
    y AS (SELECT l_suppkey AS k, {', '.join(f'{e} AS {f}, count({_SEEN[f][0]}) FILTER ({_SEEN[f][1]}) AS n_{f}, max(period_end) FILTER ({_SEEN[f][0]} IS NOT NULL AND {_SEEN[f][1]}) AS day_{f}' for f, e in _YEARLY_SQL.items())} FROM r GROUP BY l_suppkey),
    t AS (SELECT l_suppkey AS k, * REPLACE (CASE WHEN l_suppkey % 17 = 3 THEN -equity ELSE equity END AS equity) FROM n WHERE recency = 1),
    l AS (SELECT k, period_end, revenue, net_income, equity, total_assets, {', '.join(f'{e} AS {f}' for f, e in _LATEST_SQL.items())} FROM t),
    c AS (SELECT l.*, sector, CASE k % 5 WHEN 0 THEN 'bank' WHEN 1 THEN 'insurer' ELSE 'industrial' END AS profile, CASE WHEN k % 5 < 2 THEN profile ELSE concat('sector ', sector) END AS peers FROM l JOIN ({_COMPANIES.format(supplier='supplier')}) USING (k)),
    e AS (SELECT *, concat('sector ', sector) AS of FROM c WHERE equity > 0 AND sector IS NOT NULL UNION ALL SELECT *, profile FROM c WHERE equity > 0 AND sector IS NOT NULL AND k % 5 < 2),
    s AS (SELECT of, count(*) AS members, sum(revenue) FILTER (revenue > 0) AS sector_revenue, {', '.join(f'CASE WHEN count(*) FILTER ({a} / nullif({b}, 0) > 0) >= 3 THEN median({a} / nullif({b}, 0)) FILTER ({a} / nullif({b}, 0) > 0) END AS mid_{n}' for n, (a, b) in C.COMPARED.items())} FROM e GROUP BY of),
    g AS (SELECT * FROM c LEFT JOIN s ON c.peers = s.of JOIN y USING (k) LEFT JOIN (SELECT k, traded_value, market_capitalization, as_of AS market_day, source AS market_source FROM ({_MARKET.format(supplier='supplier')})) USING (k) LEFT JOIN ({_BANKS.format(supplier='supplier')}) USING (k)),
    f AS ({" UNION ALL ".join(_FACTS)})
    SELECT k, profile, fact, round(CASE WHEN reason IS NULL THEN v END, 5) + 0.0 AS value, unit, CASE WHEN reason IS NULL THEN day END AS as_of, CASE WHEN reason IS NULL THEN told END AS source, CAST(CASE WHEN reason IS NULL THEN sure ELSE 0 END AS DOUBLE) AS confidence, CASE WHEN reason IS NULL THEN 'valid' ELSE 'missing' END AS status, reason FROM f
    UNION ALL SELECT k, profile, fact, round(value, 5) + 0.0, unit, as_of, source, confidence, status, reason FROM ({_PAID})
""")
def company_fact_table(spark, sf_dir):
    """48 facts of every company with their dates, sources, confidence and reasons."""
    annual = _annual(spark, sf_dir).withColumnRenamed("l_suppkey", "k")
    latest = annual.groupBy("k").agg(F.max("period_end").alias("period_end"), *(F.max_by(m, "period_end").alias(m) for m in _MEASURES)).withColumn("equity", F.when(F.col("k") % 17 == 3, -F.col("equity")).otherwise(F.col("equity")))
    _t(spark, sf_dir, "supplier").createOrReplaceTempView("tessera_supplier")
    sectors, market, banks = (spark.sql(sql.format(supplier="tessera_supplier")) for sql in (_COMPANIES, _MARKET, _BANKS))
    found = C.company_facts(latest, annual, _yearly_macro(spark, sf_dir), "k", sectors=sectors, market=market, dividends=dividend_fact_table(spark, sf_dir), banks=banks)
    return found.withColumn("value", _r(F.col("value"), 5))


@query(f"""
    WITH f AS ({ORACLE["company_fact_table"]}),
    w AS (SELECT k, CASE WHEN reason = '{C.IMPLAUSIBLE}' THEN concat(fact, ': ', reason) WHEN profile = 'bank' AND fact = 'basel_ratio' AND status <> 'valid' THEN '{C.NO_CAPITAL}' END AS warning FROM f),
    s AS (SELECT DISTINCT k, unnest(string_split(source, ',')) AS source FROM f WHERE status = 'valid' UNION SELECT DISTINCT k, 'statements' FROM f)
    SELECT f.k, profile, count(*) FILTER (status = 'valid') AS known, count(*) FILTER (status <> 'valid') AS missing, min(confidence) FILTER (status = 'valid') AS least_confidence,
        any_value((SELECT string_agg(source, ',' ORDER BY source) FROM s WHERE s.k = f.k)) AS sources, coalesce(any_value((SELECT string_agg(DISTINCT warning, '; ' ORDER BY warning) FROM w WHERE w.k = f.k)), '') AS warnings FROM f GROUP BY f.k, profile
""")
def company_fact_summary(spark, sf_dir):
    """One row a company: how many facts are known, from which sources, how sure the least sure is, and what must be warned of."""
    told = C.company_summary(company_fact_table(spark, sf_dir), "k")
    return told.withColumns({"sources": F.array_join("sources", ","), "warnings": F.array_join("warnings", "; ")})
