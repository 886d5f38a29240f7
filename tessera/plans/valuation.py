"""Valuation metrics from two pages as a query over the star-schema tables, with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import opportunity as V
from tessera.plans.queries import _r, _t, query

_DETAILS = """p_partkey AS k, make_date(1998, 1 + CAST(p_partkey % 12 AS INT), 1) AS quote_date, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS quote, CASE WHEN p_partkey % 7 < 5 THEN p_retailprice / 10 - p_size END AS eps, CASE WHEN p_partkey % 7 > 1 THEN p_size * CAST(20 AS DOUBLE) END AS bvps,
    CASE WHEN p_partkey % 6 = 0 THEN CAST(p_size AS DOUBLE) END AS p_vp, CASE WHEN p_partkey % 8 = 0 THEN CAST(p_size AS DOUBLE) / 2 END AS p_l, CAST(p_partkey % 9 AS DOUBLE) AS div_yield, CASE WHEN p_partkey % 10 <> 0 THEN p_size * CAST(1000 AS DOUBLE) END AS shares, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice * 0.8 END AS min_52, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 1.2 END AS max_52"""
_STATUS = """p_partkey AS k, p_retailprice * 1.01 AS price, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS s_eps, CASE WHEN p_partkey % 4 = 0 THEN p_size * CAST(21 AS DOUBLE) END AS s_bvps, CASE WHEN p_partkey % 11 = 0 THEN CAST(3 AS DOUBLE) END AS s_p_vp, CASE WHEN p_partkey % 13 = 0 THEN CAST(5 AS DOUBLE) END AS s_p_l,
    CASE WHEN p_partkey % 3 = 1 THEN p_size * CAST(2 AS DOUBLE) END AS dividends, CAST(p_partkey % 5 AS DOUBLE) AS s_yield, p_retailprice * 0.7 AS s_min_52, CASE WHEN p_partkey % 4 <> 1 THEN p_retailprice * 1.3 END AS s_max_52"""
_PAID = "SELECT l_partkey AS k, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_shipdate AS DATE) END AS ex_date, CASE WHEN l_linenumber % 6 <> 0 THEN CAST(l_shipdate AS DATE) END AS payment_date, CAST(l_quantity AS DOUBLE) AS value FROM {lineitem} WHERE l_partkey % 4 <> 2"
_METRICS = [
    ("current_price", "coalesce(quote, price)", "CASE WHEN quote IS NOT NULL THEN 'details' ELSE 'status' END"), ("shares_outstanding", "shares", "'details'"), ("earnings_per_share", "e", "CASE WHEN eps IS NOT NULL THEN 'details' ELSE 'status' END"), ("book_value_per_share", "b", "CASE WHEN bvps IS NOT NULL THEN 'details' ELSE 'status' END"),
    ("price_to_book", "coalesce(p_vp, s_p_vp, p / nullif(b, 0))", "CASE WHEN p_vp IS NOT NULL THEN 'details' WHEN s_p_vp IS NOT NULL THEN 'status' WHEN quote IS NOT NULL THEN 'details' ELSE 'status' END"), ("price_to_earnings", "coalesce(p_l, s_p_l, p / nullif(e, 0))", "CASE WHEN p_l IS NOT NULL THEN 'details' WHEN s_p_l IS NOT NULL THEN 'status' WHEN quote IS NOT NULL THEN 'details' ELSE 'status' END"),
    ("dividend_yield_12m", "CASE WHEN paid IS NOT NULL AND p <> 0 THEN paid / p * 100 ELSE coalesce(nullif(div_yield, 0), s_yield) END", "paid_by"), ("dividends_12m", "paid", "paid_by"), ("graham_price", "CASE WHEN e > 0 AND b > 0 THEN sqrt(22.5 * e * b) END", "'details'"), ("bazin_price", "paid / 0.06", "paid_by"),
    ("min_52_weeks", "coalesce(min_52, s_min_52)", "CASE WHEN min_52 IS NOT NULL THEN 'details' ELSE 'status' END"), ("max_52_weeks", "coalesce(max_52, s_max_52)", "CASE WHEN max_52 IS NOT NULL THEN 'details' ELSE 'status' END"),
]


_BELIEVED = f"""
    WITH d AS (SELECT {_DETAILS} FROM part WHERE p_partkey % 14 <> 13), s AS (SELECT {_STATUS} FROM part WHERE p_partkey % 3 <> 2),
    t AS (SELECT k, sum(value) AS year_paid FROM ({_PAID.format(lineitem="lineitem")}) JOIN d USING (k) WHERE coalesce(ex_date, payment_date) >= quote_date - 365 GROUP BY k),
    w AS (SELECT *, coalesce(quote, price) AS p, coalesce(eps, s_eps) AS e, coalesce(bvps, s_bvps) AS b, coalesce(year_paid, 0) <= 0 AND dividends IS NOT NULL AS other, CASE WHEN other THEN dividends ELSE coalesce(year_paid, 0) END AS total,
        CASE WHEN total > 0 OR quote_date IS NOT NULL OR dividends IS NOT NULL THEN total END AS paid, CASE WHEN other THEN 'status' ELSE 'details' END AS paid_by FROM d FULL JOIN s USING (k) LEFT JOIN t USING (k)),"""


@query(f"""{_BELIEVED}
    m AS ({" UNION ALL ".join(f"SELECT k, '{n}' AS metric, CAST({v} AS DOUBLE) AS v, {s} AS source, '{V.REASONS[n]}' AS why FROM w" for n, v, s in _METRICS)})
    SELECT k, metric, round(v, 6) + 0.0 AS value, CASE WHEN v IS NOT NULL THEN source END AS source, CASE WHEN v IS NULL THEN 'missing' ELSE 'valid' END AS state, CASE WHEN v IS NULL THEN why END AS reason FROM m
""")
def preferred_metrics(spark, sf_dir):
    """Twelve metrics of every part from a details page and a status page, the first believed before the second, and its trailing dividends."""
    part = _t(spark, sf_dir, "part")
    part.createOrReplaceTempView("tessera_part")
    _t(spark, sf_dir, "lineitem").createOrReplaceTempView("tessera_lineitem")
    details, status = (spark.sql(f"SELECT {columns} FROM tessera_part WHERE {test}") for columns, test in ((_DETAILS, "p_partkey % 14 <> 13"), (_STATUS, "p_partkey % 3 <> 2")))
    paid = spark.sql(_PAID.format(lineitem="tessera_lineitem"))
    return V.valuation(details, status, V.trailing_dividends(paid, details, "k"), "k").withColumn("value", _r(F.col("value")))


_MORE = ", CASE WHEN p_partkey % 3 <> 1 THEN p_size * CAST(500 AS DOUBLE) END AS traded_value, CASE WHEN p_partkey % 7 <> 3 THEN p_retailprice * 1000 END AS market_value"
_REPORTED = "SELECT l_partkey AS k, CAST(l_shipdate AS DATE) AS as_of, CASE WHEN l_partkey % 9 <> 0 OR l_linenumber > 2 THEN l_quantity * CAST(3 AS DOUBLE) END AS nav_per_share FROM {lineitem} WHERE l_partkey % 3 = 0 AND l_partkey % 5 <> 1"
_DISTRIBUTED = "SELECT l_partkey AS k, CAST(l_shipdate AS DATE) AS ex_date, max(CAST(l_quantity AS DOUBLE)) / 10 AS value, CASE WHEN max(l_linenumber) % 2 = 0 THEN 'events' ELSE 'stated' END AS source FROM {lineitem} WHERE l_partkey % 4 <> 2 AND (l_partkey % 6 <> 5 OR l_linenumber = 1) GROUP BY ALL"


def _metric_sql(name: str, value: str, day: str, source: str, why: str) -> str:
    return f"SELECT k, '{name}' AS metric, CAST({value} AS DOUBLE) AS v, {day} AS day, {source} AS source, {why} AS why FROM g"


_OFFICIAL = {"book_value_per_share": ("nav", "'reports'", V.REASONS["book_value_per_share"]), "price_to_book": ("CASE WHEN p > 0 THEN p / nullif(nav, 0) END", "concat('reports,', CASE WHEN quote IS NOT NULL THEN 'details' ELSE 'status' END)", V.REASONS["current_price"])}
_ALL_METRICS = [
    *(_metric_sql(n, v, "quote_date", s, f"'{V.REASONS[n]}'") for n, v, s in _METRICS if n not in _OFFICIAL),
    *(_metric_sql(n, f"CASE WHEN filed THEN {_OFFICIAL[n][0]} ELSE {v} END", "CASE WHEN filed THEN filed_at ELSE quote_date END", f"CASE WHEN filed THEN {_OFFICIAL[n][1]} ELSE {s} END", f"CASE WHEN filed THEN '{_OFFICIAL[n][2]}' ELSE '{V.REASONS[n]}' END") for n, v, s in _METRICS if n in _OFFICIAL),
    *(_metric_sql(n, v, day, s, f"'{V.REASONS[n]}'") for n, v, day, s in (
        ("average_daily_traded_value", "traded_value", "quote_date", "'details'"), ("market_capitalization", "market_value", "quote_date", "'details'"), ("latest_distribution", "newest", "newest_at", "newest_from"),
        ("median_distribution_3m", "CASE WHEN n3 >= 3 THEN mid3 END", "newest_at", "from3"), ("median_distribution_6m", "CASE WHEN n6 >= 6 THEN mid6 END", "newest_at", "from6"),
    )),
]


@query(f"""{_BELIEVED}
    o AS (SELECT k, true AS filed, max(as_of) AS filed_at, max(nav_per_share) FILTER (as_of = top) AS nav FROM (SELECT *, max(as_of) OVER (PARTITION BY k) AS top FROM ({_REPORTED.format(lineitem="lineitem")})) GROUP BY k),
    z AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ex_date DESC) AS n FROM ({_DISTRIBUTED.format(lineitem="lineitem")})),
    q AS (SELECT k, arg_min(value, n) AS newest, max(ex_date) AS newest_at, arg_min(source, n) AS newest_from, {", ".join(f"count(*) FILTER (n <= {n}) AS n{n}, median(value) FILTER (n <= {n}) AS mid{n}, string_agg(DISTINCT source, ',' ORDER BY source) FILTER (n <= {n}) AS from{n}" for n in V.MONTHS)} FROM z GROUP BY k),
    x AS (SELECT p_partkey AS k{_MORE} FROM part WHERE p_partkey % 14 <> 13),
    g AS (SELECT * REPLACE (coalesce(filed, false) AS filed) FROM w FULL JOIN o USING (k) FULL JOIN q USING (k) LEFT JOIN x USING (k)),
    m AS ({" UNION ALL ".join(_ALL_METRICS)})
    SELECT k, metric, round(v, 6) + 0.0 AS value, CASE WHEN v IS NOT NULL THEN day END AS as_of, CASE WHEN v IS NOT NULL THEN source END AS source, CASE WHEN v IS NULL THEN 'missing' ELSE 'valid' END AS state, CASE WHEN v IS NULL THEN why END AS reason FROM m
""")
def asset_metric_table(spark, sf_dir):
    """Seventeen metrics of every part: two pages, official values a share that overrule them, and its last distributions."""
    _t(spark, sf_dir, "part").createOrReplaceTempView("tessera_part")
    _t(spark, sf_dir, "lineitem").createOrReplaceTempView("tessera_lineitem")
    details, status = (spark.sql(f"SELECT {columns} FROM tessera_part WHERE {test}") for columns, test in ((_DETAILS + _MORE, "p_partkey % 14 <> 13"), (_STATUS, "p_partkey % 3 <> 2")))
    paid, reports, distributions = (spark.sql(sql.format(lineitem="tessera_lineitem")) for sql in (_PAID, _REPORTED, _DISTRIBUTED))
    return V.asset_metrics(details, status, V.trailing_dividends(paid, details, "k"), reports, distributions, "k").withColumn("value", _r(F.col("value")))
