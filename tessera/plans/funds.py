"""All facts of funds as a query over the star-schema tables, with the SQL it must agree with: a supplier is a fund, its months are reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.distributions import dividend_facts
from tessera.operators.fund_facts import fund_facts
from tessera.plans.facts import _REPORTS, _reports
from tessera.plans.queries import _SUPPLIER_YEARS, _r, query, supplier_years

_REPORT = """l_suppkey AS k, last_day(month) AS as_of, total / shares AS nav_per_share, total * CASE WHEN l_suppkey % 4 = 0 THEN 1.1 ELSE 1 END AS net_assets, CASE WHEN l_suppkey % 9 <> 0 THEN shares END AS issued_shares, CAST(holders AS DOUBLE) AS shareholder_count,
    CASE WHEN month(month) % 3 = 0 THEN paid / total - 0.05 END AS monthly_nav_return, CASE WHEN month(month) % 5 <> 0 THEN paid / total END AS monthly_distribution_yield, CASE WHEN l_suppkey % 7 <> 0 THEN concat('A', CAST(floor(year(month) / (2 + l_suppkey % 3)) AS BIGINT)) END AS administrator,
    CASE WHEN l_suppkey % 5 <> 0 THEN make_date(1990, 1, 1) END AS inception_date, CASE WHEN l_suppkey % 6 <> 0 THEN (l_suppkey % 10) / CAST(1000 AS DOUBLE) END AS administration_fee_ratio, total AS total_assets, paid AS total_liabilities, CASE WHEN l_suppkey % 2 = 0 THEN total / 2 END AS property_assets, total / 3 AS credit_assets, paid * 2 AS liquid_assets"""
# Reports of some months are missing, young funds have few; some months distribute nothing and some other than their report says.
_FILED = "(l_suppkey + month(month)) % 8 <> 0 AND (l_suppkey % 10 <> 1 OR year(month) >= 2001) AND l_suppkey % 13 <> 12"
_PAID = "l_suppkey AS k, last_day(month) AS ex_date, CASE WHEN (l_suppkey + month(month)) % 6 = 0 THEN 0.0 ELSE paid / shares * CASE WHEN month(month) % 4 = 0 THEN 1.2 ELSE 1.0 END END AS value"
_PAYING = "l_suppkey % 11 <> 10 AND (l_suppkey % 10 <> 2 OR year(month) >= 2001)"


def _sql(name: str, value: str, unit: str, day: str, confidence: float, *needs: tuple[str, str]) -> str:
    why = "CASE " + " ".join(f"WHEN NOT coalesce({test}, false) THEN '{reason}'" for test, reason in needs) + f" WHEN ({value}) IS NULL THEN 'not in the last report' END"
    return f"SELECT k, '{name}' AS fact, CAST({value} AS DOUBLE) AS v, '{unit}' AS unit, {day} AS day, {confidence} AS sure, {why} AS reason FROM g"


_GROWTH = "CASE WHEN {0}0 > 0 AND {0}1 > 0 AND {0}_days > 0 THEN pow({0}1 / {0}0, 365.25 / {0}_days) - 1 END"
_TOLD, _SIX_PAID, _SIX_REPORTS = ("as_of IS NOT NULL", "no history"), ("n_paid >= 6", "fewer than 6 distributions"), ("n_short >= 6", "fewer than 6 reports")
_FACTS = [
    ("reporting_history_months", "n_all", "count", "as_of", 0.95, _TOLD), ("distribution_history_months", "paid_all", "count", "paid_at", 0.95, ("paid_all > 0", "no history")),
    ("distribution_stability", "sd_paid / nullif(mean_paid, 0)", "ratio", "paid_at", 0.95, _SIX_PAID), ("positive_distribution_frequency", "paying / n_paid", "ratio", "paid_at", 0.95, _SIX_PAID),
    ("distribution_growth", "(late - early) / nullif(early, 0)", "ratio", "paid_at", 0.9, ("n_paid >= 12", "fewer than 12 distributions")), ("distribution_cut_frequency", "cuts / nullif(comparable, 0)", "ratio", "paid_at", 0.9, _SIX_PAID, ("comparable > 0", "no positive distribution before another")),
    ("reporting_regularity", "n_months / month_span", "ratio", "as_of", 0.9, _SIX_REPORTS), ("report_completeness", "complete / n_short", "ratio", "as_of", 0.9, _SIX_REPORTS),
    ("nav_growth", _GROWTH.format("v"), "ratio", "as_of", 0.9, ("n_long >= 12", "fewer than 12 observations")), ("nav_return_volatility", "sd_ret", "ratio", "ret_at", 0.9, ("n_ret >= 6", "fewer than 6 returns")), ("positive_nav_return_frequency", "up / n_ret", "ratio", "ret_at", 0.9, ("n_ret >= 6", "fewer than 6 returns")),
    ("nav_max_drawdown", "fall", "ratio", "as_of", 0.9, ("n_long >= 6", "fewer than 6 observations")), ("distribution_report_consistency_error", "mid_error", "ratio", "as_of", 0.85, ("n_errors >= 6", "fewer than 6 months in both")),
    ("net_assets", "net_assets", "currency", "as_of", 0.95, _TOLD), ("shareholder_count", "shareholder_count", "count", "as_of", 0.95, _TOLD), ("fund_age_years", "date_diff('day', inception_date, as_of) / 365.25", "years", "as_of", 0.95, _TOLD), ("administration_fee_ratio", "administration_fee_ratio", "ratio", "as_of", 0.95, _TOLD),
    ("administrator_stability", "greatest(0, 1 - changes * 0.5)", "ratio", "run_at", 0.9, ("n_run >= 12", "fewer than 12 observations")), ("daily_traded_value", "CASE WHEN k % 3 = 0 THEN k * 1000.0 END", "currency", "as_of", 0.85, ("k % 3 = 0", "no market value")),
    *((n, f"{c} / nullif(total_assets, 0)", "ratio", "as_of", 0.95, _TOLD) for n, c in (("liability_ratio", "total_liabilities"), ("property_allocation", "property_assets"), ("credit_allocation", "credit_assets"), ("liquid_asset_ratio", "liquid_assets"))),
    ("issuance_nav_preservation", "CASE WHEN issues = 0 THEN 1 ELSE preserved / issues END", "ratio", "issued_at", 0.9, ("n_issued >= 12", "fewer than 12 observations")), ("shareholder_growth", _GROWTH.format("h"), "ratio", "as_of", 0.9, ("n_long >= 12", "fewer than 12 observations")),
    ("nav_total_consistency_error", "abs(nav_per_share * issued_shares - net_assets) / greatest(nav_per_share * issued_shares, net_assets)", "ratio", "as_of", 0.9, ("net_assets > 0 AND issued_shares > 0", "value, assets and shares are not all stated")),
]


@query(f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY as_of DESC) AS n, count(*) OVER (PARTITION BY k) AS n_all FROM (SELECT {_REPORT} FROM ({_REPORTS}) WHERE shares > 0 AND total > 0 AND {_FILED})),
    d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ex_date DESC) AS n, count(*) OVER (PARTITION BY k) AS paid_all FROM (SELECT {_PAID} FROM ({_REPORTS}) WHERE shares > 0 AND total > 0 AND {_PAYING})),
    l AS (SELECT *, lag(nav_per_share) OVER (PARTITION BY k ORDER BY as_of) AS before, lag(issued_shares) OVER (PARTITION BY k ORDER BY as_of) AS issued_before, lag(administrator) OVER (PARTITION BY k ORDER BY as_of) AS run_before, max(nav_per_share) OVER (PARTITION BY k ORDER BY as_of) AS peak FROM r WHERE n <= 60),
    x AS (SELECT *, CASE WHEN n <= 36 THEN coalesce(monthly_nav_return, CASE WHEN n < least(36, n_all) THEN nav_per_share / before - 1 END) END AS ret FROM l),
    a AS (SELECT k, max(n_all) AS n_all, count(*) AS n_long, max(as_of) AS as_of, count(*) FILTER (n <= 36) AS n_short, count(DISTINCT as_of) FILTER (n <= 36) AS n_months, date_diff('month', min(as_of) FILTER (n <= 36), max(as_of)) + 1 AS month_span, count(*) FILTER (n <= 36 AND monthly_nav_return IS NOT NULL AND monthly_distribution_yield IS NOT NULL) AS complete,
            arg_min(nav_per_share, as_of) AS v0, arg_max(nav_per_share, as_of) AS v1, date_diff('day', min(as_of), max(as_of)) AS v_days, arg_min(shareholder_count, as_of) AS h0, arg_max(shareholder_count, as_of) AS h1, v_days AS h_days, stddev_pop(ret) AS sd_ret, count(ret) AS n_ret, count(*) FILTER (ret >= 0) AS up, max(as_of) FILTER (ret IS NOT NULL) AS ret_at,
            max((peak - nav_per_share) / peak) AS fall, count(administrator) AS n_run, max(as_of) FILTER (administrator IS NOT NULL) AS run_at, count(*) FILTER (administrator <> run_before) AS changes, count(issued_shares) AS n_issued, max(as_of) FILTER (issued_shares IS NOT NULL) AS issued_at,
            count(*) FILTER (issued_shares > issued_before * 1.02) AS issues, count(*) FILTER (issued_shares > issued_before * 1.02 AND nav_per_share >= before * 0.97) AS preserved FROM x GROUP BY k),
    y AS (SELECT *, lag(value) OVER (PARTITION BY k ORDER BY ex_date) AS before, count(*) OVER (PARTITION BY k) AS n_paid FROM d WHERE n <= 36),
    b AS (SELECT k, max(paid_all) AS paid_all, max(n_paid) AS n_paid, max(ex_date) AS paid_at, stddev_pop(value) AS sd_paid, avg(value) AS mean_paid, count(*) FILTER (value > 0) AS paying, avg(value) FILTER (n > n_paid - n_paid // 2) AS early, avg(value) FILTER (n <= n_paid - n_paid // 2) AS late,
            count(*) FILTER (before > 0) AS comparable, count(*) FILTER (before > 0 AND value < before * 0.9) AS cuts FROM y GROUP BY k),
    e AS (SELECT y.k, median(abs(value - nav_per_share * monthly_distribution_yield) / greatest(abs(value), abs(nav_per_share * monthly_distribution_yield), 0.000001)) AS mid_error, count(*) AS n_errors FROM y JOIN r ON r.k = y.k AND r.as_of = y.ex_date AND r.n <= 36 AND monthly_distribution_yield IS NOT NULL GROUP BY y.k),
    g AS (SELECT * FROM a FULL JOIN b USING (k) LEFT JOIN e USING (k) LEFT JOIN (SELECT k, nav_per_share, net_assets, issued_shares, shareholder_count, inception_date, administration_fee_ratio, total_assets, total_liabilities, property_assets, credit_assets, liquid_assets FROM r WHERE n = 1) AS z USING (k)),
    f AS ({" UNION ALL ".join(_sql(*fact) for fact in _FACTS)})
    SELECT k, fact, round(CASE WHEN reason IS NULL THEN v END, 6) + 0.0 AS value, unit, CASE WHEN reason IS NULL THEN day END AS as_of, CAST(CASE WHEN reason IS NULL THEN sure ELSE 0 END AS DOUBLE) AS confidence, CASE WHEN reason IS NULL THEN 'valid' ELSE 'missing' END AS status, reason FROM f
""")
def fund_fact_table(spark, sf_dir):
    """26 facts of every fund with their dates, confidence and reasons."""
    months = _reports(spark, sf_dir).where("shares > 0 and total > 0").withColumn("holders", F.col("holders").cast("double"))
    months.createOrReplaceTempView("tessera_fund_months")
    reports = spark.sql(f"SELECT {_REPORT} FROM tessera_fund_months WHERE {_FILED}")
    paid = spark.sql(f"SELECT {_PAID} FROM tessera_fund_months WHERE {_PAYING}")
    traded = months.where("l_suppkey % 3 = 0").select(F.col("l_suppkey").alias("k"), (F.col("l_suppkey") * 1000.0).alias("traded_value")).distinct()
    return fund_facts(reports, paid, "k", traded).withColumn("value", _r(F.col("value")))


_DIVIDENDS = "SELECT l_suppkey AS k, month AS ex_date, paid / 1000 - 40 * (l_suppkey % 3) AS value, CASE WHEN month(month) % 2 = 0 THEN 'stated' ELSE 'events' END AS source FROM ({reports}) WHERE l_suppkey % 6 <> 5 OR year(month) >= 2000"
_EARNED = "SELECT l_suppkey AS k, make_date(yr, 12, 31) AS period_end, CAST(CASE WHEN l_suppkey % 4 <> 0 THEN tax - discount * (yr % 2) END AS DOUBLE) AS net_income, CAST(qty AS DOUBLE) / 20 AS shares_outstanding FROM ({years}) WHERE (l_suppkey + yr) % 9 <> 0"


@query(f"""
    WITH d AS (SELECT *, year(ex_date) AS yr, max(ex_date) OVER (PARTITION BY k) AS as_of, min(ex_date) OVER (PARTITION BY k) AS since FROM ({_DIVIDENDS.format(reports=_REPORTS)}) WHERE value >= 0),
    s AS (SELECT k, string_agg(DISTINCT source, ',' ORDER BY source) AS source FROM d GROUP BY k),
    y AS (SELECT k, yr, as_of, year(since) AS since, sum(value) AS paid FROM d WHERE yr >= year(as_of) - 4 GROUP BY ALL),
    p AS (SELECT y.*, CASE WHEN paid > 0 AND net_income / nullif(shares_outstanding, 0) <> 0 THEN paid / (net_income / shares_outstanding) END AS payout FROM y LEFT JOIN ({_EARNED.format(years=_SUPPLIER_YEARS)}) AS e ON e.k = y.k AND year(e.period_end) = y.yr),
    g AS (SELECT k, as_of, since, year(as_of) - since + 1 AS history, count(*) FILTER (paid > 0) / (year(as_of) - greatest(since, year(as_of) - 4) + 1) AS frequency, CASE WHEN count(*) FILTER (paid > 0) >= 3 THEN stddev_pop(paid) FILTER (paid > 0) / avg(paid) FILTER (paid > 0) END AS stability,
        CASE WHEN count(*) FILTER (payout >= 0) >= 3 THEN count(*) FILTER (payout >= 0 AND payout <= 1.2) / count(*) FILTER (payout >= 0) END AS lasting FROM p GROUP BY k, as_of, since),
    f AS (SELECT k, as_of, source, unnest([{{'fact': 'dividend_history_years', 'v': CAST(history AS DOUBLE), 'unit': 'years', 'sure': 0.85, 'reason': ''}}, {{'fact': 'dividend_payment_frequency', 'v': frequency, 'unit': 'ratio', 'sure': 0.85, 'reason': ''}},
        {{'fact': 'dividend_stability', 'v': stability, 'unit': 'ratio', 'sure': 0.8, 'reason': 'fewer than 3 years with distributions'}}, {{'fact': 'dividend_payout_sustainability', 'v': lasting, 'unit': 'ratio', 'sure': 0.8, 'reason': 'fewer than 3 years with a payout'}}], recursive := true) FROM g JOIN s USING (k))
    SELECT k, fact, round(v, 6) + 0.0 AS value, unit, CASE WHEN v IS NOT NULL THEN as_of END AS as_of, CASE WHEN v IS NOT NULL THEN CASE WHEN fact = 'dividend_payout_sustainability' THEN 'statements,distributions' ELSE source END END AS source, CAST(CASE WHEN v IS NULL THEN 0 ELSE sure END AS DOUBLE) AS confidence,
        CASE WHEN v IS NULL THEN 'missing' ELSE 'valid' END AS status, CASE WHEN v IS NULL THEN reason END AS reason FROM f
""")
def dividend_fact_table(spark, sf_dir):
    """Four facts of every company's dividends by year against its periods of the same years."""
    _reports(spark, sf_dir).createOrReplaceTempView("tessera_months")
    supplier_years(spark, sf_dir).createOrReplaceTempView("tessera_years")
    paid, periods = spark.sql(_DIVIDENDS.format(reports="SELECT * FROM tessera_months")), spark.sql(_EARNED.format(years="SELECT * FROM tessera_years"))
    return dividend_facts(paid, periods, "k").withColumn("value", _r(F.col("value")))
