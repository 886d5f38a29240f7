"""Facts of monthly reports, yearly periods and prices, each with the SQL it must agree with.

A supplier stands for a fund or company: quantities for shares, prices for values, discounts for what it pays out, line items
for its holders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import text as X
from tessera.operators import frames as R
from tessera.operators.matching import company_match
from tessera.operators.search import merge_directories
from tessera.plans.queries import ORACLE, QUERIES, _MARGINS, _ORDERS, _RATES, _SUPPLIER_YEARS, _margins, _r, _rates, _t, customer_orders, query, supplier_years

__all__ = ["ORACLE", "QUERIES"]  # those of both modules

_REPORTS = """
    SELECT l_suppkey, date_trunc('month', l_shipdate)::DATE AS month, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS shares,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS holders,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS paid FROM lineitem GROUP BY ALL"""


def _reports(spark, sf_dir) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("month")).agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("shares"), F.sum(price).cast("double").alias("total"), F.count("*").alias("holders"), F.sum(price * F.col("l_discount").cast("decimal(4,2)")).cast("double").alias("paid")
    )


@query(f"""
    WITH r AS (SELECT *, total / shares AS nav, row_number() OVER (PARTITION BY l_suppkey ORDER BY month DESC) AS recency FROM ({_REPORTS}) WHERE shares > 0 AND total > 0),
    p AS (SELECT *, lag(shares) OVER w AS prev_shares, lag(nav) OVER w AS prev_nav FROM r WHERE recency <= 60 WINDOW w AS (PARTITION BY l_suppkey ORDER BY month)),
    q AS (SELECT *, CASE WHEN recency <= 35 THEN nav / prev_nav - 1 END AS ret FROM p),
    g AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (shares > 1.02 * prev_shares) AS issues, count(*) FILTER (shares > 1.02 * prev_shares AND nav >= 0.97 * prev_nav) AS preserved,
        datediff('day', min(month), max(month)) AS days, arg_min(holders, month) AS h0, arg_max(holders, month) AS h1, arg_min(nav, month) AS v0, arg_max(nav, month) AS v1,
        count(*) FILTER (recency <= 36) AS n36, avg(paid) FILTER (recency <= 36) AS mean_paid, stddev_pop(paid) FILTER (recency <= 36) AS sd_paid, count(*) FILTER (recency <= 36 AND paid > 0) AS paying,
        count(ret) AS n_ret, stddev_pop(ret) AS sd_ret, count(*) FILTER (ret >= 0) AS up FROM q GROUP BY l_suppkey)
    SELECT l_suppkey, n, round(CASE WHEN n >= 12 THEN CASE WHEN issues = 0 THEN 1.0 ELSE preserved / issues END END, 6) + 0.0 AS issuance_nav_preservation,
        round(CASE WHEN n >= 12 THEN pow(h1 / h0, 365.25 / days) - 1 END, 6) + 0.0 AS holder_growth, round(CASE WHEN n >= 12 THEN pow(v1 / v0, 365.25 / days) - 1 END, 6) + 0.0 AS nav_growth,
        round(CASE WHEN n36 >= 6 AND mean_paid > 0 THEN sd_paid / mean_paid END, 6) + 0.0 AS distribution_stability, round(CASE WHEN n36 >= 6 THEN paying / n36 END, 6) + 0.0 AS positive_distributions,
        round(n_ret / n36, 6) + 0.0 AS report_completeness, round(CASE WHEN n_ret >= 6 THEN sd_ret END, 6) + 0.0 AS nav_return_volatility, round(CASE WHEN n_ret >= 6 THEN up / n_ret END, 6) + 0.0 AS positive_nav_returns FROM g
""")
def report_facts(spark, sf_dir):
    """Facts of the last 60 and 36 monthly reports: two windows over one shuffle by supplier, then one aggregate."""
    r = R.last_n(_reports(spark, sf_dir).where("shares > 0 and total > 0").withColumn("nav", F.col("total") / F.col("shares")), ["l_suppkey"], [F.col("month").desc()], 60)
    p = R.with_previous(r, ["l_suppkey"], [F.col("month").asc()], ["shares", "nav"]).withColumn("ret", F.when(F.col("recency") <= 35, F.col("nav") / F.col("prev_nav") - 1))
    issue, late = F.col("shares") > 1.02 * F.col("prev_shares"), F.col("recency") <= 36
    g = p.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.count(F.when(issue, 1)).alias("issues"), F.count(F.when(issue & (F.col("nav") >= 0.97 * F.col("prev_nav")), 1)).alias("preserved"), F.datediff(F.max("month"), F.min("month")).alias("days"),
        F.min_by("holders", "month").cast("double").alias("h0"), F.max_by("holders", "month").cast("double").alias("h1"), F.min_by("nav", "month").alias("v0"), F.max_by("nav", "month").alias("v1"),
        F.count(F.when(late, 1)).alias("n36"), F.avg(F.when(late, F.col("paid"))).alias("mean_paid"), F.stddev_pop(F.when(late, F.col("paid"))).alias("sd_paid"), F.count(F.when(late & (F.col("paid") > 0), 1)).alias("paying"),
        F.count("ret").alias("n_ret"), F.stddev_pop("ret").alias("sd_ret"), F.count(F.when(F.col("ret") >= 0, 1)).alias("up"),
    )
    n, n36, n_ret = F.col("n"), F.col("n36"), F.col("n_ret")
    return g.select(
        "l_suppkey", "n", _r(N.gated(n, 12, F.when(F.col("issues") == 0, 1.0).otherwise(F.col("preserved") / F.col("issues")))).alias("issuance_nav_preservation"),
        _r(N.gated(n, 12, N.annual_growth(F.col("h0"), F.col("h1"), F.col("days")))).alias("holder_growth"), _r(N.gated(n, 12, N.annual_growth(F.col("v0"), F.col("v1"), F.col("days")))).alias("nav_growth"),
        _r(N.gated(n36, 6, N.ratio_positive(F.col("sd_paid"), F.col("mean_paid")))).alias("distribution_stability"), _r(N.gated(n36, 6, F.col("paying") / n36)).alias("positive_distributions"),
        _r(n_ret / n36).alias("report_completeness"), _r(N.gated(n_ret, 6, F.col("sd_ret"))).alias("nav_return_volatility"), _r(N.gated(n_ret, 6, F.col("up") / n_ret)).alias("positive_nav_returns"),
    )


@query(f"""
    WITH i AS (SELECT yr, product(1 + rate) - 1 AS rate FROM ({_RATES}) GROUP BY yr)
    SELECT l_suppkey, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN avg(CASE WHEN margin >= 0.95 THEN 1.0 ELSE 0.0 END) END, 6) + 0.0 AS frequency
    FROM ({_MARGINS}) JOIN i USING (yr) WHERE margin IS NOT NULL AND (yr IN (1993, 1995) OR rate >= 0.0617) GROUP BY l_suppkey
""")
def stress_year_frequency(spark, sf_dir):
    """Share of good years among stress years: fixed ones and those of a high rate. The rate table has a row a year."""
    rates = _rates(spark, sf_dir).groupBy("yr").agg((F.product(1 + F.col("rate")) - 1).alias("rate"))
    m = _margins(spark, sf_dir).where("margin is not null").join(F.broadcast(rates), "yr").where("yr in (1993, 1995) or rate >= 0.0617")
    return m.groupBy("l_suppkey").agg(F.count("*").alias("n"), _r(N.gated(F.count("*"), 2, F.avg((F.col("margin") >= 0.95).cast("double")))).alias("frequency"))


@query(f"""
    WITH i AS (SELECT yr, product(1 + rate) AS factor FROM ({_RATES}) GROUP BY yr),
    p AS (SELECT l_suppkey, yr, revenue, lag(revenue) OVER (PARTITION BY l_suppkey ORDER BY yr) AS prev FROM ({_MARGINS})),
    g AS (SELECT l_suppkey, revenue / prev / factor - 1 AS growth FROM p JOIN i USING (yr) WHERE prev > 0 AND revenue IS NOT NULL)
    SELECT l_suppkey, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN avg(CASE WHEN growth > 0 THEN 1.0 ELSE 0.0 END) END, 6) + 0.0 AS frequency FROM g GROUP BY l_suppkey
""")
def positive_real_growth_share(spark, sf_dir):
    rates = _rates(spark, sf_dir).groupBy("yr").agg(F.product(1 + F.col("rate")).alias("factor"))
    p = R.with_previous(_margins(spark, sf_dir), ["l_suppkey"], [F.col("yr").asc()], ["revenue"]).where("prev_revenue > 0 and revenue is not null").join(F.broadcast(rates), "yr")
    growth = F.col("revenue") / F.col("prev_revenue") / F.col("factor") - 1
    return p.groupBy("l_suppkey").agg(F.count("*").alias("n"), _r(N.gated(F.count("*"), 3, F.avg((growth > 0).cast("double")))).alias("frequency"))


@query(f"""
    SELECT l_suppkey, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN avg(CASE WHEN margin - 0.95 > 0 THEN 1.0 ELSE 0.0 END) END, 6) + 0.0 AS positive_frequency,
        round(CASE WHEN count(*) >= 2 AND avg(revenue) > 0 THEN stddev_pop(revenue) / avg(revenue) END, 6) + 0.0 AS coefficient_of_variation, round(CASE WHEN count(*) >= 3 THEN median(margin) END, 6) + 0.0 AS median_margin,
        string_agg(CAST(yr AS VARCHAR), ',' ORDER BY yr) AS observed FROM ({_MARGINS}) WHERE margin IS NOT NULL GROUP BY l_suppkey
""")
def observed_values(spark, sf_dir):
    """Facts of a period's observations: the share above zero, variation, median, and the years observed. A few values a key."""
    m = _margins(spark, sf_dir).where("margin is not null")
    n = F.count("*")
    years = F.array_join(F.transform(F.array_sort(F.collect_list("yr")), lambda y: y.cast("string")), ",")
    return m.groupBy("l_suppkey").agg(n.alias("n"), _r(N.gated(n, 3, F.avg((F.col("margin") - 0.95 > 0).cast("double")))).alias("positive_frequency"), _r(N.gated(n, 2, N.ratio_positive(F.stddev_pop("revenue"), F.avg("revenue")))).alias("coefficient_of_variation"), _r(N.gated(n, 3, F.median("margin"))).alias("median_margin"), years.alias("observed"))


_PARTS = f"SELECT l_suppkey, yr, CASE WHEN yr % 3 <> 0 THEN gross END AS total, nullif(revenue, 0) AS a, CASE WHEN yr % 2 = 0 THEN discount END AS b FROM ({_SUPPLIER_YEARS})"


@query(f"""
    SELECT l_suppkey, yr, round(CAST(coalesce(a, 0) + coalesce(b, 0) AS DOUBLE), 4) + 0.0 AS parts, round(coalesce(CAST(total AS DOUBLE), CAST(coalesce(a, 0) + coalesce(b, 0) AS DOUBLE)), 4) + 0.0 AS total,
        CASE WHEN total IS NOT NULL THEN 'total' ELSE 'parts' END AS source FROM ({_PARTS}) WHERE NOT (a IS NULL AND b IS NULL AND total IS NULL)
""")
def total_else_parts(spark, sf_dir):
    """A stated total, else the sum of the parts that are there, with the name of what was taken."""
    y = supplier_years(spark, sf_dir).select("l_suppkey", "yr", F.when(F.col("yr") % 3 != 0, F.col("gross")).alias("total"), F.nullif(F.col("revenue"), F.lit(0)).alias("a"), F.when(F.col("yr") % 2 == 0, F.col("discount")).alias("b"))
    parts = N.sum_any(F.col("a"), F.col("b"))
    return y.where("not (a is null and b is null and total is null)").select("l_suppkey", "yr", _r(parts, 4).alias("parts"), _r(F.coalesce("total", parts), 4).alias("total"), F.when(F.col("total").isNotNull(), "total").otherwise("parts").alias("source"))


@query(f"""
    WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS least FROM ({_ORDERS}) GROUP BY ALL),
    v AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, least) AS place FROM n),
    m AS (SELECT o_custkey, o_orderpriority, day, total, row_number() OVER (PARTITION BY o_custkey, date_trunc('month', day) ORDER BY day DESC, o_orderkey) AS back FROM ({_ORDERS}))
    SELECT m.o_custkey, m.o_orderpriority AS chosen, year(day) * 100 + month(day) AS period, day AS as_of, CAST(total AS DOUBLE) AS total FROM m JOIN v ON v.o_custkey = m.o_custkey AND v.place = 1 AND v.o_orderpriority = m.o_orderpriority WHERE back = 1
""")
def voted_month_ends(spark, sf_dir):
    """The id with most reports is chosen (the first on ties); of each month its last report is kept where it is of that id."""
    o = customer_orders(spark, sf_dir)
    votes = o.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"))
    chosen = R.keep_best(votes, ["o_custkey"], [F.col("n").desc(), F.col("least").asc()]).select("o_custkey", "o_orderpriority")
    ends = R.keep_best(o.withColumn("period", F.year("day") * 100 + F.month("day")), ["o_custkey", "period"], [F.col("day").desc(), F.col("o_orderkey").asc()])
    return ends.join(chosen, ["o_custkey", "o_orderpriority"]).select("o_custkey", F.col("o_orderpriority").alias("chosen"), "period", F.col("day").alias("as_of"), F.col("total").cast("double").alias("total"))


@query(f"""
    WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderpriority DESC, o_orderkey DESC) AS r FROM ({_ORDERS}) WHERE day <= DATE '1997-12-31'),
    s AS (SELECT o_custkey, CAST(sum(total) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS DOUBLE) AS high, CAST(sum(total) AS DOUBLE) AS whole, max(total) FILTER (o_orderstatus = 'P') AS pending FROM ({_ORDERS}) GROUP BY ALL)
    SELECT s.o_custkey, round(CASE WHEN whole > 0 THEN coalesce(high, 0) / whole END, 6) + 0.0 AS high_risk, CAST(pending AS DOUBLE) AS pending, day AS latest_day, CAST(total AS DOUBLE) AS latest FROM s LEFT JOIN f ON f.o_custkey = s.o_custkey AND r = 1
""")
def ratio_and_latest(spark, sf_dir):
    """A conditional ratio of sums, a lookup by code, and the latest value on or before a date, later filings first."""
    o = customer_orders(spark, sf_dir)
    place = F.when(F.col("day") <= F.lit("1997-12-31").cast("date"), F.struct("day", "o_orderpriority", "o_orderkey"))
    high = F.coalesce(F.sum(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("total"))), F.lit(0)).cast("double")
    return o.groupBy("o_custkey").agg(
        _r(N.ratio_positive(high, F.sum("total").cast("double"))).alias("high_risk"), F.max(F.when(F.col("o_orderstatus") == "P", F.col("total"))).cast("double").alias("pending"),
        F.max_by(F.when(place.isNotNull(), F.col("day")), place).alias("latest_day"), F.max_by(F.when(place.isNotNull(), F.col("total")), place).cast("double").alias("latest"),
    )


@query(f"""
    WITH y AS (SELECT l_suppkey, yr, CAST(revenue AS DOUBLE) / CAST(qty AS DOUBLE) AS eps, CAST(gross AS DOUBLE) / CAST(qty AS DOUBLE) AS bvps, CAST(discount AS DOUBLE) / CAST(qty AS DOUBLE) AS dividend FROM ({_SUPPLIER_YEARS}) WHERE qty > 0),
    p AS (SELECT *, 12 * eps AS price, lag(eps) OVER (PARTITION BY l_suppkey ORDER BY yr) AS prev FROM y)
    SELECT l_suppkey, yr, round(price / nullif(eps, 0), 6) + 0.0 AS pe, round(price / nullif(bvps, 0), 6) + 0.0 AS pb, round(100 * coalesce(dividend, 0) / price, 6) + 0.0 AS dividend_yield, round(coalesce(dividend, 0) / 0.06, 6) + 0.0 AS bazin,
        round(CASE WHEN eps > 0 AND bvps > 0 THEN sqrt(22.5 * eps * bvps) END, 6) + 0.0 AS graham, round(CASE WHEN eps > 0 THEN dividend / eps END, 6) + 0.0 AS payout, round(CASE WHEN prev > 0 AND eps > prev THEN (price / eps) / (100 * (eps / prev - 1)) END, 4) + 0.0 AS peg FROM p WHERE price > 0
""")
def opportunity_metrics(spark, sf_dir):
    """Valuation of each year: multiples, yield, and the fair prices of the two usual rules (22.5 x EPS x BVPS; dividend over 6 %)."""
    qty = F.col("qty").cast("double")
    y = supplier_years(spark, sf_dir).where("qty > 0").select("l_suppkey", "yr", (F.col("revenue").cast("double") / qty).alias("eps"), (F.col("gross").cast("double") / qty).alias("bvps"), (F.col("discount").cast("double") / qty).alias("dividend"))
    p = R.with_previous(y.withColumn("price", 12 * F.col("eps")), ["l_suppkey"], [F.col("yr").asc()], ["eps"]).where("price > 0")
    eps, bvps, price, prev, paid = (F.col(c) for c in ("eps", "bvps", "price", "prev_eps", "dividend"))
    fair = N.ratio_nonzero(price, eps) / (100 * (eps / prev - 1))
    return p.select("l_suppkey", "yr", _r(N.ratio_nonzero(price, eps)).alias("pe"), _r(N.ratio_nonzero(price, bvps)).alias("pb"), _r(100 * F.coalesce(paid, F.lit(0.0)) / price).alias("dividend_yield"), _r(F.coalesce(paid, F.lit(0.0)) / 0.06).alias("bazin"), _r(F.when((eps > 0) & (bvps > 0), F.sqrt(22.5 * eps * bvps))).alias("graham"), _r(N.ratio_positive(paid, eps)).alias("payout"), _r(F.when((prev > 0) & (eps > prev), fair), 4).alias("peg"))


@query("""
    WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
    SELECT day, strftime(date_trunc('month', day) - INTERVAL 2 MONTH, '%Y%m') AS two_months_back, strftime(date_trunc('quarter', day) - INTERVAL 3 MONTH, '%Y') || 'Q' || quarter(date_trunc('quarter', day) - INTERVAL 3 MONTH) AS last_quarter,
        CASE WHEN month(day) * 100 + day(day) >= 1130 THEN year(day) * 100 + 9 WHEN month(day) * 100 + day(day) >= 831 THEN year(day) * 100 + 6 WHEN month(day) * 100 + day(day) >= 531 THEN year(day) * 100 + 3 WHEN month(day) * 100 + day(day) >= 331 THEN (year(day) - 1) * 100 + 12 ELSE (year(day) - 1) * 100 + 9 END AS disclosed FROM d
""")
def period_calendar(spark, sf_dir):
    """Months and quarters before a date, and the latest quarter disclosed by then."""
    d = _t(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    back = F.add_months(F.trunc("day", "quarter"), -3)
    at, year = F.month("day") * 100 + F.dayofmonth("day"), F.year("day")
    disclosed = F.when(at >= 1130, year * 100 + 9).when(at >= 831, year * 100 + 6).when(at >= 531, year * 100 + 3).when(at >= 331, (year - 1) * 100 + 12).otherwise((year - 1) * 100 + 9)
    return d.select("day", F.date_format(F.element_at(F.sequence(F.trunc("day", "month"), F.add_months(F.trunc("day", "month"), -11), F.expr("interval -1 month")), 3), "yyyyMM").alias("two_months_back"), F.concat(F.year(back).cast("string"), F.lit("Q"), F.quarter(back).cast("string")).alias("last_quarter"), disclosed.cast("long").alias("disclosed"))


@query("""
    SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, 'money' AS kind, CAST(o_orderdate AS DATE) AS long_day, CAST(o_orderdate AS DATE) AS short_day, CAST(o_orderdate AS DATE) AS iso_day, date_trunc('month', o_orderdate)::DATE AS period,
        round(CAST(o_totalprice AS DECIMAL(18,2)) * CASE o_orderkey % 4 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 WHEN 2 THEN 1000000000 ELSE 1 END, 2)::DECIMAL(38,2) AS scaled, CAST(o_totalprice AS DECIMAL(18,2)) AS plain FROM orders
""")
def parsed_values(spark, sf_dir):
    """Local numbers, magnitudes and dates as text, and what they are read as."""
    amount, day = F.col("o_totalprice").cast("decimal(18,2)"), F.to_date("o_orderdate")
    comma, kind = F.regexp_replace(amount.cast("string"), r"\.", ","), F.element_at(F.array(*map(F.lit, ("", " Mil", " Milhões", " Bilhões"))), F.when(F.col("o_orderkey") % 4 == 3, 1).otherwise((F.col("o_orderkey") % 4 + 2).cast("int")))
    texts = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("R$ "), comma).alias("money"), comma.alias("comma"), F.concat(F.lit("$ "), comma, kind).alias("scaled"), F.date_format(day, "dd/MM/yyyy").alias("d4"), F.date_format(day, "d/M/yy").alias("d2"), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00")).alias("iso"), F.date_format(day, "yyyyMM").alias("code"))
    return texts.select("o_orderkey", X.br_decimal(F.col("money")).cast("decimal(18,2)").alias("amount"), X.inferred(F.col("money"))["value_type"].alias("kind"), X.br_date(F.col("d4")).alias("long_day"), X.br_date(F.col("d2")).alias("short_day"), X.iso_date(F.col("iso")).alias("iso_day"), X.period_date(F.col("code")).alias("period"), X.magnitude_decimal(F.col("scaled")).cast("decimal(38,2)").alias("scaled"), X.comma_decimal(F.col("comma")).cast("decimal(18,2)").alias("plain"))


@query("""
    SELECT n_nationkey, 'BANCO ' || upper(replace(n_name, '_', ' ')) AS tokens, lower(replace(n_name, ' ', '_')) || '_ltda' AS key, substr(upper(replace(n_name, ' ', '')), 1, 4) || '3' AS ticker,
        CASE WHEN length(replace(n_name, ' ', '')) >= 4 THEN 'b3' ELSE 'foreign' END AS market, lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS digits, round(1.2 * (n_nationkey + 1) / 100, 6) + 0.0 AS fee, round(n_nationkey * 365 / 365.25, 6) + 0.0 AS age FROM nation
""")
def normalised_names(spark, sf_dir):
    """Names, keys and tickers made from a nation, brought back to their plain forms; a monthly fee and an age in years."""
    n = F.col("n_name")
    raw = _t(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("Bco "), n, F.lit(" S.A.")).alias("name"), F.concat(F.lower(n), F.lit(" / LTDA.")).alias("label"), F.concat(F.lit(" "), F.lower(F.substring(F.regexp_replace(n, " ", ""), 1, 4)), F.lit("3")).alias("ticker"), F.concat(F.lit("no. "), F.lpad(F.col("n_nationkey").cast("string"), 10, "0")).alias("id"), F.regexp_replace((F.col("n_nationkey") + 1).cast("decimal(6,1)").cast("string"), r"\.", ",").alias("fee"), F.date_add(F.lit("2000-01-01").cast("date"), -365 * F.col("n_nationkey")).alias("since"))
    fee = X.annual_fee(F.col("fee"), percentage_points=True) / 10
    return raw.select("n_nationkey", F.array_join(X.name_tokens(F.col("name")), " ").alias("tokens"), X.label_key(F.col("label")).alias("key"), X.ticker(F.col("ticker")).alias("ticker"), X.market(F.col("ticker")).alias("market"), X.digits(F.col("id")).alias("digits"), _r(fee).alias("fee"), _r(X.age_years(F.col("since"), F.lit("2000-01-01").cast("date"))).alias("age"))


@query("""
    WITH a AS (SELECT s_suppkey, upper(replace(s_name, '#', ' ')) AS name FROM supplier), b AS (SELECT c_custkey, upper(replace(replace(c_name, 'Customer', 'Supplier'), '#', ' ')) AS name FROM customer),
    m AS (SELECT s_suppkey, c_custkey, count(*) OVER (PARTITION BY s_suppkey) AS ties FROM a JOIN b USING (name))
    SELECT s_suppkey, c_custkey, 1 AS tier FROM m WHERE ties = 1
""")
def company_names(spark, sf_dir):
    """Suppliers and customers whose names are equal but for the legal form; a name with several partners has none."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.col("s_name"), F.lit(" S.A.")).alias("name"))
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Cia. "), F.regexp_replace("c_name", "Customer", "Supplier")).alias("name"))
    return company_match(s, c, "s_suppkey", "c_custkey", "name")


@query("""
    WITH r AS (SELECT p_brand, p_partkey AS ordinal, p_type, CASE WHEN p_size % 3 = 0 THEN p_name END AS p_name, CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS confidence FROM part),
    w AS (SELECT *, CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE -1 END AS rank FROM r)
    SELECT p_brand, p_type, arg_max(p_name, rank * 1000000000.0 - ordinal) FILTER (p_name IS NOT NULL) AS p_name, arg_max(confidence, rank * 1000000000.0 - ordinal) FILTER (confidence IS NOT NULL) AS confidence FROM w GROUP BY p_brand, p_type
""")
def merged_directory(spark, sf_dir):
    """One row per key: each field from the most confident row that has it."""
    p = _t(spark, sf_dir, "part").select("p_brand", "p_type", F.col("p_partkey").alias("ordinal"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("p_name"), F.try_element_at(F.create_map(*(F.lit(x) for x in (0, "high", 1, "medium", 2, "low"))), (F.col("p_size") % 4).cast("int")).alias("confidence"))
    return merge_directories(p, ["p_brand", "p_type"], "ordinal", "confidence")
