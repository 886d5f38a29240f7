"""The library's operators as queries over the star-schema tables, each with the SQL it must agree with.

A customer, supplier or segment stands for the entity, a calendar year or month for the period, sums of price and quantity
for the measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import text as X
from tessera.operators import frames as R
from tessera.operators.matching import token_match
from tessera.operators.search import ranked_search

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def _r(c: Column, places: int = 6) -> Column:
    """Rounded to a fixed scale; what rounds to zero is plain zero."""
    return F.round(c.cast("double"), places) + F.lit(0.0)


def supplier_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    price, share = _money("l_extendedprice"), F.col("l_discount").cast("decimal(4,2)")
    return li.groupBy("l_suppkey", F.year("l_shipdate").alias("yr")).agg(F.sum(price).alias("gross"), F.sum(price * (1 - share)).alias("revenue"), F.sum(price * share).alias("discount"), F.sum(price * (1 - share) * F.col("l_tax").cast("decimal(4,2)")).alias("tax"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("qty"))


_SUPPLIER_YEARS = """
    SELECT l_suppkey, year(l_shipdate) AS yr, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS gross,
           sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS revenue,
           sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS discount,
           sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * CAST(l_tax AS DECIMAL(4,2))) AS tax,
           sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty
    FROM lineitem GROUP BY ALL"""


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", _money("o_totalprice").alias("total"), F.to_date("o_orderdate").alias("day"), "o_orderpriority", "o_orderstatus")


_ORDERS = "SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS total, CAST(o_orderdate AS DATE) AS day, o_orderpriority, o_orderstatus FROM orders"


def customer_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_orders(spark, sf_dir).groupBy("o_custkey", F.year("day").alias("yr")).agg(F.sum("total").alias("total"))


_CUSTOMER_YEARS = f"SELECT o_custkey, year(day) AS yr, sum(total) AS total FROM ({_ORDERS}) GROUP BY ALL"


@query(f"""
    WITH y AS ({_SUPPLIER_YEARS}),
    w AS (SELECT l_suppkey, yr, CAST(revenue AS DOUBLE) / nullif(CAST(gross AS DOUBLE), 0) AS net_margin, CAST(discount AS DOUBLE) / nullif(CAST(gross AS DOUBLE), 0) AS discount_ratio,
                 CASE WHEN revenue > 0 THEN CAST(tax AS DOUBLE) / CAST(revenue AS DOUBLE) END AS tax_ratio, CASE WHEN qty > 0 THEN CAST(revenue AS DOUBLE) / CAST(qty AS DOUBLE) END AS revenue_per_unit FROM y)
    SELECT l_suppkey, yr, fact, round(value, 6) + 0.0 AS value, unit, CASE WHEN value IS NULL THEN 'missing' ELSE 'valid' END AS status FROM (
        SELECT l_suppkey, yr, 'net_margin' AS fact, net_margin AS value, 'ratio' AS unit FROM w UNION ALL SELECT l_suppkey, yr, 'discount_ratio', discount_ratio, 'ratio' FROM w
        UNION ALL SELECT l_suppkey, yr, 'tax_ratio', tax_ratio, 'ratio' FROM w UNION ALL SELECT l_suppkey, yr, 'revenue_per_unit', revenue_per_unit, 'money' FROM w)
""")
def profit_ratio_facts(spark, sf_dir):
    y = supplier_years(spark, sf_dir).select("l_suppkey", "yr", *(F.col(c).cast("double").alias(c) for c in ("gross", "revenue", "discount", "tax", "qty")))
    c = F.col
    facts = [("net_margin", N.ratio_nonzero(c("revenue"), c("gross")), "ratio"), ("discount_ratio", N.ratio_nonzero(c("discount"), c("gross")), "ratio"), ("tax_ratio", N.ratio_positive(c("tax"), c("revenue")), "ratio"), ("revenue_per_unit", N.per_share(c("revenue"), c("qty")), "money")]
    return R.inline_facts(y, ["l_suppkey", "yr"], facts).withColumn("value", _r(c("value")))


@query(f"""
    SELECT o_custkey, month, o_orderkey, CAST(total AS DOUBLE) AS total, o_orderstatus FROM (
        SELECT *, date_trunc('month', day)::DATE AS month, row_number() OVER (PARTITION BY o_custkey, date_trunc('month', day) ORDER BY (o_orderstatus = 'F') DESC, day DESC, total DESC, o_orderkey) AS rn FROM ({_ORDERS})) WHERE rn = 1
""")
def latest_version_per_key(spark, sf_dir):
    o = customer_orders(spark, sf_dir).withColumn("month", F.trunc("day", "month"))
    best = R.keep_best(o, ["o_custkey", "month"], [(F.col("o_orderstatus") == "F").desc(), F.col("day").desc(), F.col("total").desc(), F.col("o_orderkey").asc()])
    return best.select("o_custkey", "month", "o_orderkey", F.col("total").cast("double").alias("total"), "o_orderstatus")


@query(f"""
    WITH o AS ({_ORDERS}), latest AS (SELECT o_custkey, max(day) AS last_day FROM o GROUP BY o_custkey)
    SELECT o_custkey, last_day, CAST(ytd AS DOUBLE) AS ytd, CAST(prior_annual AS DOUBLE) AS prior_annual, CAST(prior_ytd AS DOUBLE) AS prior_ytd, CAST(ytd + prior_annual - prior_ytd AS DOUBLE) AS ttm FROM (
        SELECT o_custkey, last_day, sum(total) FILTER (year(day) = year(last_day)) AS ytd, sum(total) FILTER (year(day) = year(last_day) - 1) AS prior_annual,
               sum(total) FILTER (year(day) = year(last_day) - 1 AND day <= last_day - INTERVAL 1 YEAR) AS prior_ytd
        FROM o JOIN latest USING (o_custkey) GROUP BY ALL)
""")
def ttm_flow(spark, sf_dir):
    o = customer_orders(spark, sf_dir).withColumn("last_day", F.max("day").over(Window.partitionBy("o_custkey")))
    year, last = F.year("day"), F.year("last_day")
    sums = o.groupBy("o_custkey", "last_day").agg(F.sum(F.when(year == last, F.col("total"))).alias("ytd"), F.sum(F.when(year == last - 1, F.col("total"))).alias("prior_annual"), F.sum(F.when((year == last - 1) & (F.col("day") <= F.add_months("last_day", -12)), F.col("total"))).alias("prior_ytd"))
    return sums.select("o_custkey", "last_day", *(F.col(c).cast("double").alias(c) for c in ("ytd", "prior_annual", "prior_ytd")), (F.col("ytd") + F.col("prior_annual") - F.col("prior_ytd")).cast("double").alias("ttm"))


def _events(spark, sf_dir, kind):
    return _t(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id", "event_id", "ts", "value")


_VIEWS = "SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = '{}' GROUP BY ALL"


def _one_per_time(df):
    return R.keep_best(df, ["user_id", "ts"], [F.col("event_id").desc()]).select("user_id", "ts", "value")


@query(f"""
    SELECT p.event_id, p.user_id, p.ts, v.ts AS matched_at, v.value AS value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN ({_VIEWS.format("view")}) v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def asof_quote(spark, sf_dir):
    targets = _events(spark, sf_dir, "purchase").select("event_id", "user_id", "ts")
    return R.asof_latest(targets, _one_per_time(_events(spark, sf_dir, "view")), ["user_id"], "ts", "ts", ["value"])


@query(f"""
    WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
    a AS (SELECT p.*, v.ts AS at1, v.value AS v1 FROM p ASOF LEFT JOIN ({_VIEWS.format("view")}) v ON p.user_id = v.user_id AND p.ts >= v.ts),
    b AS (SELECT a.*, c.ts AS at2, c.value AS v2 FROM a ASOF LEFT JOIN ({_VIEWS.format("click")}) c ON a.user_id = c.user_id AND a.ts >= c.ts)
    SELECT event_id, user_id, ts, CASE WHEN at1 >= ts - INTERVAL 7 DAY THEN 1 WHEN at2 >= ts - INTERVAL 7 DAY THEN 2 END AS source,
           CASE WHEN at1 >= ts - INTERVAL 7 DAY THEN at1 WHEN at2 >= ts - INTERVAL 7 DAY THEN at2 END AS reference,
           CASE WHEN at1 >= ts - INTERVAL 7 DAY THEN v1 WHEN at2 >= ts - INTERVAL 7 DAY THEN v2 END AS value FROM b
""")
def bounded_priority_asof(spark, sf_dir):
    targets = _events(spark, sf_dir, "purchase").select("event_id", "user_id", "ts")
    sources = [(_one_per_time(_events(spark, sf_dir, k)), n) for n, k in ((1, "view"), (2, "click"))]
    return R.asof_bounded_priority(targets, sources, ["user_id"], "ts", "ts", "value", 7)


@query(f"""
    SELECT l_suppkey, first_year, last_year, n_years, round(CASE WHEN n_years >= 3 AND first_rev > 0 AND last_rev > 0 THEN pow(CAST(last_rev AS DOUBLE) / CAST(first_rev AS DOUBLE), 365.25 / datediff('day', make_date(first_year, 12, 31), make_date(last_year, 12, 31))) - 1 END, 6) + 0.0 AS cagr FROM (
        SELECT l_suppkey, min(yr) AS first_year, max(yr) AS last_year, count(*) AS n_years, arg_min(revenue, yr) AS first_rev, arg_max(revenue, yr) AS last_rev FROM ({_SUPPLIER_YEARS}) GROUP BY l_suppkey)
""")
def cagr_growth(spark, sf_dir):
    g = supplier_years(spark, sf_dir).groupBy("l_suppkey").agg(F.min("yr").alias("first_year"), F.max("yr").alias("last_year"), F.count("*").alias("n_years"), F.min_by("revenue", "yr").cast("double").alias("a"), F.max_by("revenue", "yr").cast("double").alias("b"))
    days = F.datediff(F.make_date("last_year", F.lit(12), F.lit(31)), F.make_date("first_year", F.lit(12), F.lit(31)))
    return g.select("l_suppkey", "first_year", "last_year", "n_years", _r(N.gated(F.col("n_years"), 3, N.annual_growth(F.col("a"), F.col("b"), days))).alias("cagr"))


_MARGINS = f"SELECT l_suppkey, yr, CAST(revenue AS DOUBLE) / nullif(CAST(gross AS DOUBLE), 0) AS margin, CAST(revenue AS DOUBLE) AS revenue FROM ({_SUPPLIER_YEARS})"


def _margins(spark, sf_dir):
    y = supplier_years(spark, sf_dir)
    return y.select("l_suppkey", "yr", N.ratio_nonzero(F.col("revenue").cast("double"), F.col("gross").cast("double")).alias("margin"), F.col("revenue").cast("double").alias("revenue"))


@query(f"SELECT l_suppkey, round(CASE WHEN count(margin) >= 3 THEN stddev_pop(margin) END, 6) + 0.0 AS volatility FROM ({_MARGINS}) GROUP BY l_suppkey")
def volatility_pop(spark, sf_dir):
    return _margins(spark, sf_dir).groupBy("l_suppkey").agg(_r(N.gated(F.count("margin"), 3, F.stddev_pop("margin"))).alias("volatility"))


@query(f"SELECT l_suppkey, round(CASE WHEN count(margin) >= 3 THEN avg(CASE WHEN margin >= 0.95 THEN 1.0 ELSE 0.0 END) FILTER (margin IS NOT NULL) END, 6) + 0.0 AS frequency FROM ({_MARGINS}) GROUP BY l_suppkey")
def threshold_frequency(spark, sf_dir):
    m = _margins(spark, sf_dir).where("margin is not null")
    return m.groupBy("l_suppkey").agg(_r(N.gated(F.count("margin"), 3, F.avg((F.col("margin") >= 0.95).cast("double")))).alias("frequency"))


@query(f"""
    WITH d AS (SELECT l_suppkey, yr, revenue - lag(revenue) OVER (PARTITION BY l_suppkey ORDER BY yr) AS change FROM ({_MARGINS}))
    SELECT l_suppkey, round(CASE WHEN count(change) >= 3 THEN avg(CASE WHEN change > 0 THEN 1.0 ELSE 0.0 END) FILTER (change IS NOT NULL) END, 6) + 0.0 AS frequency FROM d GROUP BY l_suppkey
""")
def positive_frequency(spark, sf_dir):
    d = R.with_previous(_margins(spark, sf_dir), ["l_suppkey"], [F.col("yr").asc()], ["revenue"]).withColumn("change", F.col("revenue") - F.col("prev_revenue"))
    return d.groupBy("l_suppkey").agg(_r(N.gated(F.count("change"), 3, F.avg(F.when(F.col("change").isNotNull(), (F.col("change") > 0).cast("double"))))).alias("frequency"))


_CUSTOMER_VALUES = f"SELECT c_custkey, c_mktsegment, CAST(sum(total) AS DOUBLE) AS spent FROM customer JOIN ({_ORDERS}) ON c_custkey = o_custkey GROUP BY ALL"


def _customer_values(spark, sf_dir):
    spent = customer_orders(spark, sf_dir).groupBy("o_custkey").agg(F.sum("total").cast("double").alias("spent"))
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return c.join(spent, c["c_custkey"] == spent["o_custkey"]).select("c_custkey", "c_mktsegment", "spent")


@query(f"""
    WITH v AS ({_CUSTOMER_VALUES}), m AS (SELECT c_mktsegment, median(spent) AS mid, count(*) AS n FROM v WHERE spent > 0 GROUP BY c_mktsegment)
    SELECT c_custkey, v.c_mktsegment, round(CASE WHEN n >= 3 AND mid <> 0 THEN spent / mid END, 6) + 0.0 AS ratio FROM v LEFT JOIN m ON v.c_mktsegment = m.c_mktsegment
""")
def median_peer_ratio(spark, sf_dir):
    v = _customer_values(spark, sf_dir)
    m = R.exact_median(v.where("spent > 0"), ["c_mktsegment"], "spent", "mid")
    return v.join(m, "c_mktsegment", "left").select("c_custkey", "c_mktsegment", _r(N.gated(F.col("n"), 3, N.ratio_nonzero(F.col("spent"), F.col("mid")))).alias("ratio"))


@query(f"""
    SELECT c_mktsegment, count(*) AS sample_size, round(CASE WHEN count(*) >= 3 THEN median(spent) END, 4) + 0.0 AS median_spent, round(CASE WHEN count(*) >= 3 THEN median(c_acctbal) FILTER (c_acctbal > 0) END, 4) + 0.0 AS median_balance
    FROM ({_CUSTOMER_VALUES}) JOIN (SELECT c_custkey, c_acctbal FROM customer) USING (c_custkey) GROUP BY c_mktsegment
""")
def peer_group_medians(spark, sf_dir):
    v = _customer_values(spark, sf_dir).join(_t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    spent = R.exact_median(v, ["c_mktsegment"], "spent", "mid_spent").drop("n")
    balance = R.exact_median(v.where("c_acctbal > 0"), ["c_mktsegment"], "c_acctbal", "mid_balance").drop("n")
    m = v.groupBy("c_mktsegment").agg(F.count("*").alias("sample_size")).join(spent, "c_mktsegment", "left").join(balance, "c_mktsegment", "left")
    return m.select("c_mktsegment", "sample_size", *(_r(N.gated(F.col("sample_size"), 3, F.col(f"mid_{c}")), 4).alias(f"median_{c}") for c in ("spent", "balance")))


@query(f"SELECT c_custkey, c_mktsegment, round(spent / sum(spent) FILTER (spent > 0) OVER (PARTITION BY c_mktsegment), 9) + 0.0 AS share FROM ({_CUSTOMER_VALUES})")
def sector_revenue_share(spark, sf_dir):
    v = _customer_values(spark, sf_dir)
    total = v.where("spent > 0").groupBy("c_mktsegment").agg(F.sum("spent").alias("total"))
    return v.join(total, "c_mktsegment", "left").select("c_custkey", "c_mktsegment", _r(N.ratio_nonzero(F.col("spent"), F.col("total")), 9).alias("share"))


_WEIGHTS = """
    SELECT s_nationkey, s_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gross FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY ALL"""


def _weights(spark, sf_dir):
    g = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(_money("l_extendedprice")).cast("double").alias("gross"))
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = s.join(g, s["s_suppkey"] == g["l_suppkey"]).select("s_nationkey", "s_suppkey", "gross")
    return rows.withColumn("weight", F.col("gross") / F.sum("gross").over(Window.partitionBy("s_nationkey")))


@query(f"SELECT s_nationkey, count(*) AS holdings, round(sum(w * w), 9) + 0.0 AS hhi FROM (SELECT s_nationkey, gross / sum(gross) OVER (PARTITION BY s_nationkey) AS w FROM ({_WEIGHTS})) GROUP BY s_nationkey")
def hhi_concentration(spark, sf_dir):
    return _weights(spark, sf_dir).groupBy("s_nationkey").agg(F.count("*").alias("holdings"), _r(F.sum(F.col("weight") * F.col("weight")), 9).alias("hhi"))


@query(f"SELECT s_nationkey, round(sum(w) FILTER (rn <= 10), 9) + 0.0 AS top_ten FROM (SELECT s_nationkey, gross / sum(gross) OVER (PARTITION BY s_nationkey) AS w, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM ({_WEIGHTS})) GROUP BY s_nationkey")
def top_ten_share(spark, sf_dir):
    """The first ten in the source's order, not the ten largest."""
    return R.last_n(_weights(spark, sf_dir), ["s_nationkey"], [F.col("s_suppkey").asc()], 10).groupBy("s_nationkey").agg(_r(F.sum("weight"), 9).alias("top_ten"))


_SEGMENT_MONTHS = f"SELECT c_mktsegment, date_trunc('month', day)::DATE AS month, CAST(sum(total) AS DOUBLE) AS total FROM customer JOIN ({_ORDERS}) ON c_custkey = o_custkey GROUP BY ALL"


def _segment_months(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    o = customer_orders(spark, sf_dir)
    return o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_mktsegment", F.trunc("day", "month").alias("month")).agg(F.sum("total").cast("double").alias("total"))


@query(f"""
    WITH p AS (SELECT *, max(total) OVER (PARTITION BY c_mktsegment ORDER BY month) AS peak FROM ({_SEGMENT_MONTHS}))
    SELECT c_mktsegment, count(*) AS months, round(CASE WHEN count(*) >= 6 THEN max(CASE WHEN peak > 0 THEN (peak - total) / peak END) END, 9) + 0.0 AS max_drawdown FROM p GROUP BY c_mktsegment
""")
def max_drawdown(spark, sf_dir):
    d = R.with_drawdown(_segment_months(spark, sf_dir), ["c_mktsegment"], [F.col("month").asc()], "total")
    return d.groupBy("c_mktsegment").agg(F.count("*").alias("months"), _r(N.gated(F.count("*"), 6, F.max("drawdown")), 9).alias("max_drawdown"))


@query(f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey DESC) AS rn FROM ({_ORDERS}))
    SELECT o_custkey, CASE WHEN count(*) >= 3 THEN median(CAST(total AS DOUBLE)) FILTER (rn <= 3) END AS last3, CASE WHEN count(*) >= 6 THEN median(CAST(total AS DOUBLE)) FILTER (rn <= 6) END AS last6 FROM r GROUP BY o_custkey
""")
def last_n_median(spark, sf_dir):
    r = R.last_n(customer_orders(spark, sf_dir), ["o_custkey"], [F.col("day").desc(), F.col("o_orderkey").desc()], 6)
    total, n = F.col("total").cast("double"), F.count("*")
    return r.groupBy("o_custkey").agg(N.gated(n, 3, F.median(F.when(F.col("recency") <= 3, total))).alias("last3"), N.gated(n, 6, F.median(total)).alias("last6"))


@query(f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey DESC) AS recency FROM ({_ORDERS})),
    k AS (SELECT o_custkey, total, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY recency DESC) AS pos FROM r WHERE recency <= 36)
    SELECT o_custkey, n, round(CASE WHEN n >= 12 AND a > 0 THEN b / a - 1 END, 6) + 0.0 AS growth FROM (
        SELECT o_custkey, n, CAST(sum(total) FILTER (pos <= n // 2) AS DOUBLE) / (n // 2) AS a, CAST(sum(total) FILTER (pos > n // 2) AS DOUBLE) / (n - n // 2) AS b FROM k WHERE n >= 2 GROUP BY o_custkey, n)
""")
def half_over_half_growth(spark, sf_dir):
    r = R.last_n(customer_orders(spark, sf_dir), ["o_custkey"], [F.col("day").desc(), F.col("o_orderkey").desc()], 36)
    w = Window.partitionBy("o_custkey")
    k = r.withColumns({"n": F.count("*").over(w), "pos": F.row_number().over(w.orderBy(F.col("recency").desc()))}).where("n >= 2")
    half = F.expr("n div 2")
    g = k.groupBy("o_custkey", "n").agg(F.sum(F.when(F.col("pos") <= half, F.col("total"))).cast("double").alias("a"), F.sum(F.when(F.col("pos") > half, F.col("total"))).cast("double").alias("b"))
    a, b = F.col("a") / half, F.col("b") / (F.col("n") - half)
    return g.select("o_custkey", "n", _r(N.gated(F.col("n"), 12, F.when(a > 0, b / a - 1))).alias("growth"))


@query(f"""
    WITH p AS (SELECT *, lag(total) OVER (PARTITION BY c_mktsegment ORDER BY month) AS prev FROM ({_SEGMENT_MONTHS}))
    SELECT c_mktsegment, count(*) FILTER (prev > 0) AS pairs, round(avg(CASE WHEN total < 0.9 * prev THEN 1.0 ELSE 0.0 END) FILTER (prev > 0), 9) + 0.0 AS cuts FROM p GROUP BY c_mktsegment
""")
def cut_frequency(spark, sf_dir):
    p = R.with_previous(_segment_months(spark, sf_dir), ["c_mktsegment"], [F.col("month").asc()], ["total"]).withColumn("is_pair", F.col("prev_total") > 0)
    return p.groupBy("c_mktsegment").agg(F.count(F.when(F.col("is_pair"), 1)).alias("pairs"), _r(F.avg(F.when(F.col("is_pair"), (F.col("total") < 0.9 * F.col("prev_total")).cast("double"))), 9).alias("cuts"))


@query(f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey DESC) AS recency FROM ({_ORDERS})),
    p AS (SELECT o_custkey, o_orderpriority, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY recency DESC) AS prev FROM r WHERE recency <= 60)
    SELECT o_custkey, count(*) AS n, CASE WHEN count(*) >= 12 THEN greatest(0.0, 1 - 0.5 * count(*) FILTER (prev <> o_orderpriority))::DOUBLE END AS stability FROM p GROUP BY o_custkey
""")
def change_stability(spark, sf_dir):
    r = R.last_n(customer_orders(spark, sf_dir), ["o_custkey"], [F.col("day").desc(), F.col("o_orderkey").desc()], 60)
    p = R.with_previous(r, ["o_custkey"], [F.col("recency").desc()], ["o_orderpriority"])
    changes = F.count(F.when(F.col("prev_o_orderpriority") != F.col("o_orderpriority"), 1))
    return p.groupBy("o_custkey").agg(F.count("*").alias("n"), N.gated(F.count("*"), 12, F.greatest(F.lit(0.0), 1 - 0.5 * changes)).alias("stability"))


@query(f"SELECT o_custkey, count(DISTINCT year(day) * 12 + month(day)) AS months, round(CASE WHEN count(*) >= 6 THEN count(DISTINCT year(day) * 12 + month(day)) / (max(year(day) * 12 + month(day)) - min(year(day) * 12 + month(day)) + 1)::DOUBLE END, 9) + 0.0 AS regularity FROM ({_ORDERS}) GROUP BY o_custkey")
def reporting_regularity(spark, sf_dir):
    m = F.year("day") * 12 + F.month("day")
    o = customer_orders(spark, sf_dir).withColumn("m", m)
    distinct = F.count_distinct("m")
    return o.groupBy("o_custkey").agg(distinct.alias("months"), _r(N.gated(F.count("*"), 6, distinct / (F.max("m") - F.min("m") + 1)), 9).alias("regularity"))


_RATES = "SELECT year(l_shipdate) AS yr, month(l_shipdate) AS mo, CAST(avg(CAST(l_discount AS DECIMAL(6,4))) AS DOUBLE) / 10 AS rate FROM lineitem GROUP BY ALL"


def _rates(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("yr"), F.month("l_shipdate").alias("mo")).agg(F.sum(F.col("l_discount").cast("decimal(6,4)")).cast("double").alias("s"), F.count("l_discount").alias("n"))
    return li.select("yr", "mo", (F.col("s") / F.col("n") / 10).alias("rate"))


@query(f"SELECT yr, count(*) AS months, round(product(1 + rate) - 1, 9) + 0.0 AS compounded FROM ({_RATES}) GROUP BY yr")
def yearly_compounding(spark, sf_dir):
    return _rates(spark, sf_dir).groupBy("yr").agg(F.count("*").alias("months"), _r(F.product(1 + F.col("rate")) - 1, 9).alias("compounded"))


@query(f"SELECT yr, round(avg(rate), 9) + 0.0 AS average FROM ({_RATES}) GROUP BY yr")
def yearly_average(spark, sf_dir):
    return _rates(spark, sf_dir).groupBy("yr").agg(_r(F.avg("rate"), 9).alias("average"))


@query(f"""
    WITH y AS ({_SUPPLIER_YEARS}), i AS (SELECT yr, product(1 + rate) AS factor FROM ({_RATES}) GROUP BY yr),
    e AS (SELECT l_suppkey, min(yr) AS a, max(yr) AS b, CAST(arg_min(revenue, yr) AS DOUBLE) AS ra, CAST(arg_max(revenue, yr) AS DOUBLE) AS rb, count(*) AS n FROM y GROUP BY l_suppkey),
    f AS (SELECT l_suppkey, product(factor) AS deflator, count(*) AS matched FROM e JOIN i ON i.yr > e.a AND i.yr <= e.b GROUP BY l_suppkey)
    SELECT l_suppkey, round(CASE WHEN n >= 3 AND matched >= 2 AND ra > 0 AND rb > 0 THEN pow(rb / deflator / ra, 1.0 / (b - a)) - 1 END, 6) + 0.0 AS real_growth FROM e LEFT JOIN f USING (l_suppkey)
""")
def real_growth(spark, sf_dir):
    """Revenue growth a year, net of the compounded yearly rate: the rate table has a row a year, so it is broadcast."""
    rates = _rates(spark, sf_dir).groupBy("yr").agg(F.product(1 + F.col("rate")).alias("factor"))
    y = supplier_years(spark, sf_dir).select("l_suppkey", "yr", F.col("revenue").cast("double").alias("revenue")).join(F.broadcast(rates), "yr", "left")
    w = Window.partitionBy("l_suppkey")
    ends = y.groupBy("l_suppkey").agg(F.min("yr").alias("a"), F.max("yr").alias("b"), F.min_by("revenue", "yr").alias("ra"), F.max_by("revenue", "yr").alias("rb"), F.count("*").alias("n"))
    spans = ends.select("l_suppkey", F.explode(F.sequence(F.col("a"), F.col("b"))).alias("yr"), F.col("a")).where("yr > a").join(F.broadcast(rates), "yr").groupBy("l_suppkey").agg(F.product("factor").alias("deflator"), F.count("*").alias("matched"))
    c = F.col
    growth = F.pow(c("rb") / c("deflator") / c("ra"), 1.0 / (c("b") - c("a"))) - 1
    return ends.join(spans, "l_suppkey", "left").select("l_suppkey", _r(F.when((c("n") >= 3) & (c("matched") >= 2) & (c("ra") > 0) & (c("rb") > 0), growth)).alias("real_growth"))


@query(f"""
    WITH y AS (SELECT l_suppkey, yr, CAST(qty AS DOUBLE) AS qty, lead(CAST(qty AS DOUBLE)) OVER (PARTITION BY l_suppkey ORDER BY yr) AS nxt FROM ({_SUPPLIER_YEARS})),
    f AS (SELECT *, coalesce(CASE {" ".join(f"WHEN abs(nxt / qty / {f!r} - 1) <= 0.06 THEN {f!r}" for x in (1.5, 2.0, 3.0, 4.0, 5.0, 10.0) for f in (x, 1 / x))} END, 1.0) AS factor FROM y)
    SELECT l_suppkey, yr, round(qty * coalesce(product(factor) OVER (PARTITION BY l_suppkey ORDER BY yr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 4) + 0.0 AS adjusted FROM f
""")
def cumulative_split_adjust(spark, sf_dir):
    y = supplier_years(spark, sf_dir).select("l_suppkey", "yr", F.col("qty").cast("double").alias("qty"))
    y = y.withColumn("factor", N.nearest_factor(F.lead("qty").over(Window.partitionBy("l_suppkey").orderBy("yr")) / F.col("qty")))
    p = R.reverse_product(y, ["l_suppkey"], [F.col("yr").asc()], "factor", "later")
    return p.select("l_suppkey", "yr", _r(F.col("qty") * F.col("factor") * F.col("later"), 4).alias("adjusted"))


@query(f"""
    WITH y AS ({_CUSTOMER_YEARS}), e AS (SELECT o_custkey, greatest(min(yr), max(yr) - 4) AS a, max(yr) AS b FROM y GROUP BY o_custkey),
    g AS (SELECT o_custkey, unnest(generate_series(a, b)) AS yr FROM e)
    SELECT o_custkey, g.yr, CAST(coalesce(total, 0) AS DOUBLE) AS total FROM g LEFT JOIN y USING (o_custkey, yr)
""")
def dividend_year_frame(spark, sf_dir):
    y = customer_years(spark, sf_dir)
    ends = y.groupBy("o_custkey").agg(F.min("yr").alias("a"), F.max("yr").alias("b"))
    frame = ends.select("o_custkey", F.explode(F.sequence(F.greatest(F.col("a"), F.col("b") - 4), F.col("b"))).alias("yr"))
    return frame.join(y, ["o_custkey", "yr"], "left").select("o_custkey", F.col("yr").cast("long").alias("yr"), F.coalesce("total", F.lit(0)).cast("double").alias("total"))


@query("""
    WITH l AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS lines FROM lineitem GROUP BY l_orderkey),
    e AS (SELECT year(o_orderdate) AS yr, abs(o_totalprice - lines) / greatest(abs(o_totalprice), abs(lines), 1e-6) AS err FROM orders JOIN l ON o_orderkey = l_orderkey)
    SELECT yr, count(*) AS matches, round(CASE WHEN count(*) >= 6 THEN median(err) END, 9) + 0.0 AS error FROM e GROUP BY yr
""")
def consistency_error(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(_money("l_extendedprice")).cast("double").alias("lines"))
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("yr"))
    e = o.join(lines, o["o_orderkey"] == lines["l_orderkey"]).select("yr", N.relative_error(F.col("o_totalprice"), F.col("lines")).alias("err"))
    counts, middle = e.groupBy("yr").agg(F.count("*").alias("matches")), R.exact_median(e, ["yr"], "err", "mid").drop("n")
    return counts.join(middle, "yr", "left").select("yr", "matches", _r(N.gated(F.col("matches"), 6, F.col("mid")), 9).alias("error"))


# The plausible range of each ratio, both ends included.
RANGES = [("net_margin", 0.945, 1.0), ("discount_ratio", 0.0, 0.055), ("tax_ratio", 0.0, 0.042)]


@query("WITH f AS (" + ORACLE["profit_ratio_facts"] + "), r(fact, low, high) AS (VALUES " + ", ".join(f"('{a}', {b!r}::DOUBLE, {c!r}::DOUBLE)" for a, b, c in RANGES) + """)
    SELECT l_suppkey, yr, f.fact, CASE WHEN low IS NULL OR value BETWEEN low AND high THEN value END AS value, CASE WHEN low IS NULL OR value IS NULL OR value BETWEEN low AND high THEN status ELSE 'implausible' END AS status FROM f LEFT JOIN r ON f.fact = r.fact
""")
def plausibility_filter(spark, sf_dir):
    ranges = F.broadcast(spark.createDataFrame(RANGES, "fact string, low double, high double"))
    f = profit_ratio_facts(spark, sf_dir).join(ranges, "fact", "left")
    fits = F.col("low").isNull() | F.col("value").between(F.col("low"), F.col("high"))
    return f.select("l_suppkey", "yr", "fact", F.when(fits, F.col("value")).alias("value"), F.when(fits | F.col("value").isNull(), F.col("status")).otherwise("implausible").alias("status"))


_DAILY = "SELECT CAST(ts AS DATE) AS day, count(*) AS n, '{0}' AS source FROM events WHERE event_type = '{0}' GROUP BY ALL"


@query(f"WITH a AS ({_DAILY.format('purchase')}), b AS ({_DAILY.format('view')}) SELECT * FROM a UNION ALL SELECT * FROM b WHERE day NOT IN (SELECT day FROM a)")
def priority_merge(spark, sf_dir):
    def daily(kind):
        return _t(spark, sf_dir, "events").where(F.col("event_type") == kind).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).withColumn("source", F.lit(kind))

    return R.priority_merge(daily("purchase"), daily("view"), ["day"])


_USER_DAYS = "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, '{0}' AS source FROM events WHERE event_type = '{0}' GROUP BY ALL"


@query(f"WITH a AS ({_USER_DAYS.format('purchase')}), b AS ({_USER_DAYS.format('view')}) SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.day IS NOT DISTINCT FROM b.day AND a.user_id IS NOT DISTINCT FROM b.user_id)")
def priority_merge_users(spark, sf_dir):
    """Whole sources, whose keys differ: a user's purchases of a day, else the views of that day."""
    def daily(kind):
        return _t(spark, sf_dir, "events").where(F.col("event_type") == kind).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).withColumn("source", F.lit(kind))

    return R.priority_merge(daily("purchase"), daily("view"), ["user_id", "day"])


@query("SELECT c_custkey, 'no finished order in 1997' AS reason FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'F' AND year(o_orderdate) = 1997)")
def anti_join_unavailable(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer").select("c_custkey"), _t(spark, sf_dir, "orders").where("o_orderstatus = 'F' and year(o_orderdate) = 1997").select("o_custkey")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").withColumn("reason", F.lit("no finished order in 1997"))


@query("""
    SELECT p_partkey, p_name, p_brand, match_rank FROM (SELECT p_partkey, p_name, p_brand,
        CASE WHEN upper(p_name) = 'RED' THEN 0 WHEN upper(p_name) LIKE 'RED%' THEN 1 WHEN upper(p_brand) LIKE 'RED%' THEN 2 ELSE 5 END AS match_rank FROM part
        WHERE contains(upper(p_name), 'RED') OR contains(upper(p_brand), 'RED'))
    ORDER BY match_rank, length(p_name), p_name, p_partkey LIMIT 50
""")
def ranked_search_parts(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return ranked_search(p, "red", exact="p_name", prefix=["p_name", "p_brand"], tie=["p_partkey"], limit=50)


@query("""
    WITH t AS (SELECT s_suppkey, string_split(upper(regexp_replace(s_name, '[^A-Za-z0-9]+', ' ', 'g')), ' ') AS tokens FROM supplier),
    c AS (SELECT c_custkey, string_split(upper(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g')), ' ') AS tokens FROM customer),
    a AS (SELECT s_suppkey, unnest(tokens) AS token FROM t), b AS (SELECT c_custkey, unnest(tokens) AS token FROM c),
    m AS (SELECT s_suppkey, c_custkey, count(DISTINCT a.token) AS overlap FROM a JOIN b ON a.token = b.token GROUP BY ALL),
    best AS (SELECT *, count(*) OVER (PARTITION BY s_suppkey) AS ties FROM (SELECT *, max(overlap) OVER (PARTITION BY s_suppkey) AS top FROM m) WHERE overlap = top)
    SELECT s_suppkey, c_custkey, overlap FROM best WHERE ties = 1
""")
def token_match_names(spark, sf_dir):
    """Suppliers and customers whose names share most tokens, where one partner alone does."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return token_match(s, c, "s_suppkey", "c_custkey", "name", least=1)


@query("""
    SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(source), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS source_key,
           length(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v\\x{A0}]+', ' ', 'g'))) AS squeezed FROM documents
""")
def normalize_keys(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", X.label_key(F.col("source")).alias("source_key"), F.length(X.squeeze(F.col("text"))).cast("long").alias("squeezed"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY ALL")
def parse_json_props(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return _t(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type", (F.col("k") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS links, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def html_extract(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<a href="), F.lit(0))).cast("long").alias("links"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@query(f"SELECT o_custkey, count(*) AS n, CAST(coalesce(sum(total) FILTER (day >= DATE '2001-08-01' - 365), 0) AS DOUBLE) AS trailing FROM ({_ORDERS}) GROUP BY o_custkey")
def trailing_window_sum(spark, sf_dir):
    """The last 365 days before a stated date; later rows count too."""
    recent = F.col("day") >= F.date_sub(F.lit("2001-08-01").cast("date"), 365)
    return customer_orders(spark, sf_dir).groupBy("o_custkey").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(recent, F.col("total"))), F.lit(0)).cast("double").alias("trailing"))


@query("""
    SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(upper(p_type), 'ECONOMY|SMALL') THEN 'basic' WHEN regexp_matches(upper(p_type), 'PROMO') THEN 'promotion' WHEN regexp_matches(upper(p_type), 'STANDARD|MEDIUM') THEN 'standard' ELSE 'other' END AS kind FROM part) GROUP BY kind
""")
def classify_tokens(spark, sf_dir):
    kind = X.token_class(F.col("p_type"), [("basic", ["ECONOMY", "SMALL"]), ("promotion", ["PROMO"]), ("standard", ["STANDARD", "MEDIUM"])], "other")
    return _t(spark, sf_dir, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
