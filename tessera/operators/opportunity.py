"""Valuation metrics of an asset from two pages and its dividends, each with the source it was believed from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.provenance import prefer, told

# Names of the two pages, days of dividends, and the factor of the fair price by earnings and book value.
DETAILS, STATUS, YEAR_DAYS, GRAHAM = "details", "status", 365, 22.5
REASONS = {
    "current_price": "no price", "shares_outstanding": "no share count", "earnings_per_share": "no earnings a share", "book_value_per_share": "no book value a share", "price_to_book": "no book value a share", "price_to_earnings": "no earnings a share",
    "dividend_yield_12m": "no trailing dividends", "dividends_12m": "no trailing dividends", "graham_price": "earnings and book value above zero are needed", "bazin_price": "no trailing dividends", "min_52_weeks": "no lowest price", "max_52_weeks": "no highest price",
    "average_daily_traded_value": "no traded value", "market_capitalization": "no market value", "latest_distribution": "no distribution", "median_distribution_3m": "fewer than 3 distributions", "median_distribution_6m": "fewer than 6 distributions",
}

# Distributions that the two middle values take, and what a fund's own reports are called.
MONTHS, REPORTS = (3, 6), "reports"


def trailing_dividends(dividends: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """key, trailing: dividends since a year before the day of the key's quote, by ex date, else by payment date."""
    day = F.coalesce("ex_date", "payment_date")
    met = dividends.where(day.isNotNull()).select(key, day.alias("_day"), "value").join(details.select(key, "quote_date"), key)
    return met.where(F.col("_day") >= F.date_sub("quote_date", YEAR_DAYS)).groupBy(key).agg(F.sum("value").alias("trailing"))


def valuation(details: DataFrame, status: DataFrame, trailing: DataFrame, key: str, bazin_percent: float = 6.0) -> DataFrame:
    """key, metric, value, source, state (valid or missing), reason: twelve metrics of every key of ``details`` or ``status``, a row a key in each.

    ``details``: quote, eps, bvps, p_vp, p_l, div_yield, shares, min_52, max_52; ``status``: price, s_eps, s_bvps, s_p_vp, s_p_l, dividends, s_yield,
    s_min_52, s_max_52. The details page is believed before the status page; a multiple that neither states is made from price and value and
    has the price's source. Trailing dividends of zero give way to the status page's.
    """
    wide, metrics = _believed(_pages(details, status, trailing, key), bazin_percent)
    rows = F.array(*(F.struct(F.lit(n).alias("metric"), t.alias("told"), F.lit(REASONS[n]).alias("why")) for n, t in metrics.items()))
    long = wide.select(key, F.inline(rows))
    missing = F.col("told.missing")
    return long.select(key, "metric", F.col("told.value").alias("value"), F.when(~missing, F.col("told.source")).alias("source"), F.when(missing, "missing").otherwise("valid").alias("state"), F.when(missing, F.col("why")).alias("reason"))


def _pages(details: DataFrame, status: DataFrame, trailing: DataFrame, key: str) -> DataFrame:
    return details.withColumn("_known", F.lit(True)).join(status, key, "full").join(trailing, key, "left")


def _believed(wide: DataFrame, bazin_percent: float) -> tuple[DataFrame, dict[str, Column]]:
    """The joined pages with what is believed of them, and the twelve metrics as told values over that."""
    c = F.col
    both = lambda a, b: prefer(told(c(a), DETAILS, 0), told(c(b), STATUS, 1))
    wide = wide.withColumns({"_price": both("quote", "price"), "_eps": both("eps", "s_eps"), "_bvps": both("bvps", "s_bvps"), "_pb": both("p_vp", "s_p_vp"), "_pe": both("p_l", "s_p_l"), "_min": both("min_52", "s_min_52"), "_max": both("max_52", "s_max_52")})
    price, eps, bvps = (c(f"_{n}")["value"] for n in ("price", "eps", "bvps"))

    def multiple(stated: str, of: Column) -> Column:
        return prefer(c(stated), told(F.when(of != 0, price / of), c("_price")["source"], 2))

    own = F.coalesce("trailing", F.lit(0.0))
    from_status = (own <= 0) & c("dividends").isNotNull()
    total = F.when(from_status, c("dividends")).otherwise(own)
    source = F.when(from_status, F.lit(STATUS)).otherwise(F.lit(DETAILS))
    wide = wide.withColumn("_paid", F.when((total > 0) | c("_known").isNotNull() | c("dividends").isNotNull(), total)).withColumn("_paid_source", source)
    stated_yield = F.coalesce(F.when(c("div_yield") != 0, c("div_yield")), c("s_yield"))
    shown = F.when(c("_paid").isNotNull() & (price != 0), c("_paid") / price * 100).otherwise(stated_yield)
    metrics = {
        "current_price": c("_price"), "shares_outstanding": told(c("shares"), DETAILS), "earnings_per_share": c("_eps"), "book_value_per_share": c("_bvps"), "price_to_book": multiple("_pb", bvps), "price_to_earnings": multiple("_pe", eps),
        "dividend_yield_12m": told(shown, c("_paid_source")), "dividends_12m": told(c("_paid"), c("_paid_source")), "graham_price": told(F.when((eps > 0) & (bvps > 0), F.sqrt(GRAHAM * eps * bvps)), DETAILS),
        "bazin_price": told(c("_paid") / (bazin_percent / 100), c("_paid_source")), "min_52_weeks": c("_min"), "max_52_weeks": c("_max"),
    }
    return wide, metrics


def last_distributions(distributions: DataFrame, key: str) -> DataFrame:
    """key, latest (value, ex_date, source), and for three and six of the last distributions their count, middle value and sources.

    ``distributions``: ex_date, value, source; one row a key and date. Rows without a key, date or value don't count.
    """
    newest = Window.partitionBy(key).orderBy(F.col("ex_date").desc(), F.col("value").desc(), F.col("source"))
    last = distributions.where(F.col(key).isNotNull() & F.col("ex_date").isNotNull() & F.col("value").isNotNull()).select(key, "ex_date", F.col("value").cast("double").alias("value"), "source", F.row_number().over(newest).alias("_n")).where(F.col("_n") <= max(MONTHS))
    of = lambda n, column: F.when(F.col("_n") <= n, F.col(column))
    middles = [x for n in MONTHS for x in (F.count(of(n, "value")).alias(f"_n{n}"), F.median(of(n, "value")).alias(f"_mid{n}"), F.array_join(F.array_sort(F.collect_set(of(n, "source"))), ",").alias(f"_from{n}"))]
    return last.groupBy(key).agg(F.min_by(F.struct("value", "ex_date", "source"), "_n").alias("latest"), *middles)


def asset_metrics(details: DataFrame, status: DataFrame, trailing: DataFrame, reports: DataFrame, distributions: DataFrame, key: str, bazin_percent: float = 6.0) -> DataFrame:
    """key, metric, value, as_of, source, state, reason: seventeen metrics of every key of a page, a report or a distribution.

    Pages as in ``valuation``, ``details`` with traded_value and market_value too; ``reports``: as_of, nav_per_share, of which the last of a key stands
    (the larger value of equal days) for its book value, whatever the pages say, and so for the price to it; ``distributions`` as in
    ``last_distributions``. A page's metric is of the day of its quote. One shuffle by key of each input.
    """
    nav = F.struct("as_of", F.col("nav_per_share").cast("double").alias("nav_per_share"))
    official = reports.where(F.col("as_of").isNotNull()).groupBy(key).agg(F.max(nav).alias("official"))
    met = _pages(details, status, trailing, key).join(official, key, "full").join(last_distributions(distributions, key), key, "full").where(F.col(key).isNotNull())
    wide, metrics = _believed(met, bazin_percent)
    c, price = F.col, F.col("_price")
    day, filed, stated = c("quote_date"), c("official").isNotNull(), c("official")["nav_per_share"]
    rows = {name: (t["value"], day, t["source"], F.lit(REASONS[name])) for name, t in metrics.items()}
    rows |= {"average_daily_traded_value": (c("traded_value"), day, F.lit(DETAILS), F.lit(REASONS["average_daily_traded_value"])), "market_capitalization": (c("market_value"), day, F.lit(DETAILS), F.lit(REASONS["market_capitalization"]))}
    to_book = F.when((price["value"] > 0) & (stated != 0), price["value"] / stated)
    for name, value, source, why in (("book_value_per_share", stated, F.lit(REPORTS), REASONS["book_value_per_share"]), ("price_to_book", to_book, F.concat_ws(",", F.lit(REPORTS), price["source"]), REASONS["current_price"])):
        old = rows[name]
        rows[name] = (F.when(filed, value).otherwise(old[0]), F.when(filed, c("official")["as_of"]).otherwise(old[1]), F.when(filed, source).otherwise(old[2]), F.when(filed, F.lit(why)).otherwise(old[3]))
    rows["latest_distribution"] = (c("latest")["value"], c("latest")["ex_date"], c("latest")["source"], F.lit(REASONS["latest_distribution"]))
    rows |= {f"median_distribution_{n}m": (F.when(c(f"_n{n}") >= n, c(f"_mid{n}")), c("latest")["ex_date"], c(f"_from{n}"), F.lit(REASONS[f"median_distribution_{n}m"])) for n in MONTHS}
    long = wide.select(key, F.inline(F.array(*(F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"), at.alias("as_of"), source.alias("source"), why.alias("reason")) for name, (value, at, source, why) in rows.items()))))
    known = c("value").isNotNull()
    return long.select(key, "metric", "value", F.when(known, c("as_of")).alias("as_of"), F.when(known, c("source")).alias("source"), F.when(known, "valid").otherwise("missing").alias("state"), F.when(~known, c("reason")).alias("reason"))
