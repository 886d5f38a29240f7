"""A company's quality facts from its latest twelve months, its fiscal years and yearly rates, as long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.operators.frames import inline_facts

# Years that count as recent, observations that a fact needs, the return that is good, years of stress and the rate that makes others so.
RECENT, LEAST, LEAST_STRESS, GOOD_RETURN = 5, 3, 2, 0.15
STRESS_YEARS, STRESS_RATE = (2015, 2016, 2020), 0.12

#: The last year that a date can hold.
LAST_YEAR = 9999

# Facts that divide one measure of the latest twelve months by another, and their units.
RATIOS = {
    "gross_margin": ("gross_profit", "revenue", "ratio"), "operating_margin": ("ebit", "revenue", "ratio"), "net_margin": ("net_income", "revenue", "ratio"), "return_on_equity": ("net_income", "equity", "ratio"),
    "return_on_assets": ("net_income", "total_assets", "ratio"), "cash_conversion": ("operating_cash_flow", "net_income", "ratio"), "operating_cash_flow_margin": ("operating_cash_flow", "revenue", "ratio"),
    "free_cash_flow_margin": ("free_cash_flow", "revenue", "ratio"), "net_debt_to_ebitda": ("net_debt", "ebitda", "multiple"), "debt_to_equity": ("gross_debt", "equity", "multiple"),
    "equity_ratio": ("equity", "total_assets", "ratio"), "current_ratio": ("current_assets", "current_liabilities", "multiple"),
}


def _of(top: str, bottom: str) -> Column:
    return N.ratio_nonzero(F.col(top), F.col(bottom))


def latest_facts(latest: DataFrame, key: str) -> DataFrame:
    """One row a key: ratios of the latest twelve months and the error of its values a share against public ones."""
    expense = F.when(F.col("financial_result") < 0, F.abs("financial_result"))
    facts = {name: _of(a, b) for name, (a, b, _) in RATIOS.items()} | {
        "accrual_ratio": N.ratio_nonzero(F.col("net_income") - F.col("operating_cash_flow"), F.col("total_assets")),
        "interest_coverage": N.ratio_nonzero(F.col("ebit"), expense),
        "earnings_per_share_consistency_error": N.relative_error(N.per_share(F.col("net_income"), F.col("shares")), F.col("public_eps")),
        "book_value_per_share_consistency_error": N.relative_error(N.per_share(F.col("equity"), F.col("shares")), F.col("public_bvps")),
    }
    return latest.select(key, *(value.alias(name) for name, value in facts.items()))


def _seen(value: Column, made: Column, end: Column) -> Column:
    """A fact of a value's observations: what is made of them, how many there are, and the day of the last."""
    return F.struct(made.cast("double").alias("value"), F.count(value).alias("n"), F.max(F.when(value.isNotNull(), end)).alias("as_of"))


def _growth(value: Column, end: Column, deflated: bool = False) -> Column:
    """Compound growth between the first and last observed year; three observations at least, and two years of known inflation if deflated."""
    seen = F.when(value.isNotNull(), end)
    row = F.struct(value.cast("double").alias("v"), "prices", "known")
    first, last = F.min_by(row, seen), F.max_by(row, seen)
    most = F.try_divide(last["v"], F.try_divide(last["prices"], first["prices"])) if deflated else last["v"]
    grown = N.annual_growth(first["v"], most, F.datediff(F.max(seen), F.min(seen)))
    return _seen(value, N.gated(F.count(value), LEAST, F.when(last["known"] - first["known"] >= 2, grown) if deflated else grown), end)


def _share(test: Column, end: Column, least: int = LEAST) -> Column:
    return _seen(test, N.gated(F.count(test), least, F.avg(test.cast("double"))), end)


def yearly_rates(macro: DataFrame) -> DataFrame:
    """yr, inflation, selic, prices (compounded up to the year), known (years of known inflation up to it): a row for every year of the calendar.

    Of a year that ``macro`` repeats the larger values count. Some ten thousand rows whatever the input holds, so that a broadcast is bounded.
    """
    told = macro.where("yr is not null").groupBy("yr").agg(F.max("inflation").cast("double").alias("inflation"), F.max("selic").cast("double").alias("selic"))
    years = macro.sparkSession.range(1, LAST_YEAR + 1, 1, 1).select(F.col("id").cast("int").alias("yr")).join(told, "yr", "left")
    upto = Window.orderBy("yr")
    return years.withColumns({"prices": F.product(F.coalesce(1 + F.col("inflation"), F.lit(1.0))).over(upto), "known": F.count("inflation").over(upto)})


def yearly_observations(annual: DataFrame, macro: DataFrame, key: str) -> DataFrame:
    """One row a key from rows a fiscal year; ``macro``: yr, inflation, selic. Each fact is a struct of value, n and as_of.

    One window by key numbers the years and one aggregate makes the facts, in the one shuffle of the years. Deflated growth takes each year
    between the first and the last, whether the company reported in it or not, as the quotient of two price levels.
    """
    end, late = F.col("period_end"), F.col("recency") <= RECENT
    newest = Window.partitionBy(key).orderBy(end.desc())
    rated = annual.withColumns({"recency": F.row_number().over(newest), "prev_revenue": F.lead("revenue").over(newest), "yr": F.year(end), "_roe": _of("net_income", "equity"), "_net": _of("net_income", "revenue"), "_gross": _of("gross_profit", "revenue"), "_operating": _of("ebit", "revenue"), "_cash": _of("operating_cash_flow", "net_income")}).join(F.broadcast(yearly_rates(macro)), "yr", "left")

    def recent(name: str) -> Column:
        return F.when(late, F.col(name))

    def volatile(value: Column) -> Column:
        return _seen(value, N.gated(F.count(value), LEAST, F.stddev_pop(value)), end)

    def middle(value: Column) -> Column:
        return _seen(value, N.gated(F.count(value), LEAST, F.median(value)), end)

    stressed = late & (F.col("yr").isin(*STRESS_YEARS) | (F.coalesce("selic", F.lit(0.0)) >= STRESS_RATE))
    real = F.when((F.col("recency") < RECENT) & (F.col("prev_revenue") > 0), F.try_divide(F.col("revenue") / F.col("prev_revenue"), 1 + F.col("inflation")) - 1)
    facts = {
        "revenue_cagr": _growth(F.col("revenue"), end), "earnings_cagr": _growth(F.col("net_income"), end), "net_margin_volatility": volatile(F.col("_net")), "return_on_equity_volatility": volatile(F.col("_roe")),
        "positive_earnings_frequency": _share(F.col("net_income") > 0, end), "positive_free_cash_flow_frequency": _share(F.col("free_cash_flow") > 0, end), "share_dilution": _growth(recent("shares"), end),
        "roe_5y_median": middle(recent("_roe")), "roe_above_15_frequency": _share(recent("_roe") >= GOOD_RETURN, end), "cash_conversion_median": middle(recent("_cash")),
        "gross_margin_volatility": volatile(recent("_gross")), "operating_margin_volatility": volatile(recent("_operating")), "revenue_real_cagr": _growth(recent("revenue"), end, deflated=True), "earnings_real_cagr": _growth(recent("net_income"), end, deflated=True),
        "roe_vs_selic_spread": middle(recent("_roe") - F.col("selic")), "stress_profitability_frequency": _share(F.when(stressed, F.col("net_income") > 0), end, LEAST_STRESS), "positive_real_revenue_growth_frequency": _share(real > 0, end),
    }
    return rated.groupBy(key).agg(*(value.alias(name) for name, value in facts.items()))


def yearly_facts(annual: DataFrame, macro: DataFrame, key: str) -> DataFrame:
    """The values of ``yearly_observations``."""
    seen = yearly_observations(annual, macro, key)
    return seen.select(key, *(F.col(name)["value"].alias(name) for name in seen.columns if name != key))


def stock_facts(latest: DataFrame, annual: DataFrame, macro: DataFrame, key: str) -> DataFrame:
    """key, fact, value, unit, status: 33 facts a key of ``latest``."""
    wide = latest_facts(latest, key).join(yearly_facts(annual, macro, key), key, "left")
    units = {name: unit for name, (_, _, unit) in RATIOS.items()} | {"interest_coverage": "multiple"}
    return inline_facts(wide, [key], [(c, F.col(c), units.get(c, "ratio")) for c in wide.columns if c != key])
