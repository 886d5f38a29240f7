"""All facts of a fund from its monthly reports and distributions, with dates, confidence and reasons, as long rows.

Windows number a fund's rows from the newest; the last sixty reports and thirty-six distributions, which are bounded whatever the
fund's history, then stand beside one another as arrays, and every fact is an expression over them: one shuffle of each input and one join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numeric as N

# Rows that count as recent, observations that facts need, steps that make an issue, a loss of value, a cut and a change of
# administrator, and confidence in stated, derived and compared values.
LONG, SHORT, LEAST, LEAST_LONG = 60, 36, 6, 12
ISSUE, PRESERVED, CUT, CHANGE = 1.02, 0.97, 0.90, 0.50
STATED, DERIVED, COMPARED, MARKET = 0.95, 0.90, 0.85, 0.85
NOT_STATED = "not in the last report"

REPORT = ("as_of", "nav_per_share", "net_assets", "issued_shares", "shareholder_count", "monthly_nav_return", "monthly_distribution_yield", "administrator", "inception_date", "administration_fee_ratio", "total_assets", "total_liabilities", "property_assets", "credit_assets", "liquid_assets")
FACT = "array<struct<fact:string,value:double,unit:string,as_of:date,confidence:double,status:string,reason:string>>"


def _recent(df: DataFrame, key: str, day: str, columns: tuple[str, ...], most: int, name: str) -> DataFrame:
    """key, <name> (the last rows in order of time), <name>_all (how many there are). Rows of equal days come in the order of their values."""
    row = F.struct(*columns)
    by = Window.partitionBy(key)
    numbered = df.where(F.col(key).isNotNull() & F.col(day).isNotNull()).select(key, row.alias("row"), F.row_number().over(by.orderBy(F.col(day).desc(), row.desc())).alias("_n"), F.count("*").over(by).alias("_all"))
    return numbered.where(F.col("_n") <= most).groupBy(key).agg(F.array_sort(F.collect_list("row")).alias(name), F.max("_all").alias(f"{name}_all"))


def _last(rows: Column) -> Column:
    return F.try_element_at(rows, F.lit(-1))


def _first(rows: Column) -> Column:
    return F.get(rows, F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _mean(values: Column) -> Column:
    return _sum(values) / F.size(values)


def _deviation(values: Column) -> Column:
    mean = _mean(values)
    return F.sqrt(_sum(F.transform(values, lambda v: (v - mean) * (v - mean))) / F.size(values))


def _median(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    low, high = (F.get(ordered, F.floor((n - k) / 2).cast("int")) for k in (1, 0))
    return F.when(n % 2 == 1, high).otherwise((low + high) / 2)


def _pairs(rows: Column, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` of each row and the next."""
    n = F.size(rows)
    return F.when(n > 1, F.zip_with(F.slice(rows, F.lit(1), n - 1), F.slice(rows, F.lit(2), n - 1), join))


def _share(tests: Column) -> Column:
    """The part of an array of tests that holds."""
    return F.size(F.filter(tests, lambda t: t)) / F.size(tests)


def _nav_returns(reports: Column) -> Column:
    """(as_of, value) of the stated returns, else of the change of the value a share since the report before."""
    def one(x: Column, k: Column) -> Column:
        before = F.get(reports, k - 1)["nav_per_share"]
        grown = F.when((k > 0) & (before > 0) & (x["nav_per_share"] > 0), x["nav_per_share"] / before - 1)
        return F.struct(x["as_of"].alias("as_of"), F.coalesce(x["monthly_nav_return"], grown).alias("value"))

    return F.filter(F.transform(reports, one), lambda x: x["value"].isNotNull())


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def _expected(reports: Column) -> Column:
    """What reports say was distributed a share, by month; the last report of a month counts."""
    told = F.filter(reports, lambda r: r["monthly_distribution_yield"].isNotNull() & (r["nav_per_share"] > 0))
    months = F.array_distinct(F.transform(told, lambda r: _month(r["as_of"])))
    last = F.transform(months, lambda m: F.struct(m.alias("month"), _last(F.filter(told, lambda r: _month(r["as_of"]) == m)).alias("r")))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["month"], x["r"]["nav_per_share"] * x["r"]["monthly_distribution_yield"])))


def _growth(rows: Column, name: str) -> Column:
    a, b = _first(rows), _last(rows)
    return N.annual_growth(a[name], b[name], F.datediff(b["as_of"], a["as_of"]))


def fund_facts(reports: DataFrame, distributions: DataFrame, key: str, traded: DataFrame | None = None) -> DataFrame:
    """key, fact, value, unit, as_of, confidence, status (valid or missing), reason: 26 facts of every fund with a report or a distribution.

    ``reports`` has the columns REPORT with numbers as doubles, one row a key and date; ``distributions``: ex_date, value; ``traded``: key,
    traded_value (of a market, a day). A missing fact has no date and no confidence.
    """
    number = [F.col(c).cast("double").alias(c) if c not in ("as_of", "inception_date", "administrator") else F.col(c) for c in REPORT]
    seen = _recent(reports.select(key, *number), key, "as_of", REPORT, LONG, "reports")
    paid = _recent(distributions.select(key, "ex_date", F.col("value").cast("double").alias("value")), key, "ex_date", ("ex_date", "value"), SHORT, "paid")
    both = seen.join(paid, key, "full")
    both = both.join(traded.select(key, F.col("traded_value").cast("double").alias("traded_value")), key, "left") if traded is not None else both.withColumn("traded_value", F.lit(None).cast("double"))
    nothing = lambda c: F.coalesce(F.col(c), F.array().cast(both.schema[c].dataType))
    both = both.select(key, nothing("reports").alias("reports"), nothing("paid").alias("paid"), F.coalesce("reports_all", F.lit(0)).alias("reports_all"), F.coalesce("paid_all", F.lit(0)).alias("paid_all"), "traded_value")
    all_ = F.col("reports")
    short = F.slice(all_, F.greatest(F.size(all_) - SHORT + 1, F.lit(1)), F.lit(SHORT))
    some = lambda test: F.filter(all_, test)
    both = both.withColumns({
        "short": short, "last": _last(all_), "valued": some(lambda r: r["nav_per_share"] > 0), "run": some(lambda r: F.coalesce(r["administrator"], F.lit("")) != ""), "held": some(lambda r: r["shareholder_count"] > 0),
        "issued": some(lambda r: (r["issued_shares"] > 0) & (r["nav_per_share"] > 0)), "values": F.transform("paid", lambda p: p["value"]), "last_paid": _last(F.col("paid"))["ex_date"],
    })
    both = both.withColumns({"returns": _nav_returns(F.col("short")), "expected": _expected(F.col("short")), "kept": F.filter("values", lambda v: v >= 0)})

    c, size = F.col, lambda name: F.size(F.col(name))
    last, as_of, paid_at = c("last"), c("last")["as_of"], c("last_paid")
    comparable = F.filter(_pairs(c("values"), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"] > 0)
    half = F.floor(size("values") / 2).cast("int")
    early, late = _mean(F.slice("values", F.lit(1), F.greatest(half, F.lit(1)))), _mean(F.slice("values", half + 1, F.greatest(size("values") - half, F.lit(1))))
    months = F.array_distinct(F.transform("short", lambda r: _month(r["as_of"])))
    returned = F.transform("returns", lambda r: r["value"])
    issues = F.filter(_pairs(c("issued"), lambda a, b: F.struct((b["issued_shares"] > a["issued_shares"] * ISSUE).alias("issue"), (b["nav_per_share"] >= a["nav_per_share"] * PRESERVED).alias("kept"))), lambda p: p["issue"])
    changes = F.size(F.filter(_pairs(c("run"), lambda a, b: a["administrator"] != b["administrator"]), lambda t: t))
    floor = F.lit(1e-6)
    errors = F.filter(F.transform("paid", lambda p: F.struct(p["value"].alias("v"), F.try_element_at(c("expected"), _month(p["ex_date"])).alias("e"))), lambda x: x["e"].isNotNull())
    errors = F.transform(errors, lambda x: F.abs(x["v"] - x["e"]) / F.greatest(F.abs(x["v"]), F.abs(x["e"]), floor))
    fall = F.aggregate("valued", F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("fall")), lambda a, r: F.struct(F.greatest(a["peak"], r["nav_per_share"]).alias("peak"), F.greatest(a["fall"], (F.greatest(a["peak"], r["nav_per_share"]) - r["nav_per_share"]) / F.greatest(a["peak"], r["nav_per_share"])).alias("fall")), lambda a: a["fall"])
    implied = last["nav_per_share"] * last["issued_shares"]
    no_history, few_paid = "no history", f"fewer than {LEAST} distributions"

    def fact(name: str, value: Column, unit: str, day: Column, confidence: float, *needs: tuple[Column, str]) -> Column:
        """A fact whose needs are met and whose value is known; else the first reason that applies."""
        reason = F.coalesce(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(why)) for test, why in needs), F.when(value.isNull(), F.lit(NOT_STATED)))
        known = F.when(reason.isNull(), value.cast("double"))
        return F.struct(F.lit(name).alias("fact"), known.alias("value"), F.lit(unit).alias("unit"), F.when(known.isNotNull(), day).alias("as_of"), F.when(known.isNull(), F.lit(0.0)).otherwise(F.lit(confidence)).alias("confidence"), F.when(known.isNull(), "missing").otherwise("valid").alias("status"), reason.alias("reason"))

    enough_paid, enough_reports = (size("values") >= LEAST, few_paid), (size("short") >= LEAST, f"fewer than {LEAST} reports")
    enough_returns = (size("returns") >= LEAST, f"fewer than {LEAST} returns")
    long = lambda name: (size(name) >= LEAST_LONG, f"fewer than {LEAST_LONG} observations")
    told = (last.isNotNull(), no_history)
    part = lambda name: N.ratio_nonzero(last[name], last["total_assets"])
    facts = [
        fact("reporting_history_months", F.nullif(c("reports_all"), F.lit(0)), "count", as_of, STATED, told), fact("distribution_history_months", F.nullif(c("paid_all"), F.lit(0)), "count", paid_at, STATED, (c("paid_all") > 0, no_history)),
        fact("distribution_stability", N.ratio_nonzero(_deviation(c("kept")), _mean(c("kept"))), "ratio", paid_at, STATED, (size("kept") >= LEAST, few_paid)), fact("positive_distribution_frequency", _share(F.transform("values", lambda v: v > 0)), "ratio", paid_at, STATED, enough_paid),
        fact("distribution_growth", N.ratio_nonzero(late - early, early), "ratio", paid_at, DERIVED, (size("values") >= LEAST_LONG, f"fewer than {LEAST_LONG} distributions")),
        fact("distribution_cut_frequency", _share(F.transform(comparable, lambda p: p["b"] < p["a"] * CUT)), "ratio", paid_at, DERIVED, enough_paid, (F.size(comparable) > 0, "no positive distribution before another")),
        fact("reporting_regularity", F.size(months) / (F.array_max(months) - F.array_min(months) + 1), "ratio", as_of, DERIVED, enough_reports),
        fact("report_completeness", _share(F.transform("short", lambda r: r["monthly_nav_return"].isNotNull() & r["monthly_distribution_yield"].isNotNull())), "ratio", as_of, DERIVED, enough_reports),
        fact("nav_growth", _growth(c("valued"), "nav_per_share"), "ratio", _last(c("valued"))["as_of"], DERIVED, long("valued")), fact("nav_return_volatility", _deviation(returned), "ratio", _last(c("returns"))["as_of"], DERIVED, enough_returns),
        fact("positive_nav_return_frequency", _share(F.transform(returned, lambda v: v >= 0)), "ratio", _last(c("returns"))["as_of"], DERIVED, enough_returns), fact("nav_max_drawdown", fall, "ratio", _last(c("valued"))["as_of"], DERIVED, (size("valued") >= LEAST, f"fewer than {LEAST} observations")),
        fact("distribution_report_consistency_error", _median(errors), "ratio", as_of, COMPARED, (F.size(errors) >= LEAST, f"fewer than {LEAST} months in both")), fact("net_assets", last["net_assets"], "currency", as_of, STATED, told),
        fact("shareholder_count", last["shareholder_count"], "count", as_of, STATED, told), fact("fund_age_years", F.when(last["inception_date"] <= as_of, F.datediff(as_of, last["inception_date"]) / 365.25), "years", as_of, STATED, told),
        fact("administration_fee_ratio", last["administration_fee_ratio"], "ratio", as_of, STATED, told), fact("administrator_stability", F.greatest(F.lit(0.0), 1 - changes * CHANGE), "ratio", _last(c("run"))["as_of"], DERIVED, long("run")),
        fact("daily_traded_value", c("traded_value"), "currency", as_of, MARKET, (c("traded_value").isNotNull(), "no market value")), fact("liability_ratio", part("total_liabilities"), "ratio", as_of, STATED, told), fact("property_allocation", part("property_assets"), "ratio", as_of, STATED, told),
        fact("credit_allocation", part("credit_assets"), "ratio", as_of, STATED, told), fact("liquid_asset_ratio", part("liquid_assets"), "ratio", as_of, STATED, told),
        fact("issuance_nav_preservation", F.when(F.size(issues) == 0, 1.0).otherwise(_share(F.transform(issues, lambda p: p["kept"]))), "ratio", _last(c("issued"))["as_of"], DERIVED, long("issued")), fact("shareholder_growth", _growth(c("held"), "shareholder_count"), "ratio", _last(c("held"))["as_of"], DERIVED, long("held")),
        fact("nav_total_consistency_error", F.abs(implied - last["net_assets"]) / F.greatest(implied, last["net_assets"]), "ratio", as_of, DERIVED, ((last["net_assets"] > 0) & (last["issued_shares"] > 0), "value, assets and shares are not all stated")),
    ]
    return both.select(key, F.inline(F.array(*facts).cast(FACT)))
