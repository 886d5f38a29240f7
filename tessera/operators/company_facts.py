"""All facts of a company as one table, with dates, sources, confidence and reasons, and what they say about it in one row.

Statements, their years, the sector, the market, dividends and bank reports meet by company; middle values of a sector are found without
bringing it together. A value outside its plausible range is a missing fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions.profiles import stock_profile
from tessera.operators.sectors import LEAST_PEERS, order_statistics
from tessera.operators.stock_facts import LEAST, LEAST_STRESS, RATIOS, latest_facts, yearly_observations
from tessera.sources.folders import stage

# Confidence in stated, derived, deflated, free cash flow, peer, share of sector, market, bank and credit facts.
STATED, DERIVED, DEFLATED, FREE_CASH, PEERS, SECTOR_SHARE, MARKET, BANK, CREDIT = 0.95, 0.90, 0.88, 0.65, 0.80, 0.70, 0.85, 0.98, 0.78

# The plausible range of a fact, both ends included.
RANGES = {
    "gross_margin": (-0.5, 1.2), "operating_margin": (-1.0, 1.2), "net_margin": (-1.0, 1.2), "return_on_equity": (-2.0, 3.0), "return_on_assets": (-1.0, 1.0), "cash_conversion": (-5.0, 8.0),
    "operating_cash_flow_margin": (-1.0, 1.0), "accrual_ratio": (-1.0, 1.0), "free_cash_flow_margin": (-1.0, 1.0), "net_debt_to_ebitda": (-10.0, 15.0), "debt_to_equity": (0.0, 20.0), "equity_ratio": (-0.2, 1.2),
    "current_ratio": (0.0, 20.0), "interest_coverage": (-10.0, 100.0), "revenue_cagr": (-0.8, 2.0), "earnings_cagr": (-0.8, 2.0), "share_dilution": (-0.5, 0.5), "roe_5y_median": (-2.0, 3.0),
    "cash_conversion_median": (-5.0, 8.0), "revenue_real_cagr": (-0.8, 2.0), "earnings_real_cagr": (-0.8, 2.0), "roe_vs_selic_spread": (-2.0, 3.0), "roe_vs_sector_median": (-10.0, 20.0),
    "roa_vs_sector_median": (-10.0, 20.0), "net_margin_vs_sector_median": (-10.0, 20.0), "equity_ratio_vs_sector_median": (-10.0, 20.0), "listed_sector_revenue_share": (0.0, 1.0), "basel_ratio": (0.0, 1.0),
    "core_capital_ratio": (0.0, 1.0), "regulatory_leverage_ratio": (0.0, 1.0), "high_risk_credit_ratio": (0.0, 1.0),
}

# Ratios that are compared with those of the sector, profiles that are compared over all sectors, and facts of dividends and banks.
COMPARED = {"roe_vs_sector_median": ("net_income", "equity"), "roa_vs_sector_median": ("net_income", "total_assets"), "net_margin_vs_sector_median": ("net_income", "revenue"), "equity_ratio_vs_sector_median": ("equity", "total_assets")}
OWN_PROFILE = ("bank", "insurer")
DIVIDENDS = ("dividend_history_years", "dividend_payment_frequency", "dividend_stability", "dividend_payout_sustainability")
CAPITAL = ("basel_ratio", "core_capital_ratio", "regulatory_leverage_ratio")
AGAINST_PUBLIC = ("earnings_per_share_consistency_error", "book_value_per_share_consistency_error")
DEFLATED_FACTS = ("revenue_real_cagr", "earnings_real_cagr", "roe_vs_selic_spread", "stress_profitability_frequency", "positive_real_revenue_growth_frequency")
GROWING = ("revenue_cagr", "earnings_cagr", "share_dilution", "revenue_real_cagr", "earnings_real_cagr")

NOT_STATED, IMPLAUSIBLE, NO_BANK, NO_CAPITAL = "not stated by its source", "outside the plausible range", "no bank report", "no capital ratio of the bank was found"
DRAFT = "array<struct<fact:string,value:double,unit:string,as_of:date,source:string,confidence:double,unmet:string,otherwise:string,low:double,high:double>>"


def _compared(name: str) -> Column:
    top, bottom = COMPARED[name]
    return N.ratio_nonzero(F.col(top), F.col(bottom))


def peer_groups(companies: DataFrame) -> DataFrame:
    """peers, members, sector_revenue, and a median for each compared ratio, of its positive values; three of them at least.

    ``companies`` has sector and profile. A company counts in its sector, and with an own profile (banks, insurers) in the group of that
    profile too, whatever its sector. Companies without a sector or with equity of zero or below don't count.
    """
    listed = companies.where((F.col("equity") > 0) & (F.coalesce("sector", F.lit("")) != ""))
    groups = F.array(F.struct(F.lit("sector").alias("kind"), F.col("sector").alias("name")))
    own = F.when(F.col("profile").isin(*OWN_PROFILE), F.array(F.struct(F.lit("profile").alias("kind"), F.col("profile").alias("name"))))
    members = listed.select(F.explode(F.concat(groups, F.coalesce(own, F.array().cast("array<struct<kind:string,name:string>>")))).alias("peers"), "revenue", *(_compared(c).alias(c) for c in COMPARED))
    counted = members.groupBy("peers").agg(F.count("*").alias("members"), F.sum(F.when(F.col("revenue") > 0, F.col("revenue"))).alias("sector_revenue"))
    long = members.select("peers", F.inline(F.array(*(F.struct(F.lit(c).alias("fact"), F.when(F.col(c) > 0, F.col(c)).alias("value")) for c in COMPARED))))
    # The two middle ranks, which are one where the count is odd.
    middle = order_statistics(long, ["peers", "fact"], "value", F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))
    median = F.when(F.col("n") >= LEAST_PEERS, (F.get("values", F.lit(0)) + F.get("values", F.lit(1))) / 2)
    wide = middle.groupBy("peers").agg(*(F.max(F.when(F.col("fact") == c, median)).alias(f"median_{c}") for c in COMPARED))
    return counted.join(wide, "peers", "left")


def company_facts(latest: DataFrame, annual: DataFrame, macro: DataFrame, key: str, *, sectors: DataFrame, market: DataFrame, dividends: DataFrame, banks: DataFrame) -> DataFrame:
    """key, profile, fact, value, unit, as_of, source, confidence, status, reason: 48 facts of every key of ``latest``.

    ``latest``: a row a key with period_end and the measures of ``latest_facts``; ``annual``: a row a key and fiscal year; ``macro``: yr, inflation, selic;
    ``sectors``: sector and name; ``market``: traded_value, market_capitalization, as_of, source; ``dividends``: rows of ``dividend_facts``;
    ``banks``: the capital ratios, capital_as_of, high_risk_credit_ratio, credit_as_of, which count for banks alone. All but ``macro``
    have the key; ``sectors``, ``market`` and ``banks`` have a row a key at most.
    A missing fact has no value, date or source, no confidence, and a reason. A table of one row a company is written in between.
    """
    told = latest.where(F.col(key).isNotNull()).join(sectors.select(key, "sector", "name"), key, "left")
    named = stage(told.withColumn("profile", stock_profile(F.col("sector"), F.col("name"))), "companies")
    own = F.col("profile").isin(*OWN_PROFILE)
    group = F.when(own, F.struct(F.lit("profile").alias("kind"), F.col("profile").alias("name"))).otherwise(F.struct(F.lit("sector").alias("kind"), F.col("sector").alias("name")))
    peers = named.select(key, "profile", F.col("period_end").alias("reference"), "revenue", *(_compared(c).alias(f"own_{c}") for c in COMPARED), group.alias("peers")).join(peer_groups(named), "peers", "left")
    traded = market.select(key, F.col("traded_value").cast("double").alias("traded_value"), F.col("market_capitalization").cast("double").alias("market_capitalization"), F.col("as_of").alias("market_as_of"), F.col("source").alias("market_source"))
    bank = banks.select(key, F.lit(True).alias("bank"), *(F.col(c).cast("double").alias(c) for c in (*CAPITAL, "high_risk_credit_ratio")), "capital_as_of", "credit_as_of")
    paid = dividends.groupBy(key).agg(F.collect_list(F.struct("fact", "value", "unit", "as_of", "source", "confidence", "reason")).alias("paid"))
    wide = peers.join(latest_facts(named, key), key).join(yearly_observations(annual, macro, key), key, "left").join(traded, key, "left").join(bank, key, "left").join(paid, key, "left")

    c, reference = F.col, F.col("reference")
    nothing = F.lit(None)

    def fact(name: str, value: Column, unit: str, day: Column, source: Column, confidence: float, *needs: tuple[Column, str], otherwise: str = NOT_STATED) -> Column:
        """What a fact would be, with the first need that is not met; rows decide afterwards, so that each expression stands once."""
        low, high = RANGES.get(name, (None, None))
        unmet = F.coalesce(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(why)) for test, why in needs)) if needs else nothing
        parts = (("fact", F.lit(name)), ("value", value), ("unit", F.lit(unit)), ("as_of", day), ("source", source), ("confidence", F.lit(confidence)), ("unmet", unmet), ("otherwise", F.lit(otherwise)), ("low", F.lit(low)), ("high", F.lit(high)))
        return F.struct(*(part.alias(label) for label, part in parts))

    def yearly(name: str) -> Column:
        least = LEAST_STRESS if name == "stress_profitability_frequency" else LEAST
        deflated = name in DEFLATED_FACTS
        why = "no comparable positive values" if name in GROWING else NOT_STATED
        source = "statements,rates" if deflated else "statements"
        return fact(name, c(name)["value"], "ratio", c(name)["as_of"], F.lit(source), DEFLATED if deflated else DERIVED, (c(name)["n"] >= least, f"fewer than {least} observations"), otherwise=why)

    stated = {name: (unit, FREE_CASH if name == "free_cash_flow_margin" else STATED) for name, (_, _, unit) in RATIOS.items()} | {"accrual_ratio": ("ratio", STATED), "interest_coverage": ("multiple", STATED)}
    is_bank = F.coalesce((c("profile") == "bank") & c("bank"), F.lit(False))
    facts = [
        *(fact(name, c(name), unit, reference, F.lit("statements"), sure) for name, (unit, sure) in stated.items()),
        *(fact(name, c(name), "ratio", reference, F.lit("statements,pages"), DERIVED, otherwise="totals and values a share are not both stated") for name in AGAINST_PUBLIC),
        *(yearly(name) for name in yearly_names()),
        *(fact(name, N.ratio_nonzero(c(f"own_{name}"), c(f"median_{name}")), "multiple", reference, F.lit("sector"), PEERS, (c(f"median_{name}").isNotNull(), f"fewer than {LEAST_PEERS} positive peers")) for name in COMPARED),
        fact("listed_sector_revenue_share", N.ratio_nonzero(c("revenue"), c("sector_revenue")), "ratio", reference, F.lit("sector"), SECTOR_SHARE, (c("members") >= LEAST_PEERS, f"fewer than {LEAST_PEERS} peers")),
        fact("daily_traded_value", c("traded_value"), "currency", c("market_as_of"), F.coalesce("market_source", F.lit("market")), MARKET), fact("market_capitalization", c("market_capitalization"), "currency", c("market_as_of"), F.coalesce("market_source", F.lit("market")), MARKET),
        *(fact(name, c(name), "ratio", c("capital_as_of"), F.lit("bank reports"), BANK, (is_bank, NO_BANK)) for name in CAPITAL),
        fact("high_risk_credit_ratio", c("high_risk_credit_ratio"), "ratio", c("credit_as_of"), F.lit("bank reports"), CREDIT, (is_bank, NO_BANK)),
    ]
    # Dividends tell their state themselves; a company without any has four rows that lack a distribution.
    unpaid = [F.struct(F.lit(name).alias("fact"), F.lit(0.0).alias("confidence"), F.lit("ratio").alias("unit"), F.lit("no distributions").alias("reason")) for name in DIVIDENDS]
    kept = F.transform("paid", lambda d: F.struct(d["fact"], d["value"], d["unit"], d["as_of"], d["source"], d["confidence"], d["reason"], nothing, nothing, nothing))
    lacking = F.transform(F.array(*unpaid), lambda d: F.struct(d["fact"], nothing, d["unit"], nothing, nothing, d["confidence"], d["reason"], nothing, nothing, nothing))
    long = wide.select(key, "profile", F.inline(F.concat(F.array(*facts).cast(DRAFT), F.coalesce(kept.cast(DRAFT), lacking.cast(DRAFT)))))
    reason = F.coalesce("unmet", F.when(c("value").isNull(), c("otherwise")), F.when(~c("value").between(c("low"), c("high")), F.lit(IMPLAUSIBLE)))
    valid = F.col("reason").isNull()
    return long.withColumn("reason", reason).select(
        key, "profile", "fact", F.when(valid, c("value")).alias("value"), "unit", F.when(valid, c("as_of")).alias("as_of"), F.when(valid, c("source")).alias("source"),
        F.when(valid, c("confidence")).otherwise(0.0).alias("confidence"), F.when(valid, "valid").otherwise("missing").alias("status"), "reason",
    )


def yearly_names() -> tuple[str, ...]:
    """The facts of ``yearly_observations`` in the order of the table."""
    return (
        "revenue_cagr", "earnings_cagr", "net_margin_volatility", "return_on_equity_volatility", "positive_earnings_frequency", "positive_free_cash_flow_frequency", "share_dilution", "roe_5y_median",
        "roe_above_15_frequency", "cash_conversion_median", "gross_margin_volatility", "operating_margin_volatility", *DEFLATED_FACTS,
    )


def company_summary(facts: DataFrame, key: str) -> DataFrame:
    """key, profile, known, missing, least_confidence, sources, warnings: one row a company from its facts, in one aggregate.

    ``sources`` are the distinct sources of its valid facts and that of statements, ``warnings`` a text for each implausible fact and
    for a bank without a capital ratio; both sorted. A fact may name several sources, parted by commas.
    """
    valid = F.col("status") == "valid"
    warning = F.when(F.col("reason") == IMPLAUSIBLE, F.concat("fact", F.lit(": "), "reason")).when((F.col("profile") == "bank") & (F.col("fact") == "basel_ratio") & ~valid, F.lit(NO_CAPITAL))
    parts = F.flatten(F.collect_set(F.split(F.when(valid, F.col("source")), ",")))
    told = F.filter(F.array_distinct(F.concat(F.array(F.lit("statements")), parts)), lambda s: s != "")
    return facts.groupBy(key, "profile").agg(
        F.count(F.when(valid, 1)).alias("known"), F.count(F.when(~valid, 1)).alias("missing"), F.min(F.when(valid, F.col("confidence"))).alias("least_confidence"),
        F.array_sort(told).alias("sources"), F.array_sort(F.collect_set(warning)).alias("warnings"),
    )
