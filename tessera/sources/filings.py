"""Company-facts documents: one JSON text a company, with filed observations by namespace, tag and unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import ratio_nonzero, sum_any

# The order of namespaces, and the tags of each measure by preference.
NAMESPACES = ("us-gaap", "ifrs-full", "dei")
TAGS = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet", "Revenue"),
    "gross_profit": ("GrossProfit",),
    "ebit": ("OperatingIncomeLoss", "OperatingIncomeOrLoss"),
    "net_income": ("NetIncomeLoss", "ProfitLoss", "NetIncomeLossAvailableToCommonStockholdersBasic", "ProfitLossAttributableToOwnersOfParent"),
    "equity": ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", "Equity"),
    "total_assets": ("Assets",),
    "current_assets": ("AssetsCurrent",),
    "current_liabilities": ("LiabilitiesCurrent",),
    "cash_and_equivalents": ("CashAndCashEquivalentsAtCarryingValue", "CashAndDueFromBanks", "CashAndCashEquivalents"),
    "current_debt": ("LongTermDebtAndFinanceLeaseObligationsCurrent", "LongTermDebtCurrent", "ShortTermBorrowings", "DebtCurrent"),
    "noncurrent_debt": ("LongTermDebtAndFinanceLeaseObligationsNoncurrent", "LongTermDebtNoncurrent", "LongTermDebt", "DebtNoncurrent"),
    "operating_cash_flow": ("NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"),
    "capex": ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"),
    "depreciation": ("DepreciationDepletionAndAmortization", "DepreciationDepletionAndAmortizationPropertyPlantAndEquipment"),
    "shares_outstanding": ("EntityCommonStockSharesOutstanding",),
    "earnings_per_share": ("EarningsPerShareDiluted", "EarningsPerShareBasic"),
}
FLOWS = ("revenue", "gross_profit", "ebit", "net_income", "operating_cash_flow", "capex", "depreciation", "earnings_per_share")
BALANCES = ("equity", "total_assets", "current_assets", "current_liabilities", "cash_and_equivalents", "current_debt", "noncurrent_debt", "shares_outstanding")
ANNUAL_FORMS = ("10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A")
CURRENCIES = ("USD", "EUR", "GBP", "CAD", "AUD")
ANNUAL_DAYS = 280

_ENTRY = "struct<val: string, start: string, end: string, filed: string, form: string, accn: string>"
DOCUMENT = f"entityName string, facts map<string, map<string, struct<units: map<string, array<{_ENTRY}>>>>>"


def is_annual_form(form: Column, start: Column, end: Column) -> Column:
    """An annual form, or a duration of 280 days or more; without a start only the form counts."""
    return F.coalesce(form.isin(*ANNUAL_FORMS), F.lit(False)) | F.coalesce(F.datediff(end, start) >= ANNUAL_DAYS, F.lit(False))


def chosen_unit(measure: Column, units: Column) -> Column:
    """The unit to read of a map from unit names: shares for share counts, a quotient for per-share values, a main currency else; then by name."""

    def place(name: Column) -> Column:
        other = F.when(measure == "shares_outstanding", ~F.contains(F.lower(name), F.lit("shares"))).when(measure == "earnings_per_share", ~F.contains(name, F.lit("/"))).otherwise(~name.isin("USD", "EUR", "GBP"))
        return F.struct(other.alias("other"), name.alias("name"))

    return F.array_min(F.transform(F.map_keys(units), place))["name"]


def observations(docs: DataFrame, key: str, json_col: str) -> DataFrame:
    """key, measure, unit, value, start, end, filed, form, accn: annual observations, and all of share counts.

    Of each measure only the first namespace and tag with any observation is kept; others are never mixed in. Entries
    without an end or a number are skipped, a missing filing date is the year 1. Null or broken documents give no rows.
    """
    place = F.create_map(*(x for measure, tags in TAGS.items() for k, tag in enumerate(tags) for x in (F.lit(tag), F.struct(F.lit(measure).alias("measure"), F.lit(k).alias("tag_no")))))
    space = F.create_map(*(F.lit(x) for k, name in enumerate(NAMESPACES) for x in (name, k)))
    spaces = docs.select(key, F.explode(F.from_json(json_col, DOCUMENT)["facts"]).alias("ns", "tags")).select(key, F.try_element_at(space, F.col("ns")).alias("ns_no"), F.explode("tags").alias("tag", "body"))
    tags = spaces.withColumn("place", F.try_element_at(place, F.col("tag"))).where("ns_no is not null and place is not null")
    units = tags.select(key, "place.measure", F.struct("ns_no", "place.tag_no").alias("place"), F.map_filter("body.units", lambda _, v: v.isNotNull()).alias("units")).withColumn("unit", chosen_unit(F.col("measure"), F.col("units")))
    entries = units.where("unit is not null").select(key, "measure", "place", "unit", F.inline(F.try_element_at("units", F.col("unit"))))

    def day(name: str) -> Column:
        return F.try_to_date(F.substring(name, 1, 10), "yyyy-MM-dd")

    read = entries.select(key, "measure", "place", "unit", F.expr("try_cast(val AS decimal(38,6))").alias("value"), day("start").alias("start"), day("end").alias("end"), F.coalesce(day("filed"), F.lit("0001-01-01").cast("date")).alias("filed"), F.coalesce("form", F.lit("")).alias("form"), F.coalesce("accn", F.lit("")).alias("accn"))
    kept = read.where(F.col("value").isNotNull() & F.col("end").isNotNull() & ((F.col("measure") == "shares_outstanding") | is_annual_form(F.col("form"), F.col("start"), F.col("end"))))
    return kept.withColumn("first", F.min("place").over(Window.partitionBy(key, "measure"))).where("place = first").drop("place", "first")


def filing_order() -> Column:
    """Later filings win; on the same day amendments, then the larger accession number."""
    return F.struct("filed", F.endswith("form", F.lit("/A")).alias("amendment"), "accn")


def value_at_end(seen: DataFrame, keys: list[str]) -> DataFrame:
    """One value per key and period end: that of the filing which wins."""
    return seen.groupBy(*keys, "end").agg(F.max_by("value", filing_order()).alias("value"))


def latest_instant(seen: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """The value with the latest end on or before ``as_of``, the winning filing among equal ends."""
    return seen.where(F.col("end") <= as_of).groupBy(*keys).agg(F.max_by("value", F.struct("end", filing_order().alias("filing"))).alias("value"))


def annual_statements(seen: DataFrame, key: str, years: int = 5) -> DataFrame:
    """One row for each of a company's last fiscal ends: the flows, free cash flow and EBITDA of the year."""
    flows = seen.where(F.col("measure").isin(*FLOWS))
    dated = flows.where(F.col("start").isNotNull() & is_annual_form(F.col("form"), F.col("start"), F.col("end"))).select(key, "end").distinct()
    ends = dated.withColumn("recency", F.row_number().over(Window.partitionBy(key).orderBy(F.col("end").desc()))).where(F.col("recency") <= years)
    chosen = value_at_end(flows, [key, "measure"]).groupBy(key, "end").pivot("measure", list(FLOWS)).agg(F.first("value"))
    wide = ends.join(chosen, [key, "end"])
    return wide.withColumns({"free_cash_flow": F.col("operating_cash_flow") - F.abs("capex"), "ebitda": sum_any(F.col("ebit"), F.col("depreciation"))})


def latest_balances(seen: DataFrame, key: str) -> DataFrame:
    """One row a company: balances at its last fiscal end, debt, net debt, and shares (else net income over EPS)."""
    last = annual_statements(seen, key, 1).select(key, F.col("end").alias("as_of"), "net_income", "earnings_per_share")
    balances = seen.where(F.col("measure").isin(*BALANCES)).join(last.select(key, "as_of"), key)
    wide = latest_instant(balances, [key, "measure"], F.col("as_of")).groupBy(key).pivot("measure", list(BALANCES)).agg(F.first("value"))
    debt = sum_any(F.col("current_debt"), F.col("noncurrent_debt"))
    full = last.join(wide, key, "left").withColumns({"gross_debt": debt, "net_debt": debt - F.col("cash_and_equivalents"), "shares": F.coalesce(F.col("shares_outstanding").cast("double"), ratio_nonzero(F.col("net_income").cast("double"), F.col("earnings_per_share").cast("double")))})
    return full.drop("net_income", "earnings_per_share", "shares_outstanding")


def currencies(docs: DataFrame, key: str, json_col: str) -> DataFrame:
    """key, currency: the preferred one among the units of the first revenue tag that has any of them, else USD."""
    facts = F.from_json(json_col, DOCUMENT)["facts"]
    preferred = F.array(*map(F.lit, CURRENCIES))

    def known(space: str, tag: str) -> Column:
        units = F.map_keys(F.try_element_at(F.try_element_at(facts, F.lit(space)), F.lit(tag))["units"])
        return F.get(F.array_intersect(preferred, units), F.lit(0))

    return docs.select(key, F.coalesce(*(known(space, tag) for space in NAMESPACES[:2] for tag in TAGS["revenue"]), F.lit("USD")).alias("currency"))
