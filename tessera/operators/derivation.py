"""Measures of company statements from account rows, by a table of rules, and their latest twelve months.

A rule says where a measure stands: in accounts by code, or under labels in an order of preference, perhaps of one statement group.
All rules of a table become the columns of a single aggregate, so a measure more costs no shuffle more. Figures that are sums or
differences of measures are expressions over its one row a period.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import minus_optional, sum_any
from tessera.functions.profiles import is_financial
from tessera.functions.text import fold

#: A period of so many days is a year's; so is one whose beginning is not known.
ANNUAL_DAYS = 300


@dataclass(frozen=True)
class Rule:
    """Where a measure stands.

    ``labels`` come before ``codes``; a zero under either is then unfilled, and the next place answers. ``group`` is the statement
    group (first part of the code) the labels must be in. ``positive``: of several codes the first with a value above zero.
    ``industrial``: unknown for banks, insurers and their like.
    """

    name: str
    codes: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    group: str | None = None
    positive: bool = False
    industrial: bool = False


# The accounts and labels of the standard chart.
RULES = (
    Rule("revenue", ("3.01",)),
    Rule("gross_profit", ("3.03",), industrial=True),
    Rule("ebit", ("3.05",), industrial=True),
    Rule("financial_result", ("3.06",), industrial=True),
    Rule("net_income", ("3.11",), ("Atribuído a Sócios da Empresa Controladora", "Atribuído aos Sócios da Empresa Controladora", "Lucro ou Prejuízo Líquido Consolidado do Período", "Lucro/Prejuízo Consolidado do Período", "Lucro ou Prejuízo Líquido do Período", "Lucro/Prejuízo do Período"), "3"),
    Rule("whole_equity", ("2.03",), ("Patrimônio Líquido Consolidado", "Patrimônio Líquido"), "2"),
    Rule("outside_equity", (), ("Participação dos Acionistas Não Controladores", "Participação dos Sócios Não Controladores")),
    Rule("total_assets", ("1",)),
    Rule("current_assets", ("1.01",), industrial=True),
    Rule("current_liabilities", ("2.01",), industrial=True),
    Rule("cash", ("1.01.01",), industrial=True),
    Rule("short_term_investments", ("1.01.02",), industrial=True),
    Rule("short_term_debt", ("2.01.04",), industrial=True),
    Rule("long_term_debt", ("2.02.01",), industrial=True),
    Rule("operating_cash_flow", ("6.01",), industrial=True),
    Rule("investing_cash_flow", ("6.02",), industrial=True),
    Rule("told_earnings_per_share", ("3.99.01.01", "3.99.01.02"), positive=True),
)

FLOWS = ("revenue", "gross_profit", "ebit", "ebitda", "financial_result", "net_income", "operating_cash_flow", "capex", "free_cash_flow", "depreciation")
BALANCES = ("equity", "total_assets", "current_assets", "current_liabilities", "cash_and_equivalents", "short_term_debt", "long_term_debt", "gross_debt", "net_debt", "shares_outstanding")


def _first(value: Column, order: Column, test: Column) -> Column:
    return F.min_by(F.when(test, value), F.when(test, order))


def compiled(rules: tuple[Rule, ...], code: Column, label: Column, value: Column, place: Column) -> list[Column]:
    """One aggregate a rule. ``place`` orders rows that answer the same rule: the first in file order wins."""
    folded, out = fold(label), []
    for rule in rules:
        rank = F.array_position(F.array(*(F.lit(c) for c in rule.codes)), code) if rule.codes else F.lit(0)
        by_code = _first(value, F.struct(rank, place), (rank > 0) & ((value > 0) if rule.positive else F.lit(True)))
        if rule.labels:
            told = F.array_position(F.array(*(fold(F.lit(c)) for c in rule.labels)), folded)
            in_group = F.lit(True) if rule.group is None else F.startswith(code, F.lit(f"{rule.group}."))
            by_label = _first(value, F.struct(told, place), (told > 0) & in_group)
            filled = F.when(by_label != 0, by_label)
            # A zero under a label is all that is known where the account is zero or not there.
            by_code = F.coalesce(filled, F.when(by_code != 0, by_code), by_label) if rule.codes else by_label
        out.append(by_code.alias(rule.name))
    return out


def measures(accounts: DataFrame, keys: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row by ``keys`` with a column a rule, from rows of code, label, value and place; null codes answer nothing."""
    return accounts.groupBy(*keys).agg(*compiled(rules, F.col("code"), F.col("label"), F.col("value"), F.col("place")))


def derived(measured: DataFrame, sector: str | None = "sector", depreciation: str = "depreciation", shares: str | None = "stated_shares") -> DataFrame:
    """The figures of a period: other columns of ``measured`` travel along, those of the rules become these.

    Total assets and revenue, net income and equity are known of every company; the industrial figures are null in the financial sector. Equity is
    that of the company's own holders where something is left for them. Shares are the stated ones, else net income by the filing's own
    earnings a share.
    """
    c = F.col
    bank = is_financial(c(sector)) if sector else F.lit(False)
    known = {r.name: F.when(~bank, c(r.name)) if r.industrial else c(r.name) for r in RULES}
    worn = F.when(~bank, c(depreciation))
    own = known["whole_equity"] - known["outside_equity"]
    capex = F.when(known["investing_cash_flow"] < 0, -known["investing_cash_flow"]).when(known["investing_cash_flow"].isNotNull(), F.lit(0))
    cash = sum_any(known["cash"], known["short_term_investments"])
    debt = sum_any(known["short_term_debt"], known["long_term_debt"])
    told = F.when(known["net_income"] > 0, known["net_income"] / known["told_earnings_per_share"])
    stated = F.when(c(shares) != 0, c(shares)) if shares else F.lit(None)
    figures = {
        "revenue": known["revenue"], "gross_profit": known["gross_profit"], "ebit": known["ebit"], "ebitda": sum_any(known["ebit"], worn), "financial_result": known["financial_result"], "net_income": known["net_income"],
        "equity": F.when(own > 0, own).otherwise(known["whole_equity"]), "total_assets": known["total_assets"], "current_assets": known["current_assets"], "current_liabilities": known["current_liabilities"],
        "cash_and_equivalents": cash, "short_term_debt": known["short_term_debt"], "long_term_debt": known["long_term_debt"], "gross_debt": debt, "net_debt": minus_optional(debt, cash),
        "operating_cash_flow": known["operating_cash_flow"], "capex": capex, "free_cash_flow": minus_optional(known["operating_cash_flow"], capex), "depreciation": worn, "shares_outstanding": F.coalesce(stated, told),
    }
    names = {r.name for r in RULES} | {depreciation, *([shares] if shares else [])}
    return measured.select(*(n for n in measured.columns if n not in names), *(v.cast("double").alias(n) for n, v in figures.items()))


def is_annual(start: Column, end: Column) -> Column:
    return F.coalesce(F.datediff(end, start) >= ANNUAL_DAYS, F.lit(True))


def unique_periods(periods: DataFrame, key: str, place: Column) -> DataFrame:
    """One period by key and end: a consolidated one before others, else the first in ``place``."""
    order = Window.partitionBy(key, "period_end").orderBy(F.col("consolidated").desc(), place)
    return periods.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def trailing_periods(periods: DataFrame, key: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """The twelve months up to each period: key, period_end, basis, published_at, flows, balances and ``carried``.

    ``periods`` (unique by key and end): period_end, annual, published_at, flows and balances; interim flows run from the beginning
    of the year. A year's period stands for itself. An interim one becomes its flows plus those of the year's period before it minus those
    of the interim period that ended on the same day a year earlier; a flow that one of them lacks is null, balances are its own,
    and it is published when the last of the three is, null if one is not known. basis: annual, trailing, or what is missing
    (no year, no comparable); then all figures are null.

    One shuffle by key; a key has a row a date at most, so no window grows with the data.
    """
    flows = F.struct("published_at", *FLOWS)
    before = Window.partitionBy(key).orderBy("period_end").rowsBetween(Window.unboundedPreceding, -1)
    day = Window.partitionBy(key, F.month("period_end"), F.dayofmonth("period_end"), "annual").orderBy("period_end")
    earlier = F.lag(F.struct(F.year("period_end").alias("yr"), flows.alias("flows"))).over(day)
    met = periods.withColumns({"_year": F.last(F.when(F.col("annual"), flows), ignorenulls=True).over(before), "_same": earlier})
    met = met.withColumn("_same", F.when(~F.col("annual") & (F.col("_same.yr") == F.year("period_end") - 1), F.col("_same.flows")))
    basis = F.when(F.col("annual"), "annual").when(F.col("_year").isNull(), "no year").when(F.col("_same").isNull(), "no comparable").otherwise("trailing")
    met = met.withColumn("basis", basis)
    own, whole = F.col("basis") == "annual", F.col("basis").isin("annual", "trailing")
    dates = [F.col("published_at"), F.col("_year.published_at"), F.col("_same.published_at")]
    all_known = dates[0].isNotNull() & dates[1].isNotNull() & dates[2].isNotNull()
    published = F.when(own, dates[0]).when(whole & all_known, F.greatest(*dates))
    figures = [F.when(own, F.col(c)).when(whole, F.col(c) + F.col(f"_year.{c}") - F.col(f"_same.{c}")).alias(c) for c in FLOWS]
    return met.select(key, "period_end", "basis", published.alias("published_at"), *figures, *(F.when(whole, F.col(c)).alias(c) for c in BALANCES), *carried)


def latest_trailing(periods: DataFrame, key: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """The last of ``trailing_periods`` of each key."""
    last = Window.partitionBy(key).orderBy(F.col("period_end").desc())
    return trailing_periods(periods, key, carried).withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")
