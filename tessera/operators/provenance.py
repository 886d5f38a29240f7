"""Values that say where they come from.

A told value is a struct (missing, rank, source, value, confidence, reason) whose order is its merge: present before missing, then
the smaller rank, then the source's name. So the least of any number of told values is the one to believe, ``F.min`` merges them in an
aggregate or a window and ``F.least`` in a row, and neither order nor grouping of the merges matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import nearest_factor
from tessera.operators.frames import reverse_product

TOLD = "struct<missing:boolean,rank:int,source:string,value:double,confidence:double,reason:string>"
#: Confidence in a value by how surely its company was matched, factors between share units with the error that is allowed, and how
#: far apart two implied share counts may be.
CONFIDENCE = {"high": 0.95, "medium": 0.8}
UNIT_FACTORS, UNIT_ERROR, IMPLIED_SPREAD = (0.001, 1.0, 1000.0), 0.1, 1.2


def told(value: Column, source: Column | str, rank: int = 0, confidence: Column | float = 1.0, reason: Column | str | None = None) -> Column:
    """A told value; a null is missing, for ``reason``."""
    missing, column = value.isNull(), lambda x: x if isinstance(x, Column) else F.lit(x)
    why = F.when(missing, F.coalesce(column(reason), F.concat(column(source), F.lit(" has none"))))
    return F.struct(missing.alias("missing"), F.lit(rank).alias("rank"), column(source).alias("source"), value.cast("double").alias("value"), F.when(missing, F.lit(0.0)).otherwise(column(confidence)).cast("double").alias("confidence"), why.alias("reason")).cast(TOLD)


def prefer(*values: Column) -> Column:
    """The told value to believe; ranks decide, not places."""
    return F.least(*values) if len(values) > 1 else values[0]


def scaled(of: Column, factor: Column, reason: str) -> Column:
    """A told value times a factor; where the factor is not one, the reason says so."""
    return F.struct(of["missing"].alias("missing"), of["rank"].alias("rank"), of["source"].alias("source"), (of["value"] * factor).alias("value"), of["confidence"].alias("confidence"), F.when((factor != 1) & ~of["missing"], F.lit(reason)).otherwise(of["reason"]).alias("reason")).cast(TOLD)


def implied_shares(net_income: Column, earnings_per_share: Column, equity: Column, book_value_per_share: Column) -> Column:
    """Shares that values a share imply: the mean of both counts, the one by earnings where they are over a fifth apart or the other is not there."""
    by_income, by_equity = (F.when((total > 0) & (each > 0), total / each) for total, each in ((net_income, earnings_per_share), (equity, book_value_per_share)))
    apart = F.greatest(by_income, by_equity) / F.least(by_income, by_equity) > IMPLIED_SPREAD
    return F.when(by_income.isNull() | by_equity.isNull(), F.coalesce(by_income, by_equity)).when(apart, by_income).otherwise((by_income + by_equity) / 2)


def unit_factor(reported: Column, reference: Column) -> Column:
    """What brings a share count in other units to the reference: the nearest factor, within a tenth, else one."""
    ways = F.array(*(F.struct(F.abs(reported * f - reference).alias("off"), F.lit(k).alias("at"), F.lit(f).alias("factor")) for k, f in enumerate(UNIT_FACTORS)))
    best = F.array_min(ways)
    return F.coalesce(F.when((reported > 0) & (reference > 0) & (best["off"] / reference <= UNIT_ERROR), best["factor"]), F.lit(1.0))


def split_normalised(history: DataFrame, key: str, year: str, shares: str) -> DataFrame:
    """``history`` with its share counts on the basis of the last year: each year's times the splits after it."""
    w_next = F.lead(shares).over(Window.partitionBy(key).orderBy(year))
    factor = F.when((F.col(shares) > 0) & (w_next > 0), nearest_factor(w_next / F.col(shares))).otherwise(F.lit(1.0))
    split = history.withColumn("_split", factor)
    later = reverse_product(split, [key], [F.col(year).asc()], "_split", "_later")
    return later.withColumn(shares, F.col(shares) * F.col("_later") * F.col("_split")).drop("_split", "_later")


def provenance_rows(wide: DataFrame, keys: list[str], fields: dict[str, Column], reference: Column) -> DataFrame:
    """A row a field of told values: field, value, source, confidence, status, reason, reference_date."""
    rows = F.array(*(F.struct(F.lit(name).alias("field"), value.alias("told")) for name, value in fields.items()))
    long = wide.select(*keys, reference.alias("reference_date"), F.inline(rows))
    return long.select(*keys, "field", "told.value", F.when(~F.col("told.missing"), F.col("told.source")).alias("source"), "told.confidence", F.when(F.col("told.missing"), "missing").otherwise("valid").alias("status"), "told.reason", "reference_date")


def snapshot(latest: DataFrame, keys: list[str]) -> DataFrame:
    """Provenance rows of a company's latest twelve months.

    ``latest``: what ``derivation.latest_trailing`` gives, and per company match (high or medium), capital_shares (as reported, perhaps in other
    units), market_shares, earnings_per_share, book_value_per_share, dividends_per_share and their source public_source.

    Shares: the market's count, else what earnings and book value a share imply, else the reported ones; these are brought to the
    unit of the first of the others that is there.
    """
    c = F.col
    sure = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv)), c("match")), F.lit(CONFIDENCE["medium"]))
    why = F.when(c("basis").isin("annual", "trailing"), F.lit("not in the statements")).otherwise(c("basis"))
    filed = {f"{m}_ttm": m for m in ("revenue", "ebit", "ebitda", "net_income", "free_cash_flow")} | {"equity": "equity", "net_debt": "net_debt"}
    fields = {name: told(c(m), "statements", 0, sure, why) for name, m in filed.items()}
    implied = implied_shares(c("net_income"), c("earnings_per_share"), c("equity"), c("book_value_per_share"))
    wide = latest.withColumn("_implied", implied).withColumn("_reference", F.coalesce("market_shares", "_implied"))
    reported = told(c("capital_shares"), "statements", 2, sure, "no share capital")
    shares = prefer(told(c("market_shares"), "market", 0, sure), told(c("_implied"), "implied", 1, sure), scaled(reported, unit_factor(c("capital_shares"), c("_reference")), "unit"))
    fields["shares_outstanding"] = shares
    for name in ("earnings_per_share", "book_value_per_share", "dividends_per_share"):
        fields[name] = told(c(name), c("public_source"), 0, sure, "not published")
    return provenance_rows(wide, keys, fields, c("period_end"))


def merged(rows: DataFrame, keys: list[str], value: str = "told") -> DataFrame:
    """One told value by ``keys`` from any number, and the sources that were asked: an aggregate, so in any order and grouping."""
    return rows.groupBy(*keys).agg(F.min(value).alias(value), F.array_sort(F.collect_set(F.col(f"{value}.source"))).alias("asked"))
