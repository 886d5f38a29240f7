"""Market data documents: quotes, company overviews and fund profiles, one row each, with lenient values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts without a value, the currency and exchange of local quotes, and fields by name in the documents.
NO_VALUE, CURRENCY, EXCHANGE = ("", "None", "-"), "BRL", "B3"
TEXTS = {"description": "Description", "country": "Country", "sector": "Sector", "industry": "Industry", "exchange": "Exchange", "currency": "Currency"}
NUMBERS = {"market_capitalization": "MarketCapitalization", "price_to_earnings": "PERatio", "price_to_book": "PriceToBookRatio", "earnings_per_share": "EPS", "dividend_yield": "DividendYield"}
PROFILE = {"net_assets": "net_assets", "net_expense_ratio": "net_expense_ratio", "portfolio_turnover": "portfolio_turnover", "dividend_yield": "dividend_yield", "nav": "net_asset_value"}
FAILURES = ("Error Message", "Note")


def lenient_decimal(text: Column) -> Column:
    return F.when(~text.isin(*NO_VALUE), F.trim(text).try_cast("decimal(38,10)"))


def lenient_text(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def _field(doc: str, *path: str) -> Column:
    return F.get_json_object(doc, "$" + "".join(f"['{p}']" for p in path))


def _usable(docs: DataFrame, doc: str) -> DataFrame:
    """The documents that are objects and don't tell of a failure."""
    return docs.where(F.startswith(F.ltrim(doc), F.lit("{"))).where(~F.exists(F.array(*(_field(doc, f) for f in FAILURES)), lambda x: F.coalesce(x, F.lit("")) != ""))


def quotes(docs: DataFrame, key: str, doc: str) -> DataFrame:
    """key, price, currency, exchange, quoted_at, description, market_capitalization: of the first result's data.

    Without a price there is no quote: currency, exchange and time are null then, the overview stays. Documents without
    data give no row.
    """
    data = F.get_json_object(doc, "$.results[0].data")
    read = docs.select(key, data.alias("_data")).where(F.startswith("_data", F.lit("{")))
    told = read.select(key, lenient_decimal(_field("_data", "regularMarketPrice")).alias("price"), F.coalesce(lenient_text(_field("_data", "currency")), F.lit(CURRENCY)).alias("currency"), _field("_data", "regularMarketTime").try_cast("timestamp").alias("quoted_at"), lenient_text(_field("_data", "longName")).alias("description"), lenient_decimal(_field("_data", "marketCap")).alias("market_capitalization"))
    quoted = F.col("price").isNotNull()
    return told.withColumns({"exchange": F.when(quoted, F.lit(EXCHANGE)), "currency": F.when(quoted, F.col("currency")), "quoted_at": F.when(quoted, F.col("quoted_at"))})


def overviews(docs: DataFrame, key: str, doc: str) -> DataFrame:
    """key, the texts and the numbers of a company's overview."""
    return _usable(docs, doc).select(key, *(lenient_text(_field(doc, f)).alias(n) for n, f in TEXTS.items()), *(lenient_decimal(_field(doc, f)).alias(n) for n, f in NUMBERS.items()))


def fund_profiles(docs: DataFrame, key: str, doc: str) -> DataFrame:
    """key, a fund's numbers, inception_date, description, and its sectors, asset types and holdings as arrays with weights.

    Entries without a weight are left out, as are holdings without a symbol.
    """
    listed = F.from_json(doc, "sectors array<struct<name:string, sector:string, weight:string>>, asset_allocation array<struct<name:string, sector:string, weight:string>>, holdings array<struct<symbol:string, description:string, weight:string>>")

    def allocations(items: Column) -> Column:
        named = F.transform(items, lambda i: F.struct(F.coalesce(F.nullif(i["name"], F.lit("")), i["sector"], F.lit("")).alias("name"), lenient_decimal(i["weight"]).alias("weight")))
        return F.coalesce(F.filter(named, lambda i: i["weight"].isNotNull()), F.array().cast("array<struct<name:string,weight:decimal(38,10)>>"))

    held = F.transform(F.filter(listed["holdings"], lambda i: i["symbol"] != ""), lambda i: F.struct(i["symbol"].alias("symbol"), lenient_text(i["description"]).alias("description"), lenient_decimal(i["weight"]).alias("weight")))
    kept = F.coalesce(F.filter(held, lambda i: i["weight"].isNotNull()), F.array().cast("array<struct<symbol:string,description:string,weight:decimal(38,10)>>"))
    return _usable(docs, doc).select(
        key, *(lenient_decimal(_field(doc, f)).alias(n) for n, f in PROFILE.items()), F.try_to_date(F.substring(_field(doc, "inception_date"), 1, 10), "yyyy-MM-dd").alias("inception_date"),
        lenient_text(_field(doc, "description")).alias("description"), allocations(listed["sectors"]).alias("sectors"), allocations(listed["asset_allocation"]).alias("asset_types"), kept.alias("holdings"),
    )


def foreign_instruments(found: DataFrame, key: str) -> DataFrame:
    """Identities of foreign instruments from their overviews."""
    return found.select(key, F.lit("INTERNATIONAL").alias("category"), F.col("description").alias("name"), "exchange", "country", "currency", F.lit("medium").alias("confidence"))
