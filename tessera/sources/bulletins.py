"""Local instruments: lists of a directory in several shapes, and daily bulletins with a walk back over days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.profiles import bulletin_type, directory_type
from tessera.functions.text import is_listed_ticker, iso_date, squeeze
from tessera.operators.frames import asof_latest, keep_best
from tessera.sources.directories import receipt_underlying

# Names under which lists and fields of a directory appear, in the order in which they are tried, and its tickers.
LISTS = ("stocks", "results", "data", "instruments", "assets")
FIELDS = {
    "ticker": ("stock", "ticker", "symbol", "code"), "raw_type": ("type", "assetType", "asset_type", "category"), "name": ("name", "longName", "companyName", "company_name", "description"),
    "exchange": ("exchange", "market", "exchangeName"), "country": ("country", "countryCode"), "isin": ("isin", "ISIN"), "underlying_ticker": ("underlyingTicker", "underlying_ticker", "underlyingSymbol", "referenceTicker"),
}
TICKER, EXCHANGE, COUNTRY = r"^[A-Z][A-Z0-9.\-]{0,11}$", "B3", "BR"

# Columns of a bulletin, the segment that counts, and the days that the walk goes back.
COLUMNS = ("TckrSymb", "SgmtNm", "SctyCtgyNm", "CrpnNm", "AsstDesc", "CFICd", "ISIN", "TradgCcy", "MktNm", "Xchg", "CntryNm", "Country", "RptDt")
CASH, DAYS_BACK = "CASH", 7


def _said(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def local_directory(docs: DataFrame, json_col: str, order: str) -> DataFrame:
    """ticker, raw_type, name, exchange, country, isin, underlying_ticker, instrument_type: the first entry of each valid ticker.

    A document is a list, an object with a list under a known name, or one with lists under any names. Entries that are
    no objects are skipped; null or broken documents give no rows. A receipt without an underlying takes a known one.
    """
    doc = F.col(json_col)

    def entries(listed: Column) -> Column:
        return F.filter(F.from_json(listed, "array<string>"), lambda e: F.startswith(F.ltrim(e), F.lit("{")))

    def is_list(text: Column) -> Column:
        return F.coalesce(F.startswith(F.ltrim(text), F.lit("[")), F.lit(False))

    rows = F.when(is_list(doc), entries(doc))
    for name in LISTS:
        found = F.get_json_object(doc, f"$.{name}")
        rows = rows.when(is_list(found), entries(found))
    rows = rows.otherwise(F.flatten(F.transform(F.filter(F.map_values(F.from_json(doc, "map<string,string>")), is_list), entries)))
    read = docs.select(order, F.posexplode(rows).alias("_place", "_entry")).withColumn("_entry", F.from_json("_entry", "map<string,string>"))
    told = read.select(order, "_place", *(F.coalesce(*(_said(F.try_element_at("_entry", F.lit(n))) for n in names)).alias(field) for field, names in FIELDS.items()))
    valid = told.withColumn("ticker", F.upper("ticker")).where(F.rlike("ticker", F.lit(TICKER)))
    first = keep_best(valid, ["ticker"], [F.col(order).asc(), F.col("_place").asc()]).select(*FIELDS)
    typed = first.withColumns({"exchange": F.coalesce("exchange", F.lit(EXCHANGE)), "country": F.coalesce("country", F.lit(COUNTRY)), "instrument_type": directory_type(F.col("raw_type"), F.col("name"), F.col("ticker"))})
    return typed.withColumn("underlying_ticker", F.coalesce("underlying_ticker", F.when(F.col("instrument_type") == "bdr", receipt_underlying(F.col("ticker")))))


def bulletin_instruments(docs: DataFrame, day: str, json_col: str) -> DataFrame:
    """day, ticker, name, category, instrument_type, cfi_code, isin, currency, exchange, country, reference_date: a document a day.

    Of a ticker's rows in the cash segment the first counts, in the document of each day.
    """
    parsed = F.from_json(json_col, "table struct<columns:array<struct<name:string>>, values:array<array<string>>>")["table"]
    rows = docs.select(F.col(day).alias("day"), parsed["columns"]["name"].alias("_names"), F.posexplode(parsed["values"]).alias("_place", "_fields"))
    read = rows.select("day", "_place", *(F.get("_fields", (F.array_position("_names", F.lit(c)) - 1).cast("int")).alias(c) for c in COLUMNS)).where(F.col("SgmtNm") == CASH)

    def first(*names: str) -> Column:
        return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))

    category, name = F.nullif(squeeze(F.col("SctyCtgyNm")), F.lit("")), F.coalesce(squeeze(first("CrpnNm", "AsstDesc")), F.lit(""))
    told = read.select(
        "day", "_place", F.col("TckrSymb").alias("ticker"), F.nullif(name, F.lit("")).alias("name"), category.alias("category"), bulletin_type(category, name, F.col("AsstDesc")).alias("instrument_type"), _said(F.col("CFICd")).alias("cfi_code"),
        _said(F.col("ISIN")).alias("isin"), _said(F.col("TradgCcy")).alias("currency"), _said(first("MktNm", "Xchg")).alias("exchange"), _said(first("CntryNm", "Country")).alias("country"), iso_date(F.col("RptDt")).alias("reference_date"),
    )
    return keep_best(told.where("ticker is not null and day is not null"), ["day", "ticker"], [F.col("_place").asc()]).drop("_place")


def latest_instruments(asked: DataFrame, instruments: DataFrame, ticker: str, at: str) -> DataFrame:
    """For each local ticker asked for, its latest row of the seven days before ``at``; others have nulls."""
    values = [c for c in instruments.columns if c not in ("ticker", "day")]
    wanted = asked.withColumns({"_ticker": F.when(is_listed_ticker(F.col(ticker)), F.upper(F.trim(ticker))), "_until": F.date_sub(at, 1)})
    series = instruments.withColumnRenamed("ticker", "_ticker").withColumnsRenamed({v: f"_{v}" for v in values})
    found = asof_latest(wanted, series, ["_ticker"], "_until", "day", [f"_{v}" for v in values])
    near = F.col("matched_at") >= F.date_sub(at, DAYS_BACK)
    return found.select(*asked.columns, F.when(near, F.col("matched_at")).alias("day"), *(F.when(near, F.col(f"_{v}")).alias(v) for v in values))
