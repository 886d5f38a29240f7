"""Ticker directories: JSON documents in three shapes as one table of identities, and the names that receipts borrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold
from tessera.operators.frames import keep_best

# The names under which a directory's fields appear, in the order in which they are tried.
FIELDS = {
    "ticker": ("ticker",),
    "cik": ("cik_str", "cik"),
    "name": ("name", "companyName", "company_name", "title"),
    "exchange": ("exchange", "Exchange"),
    "country": ("country", "Country"),
    "security_class": ("security_class", "class", "securityClass"),
}

# Fixed value: the shape of a local ticker.
LOCAL_TICKER = r"^[A-Z]{4}\d{1,2}$"

# Receipts and the foreign shares they stand for.
RECEIPTS = {
    "AAPL34": "AAPL", "ABUD34": "BIDU", "A1AP34": "AAPL", "AMZO34": "AMZN", "BABA34": "BABA", "BIDU34": "BIDU", "DISB34": "DIS", "GOGL34": "GOOGL",
    "M1TA34": "META", "MELI34": "MELI", "MSFT34": "MSFT", "N1DA34": "NVDA", "NFLX34": "NFLX", "NVDC34": "NVDA", "P2LT34": "PLTR", "TSLA34": "TSLA",
}


def cik(text: Column) -> Column:
    """Ten digits; null unless up to ten digits, which CIK may precede."""
    return F.when(F.rlike(F.trim(text), F.lit(r"(?i)^(CIK)?\d{1,10}$")), F.lpad(F.regexp_extract(text, r"\d+", 0), 10, "0"))


def foreign_ticker(text: Column) -> Column:
    """Upper-cased; null unless a letter and up to nine letters, digits, dots and hyphens that are no local ticker."""
    shown = F.upper(F.trim(text))
    return F.when(F.rlike(shown, F.lit(r"^[A-Z][A-Z0-9.\-]{0,9}$")) & ~F.rlike(shown, F.lit(LOCAL_TICKER)), shown)


def receipt_underlying(ticker: Column) -> Column:
    """The foreign share of a known receipt; null for others."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in RECEIPTS.items() for x in pair)), F.upper(F.trim(ticker)))


def ticker_directory(docs: DataFrame, json_col: str, order: str) -> DataFrame:
    """ticker, cik, name, exchange, country, security_class: the first entry of each valid ticker, by ``order`` and place in the document.

    A document is ``{"fields": [...], "data": [[...]]}``, ``{"data": [{...}]}``, a map or a list of entries. Entries
    without a valid ticker and number are skipped; a missing country is US. Null or broken documents give no rows.
    """

    def first(get, names: tuple[str, ...]) -> Column:
        return F.coalesce(*(F.nullif(F.trim(get(n)), F.lit("")) for n in names))

    def entries(rows: Column, get) -> Column:
        return F.transform(rows, lambda r: F.struct(*(first(lambda n: get(r, n), names).alias(field) for field, names in FIELDS.items())))

    def by_name(r: Column, n: str) -> Column:
        return F.try_element_at(r, F.lit(n))

    doc = F.col(json_col)
    matrix = F.from_json(doc, "fields array<string>, data array<array<string>>")
    listed = F.from_json(doc, "data array<map<string, string>>")["data"]
    plain = F.when(F.startswith(F.ltrim(doc), F.lit("[")), F.from_json(doc, "array<map<string, string>>")).otherwise(F.map_values(F.from_json(doc, "map<string, map<string, string>>")))
    rows = F.when(F.get_json_object(doc, "$.fields").isNotNull(), entries(matrix["data"], lambda r, n: F.get(r, (F.array_position(matrix["fields"], F.lit(n)) - 1).cast("int")))).when(F.get_json_object(doc, "$.data[0]").isNotNull(), entries(listed, by_name)).otherwise(entries(plain, by_name))
    read = docs.select(order, F.posexplode(rows).alias("_place", "e")).select(order, "_place", "e.*")
    valid = read.withColumns({"ticker": foreign_ticker(F.col("ticker")), "cik": cik(F.col("cik")), "country": F.coalesce("country", F.lit("US"))}).where("ticker is not null and cik is not null")
    return keep_best(valid, ["ticker"], [F.col(order).asc(), F.col("_place").asc()]).select(*FIELDS)


def with_underlying_names(df: DataFrame, ticker: str, name: str, underlying: str, out: str) -> DataFrame:
    """``out`` filled, where it is null, with the name of the row whose ticker is the underlying one; names that only repeat a ticker lend nothing.

    Of several rows with a ticker the largest name is lent.
    """
    lent = df.where(F.col(name).isNotNull() & (fold(F.col(name)) != fold(F.col(ticker)))).groupBy(fold(F.col(ticker)).alias("_lent")).agg(F.max(name).alias("_name"))
    wanted = F.when(F.col(out).isNull(), fold(F.col(underlying)))
    return df.withColumn("_wanted", wanted).join(lent, F.col("_wanted") == F.col("_lent"), "left").withColumn(out, F.coalesce(out, "_name")).drop("_wanted", "_lent", "_name")
