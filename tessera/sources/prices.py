"""Reference prices of debt: a delimited file behind a preamble, a table in a page, and lists of trades in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import label_key, plain_decimal
from tessera.sources.html import cells, elements, has_class, tables

# Names of columns, header keys by meaning, the table of certificates, and the places of a trade's code and prices.
CODE, UNIT_PRICE, SEPARATOR = "Código", "PU", "@"
HEADERS = {"reference": ("data_de_referencia", "data_referencia"), "identifier": ("codigo", "codigo_do_ativo"), "price": ("pu", "pu_indicativo")}
PRICE_TABLE, TRADE_CODE, TRADE_PRICES = "custom-anbi-ui-table", 2, (12, 11, 9)


def grouped_decimal(text: Column) -> Column:
    """Points group thousands and a comma parts decimals; nothing else may stand there."""
    return plain_decimal(F.translate(F.translate(text, ".", ""), ",", "."))


def positive_decimal(text: Column) -> Column:
    """A number above zero; with a comma in it one point may group thousands."""
    shown = F.trim(text)
    plain = F.when(F.contains(shown, F.lit(",")), F.translate(F.regexp_replace(shown, r"^([^.]*)\.", "$1"), ",", ".")).otherwise(shown)
    value = plain.try_cast("decimal(38,10)")
    return F.when(value > 0, value)


def debenture_prices(lines: DataFrame) -> DataFrame:
    """archive, identifier, price: rows behind the line that holds the header; the last positive price of a code wins."""
    heads = lines.where(F.contains("text", F.lit(CODE + SEPARATOR))).groupBy("archive", "member_no").agg(F.min_by(F.substring_index("text", CODE + SEPARATOR, -1), "line_no").alias("_rest"), F.min("line_no").alias("_from"))
    named = heads.select("archive", "member_no", "_from", F.split(F.concat(F.lit(CODE + SEPARATOR), "_rest"), SEPARATOR).alias("_names"))
    rows = lines.join(named, ["archive", "member_no"]).where("line_no > _from").withColumn("_fields", F.split("text", SEPARATOR))

    def field(name: str) -> Column:
        return F.get("_fields", (F.array_position("_names", F.lit(name)) - 1).cast("int"))

    read = rows.select("archive", "member_no", "line_no", F.upper(F.trim(field(CODE))).alias("identifier"), grouped_decimal(field(UNIT_PRICE)).alias("price")).where("identifier <> '' and price > 0")
    return read.groupBy("archive", "identifier").agg(F.max_by("price", F.struct("member_no", "line_no")).alias("price"))


def certificate_prices(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, reference_date, identifier, price: of a page's first table whose first row names all three; the last positive price wins."""
    read = cells(elements(pages.select(key, html), html, key), key, tables(lambda e: has_class(e, PRICE_TABLE)))
    first = read.groupBy(key, "table_no").agg(F.min("row").alias("_head"))
    heads = read.join(first, [key, "table_no"]).where("row = _head").withColumn("_key", label_key(F.col("joined")))
    places = heads.groupBy(key, "table_no", "_head").agg(*(F.min(F.when(F.col("_key").isin(*names), F.col("cell_no"))).alias(f"_{meaning}") for meaning, names in HEADERS.items())).where(" and ".join(f"_{m} is not null" for m in HEADERS))
    chosen = places.groupBy(key).agg(F.min_by(F.struct("table_no", "_head", *(f"_{m}" for m in HEADERS)), "table_no").alias("p")).select(key, "p.*")
    rows = read.join(chosen, [key, "table_no"]).where("row > _head").groupBy(key, "row").agg(*(F.max(F.when(F.col("cell_no") == F.col(f"_{m}"), F.trim("joined"))).alias(m) for m in HEADERS))
    dated = rows.select(key, "row", F.try_to_date("reference", "d/M/yyyy").alias("reference_date"), F.upper("identifier").alias("identifier"), grouped_decimal(F.col("price")).alias("price")).where("reference_date is not null and identifier <> '' and price > 0")
    return dated.groupBy(key, "reference_date", "identifier").agg(F.max_by("price", "row").alias("price"))


def trade_prices(docs: DataFrame, key: str, json_col: str) -> DataFrame:
    """key, identifier, price: the first positive price of each trade; short rows are skipped, the last trade of a code wins."""
    rows = docs.select(key, F.posexplode(F.from_json(json_col, "table struct<values:array<array<string>>>")["table"]["values"]).alias("_place", "r")).where(f"size(r) > {max(TRADE_PRICES)}")
    read = rows.select(key, "_place", F.upper(F.get("r", F.lit(TRADE_CODE))).alias("identifier"), F.coalesce(*(positive_decimal(F.get("r", F.lit(p))) for p in TRADE_PRICES)).alias("price")).where("identifier <> '' and price is not null")
    return read.groupBy(key, "identifier").agg(F.max_by("price", "_place").alias("price"))


def wanted(prices: DataFrame, identifiers: DataFrame, column: str) -> DataFrame:
    """The prices of these codes, whatever their case and the blanks around them."""
    asked = identifiers.select(F.upper(F.trim(F.col(column))).alias("identifier")).distinct()
    return prices.join(asked, "identifier", "left_semi")
