"""JSON documents as rows: tables of columns and values, lists of dated values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import br_date, comma_decimal


def value_table(docs: DataFrame, json_col: str, columns: list[str]) -> DataFrame:
    """Rows of ``{"table": {"columns": [{"name": ...}], "values": [[...]]}}`` with the named columns; absent ones are null."""
    parsed = docs.withColumn("doc", F.from_json(json_col, "table struct<columns:array<struct<name:string>>, values:array<array<string>>>"))
    rows = parsed.select(F.col("doc.table.columns.name").alias("names"), F.posexplode("doc.table.values").alias("row_no", "fields"))

    def field(name: str) -> Column:
        return F.get("fields", (F.array_position("names", F.lit(name)) - 1).cast("int")).alias(name)

    return rows.select("row_no", *map(field, columns))


def monthly_series(docs: DataFrame, json_col: str) -> DataFrame:
    """month, value (a share of one) of ``[{"data": "dd/MM/yyyy", "valor": "1,00"}]`` in percent; bad rows are skipped."""
    rows = docs.select(F.explode(F.from_json(json_col, "array<struct<data:string, valor:string>>")).alias("r"))
    read = rows.select(br_date(F.col("r.data")).alias("month"), (comma_decimal(F.col("r.valor")) / 100).cast("decimal(38,12)").alias("value"))
    return read.where("month is not null and value is not null")
