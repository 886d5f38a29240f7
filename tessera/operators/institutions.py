"""Bank registries: the conglomerate that reports for an institution, and the newest quarter with values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold


def conglomerate_codes(banks: DataFrame, code: str, prudential: str, kind: str, name: str) -> DataFrame:
    """code, conglomerate: the financial conglomerate (kind C, its name not a prudential one) of the same prudential code, else the own code.

    Where a prudential code has several such rows, the smallest code is taken. Rows without a prudential code keep their own.
    """
    heads = banks.where((F.trim(kind) == "C") & ~F.contains(fold(F.coalesce(name, F.lit(""))), F.lit("PRUDENCIAL"))).groupBy(prudential).agg(F.min(code).alias("_head"))
    return banks.join(heads, prudential, "left").select(code, F.coalesce("_head", code).alias("conglomerate"))


def quarter_number(period: str) -> Column:
    """yyyymm of a quarter's last month as a running number."""
    at = F.col(period)
    return F.floor(at / 100).cast("int") * 4 + (at % 100 / 3).cast("int")


def first_filled_quarter(asked: DataFrame, values: DataFrame, code: str, at: str, quarter: str, columns: list[str], newest: int, back: int = 8) -> DataFrame:
    """For each asked code the newest of ``back`` quarters that has values, counted back from the asked or the ``newest`` one, whichever is earlier."""
    begin = asked.withColumn("_at", F.least(F.col(at), F.lit(newest))).withColumn("_from", quarter_number("_at"))
    held = values.withColumn("_q", quarter_number(quarter))
    near = (F.col("_q") <= F.col("_from")) & (F.col("_q") > F.col("_from") - back)
    row = F.struct(quarter, *columns)
    found = begin.join(held, code, "left").groupBy(code, at).agg(F.max_by(F.when(near, row), F.when(near, F.col("_q"))).alias("_row"))
    return found.select(code, at, F.col(f"_row.{quarter}").alias(quarter), *(F.col(f"_row.{c}").alias(c) for c in columns))
