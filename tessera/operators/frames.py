"""Keyed frames: best row, last rows, neighbours, as-of joins, running figures. One shuffle by key each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``, which must be total for a determined result."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The ``n`` rows of each key that come first in ``order`` (newest first), numbered by ``recency`` from 1."""
    return df.withColumn("recency", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("recency") <= n)


def with_previous(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """prev_<column> of the row before, within the frame as it is: filter first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def asof_latest(targets: DataFrame, series: DataFrame, keys: list[str], at: str, time: str, values: list[str]) -> DataFrame:
    """For each target the latest series row at or before it; unmatched targets have nulls.

    Both sides are stacked and walked in time order, series rows first at equal times: one shuffle by key, no pairs.
    """
    series_rows = series.select(*keys, F.col(time).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(time).alias("matched_at"), *values).alias("_row"), *(F.lit(None).cast(targets.schema[c].dataType).alias(c) for c in targets.columns if c not in keys))
    target_rows = targets.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(series_rows.schema["_row"].dataType).alias("_row"), *(c for c in targets.columns if c not in keys))
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = series_rows.unionByName(target_rows).withColumn("_found", F.last("_row", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*targets.columns, "_found.matched_at", *(F.col(f"_found.{v}").alias(v) for v in values))


def asof_bounded_priority(targets: DataFrame, sources: list[tuple[DataFrame, int]], keys: list[str], at: str, time: str, value: str, days: int) -> DataFrame:
    """For each target the latest value of the first source, in priority order, that has one within ``days`` before it."""
    out = targets
    for k, (source, _) in enumerate(sources):
        found = asof_latest(out, source, keys, at, time, [value]).withColumnsRenamed({"matched_at": f"_at{k}", value: f"_value{k}"})
        near = F.col(f"_at{k}") >= F.col(at) - F.expr(f"INTERVAL {days} DAYS")
        out = found.withColumns({f"_value{k}": F.when(near, F.col(f"_value{k}")), f"_at{k}": F.when(near, F.col(f"_at{k}"))})
    numbers = range(len(sources))
    picked = F.coalesce(*(F.when(F.col(f"_at{k}").isNotNull(), F.lit(sources[k][1])) for k in numbers))
    return out.select(*targets.columns, picked.alias("source"), F.coalesce(*(F.col(f"_at{k}") for k in numbers)).alias("reference"), F.coalesce(*(F.when(F.col(f"_at{k}").isNotNull(), F.col(f"_value{k}")) for k in numbers)).alias("value"))


def priority_merge(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; where both have one, the primary's."""
    stacked = primary.withColumn("_rank", F.lit(0)).unionByName(secondary.withColumn("_rank", F.lit(1)))
    return keep_best(stacked, keys, [F.col("_rank").asc()]).drop("_rank")


def with_drawdown(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """peak so far and the fall from it, as a share."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("peak", F.max(value).over(w)).withColumn("drawdown", F.when(F.col("peak") > 0, (F.col("peak") - F.col(value)) / F.col("peak")))


def reverse_product(df: DataFrame, keys: list[str], order: list[Column], factor: str, out: str) -> DataFrame:
    """The product of the factors of all later rows, for each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(out, F.coalesce(F.product(F.col(factor)).over(w), F.lit(1.0)))


def inline_facts(df: DataFrame, keys: list[str], facts: list[tuple[str, Column, str]]) -> DataFrame:
    """Long fact rows from one wide row per key: fact, value, unit, status, reason when missing."""
    rows = F.array(*(F.struct(F.lit(name).alias("fact"), value.cast("double").alias("value"), F.lit(unit).alias("unit")) for name, value, unit in facts))
    long = df.select(*keys, F.inline(rows))
    return long.withColumn("status", F.when(F.col("value").isNull(), "missing").otherwise("valid"))


def exact_median(df: DataFrame, keys: list[str], value: str, out: str, accuracy: int = 10000) -> DataFrame:
    """keys, n (values that are not null), ``out``: the exact median of few and very large groups, none gathered in one buffer.

    An approximate percentile on either side bounds the middle; its error is below the margin taken. Values below are
    counted, those within (a five-hundredth of a group) are ranked by a running count over distinct values. Groups whose
    values are all null have no row. Null keys form groups of their own.
    """
    margin, named = 10 / accuracy, [f"_{k}" for k in keys]
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    bounds = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_v", [0.5 - margin, 0.5 + margin], accuracy).alias("_b")).withColumnsRenamed(dict(zip(keys, named, strict=True)))
    same = [F.col(k).eqNullSafe(F.col(b)) for k, b in zip(keys, named, strict=True)]
    # nulls stand for all values below the bounds and come first in the running count
    low, high = F.get("_b", F.lit(0)), F.get("_b", F.lit(1))
    counted = rows.join(bounds, same).where(F.col("_v") <= high).groupBy(*keys, "n", F.when(F.col("_v") >= low, F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first, second = (F.min(F.when(F.col("_upto") >= F.floor((F.col("n") + k) / 2), F.col("_v"))) for k in (1, 2))
    return counted.withColumn("_upto", upto).groupBy(*keys, "n").agg(((first + second) / 2).alias(out))
