"""Ranked search over a directory, and the merge of directories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import fold


def ranked_search(df: DataFrame, text: str, exact: str, prefix: list[str], tie: list[str], limit: int) -> DataFrame:
    """Rows that hold the folded text, by rank: equal to ``exact`` 0, a prefix of the k-th column k + 1, elsewhere 5.

    The limit of the report lies between 1 and 50; Spark keeps only that many rows per task while sorting.
    """
    wanted = fold(F.lit(text))
    hit = reduce(lambda a, b: a | b, [F.contains(fold(F.col(c)), wanted) for c in dict.fromkeys([exact, *prefix])])
    rank = F.when(fold(F.col(exact)) == wanted, 0)
    for k, column in enumerate(prefix):
        rank = rank.when(F.startswith(fold(F.col(column)), wanted), k + 1)
    return df.where(hit).withColumn("match_rank", rank.otherwise(5)).orderBy("match_rank", F.length(exact), exact, *tie).limit(max(1, min(50, limit)))


def merge_directories(rows: DataFrame, keys: list[str], ordinal: str, confidence: str) -> DataFrame:
    """One row per key: each field from the most confident row that has it, earlier rows first among equals."""
    rank = F.when(F.col(confidence) == "high", 2).when(F.col(confidence) == "medium", 1).when(F.col(confidence) == "low", 0).otherwise(-1)
    w = Window.partitionBy(*keys).orderBy(rank.desc(), F.col(ordinal).asc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fields = [c for c in rows.columns if c not in (*keys, ordinal)]
    return rows.select(*keys, *(F.first(c, ignorenulls=True).over(w).alias(c) for c in fields), F.row_number().over(Window.partitionBy(*keys).orderBy(rank.desc(), F.col(ordinal).asc())).alias("_rank")).where("_rank = 1").drop("_rank")
