"""Pairs of texts by sequence likeness, without a shared word and without all pairs.

The likeness (Ratcliff and Obershelp) of texts with la and lb characters is 2M / (la + lb), where M characters stand in
common blocks. At likeness ``limit`` or more, u = la + lb - 2M characters at most are outside the blocks, one at least lies between two
blocks, so there are u + 1 blocks at most, and the q-grams inside blocks, which both texts have, number
M - (u + 1)(q - 1) at least. Texts with T common q-grams (counted with their repetitions) share one among the |A| - T + 1 rarest of A
and the |B| - T + 1 rarest of B. So each text is filed under its rarest q-grams alone, pairs are made there, and no pair at or above the
limit is lost. A q-gram that most texts hold is rare in none and makes no pairs.

What meets is then held against lengths (M <= min(la, lb)) and against the characters that both have (M is no more), both in built-in
functions; the likeness itself is computed for what is left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.matching import sequence_ratio


def least_shared(total: int, limit: float, q: int) -> int:
    """The q-grams that texts of ``total`` characters together share at least, if their likeness is ``limit`` or more."""
    apart = math.floor((1 - limit) * total + 1e-9)
    return math.ceil(limit * total / 2 - 1e-9) - (apart + 1) * (q - 1)


def gram_size(limit: float) -> int:
    """The longest q-grams, up to 3, of which any two different texts at the limit share one."""
    if not 0 < limit <= 1:
        raise ValueError("limit must be above 0, 1 at most")
    # Texts of three characters together, or of two, are alike at the limit only if they are equal, or the limit is no more than 2/3.
    smallest = 4 if limit > 2 / 3 else 2
    for q in (3, 2):
        if limit / 2 > (1 - limit) * (q - 1) and all(least_shared(total, limit, q) >= 1 for total in range(smallest, 400)):
            return q
    return 1


def _numbered(parts: Column) -> Column:
    """Array elements with the number of equal ones before them: a multiset as a set."""
    return F.transform(parts, lambda g, k: F.struct(g.alias("gram"), (F.size(F.filter(F.slice(parts, F.lit(1), k + 1), lambda x: x == g))).alias("nth")))


def _grams(text: Column, q: int) -> Column:
    n = F.char_length(text) - (q - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substr(text, k, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def similar_texts(left: DataFrame, right: DataFrame, text: str, limit: float) -> DataFrame:
    """left_text, right_text, likeness: all pairs of texts at or above the limit, each pair of texts once however many rows hold it.

    Null texts match nothing; equal texts have likeness 1, two empty ones too.
    """
    q = gram_size(limit)
    a, b = (df.select(F.col(text).alias("t")).where("t is not null").distinct() for df in (left, right))
    equal = a.join(b, "t").select(F.col("t").alias("left_text"), F.col("t").alias("right_text"), F.lit(1.0).alias("likeness"))

    def filed(df: DataFrame) -> DataFrame:
        return df.select("t", F.explode(_numbered(_grams(F.col("t"), q))).alias("token"))

    grams = filed(a).withColumn("side", F.lit(0)).unionByName(filed(b).withColumn("side", F.lit(1)))
    often = grams.groupBy("token").agg(F.count("*").alias("often"))
    length = F.char_length("t")
    # Without its roundings T grows with the lengths, so the shortest text that may be alike gives a bound for all.
    total = length + F.ceil(length * limit / (2 - limit) - 1e-9)
    shared = F.ceil(total * (limit / 2 - (1 - limit) * (q - 1)) - (q - 1) - 1e-9)
    rank = F.row_number().over(Window.partitionBy("side", "t").orderBy("often", "token"))
    kept = grams.join(often, "token").withColumn("rank", rank).where(F.col("rank") <= length - (q - 1) - F.greatest(shared, F.lit(1)) + 1)
    x, y = (kept.where(f"side = {k}").select("token", F.col("t").alias(name), F.char_length("t").alias(n)) for k, name, n in ((0, "left_text", "la"), (1, "right_text", "lb")))
    near = 2 * F.least("la", "lb") >= limit * (F.col("la") + F.col("lb")) - 1e-9
    met = x.join(y, "token").where(near & (F.col("left_text") != F.col("right_text"))).select("left_text", "right_text").distinct()
    # The letters of a text are listed once, not for each of its pairs.
    for side, name, own in ((a, "left_text", "_la"), (b, "right_text", "_lb")):
        letters = F.transform(_numbered(_grams(F.col("t"), 1)), lambda x: F.concat(x["gram"], x["nth"].cast("string")))
        met = met.join(side.select(F.col("t").alias(name), letters.alias(own)), name)
    held = met.where(2 * F.size(F.array_intersect("_la", "_lb")) >= limit * (F.size("_la") + F.size("_lb")) - 1e-9).select("left_text", "right_text")
    scored = held.withColumn("likeness", sequence_ratio(F.col("left_text"), F.col("right_text"))).where(F.col("likeness") >= limit)
    return equal.unionByName(scored)
