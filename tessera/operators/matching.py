"""Joins on names: shared tokens with a unique winner, and similarity within blocks."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import BUSINESS_TOKENS, LEGAL_TOKENS, fold_squeeze, name_tokens


def token_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, name: str, least: int = 2) -> DataFrame:
    """left_id, right_id, overlap: the right row that shares most name tokens, ``least`` at least; ambiguity gives no match.

    Names that share ``least`` tokens share one that is not among the ``least - 1`` most frequent of either, so names meet there
    only: with two asked for, a word that all names hold makes no pairs. Rows without an id match nothing.
    """
    tokens = F.array_distinct(name_tokens(F.col(name)))
    a, b = left.select(left_id, tokens.alias("lt")).where(F.col(left_id).isNotNull()), right.select(right_id, tokens.alias("rt")).where(F.col(right_id).isNotNull())
    often = a.select(F.explode("lt").alias("token")).unionAll(b.select(F.explode("rt").alias("token"))).groupBy("token").agg(F.count("*").alias("often"))

    def filed(df: DataFrame, key: str, side: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(key, side).orderBy(F.col("often").desc(), F.col("token").desc()))
        return df.select(key, side, F.explode(side).alias("token")).join(often, "token").withColumn("rank", rank).where(F.col("rank") >= least).select(key, side, "token")

    met = filed(a, left_id, "lt").join(filed(b, right_id, "rt"), "token").drop("token").distinct()
    shared = met.withColumn("overlap", F.size(F.array_intersect("lt", "rt")).cast("long")).where(F.col("overlap") >= least).groupBy(left_id, right_id).agg(F.max("overlap").alias("overlap"))
    w = Window.partitionBy(left_id)
    best = shared.withColumn("top", F.max("overlap").over(w)).where("overlap = top").withColumn("ties", F.count("*").over(w))
    return best.where("ties = 1").select(left_id, right_id, "overlap")


def company_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, name: str) -> DataFrame:
    """left_id, right_id, tier: 1 for names equal without legal forms, 2 for equal ones without any noise, 3 for containment.

    Containment means that one name's tokens hold the other's, two or more; the largest overlap wins. A tier with more than
    one candidate rejects; later tiers are not tried for it. Names without a token match nothing. Equal names are counted
    and not paired, so frequent ones cost no more than others.
    """

    def named(df: DataFrame, key: str) -> DataFrame:
        tokens = name_tokens(F.col(name), LEGAL_TOKENS + BUSINESS_TOKENS)
        return df.select(key, F.array_join(name_tokens(F.col(name)), " ").alias("legal"), F.array_join(tokens, " ").alias("plain"), F.array_sort(tokens).alias("tokens")).where("size(tokens) > 0")

    def counted(by: str, to: str) -> DataFrame:
        return r.groupBy(by).agg(F.struct(F.count("*").alias("n"), F.min(right_id).alias("id")).alias(to))

    l, r = named(left, left_id), named(right, right_id)
    sets = r.groupBy(F.col("tokens").alias("rt")).agg(F.count("*").alias("n"), F.min(right_id).alias("id"))
    tried = l.join(counted("legal", "one"), "legal", "left").join(counted("plain", "two"), "plain", "left")
    open_sets = tried.where("one is null and two is null and size(tokens) > 1").select(F.col("tokens").alias("lt")).distinct()
    held = contained_pairs(open_sets, sets.select("rt").where("size(rt) > 1")).where("overlap >= 2").join(sets, "rt")
    best = held.groupBy("lt", "overlap").agg(F.sum("n").alias("n"), F.min("id").alias("id")).groupBy(F.col("lt").alias("tokens")).agg(F.max_by(F.struct("n", "id"), "overlap").alias("three"))
    found = tried.join(best, "tokens", "left").withColumns({"won": F.coalesce("one", "two", "three"), "tier": F.when(F.col("one").isNotNull(), 1).when(F.col("two").isNotNull(), 2).otherwise(3)})
    return found.where("won.n = 1").select(left_id, F.col("won.id").alias(right_id), "tier")


def contained_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """lt, rt, overlap: pairs of distinct token sets of which one holds the other.

    The larger set holds the smaller one's rarest token, so sets meet only there: a frequent word makes no pairs unless
    it is all that a set has.
    """
    a, b = left.select("lt", F.explode("lt").alias("token")), right.select("rt", F.explode("rt").alias("token"))
    often = a.select("token").unionAll(b.select("token")).groupBy("token").agg(F.count("*").alias("often"))

    def rarest(tokens: DataFrame, side: str) -> DataFrame:
        return tokens.join(often, "token").groupBy(side).agg(F.min_by("token", F.struct("often", "token")).alias("token"))

    met = rarest(a, "lt").join(b, "token").unionByName(a.join(rarest(b, "rt"), "token")).select("lt", "rt", F.size(F.array_intersect("lt", "rt")).alias("overlap"))
    return met.where("overlap = least(size(lt), size(rt))").distinct()


def token_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Pairs that share a token, with both token arrays (lt, rt) and the number shared."""
    a = left.select(left_id, "lt", F.explode("lt").alias("token"))
    b = right.select(right_id, "rt", F.explode("rt").alias("token"))
    return a.join(b, "token").groupBy(left_id, right_id, "lt", "rt").agg(F.count("*").alias("overlap"))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of two folded names; no built-in has it, so it comes in Arrow batches."""

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([difflib.SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)])

    return ratio(a, b)


# The weights of shared tokens and of likeness in a score, and words of a bank's name that do not tell it apart.
OVERLAP, LIKENESS = 0.65, 0.35
BANK_NOISE = ("CIA", "COMPANHIA", "DA", "DE", "DO", "HOLDING", "S", "SA", "SOCIEDADE")


def institution_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, name: str, accept: float = 0.30) -> DataFrame:
    """The best right row by 0.65 x token overlap over the smaller set + 0.35 x likeness of the folded names.

    Rows that share a token meet there; of the others those meet whose names are so alike that this alone is accepted. Equal names are scored once; of equal scores the smallest right_id wins. Null names match nothing.
    """
    words = F.transform(F.split(fold_squeeze(F.col(name)), " "), lambda t: F.when(t == "BCO", "BANCO").otherwise(t))

    def named(df: DataFrame, key: str, text: str, tokens: str) -> DataFrame:
        return df.where(F.col(name).isNotNull()).select(key, F.array_join(words, " ").alias(text), F.filter(F.array_distinct(words), lambda t: ~t.isin(*BANK_NOISE)).alias(tokens))

    l, r = named(left, left_id, "ln", "lt"), named(right, right_id, "rn", "rt")
    asked, listed = l.select("ln", "lt").distinct(), r.groupBy("rn", "rt").agg(F.min(right_id).alias(right_id))
    shared = token_pairs(asked, listed, "ln", "rn").join(listed.select("rn", right_id), "rn")
    from tessera.operators.similarity import similar_texts

    alone = accept / LIKENESS
    if alone <= 1:
        alike = similar_texts(asked.withColumnRenamed("ln", "text"), listed.withColumnRenamed("rn", "text"), "text", alone).select(F.col("left_text").alias("ln"), F.col("right_text").alias("rn"))
        far = alike.join(asked, "ln").join(listed, "rn").where(~F.arrays_overlap("lt", "rt"))
        shared = shared.unionByName(far.select("ln", "rn", "lt", "rt", F.lit(0).cast("long").alias("overlap"), right_id))
    scored = shared.withColumn("score", OVERLAP * F.col("overlap") / F.greatest(F.least(F.size("lt"), F.size("rt")), F.lit(1)) + LIKENESS * sequence_ratio(F.col("ln"), F.col("rn")))
    best = scored.where(F.col("score") >= accept).withColumn("_rank", F.row_number().over(Window.partitionBy("ln").orderBy(F.col("score").desc(), right_id))).where("_rank = 1")
    return l.join(best.select("ln", right_id, "score"), "ln").select(left_id, right_id, F.round("score", 6).alias("score"))
