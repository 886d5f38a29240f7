"""What a receipt stands for: its own row's fields, then reviewed aliases, then chains of receipts followed to their end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.folders import stage

# Names of a receipt's fields that tell its underlying, in order; names of any other field that may; names of the underlying's name;
# the shape of a ticker, and that of local shares, which are no underlying.
FIELDS = ("UnderlyingTicker", "UnderlyingTckrSymb", "UndrlyngTckrSymb", "UnderlyingSymbol", "ReferenceTicker", "ReferenceSymbol")
OTHER_FIELD = "(?=.*(underly|reference))(?=.*(ticker|symbol|tckr)).*"
NAME_FIELDS = ("UnderlyingName", "UndrlyngNm")
TICKER, LOCAL, RECEIPT = r"[A-Z][A-Z0-9.\-]{0,9}", r"[A-Z]{4}[0-9]{1,2}", "bdr"


def ticker_or_null(text: Column) -> Column:
    """Trimmed and upper-cased, if it may be an underlying's ticker."""
    told = F.upper(F.trim(text))
    return F.when(F.rlike(told, F.lit(rf"\A{TICKER}\z")) & ~F.rlike(told, F.lit(rf"\A{LOCAL}\z")), told)


def stated_underlying(rows: DataFrame, aliases: DataFrame, ticker: str = "ticker", kind: str = "kind", fields: str = "fields") -> DataFrame:
    """``rows`` with underlying, underlying_name, underlying_source (fields or alias; null: not a receipt, or unknown).

    ``fields`` is a map of a row's fields as text; ``aliases`` (ticker, alias) has reviewed ones. Of other fields that qualify the first
    in the order of their names counts. A name comes with fields only.
    """
    value = F.col(fields)
    named = F.coalesce(*(ticker_or_null(F.try_element_at(value, F.lit(f))) for f in FIELDS))
    others = F.filter(F.array_sort(F.map_entries(value)), lambda e: F.rlike(F.lower(e["key"]), F.lit(OTHER_FIELD)) & ticker_or_null(e["value"]).isNotNull())
    own = F.when(F.col(kind) == RECEIPT, F.coalesce(named, ticker_or_null(F.get(others, F.lit(0))["value"])))
    name = F.coalesce(*(F.nullif(F.trim(F.try_element_at(value, F.lit(f))), F.lit("")) for f in NAME_FIELDS))
    known = aliases.select(F.upper(F.trim("ticker")).alias("_key"), F.col("alias").alias("_alias")).groupBy("_key").agg(F.min("_alias").alias("_alias"))
    met = rows.withColumn("_own", own).join(known, F.upper(F.trim(ticker)) == F.col("_key"), "left").drop("_key")
    alias = F.when(F.col(kind) == RECEIPT, F.col("_alias"))
    return met.select(*rows.columns, F.coalesce("_own", alias).alias("underlying"), F.when(F.col("_own").isNotNull(), name).alias("underlying_name"), F.when(F.col("_own").isNotNull(), "fields").when(alias.isNotNull(), "alias").alias("underlying_source"))


def chain_ends(links: DataFrame, ticker: str = "ticker", underlying: str = "underlying") -> DataFrame:
    """ticker, final, steps, cycle of each link (ticker, unique, to its underlying): where its chain of links ends, and after how many.

    By pointer jumping: each round doubles how far a pointer has come, so rounds grow with the logarithm of the longest chain.
    A pointer that has come farther than there are links is on a cycle: it has no final, and its steps are null.
    """
    now = stage(links.where(F.col(ticker).isNotNull() & F.col(underlying).isNotNull()).select(F.col(ticker).alias("ticker"), F.col(underlying).alias("to"), F.lit(1).cast("long").alias("steps")), "links")
    total = now.count()
    done = None
    while True:
        there = now.select(F.col("ticker").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        # Many receipts may stand for one share, which ends there: only pointers at other receipts are joined, a row each.
        met = stage(now.join(there, "to", "left").select("ticker", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNull().alias("ended")), "jumps")
        open_, reach = met.where("not ended").agg(F.count("*"), F.min("steps")).first()
        if not open_ or reach > total:
            done = met
            break
        now = met.drop("ended")
    return done.select("ticker", F.when(F.col("ended"), F.col("to")).alias("final"), F.when(F.col("ended"), F.col("steps")).alias("steps"), (~F.col("ended")).alias("cycle"))
