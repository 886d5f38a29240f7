"""Payments to holders: flags and periods by date, and the merge of two sources by event date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold
from tessera.operators.frames import keep_best


def with_date_flags(df: DataFrame, as_of: Column, payment: str = "payment_date", ex: str = "ex_date") -> DataFrame:
    """is_future_payment and is_future_ex_date; a missing date is not in the future."""
    return df.withColumns({"is_future_payment": F.coalesce(F.col(payment) > as_of, F.lit(False)), "is_future_ex_date": F.coalesce(F.col(ex) > as_of, F.lit(False))})


def in_period(df: DataFrame, period: str, as_of: Column, payment: str = "payment_date", ex: str = "ex_date") -> DataFrame:
    """Rows of a period: ``all``, ``past`` or ``future`` by payment, ``upcoming_ex_date`` by the ex date."""
    rows = {"all": F.lit(True), "past": F.col(payment) <= as_of, "future": F.col(payment) > as_of, "upcoming_ex_date": F.col(ex) > as_of}
    return with_date_flags(df, as_of, payment, ex).where(rows[period])


def merged_distributions(stated: DataFrame, events: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """keys, ex_date, value, source: one row per event date, events over stated ones, the later ordinal among equals.

    An event's date is its ex date, else its payment date; events without date or value, below zero or of amortisation don't count.
    """
    kept = events.withColumn("_date", F.coalesce("ex_date", "payment_date")).where(F.col("_date").isNotNull() & (F.col("value") >= 0) & ~F.contains(fold(F.coalesce("kind", F.lit(""))), F.lit("AMORT")))
    both = kept.select(*keys, F.col("_date").alias("ex_date"), "value", F.lit("events").alias("source"), ordinal).unionByName(stated.select(*keys, "ex_date", "value", F.lit("stated").alias("source"), ordinal))
    return keep_best(both, [*keys, "ex_date"], [F.col("source").asc(), F.col(ordinal).desc()]).drop(ordinal)


# Years of dividends that are compared, years that a fact needs, the largest payout that can last, and confidences.
RECENT_YEARS, LEAST_YEARS, LASTING, SEEN, COMPARED = 5, 3, 1.2, 0.85, 0.8


def dividend_facts(distributions: DataFrame, periods: DataFrame, key: str) -> DataFrame:
    """key, fact, value, unit, as_of, source, confidence, status, reason: four facts of every key with a distribution of zero or more.

    ``distributions``: ex_date, value a share, source; ``periods``: period_end, net_income, shares_outstanding, of which the last of a year
    stands for it. Dividends are summed by year before anything meets, years without one count as zero, and payouts
    are of years with a dividend and earnings a share that make a payout of zero or more.
    """
    paid = distributions.where(F.col(key).isNotNull() & F.col("ex_date").isNotNull() & (F.col("value") >= 0))
    years = paid.groupBy(key, F.year("ex_date").alias("yr")).agg(F.sum(F.col("value").cast("double")).alias("paid"), F.max("ex_date").alias("day"))
    ends = paid.groupBy(key).agg(F.max("ex_date").alias("as_of"), F.year(F.min("ex_date")).alias("since"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("source"))
    earned = periods.groupBy(key, F.year("period_end").alias("yr")).agg(F.max_by(F.struct("net_income", "shares_outstanding"), "period_end").alias("p"))
    each = F.when(F.col("p.shares_outstanding") != 0, F.col("p.net_income") / F.col("p.shares_outstanding"))
    payout = F.when((F.col("paid") > 0) & (each != 0), F.col("paid") / each)
    met = years.join(ends, key).where(F.col("yr") >= F.greatest("since", F.year("as_of") - (RECENT_YEARS - 1))).join(earned, [key, "yr"], "left").withColumn("payout", payout)
    positive, kept = F.when(F.col("paid") > 0, F.col("paid")), F.when(F.col("payout") >= 0, F.col("payout"))
    g = met.groupBy(key, "as_of", "since", "source").agg(F.count(positive).alias("n"), F.avg(positive).alias("mean"), F.stddev_pop(positive).alias("sd"), F.count(kept).alias("payouts"), F.avg((kept <= LASTING).cast("double")).alias("lasting"))
    last = F.year("as_of")
    shown = last - F.greatest("since", last - (RECENT_YEARS - 1)) + 1

    def fact(name: str, value: Column, unit: str, confidence: float, source: Column, reason: str) -> Column:
        missing = value.isNull()
        return F.struct(F.lit(name).alias("fact"), value.cast("double").alias("value"), F.lit(unit).alias("unit"), F.when(~missing, F.col("as_of")).alias("as_of"), F.when(~missing, source).alias("source"), F.when(missing, F.lit(0.0)).otherwise(F.lit(confidence)).alias("confidence"), F.when(missing, "missing").otherwise("valid").alias("status"), F.when(missing, F.lit(reason)).alias("reason"))

    few = f"fewer than {LEAST_YEARS} years with"
    facts = F.array(
        fact("dividend_history_years", last - F.col("since") + 1, "years", SEEN, F.col("source"), ""), fact("dividend_payment_frequency", F.col("n") / shown, "ratio", SEEN, F.col("source"), ""),
        fact("dividend_stability", F.when(F.col("n") >= LEAST_YEARS, F.col("sd") / F.col("mean")), "ratio", COMPARED, F.col("source"), f"{few} distributions"),
        fact("dividend_payout_sustainability", F.when(F.col("payouts") >= LEAST_YEARS, F.col("lasting")), "ratio", COMPARED, F.lit("statements,distributions"), f"{few} a payout"),
    )
    return g.select(key, F.inline(facts))
