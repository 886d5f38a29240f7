"""Fixed-width quote records: one line of 245 characters for each instrument and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Places of the record (from 1) and their lengths, the record type and the cash market.
PLACES = {"record": (1, 2), "day": (3, 8), "ticker": (13, 12), "market": (25, 3), "price": (109, 13), "factor": (211, 7)}
RECORD, CASH_MARKET, CENTS = "01", "010", 100


def quotes(lines: DataFrame, tickers: list[str] | None = None) -> DataFrame:
    """ticker, reference_date, price (of one unit) of cash-market records with a price and a factor above zero.

    Lines that don't parse are dropped. Of several records for a ticker and day the last in file order wins.
    """
    cut = lines.select("archive", "member_no", "line_no", *(F.substring("text", *place).alias(name) for name, place in PLACES.items()))
    kept = cut.where((F.col("record") == RECORD) & (F.col("market") == CASH_MARKET)).withColumn("ticker", F.upper(F.trim("ticker")))
    if tickers is not None:
        kept = kept.where(F.col("ticker").isin(sorted({t.strip().upper() for t in tickers if t.strip()})))
    price, factor = F.trim("price").try_cast("decimal(20,0)"), F.trim("factor").try_cast("decimal(10,0)")
    read = kept.select("archive", "member_no", "line_no", "ticker", F.try_to_date("day", "yyyyMMdd").alias("reference_date"), price.alias("p"), factor.alias("f")).where("reference_date is not null and p > 0 and f > 0")
    unit = (F.col("p") / CENTS / F.col("f")).cast("decimal(38,10)")
    return read.groupBy("ticker", "reference_date").agg(F.max_by(unit, F.struct("archive", "member_no", "line_no")).alias("price"))
