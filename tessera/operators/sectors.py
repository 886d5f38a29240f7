"""A company against the others of its sector: multiples, and medians that leave the company itself out.

A sector may be a third of all companies, so its middle values are found without bringing it together: mergeable percentile sketches
bound the ranks that are asked for, what lies between the bounds is counted by distinct value, and the bounds are drawn
closer until few are left. From three middle values and the number of companies every median without one company follows, so no
company meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import ratio_positive
from tessera.sources.folders import stage

#: Fixed value: peers that a median needs. Values of one group that one task ranks; cells of a sketch and its accuracy.
LEAST_PEERS = 3
FEW, CELLS, ACCURACY = 100_000, 256, 10_000

MULTIPLES = {
    "price_to_earnings": ("market_cap", "net_income"), "price_to_book": ("market_cap", "equity"), "ev_to_ebitda": ("enterprise", "ebitda"), "ev_to_ebit": ("enterprise", "ebit"),
    "price_to_free_cash_flow": ("market_cap", "free_cash_flow"), "earnings_yield": ("net_income", "market_cap"), "free_cash_flow_yield": ("free_cash_flow", "market_cap"),
}


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: Column, few: int | None = None) -> DataFrame:
    """keys, n, values: the values (from the smallest, 1) at ``ranks``, an ascending array of neighbouring ranks as an expression over n.

    Nulls don't count; groups without a value have no row; ranks beyond a group give null.
    """
    few = FEW if few is None else few
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    asked = sizes.withColumn("_ranks", ranks).withColumn("_below", F.lit(0).cast("long"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    while largest > few:
        grid = rows.groupBy(*keys).agg(F.count("*").alias("_c"), F.percentile_approx("_v", [k / CELLS for k in range(CELLS + 1)], ACCURACY).alias("_grid"))
        first, last = F.array_min("_ranks") - F.col("_below"), F.array_max("_ranks") - F.col("_below")
        # A cell more on each side than the ranks need, which is far beyond a sketch's error.
        low = F.get("_grid", (F.floor((first - 1) / F.col("_c") * CELLS) - 1).cast("int"))
        high = F.get("_grid", (F.ceil(last / F.col("_c") * CELLS) + 1).cast("int"))
        bounds = asked.join(grid, keys).select(*keys, "n", "_ranks", "_below", F.coalesce(low, F.lit(float("-inf"))).alias("_low"), F.coalesce(high, F.lit(float("inf"))).alias("_high"))
        met = rows.join(bounds.select(*keys, "_low", "_high"), keys)
        under = met.where("_v < _low").groupBy(*keys).agg(F.count("*").alias("_under"))
        asked = stage(bounds.join(under, keys, "left").select(*keys, "n", "_ranks", (F.col("_below") + F.coalesce("_under", F.lit(0))).alias("_below")), "ranks")
        rows = stage(met.where("_v >= _low and _v <= _high").select(*keys, "_v"), "middle")
        left = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if left > largest / 2:  # equal values, which are counted and not ranked
            break
        largest = left
    counted = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counted.withColumn("_upto", upto).join(asked, keys).withColumn("_upto", F.col("_upto") + F.col("_below"))
    at = placed.select(*keys, "n", "_ranks", "_v", "_upto", F.posexplode("_ranks").alias("_place", "_rank")).where(F.col("_upto") >= F.col("_rank"))
    each = at.groupBy(*keys, "n", "_place").agg(F.min("_v").alias("_v"))
    found = each.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("_place", "_v"))).alias("_at"))
    return found.join(asked.select(*keys, F.size("_ranks").alias("_size")), keys).select(*keys, "n", F.transform(F.sequence(F.lit(0), F.col("_size") - 1), lambda k: F.try_element_at("_at", k)).alias("values"))


def median_of_others(own: Column, n: Column, middle: Column) -> Column:
    """The median of a group's n values without ``own`` (null: it has none among them), from those at ranks n/2, n/2 + 1, n/2 + 2."""
    low, mid, high = (F.get(middle, F.lit(k)) for k in range(3))
    # Without a value, those above it move down a rank.
    first, second = F.when(own > low, low).otherwise(mid), F.when(own > mid, mid).otherwise(high)
    odd = n % 2 == 1
    without = F.when(n > 1, F.when(odd, (first + second) / 2).otherwise(first))
    return F.when(own.isNull(), F.when(odd, mid).otherwise((low + mid) / 2)).otherwise(without)


def universe(trailing: DataFrame, sectors: DataFrame, key: str) -> DataFrame:
    """Companies with a sector, a whole last period, and equity above zero: the comparison base of all sectors."""
    listed = sectors.where("coalesce(sector, '') <> ''")
    return trailing.where("equity > 0").join(listed, key)


def multiples(companies: DataFrame, key: str, price: str, shares: str) -> DataFrame:
    """key, sector, and seven multiples of the companies with a price above zero and a share count; without a debt figure there is none."""
    priced = companies.where((F.col(price) > 0) & (F.col(shares) != 0)).withColumn("market_cap", F.col(price) * F.col(shares))
    valued = priced.withColumn("enterprise", F.col("market_cap") + F.coalesce("net_debt", F.lit(0.0)))
    return valued.select(key, "sector", *(ratio_positive(F.col(a), F.col(b)).alias(name) for name, (a, b) in MULTIPLES.items()))


def against_peers(valued: DataFrame, key: str, few: int | None = None) -> DataFrame:
    """key, sector, multiple, value, peers (other companies of the sector), sample (those with the multiple), median, ratio.

    Medians are of the others alone and need three of them. A row a company is written first: what follows reads it several
    times, and each time would make the statements behind it anew.
    """
    valued = stage(valued.select(key, "sector", *MULTIPLES), "multiples")
    long = valued.select(key, "sector", F.inline(F.array(*(F.struct(F.lit(m).alias("multiple"), F.col(m).alias("value")) for m in MULTIPLES))))
    half = F.floor(F.col("n") / 2)
    middle = order_statistics(long, ["sector", "multiple"], "value", F.array(half, half + 1, half + 2), few)
    counted = valued.groupBy("sector").agg((F.count("*") - 1).alias("peers"))
    met = long.join(middle, ["sector", "multiple"], "left").join(counted, "sector")
    own = F.col("value")
    median = F.when(F.col("peers") >= LEAST_PEERS, median_of_others(own, F.col("n"), F.col("values")))
    sample = F.coalesce("n", F.lit(0)) - F.when(own.isNotNull(), 1).otherwise(0)
    return met.select(key, "sector", "multiple", "value", "peers", sample.alias("sample"), median.alias("median")).withColumn("ratio", F.when(F.col("median") != 0, F.col("value") / F.col("median")))
