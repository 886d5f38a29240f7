"""Peers, cascades, receipts and a stored directory as queries over the star-schema tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cascade as C
from tessera.operators import derivation as D
from tessera.operators import sectors as S
from tessera.operators import underlying as U
from tessera.operators.search import merge_directories
from tessera.plans.queries import _SUPPLIER_YEARS, _r, _t, query, supplier_years
from tessera.plans.statements import _PERIODS, _TRAILING, _periods, _qualified
from tessera.sources.folders import new_folder
from tessera.sources.versioned import VersionedTable

_SECTOR = "CASE WHEN s_nationkey % 6 < 5 THEN concat('N', s_nationkey % 6) END"
_PRICE, _SHARES = "(k % 7) * 3.5", "coalesce(shares_outstanding, total_assets / 10)"


@query(f"""
    WITH p AS ({_PERIODS}), t AS (SELECT * FROM ({_qualified(_TRAILING)}) QUALIFY row_number() OVER (PARTITION BY k ORDER BY period_end DESC) = 1),
    c AS (SELECT t.* EXCLUDE (sector), s.sector, CAST({_PRICE} AS DOUBLE) * {_SHARES} AS cap, cap + coalesce(net_debt, 0) AS ev FROM t JOIN (SELECT s_suppkey AS k, {_SECTOR} AS sector FROM supplier) AS s USING (k) WHERE equity > 0 AND s.sector IS NOT NULL AND {_PRICE} > 0 AND {_SHARES} <> 0),
    m AS (SELECT k, sector, unnest([{", ".join(f"{{'multiple': '{n}', 'value': CASE WHEN {b} > 0 THEN {a} / {b} END}}" for n, (a, b) in ((n, tuple({'market_cap': 'cap', 'enterprise': 'ev'}.get(x, x) for x in pair)) for n, pair in S.MULTIPLES.items()))}], recursive := true) FROM c),
    j AS (SELECT m.k, m.sector, m.multiple, m.value, count(o.k) AS peers, count(o.value) AS sample, CASE WHEN count(o.k) >= 3 THEN median(o.value) END AS median FROM m LEFT JOIN m AS o ON o.sector = m.sector AND o.multiple = m.multiple AND o.k <> m.k GROUP BY ALL)
    SELECT k, sector, multiple, round(value, 6) + 0.0 AS value, peers, sample, round(median, 6) + 0.0 AS median, round(value / nullif(median, 0), 6) + 0.0 AS ratio FROM j
""")
def sector_peers(spark, sf_dir):
    """Every company's seven multiples against the medians of the others of its sector."""
    latest = D.latest_trailing(_periods(spark, sf_dir), "k").selectExpr("*", f"CAST({_PRICE} AS DOUBLE) AS price", f"{_SHARES} AS shares")
    listed = _t(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", f"{_SECTOR} AS sector")
    found = S.against_peers(S.multiples(S.universe(latest, listed, "k"), "k", "price", "shares"), "k")
    return found.select("k", "sector", "multiple", _r(F.col("value")).alias("value"), "peers", "sample", _r(F.col("median")).alias("median"), _r(F.col("ratio")).alias("ratio"))


@query(f"""
    WITH y AS (SELECT l_suppkey AS k, CAST(arg_max(revenue, yr) AS DOUBLE) AS revenue, CAST(arg_max(gross, yr) AS DOUBLE) AS gross, max(yr) AS yr FROM ({_SUPPLIER_YEARS}) GROUP BY 1),
    f AS (SELECT k, CASE WHEN k % 5 <> 4 AND k % 3 = 0 AND k % 12 <> 0 THEN revenue END AS one, CASE WHEN k % 2 = 0 THEN gross END AS two, yr FROM supplier LEFT JOIN y ON k = s_suppkey WHERE s_suppkey IS NOT NULL)
    SELECT s_suppkey AS k, CASE WHEN one IS NOT NULL THEN 'filings' WHEN two IS NOT NULL THEN 'pages' END AS source, CASE WHEN one IS NOT NULL THEN 'filings' ELSE 'filings,pages' END AS attempts, CASE WHEN one IS NULL AND two IS NULL THEN 'not listed; attempted sources: filings, pages' END AS reason,
        round(coalesce(one, two), 2) + 0.0 AS value, CASE WHEN one IS NOT NULL OR two IS NOT NULL THEN yr END AS yr
    FROM supplier LEFT JOIN f ON f.k = s_suppkey
""")
def cascaded_statements(spark, sf_dir):
    """Statements of every supplier: filings by the number its ticker has in a directory, pages for those without, and what was asked."""
    years = supplier_years(spark, sf_dir).groupBy("l_suppkey").agg(F.max_by("revenue", "yr").cast("double").alias("revenue"), F.max_by("gross", "yr").cast("double").alias("gross"), F.max("yr").alias("yr"))
    listed = _t(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 4").selectExpr("s_suppkey AS k", "lpad(s_suppkey * 10 + 1, 10, '0') AS cik")
    filed = years.where("l_suppkey % 3 = 0").select(F.lpad((F.col("l_suppkey") * 10 + 1).cast("string"), 10, "0").alias("cik"), F.when(F.col("l_suppkey") % 12 != 0, F.col("revenue")).alias("value"), "yr")
    filings = listed.join(filed, "cik").select("k", "value", "yr")
    pages = years.where("l_suppkey % 2 = 0").select(F.col("l_suppkey").alias("k"), F.col("gross").alias("value"), "yr")
    found = C.cascade(_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k", [("filings", filings), ("pages", pages)], F.col("value").isNotNull(), "not listed")
    return found.select("k", "source", F.array_join("attempts", ",").alias("attempts"), "reason", _r(F.col("answer.value"), 2).alias("value"), "answer.yr")


_TARGET = "CASE WHEN c_custkey % 100 = 10 THEN c_custkey + 10 WHEN c_custkey % 100 = 20 THEN c_custkey - 10 ELSE CAST(floor(c_custkey / 2) AS BIGINT) END"


@query(f"""
    WITH RECURSIVE r AS (SELECT c_custkey AS k, 'C' || c_custkey AS ticker, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 22 <> 0 THEN concat('C', {_TARGET}) END AS underlying, CASE WHEN c_custkey % 3 = 2 THEN 'alias' ELSE 'fields' END AS source FROM customer),
    w AS (SELECT ticker AS origin, underlying AS reached, 1 AS steps, [ticker] AS path FROM r WHERE underlying IS NOT NULL
          UNION ALL SELECT w.origin, r.underlying, w.steps + 1, list_append(w.path, w.reached) FROM w JOIN r ON r.ticker = w.reached WHERE r.underlying IS NOT NULL AND NOT list_contains(w.path, w.reached)),
    e AS (SELECT origin, arg_max(reached, steps) AS final, max(steps) AS steps, arg_max(list_contains(path, reached), steps) AS cycle FROM w GROUP BY origin)
    SELECT k, underlying, CASE WHEN underlying IS NOT NULL THEN source END AS source, CASE WHEN source = 'fields' AND underlying IS NOT NULL THEN 'Name ' || k END AS underlying_name, CASE WHEN NOT cycle THEN final END AS final, CAST(CASE WHEN NOT cycle THEN steps END AS BIGINT) AS steps, cycle FROM r LEFT JOIN e ON origin = ticker
""")
def receipt_underlyings(spark, sf_dir):
    """Customers as receipts: what each stands for by its fields or an alias, and where chains of receipts end."""
    c = _t(spark, sf_dir, "customer")
    target = F.concat(F.lit("C"), F.expr(_TARGET).cast("string"))
    local = F.when(F.col("c_custkey") % 22 == 0, F.lit("ABCD3")).otherwise(F.concat(F.lit(" "), F.lower(target)))
    name = F.concat(F.lit(" Name "), F.col("c_custkey").cast("string"))
    fields = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("ReferenceSymbol"), local, F.lit("UnderlyingName"), name)).when(F.col("c_custkey") % 3 == 1, F.create_map(F.lit("x_reference_symbol"), local, F.lit("UndrlyngNm"), name))
    rows = c.select(F.col("c_custkey").alias("k"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"), F.when(F.col("c_custkey") % 2 == 0, "bdr").otherwise("stock").alias("kind"), fields.alias("fields"))
    aliases = c.where("c_custkey % 3 = 2 and c_custkey % 22 <> 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("ticker"), target.alias("alias"))
    told = U.stated_underlying(rows, aliases)
    ends = U.chain_ends(told)
    return told.join(ends, "ticker", "left").select("k", "underlying", F.col("underlying_source").alias("source"), "underlying_name", "final", "steps", "cycle")


def _upsert(a: str, b: str) -> str:
    rank = "CASE {0}.confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE -1 END"
    first = f"({rank.format('y')}) > ({rank.format('x')})"
    return f"SELECT ticker, exchange, {', '.join(f'CASE WHEN {first} THEN coalesce(y.{c}, x.{c}) ELSE coalesce(x.{c}, y.{c}) END AS {c}' for c in ('name', 'country', 'confidence'))} FROM ({a}) AS x FULL JOIN ({b}) AS y USING (ticker, exchange)"


_FIRST = "SELECT concat('T', c_custkey) AS ticker, concat('X', c_custkey % 2) AS exchange, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN concat('N', c_nationkey) END AS country, CASE WHEN c_custkey % 5 = 0 THEN 'high' WHEN c_custkey % 5 < 4 THEN 'medium' END AS confidence FROM customer"
_SECOND = "SELECT concat('T', s_suppkey * 2) AS ticker, 'X0' AS exchange, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS name, concat('S', s_nationkey) AS country, CASE WHEN s_suppkey % 2 = 0 THEN 'high' ELSE 'low' END AS confidence FROM supplier"
_THIRD = "SELECT concat('T', n_nationkey) AS ticker, concat('X', n_nationkey % 3) AS exchange, n_name AS name, n_name AS country, 'medium' AS confidence FROM nation"


@query(f"SELECT * FROM ({_upsert(_upsert(_FIRST, _SECOND), _THIRD)})")
def directory_upserts(spark, sf_dir):
    """A stored directory after three increments, each merged into the buckets that its keys fall in."""
    for name in ("customer", "supplier", "nation"):
        _t(spark, sf_dir, name).createOrReplaceTempView(f"tessera_{name}")
    table = VersionedTable(spark, new_folder(spark, "directory"), ["ticker", "exchange"], 32)
    for sql, name in ((_FIRST, "customer"), (_SECOND, "supplier"), (_THIRD, "nation")):
        table.merge(spark.sql(sql.replace(f"FROM {name}", f"FROM tessera_{name}")), lambda rows: merge_directories(rows, table.keys, "ordinal", "confidence"))
    return table.read()
