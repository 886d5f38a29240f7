"""Filings, profiles and registries as queries over the star-schema tables, each with the SQL it must agree with.

Suppliers file a document a company with a year's sums as its measures; parts, customers and nations lend names and keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import profiles as P
from tessera.operators import frames as R
from tessera.operators.distributions import in_period, merged_distributions
from tessera.operators.institutions import conglomerate_codes, first_filled_quarter
from tessera.operators.matching import institution_match
from tessera.plans.facts import ORACLE, QUERIES
from tessera.plans.queries import _ORDERS, _SUPPLIER_YEARS, _r, _t, customer_orders, query, supplier_years
from tessera.sources import directories, filings, fund_reports

__all__ = ["ORACLE", "QUERIES"]  # those of all modules


def _documents(spark, sf_dir) -> DataFrame:
    """A document a supplier; its lists hold an entry a calendar year. Even years amend their net income; odd ones alone have debt."""
    yr, even = F.col("yr"), F.col("yr") % 2 == 0

    def entry(value: str, end: str = "-12-31", start: str | None = "-01-01", form: str = "10-K", filed: str = "-02-01") -> Column:
        begin = F.lit(None).cast("string") if start is None else F.concat(yr, F.lit(start))
        return F.struct(F.col(value).cast("string").alias("val"), begin.alias("start"), F.concat(yr, F.lit(end)).alias("end"), F.concat(yr + 1, F.lit(filed)).alias("filed"), F.lit(form).alias("form"), F.lit("1").alias("accn"))

    def units(name: str, *lists: Column) -> Column:
        return F.struct(F.create_map(F.lit(name), F.concat(*lists)).alias("units"))

    one = F.collect_list
    tags = {
        "Revenues": units("USD", one(entry("revenue"))), "SalesRevenueNet": units("USD", one(entry("tax"))), "NetIncomeLoss": units("USD", one(entry("gross")), one(F.when(even, entry("discount", form="10-K/A", filed="-05-01")))),
        "NetCashProvidedByUsedInOperatingActivities": units("EUR", one(entry("gross"))), "PaymentsToAcquireProductiveAssets": units("USD", one(F.when(~even, entry("tax")))), "OperatingIncomeLoss": units("USD", one(entry("discount", form="6-K")), one(entry("qty", start="-09-01", form="6-K"))),
        "DepreciationDepletionAndAmortization": units("USD", one(entry("tax"))), "EarningsPerShareDiluted": units("USD/shares", one(entry("qty"))),
        "StockholdersEquity": units("USD", one(entry("discount", end="-06-30", start=None))), "CashAndDueFromBanks": units("USD", one(entry("gross", start=None))), "DebtCurrent": units("USD", one(F.when(~even, entry("tax", start=None)))),
    }
    space = F.create_map(*(x for tag, body in tags.items() for x in (F.lit(tag), body)))
    doc = F.to_json(F.struct(F.lit("Supplier").alias("entityName"), F.create_map(F.lit("us-gaap"), space, F.lit("ifrs-full"), F.create_map(F.lit("Revenue"), units("EUR", one(entry("qty"))))).alias("facts")))
    return supplier_years(spark, sf_dir).groupBy("l_suppkey").agg(doc.alias("doc"))


@query(f"""
    WITH y AS (SELECT l_suppkey, yr, CAST(revenue AS DOUBLE) AS revenue, CAST(gross AS DOUBLE) AS gross, CAST(discount AS DOUBLE) AS discount, CAST(tax AS DOUBLE) AS tax, row_number() OVER (PARTITION BY l_suppkey ORDER BY yr DESC) AS recency FROM ({_SUPPLIER_YEARS}))
    SELECT l_suppkey, yr, round(revenue, 3) + 0.0 AS revenue, round(CASE WHEN yr % 2 = 0 THEN discount ELSE gross END, 3) + 0.0 AS net_income, round(CASE WHEN yr % 2 = 1 THEN gross - abs(tax) END, 3) + 0.0 AS free_cash_flow, round(discount + tax, 3) + 0.0 AS ebitda FROM y WHERE recency <= 5
""")
def filed_statements(spark, sf_dir):
    """The last five fiscal years of each company's document: preferred tags and units, amendments over originals, whole years alone."""
    seen = filings.observations(_documents(spark, sf_dir), "l_suppkey", "doc")
    return filings.annual_statements(seen, "l_suppkey").select("l_suppkey", F.year("end").alias("yr"), *(_r(F.col(c), 3).alias(c) for c in ("revenue", "net_income", "free_cash_flow", "ebitda")))


@query(f"""
    WITH y AS (SELECT l_suppkey, yr, CAST(gross AS DOUBLE) AS gross, CAST(discount AS DOUBLE) AS discount, CAST(tax AS DOUBLE) AS tax, CAST(qty AS DOUBLE) AS qty FROM ({_SUPPLIER_YEARS})),
    l AS (SELECT l_suppkey, max(yr) AS yr, arg_max(discount, yr) AS discount, arg_max(gross, yr) AS gross, arg_max(tax, yr) FILTER (yr % 2 = 1) AS debt, arg_max(qty, yr) AS qty FROM y GROUP BY l_suppkey)
    SELECT l_suppkey, make_date(yr, 12, 31) AS as_of, round(discount, 3) + 0.0 AS equity, round(gross, 3) + 0.0 AS cash, round(debt, 3) + 0.0 AS gross_debt, round(debt - gross, 3) + 0.0 AS net_debt,
        round((CASE WHEN yr % 2 = 0 THEN discount ELSE gross END) / nullif(qty, 0), 3) + 0.0 AS shares, 'USD' AS currency FROM l
""")
def filed_balances(spark, sf_dir):
    """Balances at each company's last fiscal end, its debts, implied shares and currency."""
    docs = _documents(spark, sf_dir)
    found = filings.latest_balances(filings.observations(docs, "l_suppkey", "doc"), "l_suppkey").withColumnRenamed("cash_and_equivalents", "cash")
    return found.join(filings.currencies(docs, "l_suppkey", "doc"), "l_suppkey").select("l_suppkey", "as_of", *(_r(F.col(c), 3).alias(c) for c in ("equity", "cash", "gross_debt", "net_debt", "shares")), "currency")


_SECTORS = ["Bancos", "Intermediários Financeiros", "Seguradoras - Seguros", "Petróleo e Gás", "Energia Elétrica", "Varejo", "Papel e Celulose - Banco"]
_SECTOR_CLASSES = ["bank", "bank", "insurer", "commodity", "utility", "industrial", "bank"]


def _pick(key: str, texts: list) -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), (F.col(key) % len(texts) + 1).cast("int"))


def _sql_list(texts: list) -> str:
    return "[" + ", ".join("NULL" if t is None else f"'{t}'" for t in texts) + "]"


_CLASSED = f"SELECT c_custkey, c_acctbal, {_sql_list(_SECTORS)}[CAST(c_custkey % 7 + 1 AS INTEGER)] AS sector, {_sql_list(_SECTOR_CLASSES)}[CAST(c_custkey % 7 + 1 AS INTEGER)] AS profile FROM customer"


@query(f"""
    WITH c AS ({_CLASSED}), s AS (SELECT sector, count(*) AS n, median(c_acctbal) AS mid FROM c WHERE c_acctbal IS NOT NULL GROUP BY sector), p AS (SELECT profile, count(*) AS n, median(c_acctbal) AS mid FROM c WHERE c_acctbal IS NOT NULL GROUP BY profile)
    SELECT c_custkey, c.profile, CASE WHEN c.profile IN ('bank', 'insurer') THEN p.n ELSE s.n END AS peers, round(CASE WHEN c.profile IN ('bank', 'insurer') THEN p.mid ELSE s.mid END, 4) + 0.0 AS median FROM c JOIN s USING (sector) JOIN p ON p.profile = c.profile
""")
def profile_peers(spark, sf_dir):
    """Each company's peers: its sector, but for banks and insurers all of their profile; the company itself counts."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", _pick("c_custkey", _SECTORS).alias("sector")).withColumn("profile", P.stock_profile(F.col("sector"), F.lit(None).cast("string")))
    by_sector = R.exact_median(c, ["sector"], "c_acctbal", "s_mid").withColumnRenamed("n", "s_n")
    by_profile = R.exact_median(c, ["profile"], "c_acctbal", "p_mid").withColumnRenamed("n", "p_n")
    wide = F.col("profile").isin("bank", "insurer")
    return c.join(by_sector, "sector").join(by_profile, "profile").select("c_custkey", "profile", F.when(wide, F.col("p_n")).otherwise(F.col("s_n")).alias("peers"), _r(F.when(wide, F.col("p_mid")).otherwise(F.col("s_mid")), 4).alias("median"))


_LINES = ["FUNDO DE INDICE", "FI-INFRA alfa", "Fiagro beta", "BDR NIVEL I", "FUNDS fii", "FUNDS gama", "CASH UNT N2", "CASH ON NM", "delta"]
_LINE_TYPES = ["etf", "fi_infra", "fiagro", "bdr", "fii", "fund", "unit", "stock", "unknown"]
_ROWS = ["Depositary receipt", "ETF", "FI AGRO", "FI INFRA", "Real Estate Trust", "fund", "Unit", "Common", None]
_ROW_TYPES = ["bdr", "etf", "fiagro", "fi_infra", "fii", "fii", "unit", "stock", "unknown"]
_THEMES = ["Bitcoin", "Treasury", None, ""]


@query(f"""
    SELECT p_partkey, {_sql_list(_LINE_TYPES)}[CAST(p_partkey % 9 + 1 AS INTEGER)] AS bulletin, {_sql_list(_ROW_TYPES)}[CAST(p_partkey % 9 + 1 AS INTEGER)] AS directory,
        CASE p_partkey % 4 WHEN 0 THEN 'crypto' WHEN 1 THEN 'fixed_income' ELSE CASE WHEN greatest(p_size, 60 - p_size) >= 39 THEN 'thematic' ELSE 'broad' END END AS theme FROM part
""")
def instrument_types(spark, sf_dir):
    """Bulletin lines, directory rows and index funds by their rules."""
    p = _t(spark, sf_dir, "part")
    weights = F.array(F.col("p_size") / 60 * 100, (60 - F.col("p_size")) / 60 * 100)
    return p.select("p_partkey", P.bulletin_type(_pick("p_partkey", _LINES), F.lit("item"), F.lit("")).alias("bulletin"), P.directory_type(_pick("p_partkey", _ROWS), F.lit("x"), F.lit("ALFA11")).alias("directory"), P.etf_profile(_pick("p_partkey", _THEMES), F.array(F.lit("Equity")), weights).alias("theme"))


@query(f"""
    WITH y AS (SELECT l_suppkey, yr, CAST(gross AS DOUBLE) AS total, CAST(qty * 800 AS DOUBLE) AS land, CAST(revenue AS DOUBLE) / 2 AS credit FROM ({_SUPPLIER_YEARS}))
    SELECT l_suppkey, yr, CASE WHEN yr % 3 = 0 THEN 'fi_infra' WHEN yr % 3 = 1 THEN CASE WHEN credit >= land THEN 'fiagro_credit' ELSE 'fiagro_land' END WHEN land / total >= 0.5 THEN 'brick' WHEN credit / total >= 0.5 THEN 'paper' ELSE 'hybrid' END AS profile FROM y WHERE total > 0
""")
def fund_profiles(spark, sf_dir):
    """Portfolios of property, credit or both, by their shares of the total."""
    y = supplier_years(spark, sf_dir).where("gross > 0").select("l_suppkey", "yr", F.col("gross").cast("double").alias("total"), (F.col("qty") * 800).cast("double").alias("land"), (F.col("revenue").cast("double") / 2).alias("credit"))
    kind = F.when(F.col("yr") % 3 == 0, "fi_infra").when(F.col("yr") % 3 == 1, "fiagro").otherwise("fii")
    return y.select("l_suppkey", "yr", P.fund_profile(kind, F.col("land"), F.col("credit"), F.col("total")).alias("profile"))


_QUARTERS = f"SELECT o_custkey, year(day) * 100 + quarter(day) * 3 AS quarter, year(day) * 4 + quarter(day) AS q, CAST(sum(total) AS DOUBLE) AS total FROM ({_ORDERS}) WHERE o_orderstatus = 'F' GROUP BY ALL"


@query(f"""
    WITH v AS ({_QUARTERS}), r AS (SELECT c_custkey, quarter, total, row_number() OVER (PARTITION BY c_custkey ORDER BY q DESC NULLS LAST) AS rn FROM customer LEFT JOIN v ON o_custkey = c_custkey AND q <= 1998 * 4 + 2 AND q > 1998 * 4 + 2 - 8)
    SELECT c_custkey, quarter, round(total, 2) + 0.0 AS total FROM r WHERE rn = 1
""")
def newest_filled_quarter(spark, sf_dir):
    """The newest of eight quarters with finished orders, counted back from the earlier of two dates."""
    o = customer_orders(spark, sf_dir).where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey"), (F.year("day") * 100 + F.quarter("day") * 3).alias("quarter")).agg(F.sum("total").alias("total"))
    asked = _t(spark, sf_dir, "customer").select("c_custkey", F.lit(199812).alias("asked"))
    return first_filled_quarter(asked, o, "c_custkey", "asked", "quarter", ["total"], newest=199806).select("c_custkey", F.col("quarter").cast("long").alias("quarter"), _r(F.col("total"), 2).alias("total"))


@query("""
    WITH h AS (SELECT c_nationkey, min(c_custkey) AS head FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1 GROUP BY c_nationkey)
    SELECT c_custkey, coalesce(head, c_custkey) AS conglomerate FROM customer LEFT JOIN h USING (c_nationkey)
""")
def conglomerates(spark, sf_dir):
    """The financial conglomerate that reports for an institution, else itself."""
    name = F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, " - Prudencial").otherwise(""))
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, "C ").otherwise("B").alias("kind"), name.alias("name"))
    return conglomerate_codes(c, "c_custkey", "c_nationkey", "kind", "name")


_HELD = f"SELECT l_suppkey, yr, CAST(gross AS DECIMAL(18,2)) AS gross, CAST(tax AS DECIMAL(18,2)) AS tax, CAST(qty AS DECIMAL(18,2)) AS qty FROM ({_SUPPLIER_YEARS})"


def _member(df: DataFrame, number: int, name: str, columns: dict[str, Column]) -> DataFrame:
    """Lines of a member, with decimal commas; its header is no row here."""
    text = F.concat_ws(";", *(F.coalesce(F.regexp_replace(c.cast("string"), r"\.", ","), F.lit("")) for c in columns.values()))
    return df.select(F.lit("a.zip").alias("archive"), F.lit(name).alias("member"), F.lit(number).alias("member_no"), (F.col("l_suppkey") * 10000 + F.col("yr")).cast("long").alias("line_no"), F.lit(";".join(columns)).alias("header"), text.alias("text"))


@query(f"""
    SELECT CAST(l_suppkey AS VARCHAR) AS fund, make_date(yr, 12, 1) AS as_of, round(CAST(gross AS DOUBLE), 2) + 0.0 AS nav, round(CASE WHEN yr % 2 = 0 THEN CAST(qty AS DOUBLE) END, 2) + 0.0 AS issued_shares, 'S' || l_suppkey AS administrator,
        round(CASE WHEN yr % 3 = 0 THEN CAST(gross AS DOUBLE) ELSE CAST(tax + qty AS DOUBLE) END, 2) + 0.0 AS total_assets, round(CAST(qty AS DOUBLE) / CASE WHEN yr % 3 = 0 THEN CAST(gross AS DOUBLE) ELSE CAST(tax + qty AS DOUBLE) END, 5) + 0.0 AS credit_share FROM ({_HELD}) WHERE gross > 0 AND tax + qty > 0
""")
def fund_monthly_reports(spark, sf_dir):
    """Three members of an archive by fund and date: issued shares from the general one, a stated total or the sum of its parts."""
    y = supplier_years(spark, sf_dir).select("l_suppkey", "yr", *(F.col(c).cast("decimal(18,2)").alias(c) for c in ("gross", "tax", "qty"))).where("tax + qty > 0")
    key = {"CNPJ_Fundo": F.col("l_suppkey"), "Data_Referencia": F.concat(F.col("yr"), F.lit("-12-01"))}
    general = _member(y, 0, "geral.csv", key | {"Quantidade_Cotas_Emitidas": F.when(F.col("yr") % 2 == 0, F.col("qty")), "Nome_Administrador": F.concat(F.lit('"S'), F.col("l_suppkey"), F.lit('"'))})
    complement = _member(y, 1, "complemento.csv", key | {"Valor_Patrimonial_Cotas": F.col("gross")})
    assets = _member(y, 2, "ativo_passivo.csv", key | {"Valor_Ativo": F.when(F.col("yr") % 3 == 0, F.col("gross")), "Total_Investido": F.col("tax"), "Valores_Receber": F.col("qty"), "CRI": F.col("qty")})
    read = fund_reports.monthly_reports(*(fund_reports.quoted(lines, columns) for lines, columns in ((complement, fund_reports.COMPLEMENT), (general, fund_reports.GENERAL), (assets, fund_reports.ASSETS))))
    return fund_reports.portfolio_shares(read).select("fund", "as_of", _r(F.col("nav_per_share"), 2).alias("nav"), _r(F.col("issued_shares"), 2).alias("issued_shares"), "administrator", _r(F.col("total_assets"), 2).alias("total_assets"), _r(F.col("credit_share"), 5).alias("credit_share"))


@query(f"""
    WITH o AS ({_ORDERS}), e AS (SELECT o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN day + 30 ELSE day END AS ex_date, total, o_orderkey FROM o WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'),
    b AS (SELECT o_custkey, ex_date, total, 'events' AS source, o_orderkey FROM e UNION ALL SELECT o_custkey, day, total, 'stated', o_orderkey FROM o WHERE o_orderstatus <> 'F')
    SELECT o_custkey, CAST(ex_date AS DATE) AS ex_date, CAST(total AS DOUBLE) AS value, source FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, ex_date ORDER BY source, o_orderkey DESC) AS r FROM b) WHERE r = 1
""")
def distribution_merge(spark, sf_dir):
    """Events over stated payments by customer and date; those of amortisation don't count, a missing ex date is the payment's."""
    o = customer_orders(spark, sf_dir)
    events = o.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("day")).alias("ex_date"), F.date_add("day", 30).alias("payment_date"), F.col("total").alias("value"), F.when(F.col("o_orderpriority") == "5-LOW", "Amortização").alias("kind"))
    stated = o.where("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey", F.col("day").alias("ex_date"), F.col("total").alias("value"))
    return merged_distributions(stated, events, ["o_custkey"], "o_orderkey").select("o_custkey", "ex_date", F.col("value").cast("double").alias("value"), "source")


@query(f"""
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN day END AS ex_date, CASE WHEN o_orderkey % 3 <> 0 THEN day + 30 END AS payment_date FROM ({_ORDERS})),
    f AS (SELECT o_orderkey, coalesce(payment_date > DATE '1997-06-30', false) AS is_future_payment, coalesce(ex_date > DATE '1997-06-30', false) AS is_future_ex_date, payment_date FROM o)
    SELECT 'past' AS period, o_orderkey, is_future_payment, is_future_ex_date FROM f WHERE payment_date <= DATE '1997-06-30' UNION ALL SELECT 'future', o_orderkey, is_future_payment, is_future_ex_date FROM f WHERE is_future_payment UNION ALL SELECT 'upcoming_ex_date', o_orderkey, is_future_payment, is_future_ex_date FROM f WHERE is_future_ex_date
""")
def payment_periods(spark, sf_dir):
    """Payments past and to come, and those whose ex date is to come."""
    o = customer_orders(spark, sf_dir).select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("day")).alias("ex_date"), F.when(F.col("o_orderkey") % 3 != 0, F.date_add("day", 30)).alias("payment_date"))
    at = F.lit("1997-06-30").cast("date")
    past, *rest = (in_period(o, p, at).select(F.lit(p).alias("period"), "o_orderkey", "is_future_payment", "is_future_ex_date") for p in ("past", "future", "upcoming_ex_date"))
    return past.unionByName(rest[0]).unionByName(rest[1])


@query("""
    SELECT 'C' || c_custkey AS ticker, lpad(CAST(min(c_custkey) AS VARCHAR), 10, '0') AS cik, min(c_name) AS name, CASE WHEN c_custkey % 3 = 0 THEN 'N' || min(c_nationkey) END AS exchange, 'US' AS country, CAST(NULL AS VARCHAR) AS security_class
    FROM customer WHERE NOT regexp_full_match('C' || c_custkey, '[A-Z]{4}[0-9]{1,2}') AND length('C' || c_custkey) <= 10 GROUP BY c_custkey
""")
def directory_entries(spark, sf_dir):
    """A directory's documents, in each of the three shapes, as one table."""
    c = _t(spark, sf_dir, "customer")
    key, number, place = F.concat(F.lit("c"), F.col("c_custkey")), F.col("c_custkey").cast("string"), F.concat(F.lit("N"), F.col("c_nationkey"))
    matrix = F.to_json(F.struct(F.array(*map(F.lit, ("ticker", "cik", "title", "exchange"))).alias("fields"), F.array(F.array(key, number, F.col("c_name"), place)).alias("data")))
    entry = F.struct(key.alias("ticker"), F.col("c_custkey").alias("cik_str"), F.col("c_name").alias("companyName"))
    doc = F.when(F.col("c_custkey") % 3 == 0, matrix).when(F.col("c_custkey") % 3 == 1, F.to_json(F.struct(F.array(entry).alias("data")))).otherwise(F.to_json(F.struct(entry.alias("0"))))
    return directories.ticker_directory(c.select("c_custkey", doc.alias("doc")), "doc", "c_custkey")


@query("""
    WITH s AS (SELECT s_suppkey, 'S' || s_suppkey AS ticker, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name, CASE WHEN s_suppkey % 3 > 0 THEN 's' || (s_suppkey + 1) END AS underlying, CASE WHEN s_suppkey % 5 = 0 THEN 'own' END AS own FROM supplier)
    SELECT s.s_suppkey, coalesce(s.own, t.name) AS underlying_name FROM s LEFT JOIN s t ON upper(s.underlying) = t.ticker
""")
def borrowed_names(spark, sf_dir):
    """Receipts that have no issuer's name take that of the share they stand for."""
    k = F.col("s_suppkey")
    s = _t(spark, sf_dir, "supplier").select(k, F.concat(F.lit("S"), k).alias("ticker"), F.when(k % 2 == 0, F.col("s_name")).alias("name"), F.when(k % 3 > 0, F.concat(F.lit("s"), (k + 1).cast("string"))).alias("underlying"), F.when(k % 5 == 0, "own").alias("underlying_name"))
    return directories.with_underlying_names(s, "ticker", "name", "underlying", "underlying_name").select("s_suppkey", "underlying_name")


@query("SELECT n_nationkey, n_nationkey AS institution, 1.0::DOUBLE AS score FROM nation")
def institution_names(spark, sf_dir):
    """Nations as banks, abbreviated on one side and in full on the other: each finds itself, wholly alike."""
    n = _t(spark, sf_dir, "nation")
    asked = n.select("n_nationkey", F.concat(F.lit(" Bco "), F.lower("n_name")).alias("name"))
    return institution_match(asked, n.select(F.col("n_nationkey").alias("institution"), F.concat(F.lit("Banco "), F.col("n_name")).alias("name")), "n_nationkey", "institution", "name")
