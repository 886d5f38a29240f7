"""Company statements from delimited archive members: account rows to one filing per company and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import digits, fold, iso_date, plain_decimal
from tessera.operators.frames import keep_best
from tessera.sources.archives import delimited

# The period order that is kept, scales, account codes that make a filing meaningful, depreciation words, and
# the accounts per share, whose scale is told by their size.
LAST_PERIOD = "ÚLTIMO"
MEANINGFUL = ("3.01", "3.11", "2.03", "1")
DEPRECIATION = "DEPRECIA|AMORTIZA"
PER_SHARE = r"^3\.99\.0[12]\."

ACCOUNT_COLUMNS = ["CNPJ_CIA", "DT_REFER", "DT_RECEB", "VERSAO", "DENOM_CIA", "CD_CVM", "ESCALA_MOEDA", "ORDEM_EXERC", "DT_INI_EXERC", "DT_FIM_EXERC", "CD_CONTA", "DS_CONTA", "VL_CONTA"]
CAPITAL_COLUMNS = ["CNPJ_CIA", "DT_REFER", "QT_ACAO_ORDIN_CAP_INTEGR", "QT_ACAO_PREF_CAP_INTEGR", "QT_ACAO_TOTAL_CAP_INTEGR", "QT_ACAO_TOTAL_TESOURO"]
REGISTRY_COLUMNS = ["CNPJ_CIA", "DENOM_SOCIAL", "DENOM_COMERC", "CD_CVM", "SETOR_ATIV", "SIT"]


def _place() -> Column:
    return F.struct("archive", "member_no", "line_no").alias("place")


def account_scale(code: Column, value: Column, scale: Column) -> Column:
    """1000 or 1 by the stated scale; amounts per share of 100 or more under MIL are thousandths."""
    name = F.upper(F.trim(F.coalesce(scale, F.lit(""))))
    per_share = F.rlike(code, F.lit(PER_SHARE)) & (name == "MIL")
    factor = F.when(per_share & (F.abs(value) >= 100), F.lit("0.001")).when(per_share, F.lit("1")).when(name == "MIL", F.lit("1000")).otherwise(F.lit("1"))
    return factor.cast("decimal(10,3)")


def version_number(version: Column) -> Column:
    return F.coalesce(plain_decimal(version), F.lit(0).cast("decimal(38,10)"))


def is_depreciation(code: Column, label: Column) -> Column:
    return F.startswith(code, F.lit("6.")) & F.coalesce(F.rlike(fold(label), F.lit(DEPRECIATION)), F.lit(False))


def _role(member: Column) -> Column:
    name = F.lower(member)
    return F.when(F.contains(name, F.lit("composicao_capital")) | F.contains(name, F.lit("parecer")), "other").when(F.contains(name, F.lit("_con_")), "consolidated").when(F.contains(name, F.lit("_ind_")), "individual").otherwise("filing")


def _blank_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def publications(lines: DataFrame) -> DataFrame:
    """company, reference_date, version, received: the last date received, from the members that describe filings."""
    rows = delimited(lines.where(_role(F.col("member")) == "filing"), ["CNPJ_CIA", "DT_REFER", "VERSAO", "DT_RECEB"])
    read = rows.select(digits(F.col("CNPJ_CIA")).alias("company"), iso_date(F.col("DT_REFER")).alias("reference_date"), F.trim(F.coalesce("VERSAO", F.lit(""))).alias("version"), iso_date(F.col("DT_RECEB")).alias("received"))
    return read.where("company <> '' and reference_date is not null and received is not null").groupBy("company", "reference_date", "version").agg(F.max("received").alias("received"))


def accounts(lines: DataFrame) -> DataFrame:
    """Account rows of the last period with a value: keys, scaled value, label, and where they stood."""
    rows = delimited(lines.where(_role(F.col("member")).isin("consolidated", "individual")), ACCOUNT_COLUMNS)
    value = plain_decimal(F.col("VL_CONTA"))
    read = rows.where(F.upper(F.trim("ORDEM_EXERC")) == LAST_PERIOD).select(
        _place(), digits(F.col("CNPJ_CIA")).alias("company"), (_role(F.col("member")) == "consolidated").alias("consolidated"), F.trim(F.coalesce("VERSAO", F.lit(""))).alias("version"),
        F.coalesce(iso_date(F.col("DT_FIM_EXERC")), iso_date(F.col("DT_REFER"))).alias("period_end"), iso_date(F.col("DT_REFER")).alias("reference_date"), iso_date(F.col("DT_INI_EXERC")).alias("period_start"), iso_date(F.col("DT_RECEB")).alias("received"),
        F.trim("CD_CVM").alias("registry_code"), F.trim("DENOM_CIA").alias("company_name"), F.trim("CD_CONTA").alias("code"), F.col("DS_CONTA").alias("label"), value.alias("stated"), F.col("ESCALA_MOEDA").alias("scale"),
    )
    kept = read.where("company <> '' and period_end is not null and reference_date is not null and stated is not null and code <> ''")
    return kept.withColumn("value", (F.col("stated") * account_scale(F.col("code"), F.col("stated"), F.col("scale"))).cast("decimal(38,10)"))


def filings(lines: DataFrame) -> DataFrame:
    """One row per company, period, kind and version. Of rows that repeat an account the first in file order wins.

    Two grouped passes: by account, then by filing, so a filing's map is the only thing gathered (its accounts).
    """
    key = ["company", "period_end", "consolidated", "version"]
    known = publications(lines).withColumnRenamed("received", "listed")
    rows = accounts(lines).join(known, ["company", "reference_date", "version"], "left")

    def first(value: Column) -> Column:
        """The first that is there."""
        return F.min_by(value, F.when(value.isNotNull(), F.col("place")))

    worn = F.when(is_depreciation(F.col("code"), F.col("label")), F.abs("value"))
    each = rows.groupBy(*key, "code").agg(
        F.min_by("value", "place").alias("value"), first(_blank_null(F.col("label"))).alias("label"), first(worn).alias("worn"), F.min(F.when(worn.isNotNull(), F.col("place"))).alias("worn_at"), F.min("place").alias("place"),
        *(F.min_by(c, "place").alias(c) for c in ("registry_code", "company_name", "reference_date", "received")), first(F.col("period_start")).alias("period_start"), first(F.col("listed")).alias("listed"),
    )
    entry = F.struct("code", "value")
    whole = each.groupBy(*key).agg(
        *(F.min_by(c, "place").alias(c) for c in ("registry_code", "company_name", "reference_date")), first(F.col("period_start")).alias("period_start"),
        F.coalesce(F.min_by("received", "place"), first(F.col("listed"))).alias("published_at"), F.map_from_entries(F.collect_list(entry)).alias("accounts"),
        F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("code", "label")))).alias("labels"), F.min_by("worn", "worn_at").alias("depreciation"), F.min("place").alias("place"),
    )
    meaningful = F.exists(F.array(*map(F.lit, MEANINGFUL)), lambda c: F.coalesce(F.try_element_at("accounts", c), F.lit(0).cast("decimal(38,10)")) != 0)
    return whole.withColumn("meaningful", meaningful)


def periods(lines: DataFrame, prefer_consolidated: bool = True) -> DataFrame:
    """The best filing of each company and period: meaningful, consolidated, highest version, latest published, most accounts."""
    order = [F.col("meaningful").desc(), *([F.col("consolidated").desc()] if prefer_consolidated else []), version_number(F.col("version")).desc(), F.col("published_at").desc_nulls_last(), F.size("accounts").desc(), F.col("place").asc()]
    return keep_best(filings(lines), ["company", "period_end"], order).drop("place", "meaningful")


def share_capital(lines: DataFrame) -> DataFrame:
    """company, reference_date, common, preferred, treasury, total, outstanding: of the latest reference (first on ties)."""
    rows = delimited(lines.where(F.contains(F.lower("member"), F.lit("composicao_capital"))), CAPITAL_COLUMNS)
    zero = F.lit(0).cast("decimal(38,10)")
    common, preferred, total, treasury = (F.coalesce(plain_decimal(F.col(c)), zero) for c in CAPITAL_COLUMNS[2:])
    read = rows.select(_place(), digits(F.col("CNPJ_CIA")).alias("company"), iso_date(F.col("DT_REFER")).alias("reference_date"), F.when((common + preferred <= 0) & (total > 0), total).otherwise(common).cast("decimal(38,10)").alias("common"), preferred.alias("preferred"), treasury.alias("treasury"))
    last = keep_best(read.where("company <> '' and reference_date is not null"), ["company"], [F.col("reference_date").desc(), F.col("place").asc()])
    issued = (F.col("common") + F.col("preferred")).cast("decimal(38,10)")
    outstanding = F.when(F.col("treasury") < issued, issued - F.col("treasury")).otherwise(issued).cast("decimal(38,10)")
    return last.select("company", "reference_date", "common", "preferred", "treasury", issued.alias("total"), outstanding.alias("outstanding"))


def registry(lines: DataFrame) -> DataFrame:
    """One row per company, the last in file order; rows without an id or a name are dropped."""
    rows = delimited(lines, REGISTRY_COLUMNS)
    read = rows.select(_place(), digits(F.col("CNPJ_CIA")).alias("company"), F.trim("CD_CVM").alias("registry_code"), F.trim("DENOM_SOCIAL").alias("corporate_name"), _blank_null(F.col("DENOM_COMERC")).alias("trade_name"), _blank_null(F.col("SETOR_ATIV")).alias("sector"), F.trim("SIT").alias("status"))
    return keep_best(read.where("company <> '' and corporate_name <> ''"), ["company"], [F.col("place").desc()]).drop("place")
