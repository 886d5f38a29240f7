"""Monthly fund archives: members of quoted records, brought together by fund and date, and matched to listed instruments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import ratio_positive
from tessera.functions.text import annual_fee, comma_decimal, digits, fold_squeeze, iso_date
from tessera.operators.frames import keep_best
from tessera.operators.matching import sequence_ratio
from tessera.sources.records import named

# Column names of the members; several names for a value are tried in order.
GENERAL = ("CNPJ_Fundo_Classe", "CNPJ_Fundo", "Nome_Fundo_Classe", "Nome_Fundo", "Codigo_ISIN", "Data_Referencia", "Quantidade_Cotas_Emitidas", "Data_Funcionamento", "Segmento_Atuacao", "Nome_Administrador")
SHARES = {"monthly_distribution_yield": ("Percentual_Dividend_Yield_Mes", "Dividend_Yield_Mes"), "monthly_nav_return": ("Percentual_Rentabilidade_Patrimonial_Mes", "Rentabilidade_Patrimonial_Mes"), "monthly_effective_return": ("Percentual_Rentabilidade_Efetiva_Mes", "Rentabilidade_Efetiva_Mes")}
NAV, NET_ASSETS, FEE = "Valor_Patrimonial_Cotas", "Patrimonio_Liquido", "Percentual_Despesas_Taxa_Administracao"
ISSUED, HOLDERS = ("Cotas_Emitidas", "Quantidade_Cotas_Emitidas"), ("Total_Numero_Cotistas", "Numero_Cotistas")
COMPLEMENT = ("CNPJ_Fundo_Classe", "CNPJ_Fundo", "Data_Referencia", NAV, NET_ASSETS, FEE, *ISSUED, *HOLDERS, *(c for names in SHARES.values() for c in names))
TOTALS = {
    "total_assets": ("Valor_Ativo", ("Total_Necessidades_Liquidez", "Total_Investido", "Valores_Receber")),
    "property_assets": ("Direitos_Bens_Imoveis", ("Terrenos", "Imoveis_Renda_Acabados", "Imoveis_Renda_Construcao", "Imoveis_Venda_Acabados", "Imoveis_Venda_Construcao", "Outros_Direitos_Reais")),
    "liquid_assets": ("Total_Necessidades_Liquidez", ("Disponibilidades", "Titulos_Publicos", "Fundos_Renda_Fixa")),
    "credit_assets": (None, ("CRI", "CRI_CRA", "Letras_Hipotecarias", "LCI", "LCI_LCA", "LIG", "Debentures")),
}
LIABILITIES = "Total_Passivo"
ASSETS = ("CNPJ_Fundo_Classe", "CNPJ_Fundo", "Data_Referencia", LIABILITIES, *dict.fromkeys(c for total, parts in TOTALS.values() for c in (total, *parts) if c))
AGRO = ("CNPJ_Classe", "Nome_Classe", "Codigo_ISIN", *(c for c in COMPLEMENT if not c.startswith("CNPJ")))
FILE_ORDER = ("archive", "member_no", "line_no")


def first_member(lines: DataFrame, included: str, excluded: str | None = None) -> DataFrame:
    """The lines of each archive's first member whose name holds ``included``, in either case, and not ``excluded``."""
    name = F.lower("member")
    named = lines.where(F.contains(name, F.lit(included)) & (F.lit(True) if excluded is None else ~F.contains(name, F.lit(excluded))))
    return named.join(named.groupBy("archive").agg(F.min("member_no").alias("member_no")), ["archive", "member_no"])


def quoted(lines: DataFrame, columns: tuple[str, ...], separator: str = ";") -> DataFrame:
    """The named columns of records whose fields may stand in quotes; short rows end in nulls, blank ones are skipped.

    Where fields hold line breaks, ``lines`` is what ``records.whole_records`` gives.
    """
    return named(lines, columns, separator).drop("member")


def _text(column: str) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def _first_text(columns: tuple[str, ...]) -> Column:
    """The first column that is not empty; one of blanks counts and is read as null later."""
    return F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in columns))


def fund_id() -> Column:
    return F.nullif(digits(_first_text(("CNPJ_Fundo_Classe", "CNPJ_Fundo"))), F.lit(""))


def sum_of_present(columns: tuple[str, ...]) -> Column:
    """The sum of those numbers that are there; null if none is."""
    values = F.filter(F.array(*(comma_decimal(F.col(c)) for c in columns)), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0).cast("decimal(38,10)"), lambda a, v: (a + v).cast("decimal(38,10)")))


def matched_funds(general: DataFrame, instruments: DataFrame, key: str, isin: str, name: str) -> DataFrame:
    """key, fund: of the funds with the instrument's first ten characters of ISIN the one whose name is most alike, first in file order among equals."""

    def prefix(code: Column) -> Column:
        return F.upper(F.substring(F.nullif(code, F.lit("")), 1, 10))

    funds = general.select(*FILE_ORDER, fund_id().alias("fund"), prefix(_text("Codigo_ISIN")).alias("_isin"), fold_squeeze(F.trim(_first_text(("Nome_Fundo_Classe", "Nome_Fundo")))).alias("_fund_name")).where("fund is not null")
    once = keep_best(funds, ["_isin", "fund", "_fund_name"], [F.col(c).asc() for c in FILE_ORDER])
    wanted = instruments.select(F.col(key), prefix(F.col(isin)).alias("_isin"), fold_squeeze(F.col(name)).alias("_name"))
    alike = F.when((F.col("_fund_name") != "") & (F.col("_name") != ""), sequence_ratio(F.col("_fund_name"), F.col("_name")))
    met = wanted.join(once, "_isin").withColumn("_alike", F.coalesce(alike, F.lit(0.0)))
    return keep_best(met, [key], [F.col("_alike").desc(), *(F.col(c).asc() for c in FILE_ORDER)]).select(key, "fund")


def monthly_reports(complement: DataFrame, general: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per fund and date: values a share, returns, holders, and what the other two members say of that date.

    Of several rows for a fund and date the last in file order counts, in each member. Rows without a date or a positive
    value a share are skipped; a date that the other members lack has nulls.
    """

    def dated(df: DataFrame, keep: list[Column]) -> DataFrame:
        return df.select(*FILE_ORDER, fund_id().alias("fund"), iso_date(_text("Data_Referencia")).alias("as_of"), *keep).where("fund is not null and as_of is not null")

    def latest(df: DataFrame) -> DataFrame:
        return keep_best(df, ["fund", "as_of"], [F.col(c).desc() for c in FILE_ORDER]).drop(*FILE_ORDER)

    told = latest(dated(general, [comma_decimal(F.col("Quantidade_Cotas_Emitidas")).alias("told_shares"), iso_date(_text("Data_Funcionamento")).alias("inception_date"), _text("Segmento_Atuacao").alias("segment"), _text("Nome_Administrador").alias("administrator")]))
    sums = {name: F.coalesce(*([comma_decimal(F.col(total))] if total else []), sum_of_present(parts)).alias(name) for name, (total, parts) in TOTALS.items()}
    held = latest(dated(assets, [comma_decimal(F.col(LIABILITIES)).alias("total_liabilities"), *sums.values()]))
    shares = [comma_decimal(_first_text(names)).alias(name) for name, names in SHARES.items()]
    values = dated(complement, [comma_decimal(F.col(NAV)).alias("nav_per_share"), comma_decimal(F.col(NET_ASSETS)).alias("net_assets"), _first_text(ISSUED).alias("own_shares"), comma_decimal(_first_text(HOLDERS)).alias("shareholder_count"), annual_fee(F.col(FEE)).alias("administration_fee_ratio"), *shares])
    full = latest(values.where("nav_per_share > 0")).join(told, ["fund", "as_of"], "left").join(held, ["fund", "as_of"], "left")
    issued = F.when(F.col("own_shares").isNotNull(), comma_decimal(F.col("own_shares"))).otherwise(F.col("told_shares"))
    return full.withColumn("issued_shares", issued).drop("own_shares", "told_shares")


def month_ends(daily: DataFrame) -> DataFrame:
    """fund, as_of, nav_per_share: the last positive daily value of each fund and month, the first in file order among equal dates."""
    read = daily.select(*FILE_ORDER, F.nullif(digits(F.col("CNPJ_FUNDO_CLASSE")), F.lit("")).alias("fund"), iso_date(_text("DT_COMPTC")).alias("as_of"), comma_decimal(F.col("VL_QUOTA")).alias("nav_per_share")).where("fund is not null and as_of is not null and nav_per_share > 0")
    return keep_best(read.withColumn("_month", F.trunc("as_of", "month")), ["fund", "_month"], [F.col("as_of").desc(), *(F.col(c).asc() for c in FILE_ORDER)]).select("fund", "as_of", "nav_per_share")


def portfolio_shares(reports: DataFrame) -> DataFrame:
    """Each report with its shares of property, credit and liquid assets, and of liabilities, in total assets."""
    parts = {"property_share": "property_assets", "credit_share": "credit_assets", "liquid_share": "liquid_assets", "leverage": "total_liabilities"}
    return reports.withColumns({name: ratio_positive(F.col(of).cast("double"), F.col("total_assets").cast("double")) for name, of in parts.items()})


def agro_rows(lines: DataFrame) -> DataFrame:
    """Rows of agro-chain archives, the member of classes alone, under the names of the other funds' members."""
    rows = quoted(first_member(lines, "inf_mensal_fiagro_", "subclasse"), AGRO).withColumnsRenamed({"CNPJ_Classe": "CNPJ_Fundo_Classe", "Nome_Classe": "Nome_Fundo_Classe"})
    return rows.withColumns({"CNPJ_Fundo": F.lit(None).cast("string"), "Nome_Fundo": F.lit(None).cast("string")}).where(iso_date(_text("Data_Referencia")).isNotNull() & (comma_decimal(F.col(NAV)) > 0))


def agro_reports(rows: DataFrame) -> DataFrame:
    """One row per fund and date, the last in file order: as ``monthly_reports``, from percentages; what its archive lacks is null."""
    shares = [(comma_decimal(_first_text(names)) / 100).cast("decimal(38,12)").alias(name) for name, names in SHARES.items()]
    values = rows.select(*FILE_ORDER, fund_id().alias("fund"), iso_date(_text("Data_Referencia")).alias("as_of"), comma_decimal(F.col(NAV)).alias("nav_per_share"), comma_decimal(F.col(NET_ASSETS)).alias("net_assets"), comma_decimal(_first_text(ISSUED)).alias("issued_shares"), comma_decimal(_first_text(HOLDERS)).alias("shareholder_count"), annual_fee(F.col(FEE), percentage_points=True).alias("administration_fee_ratio"), *shares)
    return keep_best(values.where("fund is not null"), ["fund", "as_of"], [F.col(c).desc() for c in FILE_ORDER]).drop(*FILE_ORDER)
