"""Profiles and instrument types from names, labels and weights: ordered rules over folded text, the first that holds wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.numeric import ratio_nonzero, unscaled_share
from tessera.functions.text import fold, squeeze, token_class

# Word parts that tell a company's business, in the order in which they are tried.
STOCK_RULES = [
    ("bank", ["BANCO", "BCO ", "INTERMEDIAR", "SERVICOS FINANCEIROS"]),
    ("insurer", ["SEGURO", "SEGURIDADE", "PREVIDENCIA"]),
    ("commodity", ["PETROLEO", "MINERACAO", "SIDERURGIA", "METALURGIA", "PAPEL E CELULOSE"]),
    ("utility", ["ENERGIA ELETRICA", "SANEAMENTO", "GAS"]),
]
FINANCIAL_PARTS = ["BANCO", "INTERMEDIAR", "FINANCEIR", "SEGUR", "PREVIDEN"]

# Word parts of index funds, bulletin lines and directory rows, in the order in which they are tried.
ETF_RULES = [("crypto", ["BITCOIN", "CRYPTO", "DIGITAL ASSET"]), ("fixed_income", ["BOND", "FIXED INCOME", "TREASURY", "CREDIT"])]
BULLETIN_RULES = [
    ("fi_infra", ["FI INFRA", "FI-INFRA"]),
    ("fiagro", ["FIAGRO", "FI AGRO"]),
    ("etf", ["FUNDO DE INDICE", r"\bETF\b"]),
    ("bdr", [r"(^| )BDR", r"(^| )DRN", r"(^| )DRE"]),
    ("fii", ["FUNDS.*IMOB", "IMOB.*FUNDS", "FII.*IMOB", "IMOB.*FII", "(^| )FII"]),
    ("fund", ["FUNDS", "FII"]),
    ("unit", ["(^| )UNT", "UNIT"]),
    ("stock", ["COMMON EQUITIES", "PREFERRED EQUITIES", " ON", " PN"]),
]
DIRECTORY_RULES = [
    ("bdr", ["BDR", "DEPOSITARY"]),
    ("etf", ["ETF", "FUNDO DE IND"]),
    ("fiagro", ["FIAGRO", "FI AGRO"]),
    ("fi_infra", ["FI-INFRA", "FI INFRA"]),
    ("fii", ["FII", "IMOBILI", "REAL ESTATE"]),
]
DIRECTORY_LATE_RULES = [("unit", ["UNIT", "(^| )UNT"]), ("stock", ["STOCK", "EQUITY", "COMMON"])]

THEMATIC_SHARE = 0.65
MAIN_SHARE = 0.50


def _words(*parts: Column) -> Column:
    return squeeze(F.concat_ws(" ", *parts))


def is_financial(sector: Column) -> Column:
    return F.coalesce(F.rlike(fold(sector), F.lit("|".join(FINANCIAL_PARTS))), F.lit(False))


def stock_profile(sector: Column, name: Column) -> Column:
    """bank, insurer, commodity, utility, else industrial; nulls count as empty."""
    return token_class(_words(sector, name), STOCK_RULES, "industrial")


def etf_profile(description: Column, asset_types: Column, weights: Column) -> Column:
    """By words of the description and asset types; else thematic where one sector holds 65 % or more, else broad.

    ``asset_types`` is an array of names, ``weights`` of sector weights, shares or percentages.
    """
    largest = F.array_max(weights)
    rest = F.when(unscaled_share(largest, largest) >= THEMATIC_SHARE, "thematic").otherwise("broad")
    return token_class(_words(description, F.array_join(asset_types, " ")), ETF_RULES, rest)


def fund_profile(kind: Column, property_assets: Column, credit_assets: Column, total_assets: Column) -> Column:
    """The kind of portfolio by the shares of property and of credit in total assets; unknown shares decide nothing."""
    land, credit = (ratio_nonzero(part.cast("double"), total_assets.cast("double")) for part in (property_assets, credit_assets))
    agro = F.when(F.coalesce(credit, F.lit(0)) >= F.coalesce(land, F.lit(0)), "fiagro_credit").otherwise("fiagro_land")
    return F.when(kind == "fi_infra", "fi_infra").when(kind == "fiagro", agro).when(land >= MAIN_SHARE, "brick").when(credit >= MAIN_SHARE, "paper").otherwise("hybrid")


def bulletin_type(category: Column, description: Column, asset_description: Column) -> Column:
    """Instrument type of a bulletin line. A share class is looked for behind a space, so not at the very beginning."""
    text = F.concat_ws(" ", F.coalesce(category, F.lit("")), F.coalesce(description, F.lit("")), F.coalesce(asset_description, F.lit("")))
    return token_class(squeeze(text), BULLETIN_RULES, "unknown")


def directory_type(raw_type: Column, name: Column, ticker: Column) -> Column:
    """Instrument type of a directory row; a plain fund whose ticker ends in 11 is a real-estate fund."""
    text = F.concat_ws(" ", raw_type, name)
    plain_fund = F.upper(F.trim(raw_type)).isin("FUND", "FUNDS", "FUNDOS") & F.endswith(ticker, F.lit("11"))
    return token_class(text, DIRECTORY_RULES, F.when(F.coalesce(plain_fund, F.lit(False)), "fii").otherwise(token_class(text, DIRECTORY_LATE_RULES, "unknown")))
