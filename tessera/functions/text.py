"""Text normalisation and locale-aware casts, as Column -> Column functions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks, and their base letters.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
BASE = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"

# Texts that stand for no value.
NULL_TEXTS = ("", "-", "--", "n/d", "nd", "n/a", "na", "null", "none", "n.d.", "indisponivel")

# Legal forms and small words that company names carry.
LEGAL_TOKENS = ("SA", "S", "A", "LTDA", "ME", "EPP", "CIA", "COMPANHIA", "DO", "DA", "DE", "DOS", "DAS", "E", "EM")

# Words that tell little of a business, besides the legal forms.
BUSINESS_TOKENS = ("PARTICIPACOES", "PARTICIPACAO", "PART", "HOLDING", "HOLDINGS", "GRUPO", "BRASILEIRA", "BRASILEIRO", "NACIONAL", "INDUSTRIA", "INDUSTRIAS", "COMERCIO", "EMPREENDIMENTOS", "INVESTIMENTOS", "NOVA", "NOVO")

# Abbreviations in filing names.
SYNONYMS = {"BCO": "BANCO", "TELEC": "TELECOMUNICACOES", "TELECOM": "TELECOMUNICACOES", "DISTRIB": "DISTRIBUIDORA", "ELETR": "ELETRICA", "CENT": "CENTRAIS", "EMPR": "EMPRESA", "SERV": "SERVICOS", "TRANSM": "TRANSMISSAO", "ENERG": "ENERGIA", "SID": "SIDERURGICA", "CONSTR": "CONSTRUTORA"}

# Magnitude words, each also the beginning of its plural's; and label parts that mean money.
MAGNITUDES = (("trilho|trilhao", 10**12), ("bilho|bilhao", 10**9), ("milho|milhao", 10**6), ("mil", 10**3))
MONEY_LABELS = "valor|cotacao|volume|vpa|lpa|preco"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row, however often it stands in there."""
    return F.transform(F.array(value), body)[0]


def squeeze(text: Column) -> Column:
    """Trimmed, with runs of white space as one space."""
    return F.trim(F.regexp_replace(F.translate(text, " ", " "), r"\s+", " "))


def strip_marks(text: Column) -> Column:
    """Latin letters without their marks; what is not ASCII after that is dropped."""
    return F.regexp_replace(F.translate(text, ACCENTED, BASE), r"[^\x00-\x7F]", "")


def fold(text: Column) -> Column:
    """Upper-case ASCII. Non-ASCII goes before upper-casing, so that a sharp s leaves nothing."""
    return F.upper(strip_marks(text))


def fold_squeeze(text: Column) -> Column:
    return squeeze(fold(text))


def lower_key(text: Column) -> Column:
    return F.lower(strip_marks(squeeze(text)))


def label_key(text: Column, empty: str = "campo") -> Column:
    """A label as an identifier: folded, other characters to single underscores, lower case."""
    key = F.regexp_replace(F.regexp_replace(F.lower(fold(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit(empty)).otherwise(key)


def null_like(text: Column) -> Column:
    return F.lower(strip_marks(squeeze(F.coalesce(text, F.lit(""))))).isin(*NULL_TEXTS)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def br_decimal(text: Column, scale: int = 10) -> Column:
    """Points group thousands, a comma parts decimals; a letter means no number, other signs don't count."""
    def read(bare: Column) -> Column:
        plain = F.regexp_replace(F.translate(F.translate(bare, ".", ""), ",", "."), r"[^0-9.\-+]", "")
        return F.when(~F.rlike(bare, F.lit("[A-Za-zÀ-ÿ]")), plain.try_cast(f"decimal(38,{scale})"))

    return let(text, lambda t: F.when(~null_like(t), let(F.regexp_replace(squeeze(t), r"R\$|%", ""), read)))


def plain_decimal(text: Column, scale: int = 10) -> Column:
    return F.when(~null_like(text), F.trim(text).try_cast(f"decimal(38,{scale})"))


def comma_decimal(text: Column, scale: int = 10) -> Column:
    """A decimal comma without grouping."""
    return F.when(~null_like(text), F.regexp_replace(F.trim(text), ",", ".").try_cast(f"decimal(38,{scale})"))


def page_decimal(text: Column, scale: int = 10) -> Column:
    """Points group thousands only where a comma parts decimals."""
    plain = F.when(F.contains(text, F.lit(",")), F.translate(F.translate(text, ".", ""), ",", ".")).otherwise(text)
    return F.trim(plain).try_cast(f"decimal(38,{scale})")


def magnitude_decimal(text: Column, scale: int = 10) -> Column:
    """The first amount before a local price, scaled by the magnitude word in that text; also short forms such as 2.5B or (3 M)."""
    def read(reported: Column) -> Column:
        amount = page_decimal(F.regexp_extract(reported, r"-?\d[\d.]*(?:,\d+)?", 0), 6)
        signed = let(amount, lambda a: F.when(F.rlike(reported, F.lit(r"\(\s*\d")), -a).otherwise(a))
        initial = F.upper(F.regexp_extract(reported, r"\d\s*([KMBTkmbt])\b", 1))
        return (signed * let(lower_key(reported), lambda key: let(initial, lambda i: size_of(key, i))).cast("decimal(20,0)")).cast(f"decimal(38,{scale})")

    def size_of(key: Column, initial: Column) -> Column:
        factor = F.lit(1)
        for words, size in reversed(MAGNITUDES):
            factor = F.when(F.rlike(key, F.lit(words)), F.lit(size)).otherwise(factor)
        for letter, size in (("T", 10**12), ("B", 10**9), ("M", 10**6), ("K", 10**3)):
            factor = F.when(initial == letter, F.lit(size)).otherwise(factor)
        return factor

    return let(F.split(text, r"R\$")[0], read)


def br_date(text: Column) -> Column:
    """Day, month and year; a year of two digits is one from 1969 to 2068."""
    def read(shown: Column) -> Column:
        short = let(F.try_to_date(shown, "d/M/yy"), lambda d: F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d))
        # What holds no two strokes is no date and is not parsed.
        return F.when(F.rlike(shown, F.lit("^[^/]*/[^/]*/[^/]*$")) & ~null_like(shown), let(F.try_to_date(shown, "d/M/yyyy"), lambda d: F.when(d.isNotNull(), d).otherwise(short)))

    return let(squeeze(text), read)


def iso_date(text: Column) -> Column:
    return F.try_to_date(F.substring(F.trim(text), 1, 10), "yyyy-MM-dd")


def header_date(text: Column) -> Column:
    """A column header such as ``Dec 31, 2023``."""
    return F.try_to_date(F.trim(text), "MMM d, yyyy")


def period_date(code: Column) -> Column:
    """yyyymm as the first of its month."""
    return F.try_to_date(F.concat(code.cast("string"), F.lit("01")), "yyyyMMdd")


def inferred(text: Column, label: Column | None = None) -> Column:
    """struct(value_type, value_date, value_decimal, value_text): date, then percent, money or number, then text.

    Money has its sign before it or a label that says so.
    """
    by_label = F.lit(False) if label is None else F.coalesce(F.rlike(label_key(label), F.lit(MONEY_LABELS)), F.lit(False))

    def read(x: Column) -> Column:
        shown, day, number = x["shown"], x["day"], x["number"]
        money = F.startswith(shown, F.lit("R$")) | by_label
        kind = F.when(null_like(shown), "null").when(day.isNotNull(), "date").when(number.isNull(), "text").when(F.contains(shown, F.lit("%")), "percent").when(money, "money").otherwise("number")
        return let(kind, lambda k: F.struct(k.alias("value_type"), F.when(k == "date", day).alias("value_date"), F.when(k.isin("percent", "money", "number"), number).alias("value_decimal"), F.when(k == "text", shown).alias("value_text")))

    return let(squeeze(text), lambda shown: let(F.struct(shown.alias("shown"), br_date(shown).alias("day"), br_decimal(shown).alias("number")), read))


def name_tokens(text: Column, noise: tuple[str, ...] = LEGAL_TOKENS) -> Column:
    """A company name as distinct tokens, abbreviations in full, without noise; where nothing else is left, all of them.

    ``LEGAL_TOKENS`` tell the least; with ``BUSINESS_TOKENS`` besides, only what identifies stays.
    """
    plain = F.regexp_replace(F.regexp_replace(fold(text), r"S/A|S\.A\.", " SA "), "[^A-Z0-9]+", " ")
    full = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    every = F.array_distinct(F.transform(F.filter(F.split(F.trim(plain), " "), lambda t: t != ""), lambda t: F.coalesce(F.try_element_at(full, t), t)))
    kept = F.filter(every, lambda t: ~t.isin(*noise))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def annual_fee(text: Column, percentage_points: bool = False) -> Column:
    """A monthly fee over twelve months, as a share; negative ones are null."""
    fee = comma_decimal(text) / (100 if percentage_points else 1)
    return F.when(fee >= 0, fee * 12)


def age_years(since: Column, at: Column) -> Column:
    """Years of 365.25 days; null where it begins later."""
    return F.when(since <= at, F.datediff(at, since) / 365.25)


def ticker(text: Column) -> Column:
    """Upper-cased; null unless letters, digits, dots and hyphens, twelve at most."""
    shown = F.upper(F.trim(text))
    return F.when(F.rlike(shown, F.lit(r"^[A-Z0-9][A-Z0-9.\-]{0,11}$")), shown)


def is_listed_ticker(text: Column) -> Column:
    """Local listing shapes: four letters or digits that start with a letter, then one or two digits and an optional F or B."""
    return F.coalesce(F.rlike(F.upper(F.trim(text)), F.lit(r"^[A-Z][A-Z0-9]{3}[0-9]{1,2}[FB]?$")), F.lit(False))


def market(text: Column) -> Column:
    shown = F.coalesce(F.trim(text), F.lit(""))
    return F.when(shown == "", "unknown").when(is_listed_ticker(shown), "b3").otherwise("foreign")


def token_class(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The first class one of whose tokens occurs in the folded text."""
    folded, out = fold(text), None
    for name, tokens in rules:
        hit = F.rlike(folded, F.lit("|".join(tokens)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)
