"""Expressions over company names, tickers, industry codes and notes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.dates import col

# Corporate suffix words that a normalised name drops.
SUFFIXES = (
    "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "COMPANIES", "LTD", "LIMITED", "PLC", "HOLDINGS?", "HLDGS?", "GROUP", "GRP", "THE", "LLC", "LP", "L P", "NV", "N V",
    "SA", "S A", "AG", "CL A", "CL B", "CLASS A", "CLASS B", "NEW", "OLD", "DE", "TRUST", "TR", "INTERNATIONAL", "INTL", "ENTERPRISES?", "INDUSTRIES", "INDS?",
)
# Words that say nothing about whose name it is.
NAME_STOP = ("inc", "incorporated", "corp", "corporation", "co", "company", "companies", "ltd", "limited", "plc", "holdings", "holding", "group", "the", "and", "of", "class", "new")
# Industry code ranges and their sectors; the first range that holds a code decides.
SIC_RANGES = (
    (1520, 1540, "Consumer Discretionary"), (2830, 2836, "Health Care"), (3021, 3021, "Consumer Discretionary"), (3826, 3826, "Health Care"), (4400, 4499, "Consumer Discretionary"),
    (4700, 4799, "Consumer Discretionary"), (4922, 4925, "Energy"), (5013, 5013, "Consumer Discretionary"), (5122, 5122, "Health Care"), (5961, 5961, "Consumer Discretionary"),
    (8731, 8731, "Health Care"), (2840, 2844, "Consumer Staples"), (3570, 3579, "Information Technology"), (3660, 3679, "Information Technology"), (3711, 3716, "Consumer Discretionary"),
    (3751, 3751, "Consumer Discretionary"), (3812, 3812, "Industrials"), (3821, 3829, "Information Technology"), (3840, 3851, "Health Care"), (5047, 5047, "Health Care"),
    (5140, 5149, "Consumer Staples"), (5331, 5331, "Consumer Staples"), (5400, 5499, "Consumer Staples"), (5912, 5912, "Consumer Staples"), (6324, 6324, "Health Care"),
    (6500, 6599, "Real Estate"), (6798, 6798, "Real Estate"), (7310, 7319, "Communication Services"), (7370, 7379, "Information Technology"), (7810, 7841, "Communication Services"),
    (2711, 2741, "Communication Services"), (1300, 1399, "Energy"), (2900, 2999, "Energy"), (1000, 1499, "Materials"), (2600, 2699, "Materials"), (2800, 2899, "Materials"),
    (3000, 3099, "Materials"), (3200, 3399, "Materials"), (1500, 1799, "Industrials"), (3400, 3599, "Industrials"), (3600, 3699, "Industrials"), (3700, 3799, "Industrials"),
    (3800, 3899, "Industrials"), (4000, 4799, "Industrials"), (5000, 5199, "Industrials"), (7300, 7399, "Industrials"), (8700, 8799, "Industrials"), (2000, 2199, "Consumer Staples"),
    (2200, 2599, "Consumer Discretionary"), (3900, 3999, "Consumer Discretionary"), (5200, 5999, "Consumer Discretionary"), (7000, 7299, "Consumer Discretionary"),
    (7500, 7999, "Consumer Discretionary"), (8000, 8099, "Health Care"), (6000, 6799, "Financials"), (4800, 4899, "Communication Services"), (4900, 4999, "Utilities"), (100, 999, "Materials"),
)
# How a diagnostic run's note begins.
DIAGNOSTIC_NOTES = ("diagnostic", "sensitivity", "french replication")
# The fields that make two runs the same specification.
KEY_FIELDS = ("factor", "signal", "weighting", "cost_bps", "lag_days", "rebalance", "holding_months", "winsor_lo", "winsor_hi", "n_deciles", "sector_neutral", "start", "end", "variant")


def clean_ticker(text: Column | str) -> Column:
    """The leading ticker token; null if the text does not begin with one."""
    return F.nullif(F.regexp_extract(col(text), r"^([A-Z][A-Z0-9.\-]{0,9})", 1), F.lit(""))


def dashed(ticker: Column | str) -> Column:
    return F.replace(col(ticker), F.lit("."), F.lit("-"))


def normalise_name(name: Column | str) -> Column:
    """Upper case, & spelled out, punctuation and corporate suffixes gone, single spaces; "" for null."""
    plain = F.regexp_replace(F.replace(F.upper(F.coalesce(col(name), F.lit(""))), F.lit("&"), F.lit(" AND ")), "[^A-Z0-9 ]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, rf"\b({'|'.join(SUFFIXES)})\b", " "), r"\s+", " "))


def name_tokens(name: Column | str) -> Column:
    """Distinct lower-case words of a name without the ones that say nothing."""
    words = F.regexp_extract_all(F.replace(F.lower(F.coalesce(col(name), F.lit(""))), F.lit("&"), F.lit(" and ")), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, NAME_STOP)))


def name_overlap(a: Column | str, b: Column | str) -> Column:
    """Shared tokens over those of the smaller name; null if either has none."""
    x, y = name_tokens(a), name_tokens(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)))


def is_real_name(name: Column | str) -> Column:
    return F.coalesce(col(name).rlike("[A-Za-z]"), F.lit(False))


def sic_to_sector(sic: Column | str) -> Column:
    out, code = None, col(sic)
    for low, high, sector in SIC_RANGES:
        out = (F if out is None else out).when(code.between(low, high), F.lit(sector))
    return out.otherwise(F.lit("Other"))


def spec_kind(note: Column | str) -> Column:
    return F.when(F.lower(F.trim(F.coalesce(col(note), F.lit("")))).rlike(f"^({'|'.join(DIAGNOSTIC_NOTES)})"), "diagnostic").otherwise("candidate")


def sector_neutral_of(note: Column | str) -> Column:
    return F.when(F.contains(F.coalesce(col(note), F.lit("")), F.lit("no-sector")), "0").otherwise("1")


def variant_of(note: Column | str, signal: Column | str) -> Column:
    n, s = F.lower(F.trim(F.coalesce(col(note), F.lit("")))), F.coalesce(col(signal), F.lit(""))
    text = F.when(F.contains(n, F.lit("jaccard")), "jaccard").otherwise("cosine")
    return F.when(F.startswith(n, F.lit("sensitivity terminal")), "terminal").when(F.contains(s, F.lit("doc_similarity")), text).otherwise("")


def one_spelling(value: object) -> str:
    """"10" and "10.0" alike; anything that is no number as it is."""
    text = "" if value is None else str(value).strip()
    try:
        return f"{float(text):g}"
    except ValueError:
        return text


def spec_key(row: dict[str, object]) -> str:
    """Twelve hex digits that name a specification."""
    return hashlib.sha256("\x1f".join(one_spelling(row.get(k)) for k in KEY_FIELDS).encode()).hexdigest()[:12]


def one_spelling_column(value: Column) -> Column:
    """``one_spelling`` of a column: a number with six significant digits, without zeros at its end."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    d = text.try_cast("double")
    low = F.floor(F.log10(F.abs(d)))
    held = F.round(d / F.pow(F.lit(10.0), low), 5)  # one digit before the point
    power = low + F.when(F.abs(held) >= 10, 1).otherwise(0)
    digits = lambda x: F.regexp_replace(F.regexp_replace(x.cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    exponent = F.concat(digits(held / F.when(F.abs(held) >= 10, 10).otherwise(1)), F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    plain = digits(F.round(held * F.pow(F.lit(10.0), low), 10))
    number = F.when(d == 0, F.when(F.startswith(text, F.lit("-")), "-0").otherwise("0")).when((power >= -4) & (power < 6), plain).otherwise(exponent)
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), text).otherwise(number)


def spec_key_of_columns() -> Column:
    """``spec_key`` over columns, however their numbers are spelled."""
    joined = F.concat_ws("\x1f", *(one_spelling_column(F.col(k)) for k in KEY_FIELDS))
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 12)


def spec_key_column() -> Column:
    """``spec_key`` over columns that are spelled one way already."""
    joined = F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in KEY_FIELDS))
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 12)
