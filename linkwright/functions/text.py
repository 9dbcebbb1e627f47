"""Normalisation and tokens of names, addresses and countries, as Column functions.

Everything runs in the JVM but NFKC, for which Spark has no function; its Arrow UDF passes ASCII
texts through and is meant to run once, where the normalised table is built.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Legal forms and their canonical words.
LEGAL_FORMS = {
    "pvt": "private", "pvtltd": "private limited", "ltd": "limited", "ltee": "limited", "corp": "corporation", "inc": "incorporated", "co": "company", "pty": "proprietary",
}
# Abbreviations in addresses.
ADDRESS_FORMS = {
    "rd": "road", "st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "hwy": "highway", "pkwy": "parkway",
    "ste": "suite", "apt": "apartment", "bldg": "building", "fl": "floor", "no": "number", "num": "number",
}
# Words that are no blocking keys.
NAME_STOP = ["the", "a", "an", "of", "and", "for", "to", "at", "in", "on"]
ADDRESS_SKIP = [
    "road", "street", "avenue", "boulevard", "drive", "lane", "highway", "parkway", "suite", "apartment", "building", "floor", "number", "near", "opp", "opposite",
    "behind", "plot", "area", "sector", "phase", "block", "and", "the",
]
# Texts that are read as missing.
NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
MISSING_WORDS = ["", "nan", "none", "null", "na"]


@F.pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition."""
    return _nfkc(c)


def strip(c: Column) -> Column:
    """Without white space at both ends; any Unicode white space, not spaces alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def na_to_null(c: Column) -> Column:
    """Null for texts that stand for a missing value."""
    return F.when(~c.isin(NA_STRINGS), c)


def is_missing(c: Column) -> Column:
    """Null, or after stripping and lowering one of the words for nothing."""
    return c.isNull() | F.lower(strip(c)).isin(MISSING_WORDS)


def _collapsed(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def _mapped(c: Column, forms: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])
    return F.array_join(F.transform(F.split(c, " "), lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")


def normalize_name(c: Column, *, compat: bool = True) -> Column:
    """Canonical form of a business name; null and blank give ''.

    Stripped, NFKC (unless compat is False), lower case, `&` as the word and, other signs as spaces, spaces
    collapsed, legal forms spelled out word by word.
    """
    c = F.coalesce(c, F.lit(""))
    c = F.lower(nfkc(c) if compat else c)
    c = F.regexp_replace(c, r"(?U)\s*&\s*", " and ")
    return _mapped(_collapsed(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_\s]+", " ")), LEGAL_FORMS)


def normalize_address(c: Column, *, compat: bool = True) -> Column:
    """Canonical form of an address, abbreviations spelled out; null and blank give ''."""
    c = F.coalesce(c, F.lit(""))
    c = F.lower(nfkc(c) if compat else c)
    return _mapped(_collapsed(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_\s]+", " ")), ADDRESS_FORMS)


def normalize_country(c: Column, *, compat: bool = True) -> Column:
    """Stripped lower-case label; the set of labels is open. Null gives ''."""
    c = F.coalesce(c, F.lit(""))
    return F.lower(strip(nfkc(c) if compat else c))


def tokens(c: Column) -> Column:
    """Words of a normalised text; '' has none."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def name_tokens(c: Column) -> Column:
    """Distinct words of a normalised name that serve as keys: two characters or more, no function word."""
    return F.array_distinct(F.filter(tokens(c), lambda t: (F.length(t) >= 2) & ~t.isin(NAME_STOP)))


def numeric_tokens(*texts: Column) -> Column:
    """Distinct runs of decimal digits of the texts, in order."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(t, F.lit(r"(\p{Nd}+)"), F.lit(1)) for t in texts]))


def address_tokens(c: Column) -> Column:
    """Distinct words of a normalised address that serve as keys: numbers, and words of three
    characters or more that are no usual address word."""
    return F.array_distinct(F.filter(tokens(c), lambda t: t.rlike(r"^\p{Nd}+$") | ((F.length(t) >= 3) & ~t.isin(ADDRESS_SKIP))))


def id_list(c: Column) -> Column:
    """Entries of a comma-separated list, stripped, empty ones dropped; a missing list has none."""
    return F.when(is_missing(c), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(c, ","), strip), lambda x: x != ""))


def hashed(*parts: Column | str) -> Column:
    """First 32 bits of md5 over the parts joined by '|': the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")
