"""Normalization and parsing of clinical strings as column expressions.

Only Unicode normal forms need Python; they run as Arrow-batched functions.  Offsets
are 0-based code points, half-open, always on the raw text.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Units that stay upper case in lexical text.
UNITS = ["mg", "mcg", "g", "kg", "ml", "l", "meq", "mmol", "unit", "units", "hr"]
# One code reference of the disease classification.
CODE_REFERENCE = r"[A-Z]\d{2}(?:(?:\.[0-9A-Z]+)|(?:\.\-))?[†*]?"
# First and last code of each chapter of the disease classification.
CHAPTERS = [
    ("I", "A00", "B99"), ("II", "C00", "D48"), ("III", "D50", "D89"), ("IV", "E00", "E90"), ("V", "F00", "F99"), ("VI", "G00", "G99"),
    ("VII", "H00", "H59"), ("VIII", "H60", "H95"), ("IX", "I00", "I99"), ("X", "J00", "J99"), ("XI", "K00", "K93"), ("XII", "L00", "L99"),
    ("XIII", "M00", "M99"), ("XIV", "N00", "N99"), ("XV", "O00", "O99"), ("XVI", "P00", "P96"), ("XVII", "Q00", "Q99"), ("XVIII", "R00", "R99"),
    ("XIX", "S00", "T98"), ("XX", "V01", "Y98"), ("XXI", "Z00", "Z99"), ("XXII", "U00", "U99"),
]


def let(c: Column, fn) -> Column:
    """``fn`` of ``c``, which is computed once however often ``fn`` names it, inside lambdas too."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def _form(kind: str):
    @F.pandas_udf(T.StringType())
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(kind, x))

    return of


nfc, nfkc = _form("NFC"), _form("NFKC")


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


def _folding() -> tuple[str, str]:
    """Precomposed Latin letters whose decomposition is one ASCII letter and marks, and those letters."""
    pairs = [("đ", "d"), ("Đ", "D")]
    for cp in range(0xC0, 0x1F00):
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and d[0].isascii() and d[0].isalpha() and all(unicodedata.category(x) == "Mn" for x in d[1:]):
            pairs.append((chr(cp), d[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _folding()


def fold_marks(c: Column) -> Column:
    """Latin letters without their marks, the barred d as d; other combining marks go."""
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{Mn}", "")


def collapse(c: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    return collapse(nfc(c))


def normalized_key(c: Column) -> Column:
    return casefold(clean_text(c))


def lexical_text(c: Column) -> Column:
    """Compatibility form, case folded, then each unit in upper case at word borders."""
    out = casefold(collapse(nfkc(c)))
    for u in sorted(UNITS, key=len, reverse=True):
        out = F.regexp_replace(out, rf"(?U)\b{u}\b", u.upper())
    return out


def without_references(c: Column) -> Column:
    """Trailing parenthesised code references go, all of them; coding marks and private characters too."""
    one = rf"\s*\(\s*{CODE_REFERENCE}(?:\s*[,;]\s*{CODE_REFERENCE})*\s*\)"
    out = F.regexp_replace(collapse(c), rf"(?i)(?:{one})+\s*$", "")
    out = F.replace(F.replace(out, F.lit(""), F.lit("alpha")), F.lit(""), F.lit("beta"))
    return collapse(F.regexp_replace(out, "[?†*]", ""))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def reserved_code(c: Column) -> Column:
    return c.rlike(r"(?i)^U(?:1[3-9]|[2-4][0-9])(?:\.|$)")


def chapter_of(code: Column) -> Column:
    """Chapter by the three-character head of a code."""
    head = F.upper(F.substring(code, 1, 3))
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(CHAPTERS):
        out = F.when(head.between(lo, hi), name).otherwise(out)
    return out


def digest_id(prefix: str, *columns: Column) -> Column:
    """``prefix`` and 16 hexadecimal digits of the SHA-256 of the parts, joined by the unit separator."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *columns).cast("binary"), 256), 1, 16))


def strengths(c: Column) -> Column:
    """Every ``number unit`` of a mention as ``array<struct<value double, unit string>>``; decimal commas are points."""
    found = F.regexp_extract_all(F.regexp_replace(F.lower(c), r"(\d),(\d)", "$1.$2"), F.lit(r"(\d+(?:\.\d+)?)\s*(mcg|mg|gm|g|meq|iu|unit)\b"), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, r"^(\d+(?:\.\d+)?)", 1).cast("double").alias("value"), F.regexp_extract(m, r"([a-z]+)$", 1).alias("unit")))


def milligrams(value: Column, unit: Column) -> Column:
    """Mass units in milligrams; other units as they are."""
    return value * F.when(unit == "mcg", 0.001).when(unit.isin("g", "gm"), 1000.0).otherwise(1.0)


# Frequency phrases with their code and hours between doses.
FREQUENCIES = {"once daily": ("QD", 24), "twice daily": ("BID", 12), "daily": ("QD", 24), "qd": ("QD", 24), "qid": ("QID", 6), "tid": ("TID", 8), "bid": ("BID", 12), "qhs": ("QHS", 24), "qam": ("QAM", 24)}


def frequency(c: Column) -> Column:
    """``struct<code, hours>`` of a dosing frequency: a phrase, the longest first, or else every so many hours."""
    t = F.lower(c)
    every = F.regexp_extract(t, r"\bq(\d+)h\b", 1)
    code, hours = F.when(every != "", F.concat(F.lit("Q"), every, F.lit("H"))), F.when(every != "", every.cast("int"))
    for phrase in sorted(FREQUENCIES, key=len):
        name, h = FREQUENCIES[phrase]
        hit = t.rlike(rf"\b{phrase}\b")
        code, hours = F.when(hit, name).otherwise(code), F.when(hit, h).otherwise(hours)
    return F.struct(code.alias("code"), hours.alias("hours"))
