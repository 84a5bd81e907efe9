"""Standardising column expressions: text, names of firms, contacts, postcodes, dates.

All are built-in Spark expressions, so they stay inside whole-stage code
generation; only folding of letters beyond ASCII has an Arrow function, which
plain ASCII values never reach (see ``fold``). Null gives null everywhere, and a
value that cannot be standardised gives null.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
#: Letters that Unicode decomposition leaves whole, and what stands for them.
LETTERS = {"ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}
#: Legal forms by spelling, and the canonical form of each.
LEGAL_FORMS = {
    "ltd": "ltd", "limited": "ltd", "inc": "inc", "incorporated": "inc", "llc": "llc", "plc": "plc",
    "corp": "corp", "corporation": "corp", "co": "co", "company": "co", "gmbh": "gmbh", "ag": "ag",
    "sa": "sa", "sas": "sas", "bv": "bv", "nv": "nv", "pty": "pty", "proprietary": "pty", "srl": "srl",
    "oy": "oy", "ab": "ab",
}
STOP_WORDS = ("the", "and", "of")
#: Values that say nothing, in lower case; values of punctuation alone, or of one repeated x, say nothing either.
FILLERS = ("n/a", "na", "nil", "none", "null", "unknown", "not known", "not available", "tbc", "tba", "xxx", "no email", "no phone", "none@none")
PLACEHOLDER_DATE = "1900-01-01"
#: Sources in which the first of January stands for an unknown day.
JANUARY_SOURCES = ("student_records",)
DAY_FIRST_SOURCES = ("student_records",)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


@F.pandas_udf(StringType())
def _compatible(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def clean_text(c: Column | str, python: bool = True) -> Column:
    """Compatibility forms made plain, control characters out, white space collapsed and stripped.

    Plain ASCII never reaches Python. Without ``python``, as inside arrays, compatibility forms stay.
    """
    c = _col(c)
    if python:
        c = F.when(c.rlike(r"[^\x00-\x7F]"), _compatible(c)).otherwise(c)
    c = F.regexp_replace(c, r"[\t\n\x0B\f\r]", " ")
    c = F.regexp_replace(c, r"[\p{Cc}\p{Cf}]", "")
    return empty_to_null(F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " ")))


def fold_text(text: str | None) -> str | None:
    """Lower case without marks, punctuation and symbols; the plain form of what ``fold`` computes."""
    if text is None:
        return None
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    text = "".join(LETTERS.get(ch, ch) for ch in text)
    out = []
    for ch in text:
        kind = unicodedata.category(ch)[0]
        if kind != "M":
            out.append(" " if kind in "PSZC" else ch)
    return " ".join("".join(out).split()) or None


@F.pandas_udf(StringType())
def _fold_any(values: pd.Series) -> pd.Series:
    return values.map(fold_text, na_action="ignore")


#: Latin letters whose folding is a single fixed letter; values made of these and ASCII need no Python.
_ACCENTED = "".join(
    ch for ch in map(chr, range(0xC0, 0x180)) if len(f := fold_text(ch) or "") == 1 and f.isascii()
)
_PLAIN = "".join(fold_text(ch) for ch in _ACCENTED)
_LONG = {ch: f for ch in map(chr, range(0xC0, 0x180)) if (f := fold_text(ch)) and len(f) > 1 and f.isascii()}


def fold(c: Column | str, python: bool = True) -> Column:
    """Case-folded text without accents, punctuation and symbols.

    Latin letters up to U+017F fold by built-in functions. With ``python``,
    values that hold anything further go through Unicode decomposition in an
    Arrow function; without, such characters become spaces where they are no letters.
    """
    c = _col(c)
    quick = F.translate(c, _ACCENTED, _PLAIN)
    for letter, plain in _LONG.items():
        quick = F.replace(quick, F.lit(letter), F.lit(plain))
    quick = F.regexp_replace(F.lower(quick), r"\p{M}+", "")
    quick = empty_to_null(F.trim(F.regexp_replace(quick, r"[\p{P}\p{S}\p{Z}\p{C}]+", " ")))
    if not python:
        return quick
    return F.when(c.rlike("[^\\x00-\\x7FÀ-ſ]"), _fold_any(c)).otherwise(quick)


def says_something(c: Column | str) -> Column:
    """False for null, blank and filler values in any case and spacing, true for the rest."""
    c = F.lower(F.trim(F.regexp_replace(_col(c), r"[\s\p{Z}\p{Cf}]+", " ")))
    return F.coalesce(c.rlike(r"[\p{L}\p{N}]") & ~c.rlike("^x+$") & ~c.isin(*FILLERS), F.lit(False))


def org_core(c: Column | str) -> Column:
    """The name of a firm without trailing legal forms and stop words, but never to nothing."""
    text = fold(F.regexp_replace(F.regexp_replace(_col(c), "&", " and "), r"\.", ""), python=False)
    forms = "|".join(LEGAL_FORMS)
    bare = F.regexp_replace(text, f"(?<=\\S)( (?:{forms}))+$", "")
    fewer = F.array_except(F.split(bare, " "), F.array(*map(F.lit, STOP_WORDS)))
    kept = F.filter(F.split(bare, " "), lambda w: ~w.isin(*STOP_WORDS))
    return F.when(F.size(fewer) > 0, F.array_join(kept, " ")).otherwise(bare)


def org_legal(c: Column | str) -> Column:
    """The canonical legal form at the end of a firm's name, or null."""
    text = fold(F.regexp_replace(F.regexp_replace(_col(c), "&", " and "), r"\.", ""), python=False)
    last = F.regexp_extract(text, " (" + "|".join(LEGAL_FORMS) + ")$", 1)
    return F.element_at(F.create_map(*(F.lit(x) for kv in LEGAL_FORMS.items() for x in kv)), empty_to_null(last))


def phone_e164(c: Column | str, country_code: str = "999") -> Column:
    """+ and 8 to 15 digits; national forms get the country code."""
    c = F.trim(_col(c))
    opened = F.when(c.startswith("+"), F.regexp_replace(c, r"\(0\)", "")).otherwise(c)
    digits = F.regexp_replace(opened, r"\D", "")
    full = (
        F.when(opened.startswith("+"), digits)
        .when(digits.startswith("00"), F.substring(digits, 3, 40))
        .when(digits.startswith("0"), F.concat(F.lit(country_code), F.substring(digits, 2, 40)))
        .otherwise(F.concat(F.lit(country_code), digits))
    )
    return F.when((digits != "") & F.length(full).between(8, 15), F.concat(F.lit("+"), full))


def email(c: Column | str) -> Column:
    c = F.lower(F.trim(_col(c)))
    return F.when(c.rlike(r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"), c)


def postcode(c: Column | str) -> Column:
    return empty_to_null(F.regexp_replace(F.upper(_col(c)), r"[\s\-]", ""))


def url_domain(c: Column | str) -> Column:
    c = F.lower(F.trim(_col(c)))
    c = F.regexp_replace(c, r"^[a-z][a-z0-9+.\-]*://", "")
    c = F.regexp_replace(c, r"[/?#].*$", "")
    c = F.regexp_replace(F.regexp_replace(c, r"^.*@", ""), r":\d*$", "")
    return empty_to_null(F.regexp_replace(F.regexp_replace(c, r"^\.+|\.+$", ""), r"^www\.", ""))


def code(c: Column | str) -> Column:
    return F.upper(clean_text(c))


def iso_date(c: Column | str, day_first: Column | bool = False) -> Column:
    """yyyy-MM-dd of a whole date in any accepted spelling; null where it names no day of the calendar.

    Accepted: ISO with or without time, yyyymmdd, y/m/d, d.m.y; d/m/y and d-m-y
    where the source writes the day first, m/d/y and m-d-y elsewhere.
    """
    c = F.trim(_col(c))
    first = F.lit(day_first) if isinstance(day_first, bool) else day_first
    ymd = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[T ].*)?$"
    packed, dmy, dots = r"^(\d{4})(\d{2})(\d{2})$", r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"

    def part(rx: str, k: int) -> Column:
        return F.regexp_extract(c, rx, k)

    def join(rx: str, y: int, m: int, d: int) -> Column:
        return F.concat_ws("-", part(rx, y), F.lpad(part(rx, m), 2, "0"), F.lpad(part(rx, d), 2, "0"))

    text = (
        F.when(c.rlike(ymd), join(ymd, 1, 2, 3))
        .when(c.rlike(packed), join(packed, 1, 2, 3))
        .when(c.rlike(dots), join(dots, 3, 2, 1))
        .when(c.rlike(dmy) & first, join(dmy, 3, 2, 1))
        .when(c.rlike(dmy), join(dmy, 3, 1, 2))
    )
    return F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd")


def is_placeholder_date(iso: Column, source: Column) -> Column:
    """Whether a whole date stands for an unknown one in its source."""
    january = source.isin(*JANUARY_SOURCES) & iso.endswith("-01-01")
    return F.coalesce((iso == PLACEHOLDER_DATE) | january, F.lit(False))
