"""Whitespace, accent folding and list splitting."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Unicode whitespace plus the four ASCII separators that count as blank text.
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_WS = r"[\s\x1c-\x1f]"
#: Runs that change when whitespace is collapsed; a single space between words is left alone.
WS_RUN = rf"(?U)[{_WS}&&[^ ]]{_WS}*| {_WS}+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Drop leading and trailing whitespace of any kind; null stays null."""
    return F.btrim(col(c), F.lit(WS_CHARS))


def text(c: Column | str) -> Column:
    """Stripped text, null as the empty string."""
    return strip(F.coalesce(col(c).cast("string"), F.lit("")))


def norm_ws(c: Column | str) -> Column:
    """Trim and collapse whitespace; null becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), WS_RUN, " "))


def blank_to_null(c: Column | str) -> Column:
    """Stripped text; blank, null and the text of a missing number become null."""
    value = col(c).cast("string")
    stripped = strip(value)
    kept = F.when(stripped != "", stripped)
    if not isinstance(c, str):
        return kept
    # A column, cheap to look at again: text that begins and ends with a visible ASCII character stays as it is.
    neat = (value >= "!") & (value < "\x7f") & F.substring(value, -1, 1).between("!", "~")
    return F.when(neat, value).otherwise(kept)


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """``translate`` arguments that strip accents, derived from the Unicode decompositions.

    Every character whose decomposition minus combining marks is one character maps to
    that character; combining marks come last and have no counterpart, so they are dropped.
    Hangul syllables decompose into several letters and stay as they are.
    """
    source, target, dropped = [], [], []
    for point in range(0x80, 0x2FA20):
        char = chr(point)
        if 0xD800 <= point < 0xE000:
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", char) if not unicodedata.combining(x))
        if not base:
            dropped.append(char)
        elif base != char and len(base) == 1:
            source.append(char)
            target.append(base)
    return "".join(source + dropped), "".join(target)


def strip_accents(c: Column | str) -> Column:
    """Remove accents inside the JVM, so that the expression stays in generated code."""
    source, target = _fold_table()
    return F.translate(col(c), source, target)


def canon(c: Column | str) -> Column:
    """Lower-case text without accents; null becomes the empty string."""
    return F.lower(strip_accents(F.coalesce(col(c), F.lit(""))))


def norm_table_name(c: Column | str) -> Column:
    """Key of a table name: ASCII letters and digits, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^0-9a-zA-Z]+", ""))


def _clean_items(items: Column) -> Column:
    return F.filter(F.transform(items, strip), lambda x: x != "")


def split_multi(c: Column | str) -> Column:
    """Items between ``;`` and ``,`` without blanks."""
    return _clean_items(F.split(F.coalesce(col(c), F.lit("")), "[;,]"))


def distinct_items(items: Column | str) -> Column:
    """Distinct items of an array in order of first appearance."""
    return F.array_distinct(col(items))


def citizenships(c: Column | str, is_array: bool = False) -> Column:
    """Trimmed distinct items of a list or delimited text; an empty result is null."""
    source = F.filter(col(c), lambda x: x.isNotNull()) if is_array else F.split(col(c), "[;,]")
    items = distinct_items(_clean_items(source))
    return F.get(F.filter(F.array(items), lambda kept: F.size(kept) > 0), F.lit(0))


def same_items(a: Column | str, b: Column | str) -> Column:
    """True when two arrays hold the same items, whatever their order; null equals null."""
    return F.array_sort(col(a)).eqNullSafe(F.array_sort(col(b)))


def first_non_blank(*cs: Column | str) -> Column:
    """First of several columns that holds text."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def fill_missing(target: Column | str, source: Column | str, phone: bool = False) -> Column:
    """Keep a non-empty target, else take a non-empty source; a phone must normalise."""
    from rollbook.functions.phones import normalize_phone

    kept = F.nullif(col(target), F.lit(""))
    found = normalize_phone(source) if phone else F.nullif(col(source), F.lit(""))
    return F.coalesce(kept, found, col(target))


def split_entry(c: Column | str) -> Column:
    """Name and position of a ledger entry, split at ``,``, then `` – ``, then `` - ``."""
    entry = col(c)

    def cut(separator: str) -> Column:
        parts = F.split(entry, separator, 2)
        return F.struct(strip(parts[0]).alias("name"), strip(parts[1]).alias("position"))

    whole = F.struct(strip(entry).alias("name"), F.lit("").alias("position"))
    return (
        F.when(entry.contains(","), cut(","))
        .when(entry.contains(" – "), cut(" – "))
        .when(entry.contains(" - "), cut(" - "))
        .otherwise(whole)
    )


def split_location(c: Column | str) -> Column:
    """Place and country hint of a location.

    A trailing code (letter and three digits) is the hint; otherwise the text after the
    first of ``,``, `` - ``, `` / `` and ``\\`` that occurs.
    """
    value = text(c)
    coded = r"(?U)^([^\n]*?)[\s,;\-]*([A-Za-z]\d{3})$"
    code, place = F.regexp_extract(value, coded, 2), F.regexp_extract(value, coded, 1)

    def pair(first: Column, second: Column) -> Column:
        return F.struct(first.alias("place"), second.alias("country_hint"))

    def cut(separator: str, pattern: str) -> Column:
        parts = F.split(value, pattern, 2)
        return pair(strip(parts[0]), blank_to_null(parts[1]))

    return (
        F.when(value == "", pair(F.lit(""), F.lit(None).cast("string")))
        .when(code != "", pair(F.regexp_replace(place, r"^[ ,;\-\t]+|[ ,;\-\t]+$", ""), F.upper(code)))
        .when(value.contains(","), cut(",", ","))
        .when(value.contains(" - "), cut(" - ", " - "))
        .when(value.contains(" / "), cut(" / ", " / "))
        .when(value.contains("\\"), cut("\\", r"\\"))
        .otherwise(pair(value, F.lit(None).cast("string")))
    )


def split_multi_country(c: Column | str) -> Column:
    """Country mentions in free text: ``;``, ``,``, ``/``, ``and`` and the Croatian ``i`` separate them."""
    value = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?Ui)\bR\.\s*", "R ")
    value = F.replace(value, F.lit("&"), F.lit(" and "))
    return _clean_items(F.split(value, r"(?Ui)[;,/]|\band\b|\bi\b"))
