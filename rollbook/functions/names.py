"""Person names: lookup keys, variants and display form."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from rollbook.functions.text import WS_CHARS, canon, col, let, norm_ws, strip

VARIANT = "struct<first:string,middle:string,last:string>"


def _before_after_comma(s: Column) -> tuple[Column, Column]:
    parts = F.split(s, ",", 2)
    return strip(parts[0]), strip(parts[1])


def _first_name_first(s: Column) -> Column:
    last, first = _before_after_comma(s)
    return F.when(s.contains(","), strip(F.concat_ws(" ", first, last))).otherwise(s)


def _last_word(s: Column) -> Column:
    return F.substring_index(s, " ", -1)


def _without_last_word(s: Column) -> Column:
    """Everything before the last space, without that space."""
    return F.when(s.contains(" "), F.substring(s, F.lit(1), F.length(s) - F.length(_last_word(s)) - 1)).otherwise("")


def name_key(last: Column | str, first_middle: Column | str) -> Column:
    """Lookup key ``last|first middle``."""
    return F.trim(F.concat_ws("|", canon(last), canon(first_middle)))


def name_key_from_raw(c: Column | str) -> Column:
    """Lookup key of ``Last, First`` or ``First Last`` text; blank text gives an empty key."""

    def key(s: Column) -> Column:
        last, first = _before_after_comma(s)
        comma = s.contains(",")
        built = name_key(
            F.when(comma, last).otherwise(_last_word(s)), F.when(comma, first).otherwise(_without_last_word(s))
        )
        return F.when(s == "", F.lit("")).otherwise(built)

    return let(norm_ws(c), key)


def name_variants(c: Column | str) -> Column:
    """Array of possible ``(first, middle, last)`` readings, shortest surname first.

    A surname takes one to three of the last words and always leaves a first name.
    """

    def readings(words: Column) -> Column:
        n = F.size(words)

        def reading(i: Column) -> Column:
            return F.struct(
                F.get(words, F.lit(0)).alias("first"),
                F.array_join(F.slice(words, F.lit(2), n - i - 1), " ").alias("middle"),
                F.array_join(F.slice(words, n - i + 1, i), " ").alias("last"),
            )

        single = F.struct(F.get(words, F.lit(0)).alias("first"), F.lit("").alias("middle"), F.lit("").alias("last"))
        return (
            F.when(n == 0, F.array().cast(f"array<{VARIANT}>"))
            .when(n == 1, F.array(single))
            .otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(3), n - 1))), reading))
        )

    ordered = let(norm_ws(c), lambda s: canon(_first_name_first(s)))
    return let(F.filter(F.split(ordered, " "), lambda w: w != ""), readings)


def _capital_last(s: Column) -> Column:
    """The last word in capitals, where there is more than one."""
    last = _last_word(s)
    shown = F.concat(F.substring(s, F.lit(1), F.length(s) - F.length(last)), F.upper(last))
    return F.when(s.contains(" "), shown).otherwise(s)


def _unless_plain(c: Column | str, comma: bool, body: Callable[[Column], Column]) -> Column:
    """``body`` of the stripped name; words with single plain spaces only need their last one in capitals, which is cheap."""
    odd = f"[{re.escape(WS_CHARS.replace(' ', ''))}{',' if comma else ''}]|  "
    return let(strip(F.coalesce(col(c), F.lit(""))), lambda s: F.when(s.rlike(odd), body(s)).otherwise(_capital_last(s)))


def _normalized(raw: Column, comma: bool) -> Column:
    """The normalised form of a stripped name."""

    def normalized(s: Column) -> Column:
        capitals = (s == F.upper(s)) & (s != F.lower(s))
        last = F.regexp_extract(s, r"(?U)(\S+)$", 1)
        first = norm_ws(F.substring(s, F.lit(1), F.length(s) - F.length(last)))
        return F.when(capitals | (first == ""), s).otherwise(F.concat_ws(" ", first, F.upper(last)))

    return let(let(raw, _first_name_first) if comma else raw, normalized)


def normalize_name(c: Column | str, comma: bool = True) -> Column:
    """``First Middle LAST``; text in capitals and single words stay as they are.

    ``comma=False`` is the rule of the bulk loader, which does not reorder ``Last, First``.
    """
    return _unless_plain(c, comma, lambda s: _normalized(s, comma))


def display_name(c: Column | str, comma: bool = True) -> Column:
    """Normalised name with its last word in capitals."""

    return _unless_plain(c, comma, lambda s: let(_normalized(s, comma), _capital_last))


def base_name(c: Column | str) -> Column:
    """Display name of an attendee cell, whose whitespace is collapsed first."""
    return display_name(let(norm_ws(c), _first_name_first))
