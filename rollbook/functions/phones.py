"""Phone numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rollbook.functions.text import col, text


#: Numbers of digits alone, with or without their prefix; they need no further cleaning.
_PLAIN = r"^(?:00|\+|(?!00))\d{8,15}\z"


def normalize_phone(c: Column | str) -> Column:
    """``+`` and 8 to 15 digits, or null.  A leading ``00`` stands for ``+``."""
    raw, whole = col(c).cast("string"), text(c)
    plain = (
        F.when(raw.startswith("+"), raw)
        .when(raw.startswith("00"), F.concat(F.lit("+"), F.substring(raw, 3, 15)))
        .otherwise(F.concat(F.lit("+"), raw))
    )
    value = F.regexp_replace(F.regexp_replace(whole, "^00", ""), r"^\+", "")
    digits = F.regexp_replace(value, r"(?U)\D", "")
    cleaned = F.when(F.length(digits).between(8, 15), F.concat(F.lit("+"), digits))
    return F.when(raw.rlike(_PLAIN), plain).otherwise(cleaned)
