"""Coded fields: gender, grade, booleans, event and document types, cost."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from rollbook.functions.text import blank_to_null, col, strip, text
from rollbook.schemas import DEFAULT_GRADE, EVENT_TYPES, GRADES

# The words each form of a yes/no field accepts.
_TRUE = {
    "workbook": ("yes", "true"),
    "load": ("yes", "true", "1", "y"),
    "form": ("true", "1", "on", "yes"),
    "preview": ("true", "1", "yes", "on"),
    "model": ("true", "t", "1", "yes", "y", "on"),
}
_FALSE = {
    "workbook": ("no", "false"),
    "load": ("no", "false", "0", "n"),
    "preview": ("false", "0", "no", "off"),
    "model": ("false", "f", "0", "no", "n", "off"),
}
_MALE = ("m", "male", "man", "mr")
_FEMALE = ("f", "female", "woman", "ms", "mrs")


def gender(c: Column | str, variant: str = "labels") -> Column:
    """``labels`` knows a set of words and titles; ``initial`` looks at the first letter only."""
    value = F.lower(text(c))
    if variant == "initial":
        return F.when(value.startswith("m"), "Male").when(value.startswith("f"), "Female")
    value = F.regexp_replace(value, r"\.+$", "")
    return F.when(value.isin(*_MALE), "Male").when(value.isin(*_FEMALE), "Female")


def _whole(value: Column) -> Column:
    """Integer part of a finite double, null for anything else."""
    return F.when(F.abs(value) < 1e9, value).cast("int")


def grade(c: Column | str, source: str = "text", kind: Column | str | None = None) -> Column:
    """Grade as INT, 1 when it cannot be read.

    ``text`` takes any number from 0 up to below 3; ``cell`` takes numeric cells only and
    keeps their value; ``load`` takes whole numbers in text and numbers in 0, 1, 2.
    """
    if source == "cell":
        number = _whole(col(c).try_cast("double"))
        if kind is not None:
            number = F.when(col(kind) == "n", number)
        return F.coalesce(number, F.lit(DEFAULT_GRADE))
    number = _whole(F.when(strip(col(c).cast("string")) != "", col(c)).try_cast("double"))
    if source == "load":
        plain = strip(col(c).cast("string")).rlike(r"^[+-]?\d+$")
        number = F.when(plain if kind is None else plain | (col(kind) == "n"), number)
    return F.when(number.isin(*GRADES), number).otherwise(F.lit(DEFAULT_GRADE))


def grade_label(c: Column | str) -> Column:
    """Display label of a grade, null for an unknown one."""
    value = col(c).try_cast("int")
    label = F.when(F.lit(False), "")
    for code, name in GRADES.items():
        label = label.when(value == code, name)
    return label


def to_bool(c: Column | str, variant: str = "workbook") -> Column:
    """BOOLEAN of a yes/no field.  A ``form`` value that is not a yes is a no; blank is null."""
    value = F.lower(text(c))
    yes = value.isin(*_TRUE[variant])
    if variant == "form":
        return F.when(value != "", yes)
    return F.when(yes, True).when(value.isin(*_FALSE[variant]), False)


def event_type(c: Column | str, unknown: str | None = None) -> Column:
    """Event type as written, or in title case; ``unknown`` replaces other non-empty text.

    With ``unknown`` set the value must match as written, as an upload requires.
    """
    value = col(c)
    known = value.isin(*EVENT_TYPES)
    if unknown is not None:
        return F.when(known, value).when(value != "", F.lit(unknown))
    stripped = strip(value)
    titled = F.initcap(F.lower(stripped))
    return F.when(stripped.isin(*EVENT_TYPES), stripped).when(titled.isin(*EVENT_TYPES), titled)


def doc_type(c: Column | str, variant: str = "contains") -> Column:
    """Passport or ID Card.

    ``contains`` looks for ``pass`` anywhere, ``strict`` wants exactly ``Passport``, and
    ``load`` ignores case and leaves a blank field null.
    """
    value = text(c)
    if variant == "strict":
        return F.when(value == "Passport", "Passport").otherwise("ID Card")
    if variant == "load":
        return F.when(F.lower(value) == "passport", "Passport").when(value != "", "ID Card")
    key = F.regexp_replace(F.lower(value), "[^a-z0-9]+", " ")
    return F.when(key.contains("pass"), "Passport").otherwise("ID Card")


def enum_match(c: Column | str, values: Iterable[str]) -> Column:
    """The member of ``values`` that equals the text apart from case, else null."""
    lowered = F.lower(text(c))
    found = F.when(F.lit(False), "")
    for value in values:
        found = found.when(lowered == value.lower(), value)
    return found


def cost(c: Column | str) -> Column:
    """Cost as DOUBLE, null when the text is no finite number."""
    number = blank_to_null(c).try_cast("double")
    return F.when(~F.isnan(number), number)


def transport(table_value: Column, online_value: Column, has_travel_column: Column) -> Column:
    """The country table decides; the online table counts only where there is no Travel column."""
    own = F.nullif(table_value, F.lit(""))
    return F.coalesce(own, F.when(~has_travel_column, F.nullif(online_value, F.lit(""))), F.lit(""))


def load_defaults() -> dict[str, Column]:
    """Defaults of a bulk-loaded snapshot, by column."""
    transportation = F.coalesce(F.col("transportation"), F.lit("Other"))
    other = blank_to_null("transport_other")
    leaving = F.coalesce(F.nullif(F.col("traveling_from"), F.lit("")), F.lit("Unknown"))
    return {
        "transportation": transportation,
        "transport_other": F.when(
            (transportation == "Other") & other.isNull(), F.lit("Unspecified")
        ).otherwise(F.col("transport_other")),
        "travel_doc_type": F.coalesce(F.col("travel_doc_type"), F.lit("Passport")),
        "traveling_from": leaving,
        "returning_to": F.coalesce(F.nullif(F.col("returning_to"), F.lit("")), leaving),
    }


def audit_value(c: Column | str, kind: str = "text") -> Column:
    """Text of an old or new value in an audit entry: ISO for dates, JSON for arrays."""
    value = col(c)
    if kind == "date":
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    if kind == "array":
        return F.to_json(value)
    return value.cast("string")
