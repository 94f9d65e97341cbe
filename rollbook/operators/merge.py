"""Newest-wins and last-wins merges, unions of arrays and the two workbook lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rollbook.functions.enums import gender
from rollbook.functions.names import display_name, name_key, name_key_from_raw
from rollbook.functions.phones import normalize_phone
from rollbook.functions.text import norm_ws, split_multi, text


def newest_wins(
    rows: DataFrame,
    keys: Sequence[str],
    date: str,
    order: str,
    newest: Sequence[str],
    first: Sequence[str] = (),
) -> DataFrame:
    """One row per key: ``newest`` columns of the latest date, ``first`` columns of the first row.

    Of equal dates the earliest row counts and a missing date is the oldest.  Both picks are
    aggregates, so a hot key is reduced on every task before the shuffle.
    """
    age = F.struct(F.col(date).isNotNull(), F.col(date), -F.col(order))
    picks = [F.max_by(F.struct(*newest), age).alias("_new")]
    shown = [*keys, "_new.*"]
    if first:
        picks.append(F.min_by(F.struct(*first), F.col(order)).alias("_first"))
        shown.append("_first.*")
    return rows.groupBy(*keys).agg(*picks).select(*shown)


def union_arrays(rows: DataFrame, keys: Sequence[str], items: str, order: str) -> DataFrame:
    """Distinct items of all arrays of a key, in order of first appearance.

    Items are reduced to one row per key and item before any array is built, so an array
    is as long as the number of different items.
    """
    single = rows.select(*keys, order, F.posexplode(items).alias("_pos", "_item"))
    seen = single.groupBy(*keys, "_item").agg(F.min(F.struct(order, "_pos")).alias("_seen"))
    ordered = F.array_sort(F.collect_list(F.struct("_seen", "_item")))
    return seen.groupBy(*keys).agg(ordered.alias("_items")).select(*keys, F.col("_items._item").alias(items))


def last_non_blank(
    rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Per key and column the last value that is neither null nor blank text."""
    kinds = dict(rows.dtypes)
    columns = columns or [c for c in rows.columns if c not in (*keys, order)]

    def last(name: str) -> Column:
        filled = F.col(name).isNotNull()
        if kinds[name] == "string":
            filled = filled & (text(name) != "")
        return F.max_by(F.col(name), F.when(filled, F.col(order))).alias(name)

    return rows.groupBy(*keys).agg(*[last(c) for c in columns])


def last_row(rows: DataFrame, keys: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """The last row of every key."""
    order = [order] if isinstance(order, str) else list(order)
    others = [c for c in rows.columns if c not in keys]
    if any("map<" in kind or "variant" in kind for _, kind in rows.dtypes):  # these cannot be compared
        best = F.max_by(F.struct(*others), F.struct(*order)).alias("_last")
    else:
        # The order comes first in the row itself, so it does not travel twice.
        best = F.max(F.struct(*order, *[c for c in others if c not in order])).alias("_last")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col("_last").getField(c).alias(c) for c in others])


def positions_lookup(rows: DataFrame, scope: Sequence[str] = ("path",), order: str = "row_no") -> DataFrame:
    """Position, phone and email by name key; the last row of a key counts.

    Input columns: ``name_raw``, ``position``, ``phone`` and ``email`` as text.
    """
    keyed = rows.select(
        *scope,
        order,
        name_key_from_raw("name_raw").alias("key"),
        norm_ws("position").alias("position"),
        F.coalesce(normalize_phone("phone"), F.lit("")).alias("phone"),
        norm_ws("email").alias("email"),
    ).filter("key <> ''")
    return last_row(keyed, [*scope, "key"], order).drop(order)


#: Text columns of the online table that only need their whitespace cleaned.
_ONLINE_TEXT = (
    "pob travel_doc_number returning_to diet_restrictions intl_authority bank_name iban swift "
    "travel_doc_issued_by organization unit rank bio_short position"
).split()


def online_entries(rows: DataFrame) -> DataFrame:
    """Cleaned columns of the online table, one row per person with a name."""
    first, middle, last = norm_ws("first_name"), norm_ws("middle_name"), norm_ws("last_name")
    birth = F.regexp_replace(norm_ws("birth_country_raw"), r"(?i),\s*world$", "")
    columns = {
        "name": display_name(norm_ws(F.concat_ws(" ", first, middle, last))),
        "_key": name_key(last, F.trim(F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(middle, F.lit(""))))),
        "_short_key": F.when((middle != "") & (first != ""), name_key(last, first)),
        "_named": (first != "") | (last != ""),
        "gender": F.coalesce(gender("gender"), text("gender")),
        "birth_country": birth,
        "citizenships": split_multi(norm_ws("citizenships_raw")),
        "email_list": norm_ws("email"),
        "phone_list": F.coalesce(normalize_phone("phone"), F.lit("")),
        "travel_doc_type_raw": text("travel_doc_type"),
        "transportation_declared": text("transportation"),
        "transport_other": text("transport_other"),
        "traveling_from_declared": norm_ws("traveling_from"),
        "iban_type": text("iban_type"),
    }
    columns.update({name: norm_ws(name) for name in _ONLINE_TEXT})
    return rows.withColumns(columns).filter("_named").drop("_named")


ONLINE_FIELDS = [
    "name", "gender", "dob", "dob_kind", "pob", "birth_country", "citizenships", "email_list", "phone_list",
    "travel_doc_type_raw", "travel_doc_number", "travel_doc_issue", "travel_doc_issue_kind", "travel_doc_expiry",
    "travel_doc_expiry_kind", "travel_doc_issued_by", "transportation_declared", "transport_other",
    "traveling_from_declared", "returning_to", "diet_restrictions", "organization", "unit", "position", "rank",
    "intl_authority", "bio_short", "bank_name", "iban", "iban_type", "swift",
]


def online_lookup(rows: DataFrame, scope: Sequence[str] = ("path",), order: str = "row_no") -> DataFrame:
    """Online entries by name key, also without the middle name; the first row of a key counts."""
    entries = online_entries(rows)
    keys = F.array_distinct(F.array_compact(F.array("_key", "_short_key")))
    fields = [f for f in ONLINE_FIELDS if f in entries.columns]
    single = entries.select(*scope, order, F.posexplode(keys).alias("_key_no", "key"), F.struct(*fields).alias("online"))
    return (
        single.groupBy(*scope, "key")
        .agg(F.min_by("online", F.struct(order, "_key_no")).alias("online"))
        .select(*scope, "key", "online")
    )


def attendee_numbers(participants: DataFrame) -> Column:
    """Highest number at the end of a pid, as a one-value subquery; 0 without participants."""
    number = F.regexp_extract(F.upper(F.trim("pid")), r"(\d+)$", 1).try_cast("bigint")
    return participants.agg(F.coalesce(F.max(number), F.lit(0)).alias("n")).scalar()


def next_pid(participants: DataFrame) -> DataFrame:
    """The next participant id after the numerically highest one."""
    number = F.regexp_extract(F.upper(F.trim("pid")), r"(\d+)$", 1).try_cast("bigint")
    highest = participants.agg(F.coalesce(F.max(number), F.lit(0)).alias("n"))
    return highest.select(F.format_string("P%04d", F.col("n") + 1).alias("next_pid"))
