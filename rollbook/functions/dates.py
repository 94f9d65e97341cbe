"""Dates from text and from spreadsheet day numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rollbook.functions.text import col, strip
from rollbook.schemas import WORKBOOK_ZONE

# Month names of event headers and the day 0 of spreadsheet dates.
MONTHS = (
    "JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER"
).split()
DAY_ZERO = "1899-12-30"
EMPTY_DOB = "1900-01-01"

_YMD = r"^\d{4}-\d{1,2}-\d{1,2}$"
_DMY = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
_MDY = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
#: A date alone with nothing around it, as most are written; the year 0 is none.
_PLAIN = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}\z"
_BASIC = r"^(\d{4})(\d{2})(\d{2})$"
_CLOCK = r"\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?"
_OFFSET = r"Z|[+-]\d{2}:\d{2}"
_ISO = rf"^(\d{{4}}-\d{{2}}-\d{{2}}).({_CLOCK})({_OFFSET})?$"


def wall_clock(c: Column | str) -> Column:
    """Date and time written in the text, without any offset, as TIMESTAMP_NTZ; bad text is null.

    Accepts ``Y-m-d``, ``d.m.Y``, ``m/d/Y`` and ISO date-times.  Every form is matched
    first, because a plain cast would also take a bare year.
    """
    s = strip(col(c))
    clock = F.regexp_replace(F.regexp_extract(s, _ISO, 2), ",", ".")
    clock = F.when(F.length(clock) == 2, F.concat(clock, F.lit(":00"))).otherwise(clock)
    canonical = (
        F.when(s.rlike(_YMD), s)
        .when(s.rlike(_DMY), F.regexp_replace(s, _DMY, r"$3-$2-$1"))
        .when(s.rlike(_MDY), F.regexp_replace(s, _MDY, r"$3-$1-$2"))
        .when(s.rlike(_BASIC), F.regexp_replace(s, _BASIC, r"$1-$2-$3"))
        .when(s.rlike(_ISO), F.concat_ws(" ", F.regexp_extract(s, _ISO, 1), clock))
    )
    return F.when(~canonical.startswith("0000"), canonical).try_cast("timestamp_ntz")


def offset_minutes(c: Column | str) -> Column:
    """Offset from UTC written in the text, null when there is none."""
    mark = F.regexp_extract(strip(col(c)), _ISO, 3)
    size = F.substring(mark, 2, 2).try_cast("int") * 60 + F.substring(mark, 5, 2).try_cast("int")
    return F.when(mark == "Z", F.lit(0)).when(mark.startswith("-"), -size).when(mark != "", size)


def _shift(ts: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes, ts)


def _in_zone(c: Column | str, zone: str) -> Column:
    """Wall clock in ``zone``: text without an offset is taken as already there."""
    local, offset = wall_clock(c), offset_minutes(c)
    return F.when(offset.isNull(), local).otherwise(
        F.convert_timezone(F.lit("UTC"), F.lit(zone), _shift(local, -offset))
    )


def _to_instant(local: Column, zone: str) -> Column:
    """TIMESTAMP of a wall clock in ``zone``; the session time zone is UTC."""
    utc = local if zone == "UTC" else F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    return utc.cast("timestamp")


def excel_datetime(c: Column | str) -> Column:
    """Date and time of a positive day number, to the microsecond."""
    days = col(c).cast("double")
    valid = (days > 0) & (days < 2958466) & ~F.isnan(days)
    micros = F.bround(F.when(valid, days) * F.lit(86_400_000_000.0)).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.lit(DAY_ZERO).cast("timestamp_ntz"))


def cell_datetime(c: Column | str, kind: Column | str | None = None) -> Column:
    """Wall clock of a cell: a number (kind ``n``) is a day number, everything else is text."""
    if kind is None:
        return wall_clock(c)
    return F.when(col(kind) == "n", excel_datetime(col(c).try_cast("double"))).otherwise(wall_clock(c))


def coerce_ts(c: Column | str, kind: Column | str | None = None, zone: str = WORKBOOK_ZONE) -> Column:
    """Instant of a workbook date; a value without an offset belongs to ``zone``."""
    local = cell_datetime(c, kind)
    offset = offset_minutes(c)
    return F.when(offset.isNull(), _to_instant(local, zone)).otherwise(_to_instant(_shift(local, -offset), "UTC"))


def iso_date(c: Column | str, kind: Column | str | None = None, zone: str = WORKBOOK_ZONE) -> Column:
    """``YYYY-MM-DD`` of a date-like value in ``zone``, empty when it is none."""
    local = _in_zone(c, zone)
    if kind is not None:
        local = F.when(col(kind) == "n", excel_datetime(col(c).try_cast("double"))).otherwise(local)
    return F.coalesce(F.date_format(local.cast("date"), "yyyy-MM-dd"), F.lit(""))


def normalize_dob(c: Column | str, kind: Column | str | None = None) -> Column:
    """Date of birth; the placeholder of an empty spreadsheet date is null."""
    day = F.when(col(c).rlike(_PLAIN), col(c).try_cast("date")).otherwise(_in_zone(c, "UTC").cast("date"))
    if kind is not None:
        day = F.when(col(kind) == "n", excel_datetime(col(c).try_cast("double")).cast("date")).otherwise(day)
    return F.nullif(day, F.lit(EMPTY_DOB).cast("date"))


def bad_dob(c: Column | str) -> Column:
    """True for text that is not blank and holds no date."""
    unread = F.coalesce(strip(col(c)), F.lit("")).__ne__("") & wall_clock(c).isNull()
    return F.when(col(c).rlike(_PLAIN), col(c).try_cast("date").isNull()).otherwise(unread)


def snapshot_ts(c: Column | str) -> Column:
    """Instant of a stored snapshot date; a value without an offset is UTC."""
    read = F.when(col(c).rlike(_PLAIN), col(c).try_cast("timestamp_ntz").cast("timestamp")).otherwise(coerce_ts(c, zone="UTC"))
    return F.when(col(c).isNotNull(), read)


def year_from_name(c: Column | str) -> Column:
    """Year of a file name such as ``PFE25M2``; the current UTC year when there is none."""
    found = F.regexp_extract(F.upper(col(c)), r"PFE(\d{2})M", 1)
    return F.when(found != "", F.lit(2000) + found.try_cast("int")).otherwise(
        F.year(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))
    )


def _date_or_null(year: Column, month: Column, day: Column) -> Column:
    """Date of three numbers, null when there is no such day."""
    return F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date")


def event_header(a1: Column | str, a2: Column | str, year: Column) -> Column:
    """Fields of the two header cells of an event.

    The first cell is ``eid title``; the second ``MONTH d - d - Place, COUNTRY``.  The
    country stays text here and is resolved by a join.
    """
    from rollbook.functions.text import norm_ws

    first, second = norm_ws(a1), norm_ws(a2)
    parts = F.transform(F.split(second, " - "), strip)
    complete = F.size(parts) >= 3
    start_part = F.upper(F.get(parts, F.lit(0)))
    head = r"^([A-Z]+)\s+(\d{1,2})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(start_part, head, 1)).cast("int")
    month = F.when(month > 0, month)
    start_day = F.regexp_extract(start_part, head, 2).try_cast("int")
    end_day = F.regexp_replace(F.get(parts, F.lit(1)), r"\D", "").try_cast("int")
    location = F.when(complete, F.get(parts, F.lit(2))).otherwise("")
    sides = F.split(location, ",", 2)
    country = F.when(location.contains(","), norm_ws(sides[1]))
    return F.struct(
        F.substring_index(first, " ", 1).alias("eid"),
        F.when(first.contains(" "), F.regexp_replace(first, "^[^ ]* ", "")).otherwise("").alias("title"),
        F.when(complete, _date_or_null(year, month, start_day)).alias("start_date"),
        F.when(complete, _date_or_null(year, month, end_day)).alias("end_date"),
        F.when(location.contains(","), strip(sides[0])).otherwise(location).alias("place"),
        F.nullif(country, F.lit("")).alias("country_text"),
    )
