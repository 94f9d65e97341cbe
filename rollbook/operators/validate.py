"""Data-quality rules.  A rule set is a column with the array of a row's errors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rollbook.functions.phones import normalize_phone
from rollbook.functions.text import blank_to_null, norm_table_name, text
from rollbook.schemas import (
    ATTEMPTS, COUNTRY_TABLES, DOC_TYPES, GENDERS, GRADES, IBAN_TYPES, TRANSPORTS,
)

_EMAIL = r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"


def errors_of(*checks: tuple[Column, str]) -> Column:
    """Messages of the checks that are true; a null check counts as passed."""
    messages = F.array_compact(F.array(*[F.when(bad, F.lit(message)) for bad, message in checks]))
    # The array is made for rows with an error only; generated code looks for one up to the first.
    failed = reduce(Column.__or__, [F.coalesce(bad, F.lit(False)) for bad, _ in checks])
    return F.when(failed, messages).otherwise(F.array_compact(F.array(F.lit(None).cast("string"))))


def validate(df: DataFrame, rules: Column) -> tuple[DataFrame, DataFrame]:
    """Split rows into valid ones and rejects, which carry ``errors``."""
    checked = df.withColumn("errors", rules)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def valid_only(df: DataFrame, rules: Column) -> DataFrame:
    return validate(df, rules)[0]


def _length(name: str) -> Column:
    return F.coalesce(F.length(name), F.lit(0))


def _not_in(name: str, values: Sequence, optional: bool = False) -> Column:
    known = F.col(name).isin(*values)
    return (F.col(name).isNotNull() & ~known) if optional else F.coalesce(~known, F.lit(True))


def participant_rules(allow_missing_dob: bool = False, dob_text: str | None = None, raw_phone: str = "phone") -> Column:
    """Stored participant; ``dob_text`` is the text the date was read from, if it was text."""
    checks = [
        (_length("pid") < 3, "pid too short"),
        (~_length("representing_country").between(2, 10), "representing_country length"),
        (_not_in("gender", GENDERS), "gender unknown"),
        (_not_in("grade", list(GRADES), optional=True), "grade unknown"),
        (_length("name") < 1, "name missing"),
        (~blank_to_null("email").rlike(_EMAIL), "email invalid"),
        (blank_to_null(raw_phone).isNotNull() & normalize_phone(raw_phone).isNull(), "phone invalid"),
    ]
    if dob_text is not None:
        from rollbook.functions.dates import bad_dob

        checks.append((bad_dob(dob_text), "invalid dob format"))
    if not allow_missing_dob:
        checks.append((F.col("dob").isNull(), "dob is required"))
    return errors_of(*checks)


def event_rules() -> Column:
    """Event: dates in order and no blank participant in the roster."""
    blank = F.exists("participants", lambda p: F.coalesce(text(p) == "", F.lit(True)))
    return errors_of(
        (F.col("start_date") > F.col("end_date"), "start_date after end_date"), (blank, "blank participant")
    )


def snapshot_rules() -> Column:
    """Snapshot: required fields, coded values, a text for other transport, issue before expiry."""
    return errors_of(
        (F.col("event_id").isNull(), "event_id missing"),
        (F.col("participant_id").isNull(), "participant_id missing"),
        (_not_in("transportation", TRANSPORTS), "transportation unknown"),
        (F.col("traveling_from").isNull(), "traveling_from missing"),
        (F.col("returning_to").isNull(), "returning_to missing"),
        (_not_in("travel_doc_type", DOC_TYPES), "travel_doc_type unknown"),
        (_not_in("iban_type", IBAN_TYPES, optional=True), "iban_type unknown"),
        ((F.col("transportation") == "Other") & blank_to_null("transport_other").isNull(), "transport_other required"),
        (F.col("travel_doc_issue_date") > F.col("travel_doc_expiry_date"), "issue date after expiry date"),
    )


def score_rules() -> Column:
    return errors_of((F.col("score") < 0, "score negative"), (_not_in("type", ATTEMPTS), "type unknown"))


def country_rules() -> Column:
    return errors_of((_length("cid") != 4, "cid length"), (_length("country") < 2, "country too short"))


def load_row_rules(row_no: Column) -> Column:
    """Mandatory fields of a bulk-load row; the messages name the row."""

    def missing(field: str) -> Column:
        return F.format_string(f"Row %d: missing mandatory field '{field}'", row_no)

    bad = [
        F.when(text("name") == "", missing("Name")),
        F.when(F.col("representing_country").isNull(), missing("Representing Country")),
        F.when(F.col("gender").isNull(), missing("Gender")),
    ]
    return F.array_compact(F.array(*bad))


def event_edit_rules() -> Column:
    """Edit form of an event: a title, dates as YYYY-MM-DD, end not before start."""

    def day(name: str) -> Column:
        value = text(name)
        return F.when(value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), value).try_cast("date")

    def bad(name: str) -> Column:
        return (text(name) != "") & day(name).isNull()

    return errors_of(
        (text("title") == "", "Title is required."),
        (bad("start_date"), "start_date: Enter a valid date in YYYY-MM-DD format."),
        (bad("end_date"), "end_date: Enter a valid date in YYYY-MM-DD format."),
        (day("start_date") > day("end_date"), "End date must be on or after the start date."),
    )


def bundle_rules(bundles: DataFrame, stored_events: DataFrame) -> DataFrame:
    """Bundles with ``errors``: not empty, an event with an eid, and not uploaded before."""
    stored = stored_events.select(F.col("eid").alias("_stored")).distinct()
    joined = bundles.join(stored, text("event.eid") == F.col("_stored"), "left")
    event = F.col("event")
    empty = event.isNull() & F.col("participants").isNull() & F.col("participant_events").isNull()
    eid = text("event.eid")
    rules = errors_of(
        (empty, "Preview payload is empty"),
        (~empty & event.isNull(), "Event data is missing from the preview payload"),
        (event.isNotNull() & (eid == ""), "Event is missing an eid"),
        (F.col("_stored").isNotNull(), "Event has already been uploaded"),
    )
    return joined.withColumn("errors", rules).drop("_stored")


def link_rules() -> Column:
    return errors_of(
        (text("participant_id") == "", "participant_id is required"), (text("event_id") == "", "event_id is required")
    )


def check_workbooks(sheets: DataFrame, tables: DataFrame, headers: DataFrame, records: DataFrame) -> DataFrame:
    """One row per workbook: ``ok``, what is ``missing`` and the tables ``seen``.

    A missing sheet ends the list of findings.  A workbook with embedded records passes.
    """
    titles = sheets.groupBy("path").agg(
        F.bool_or(F.col("sheet") == "Participants").alias("_list"),
        F.bool_or(F.col("sheet") == "COST Overview").alias("_cost"),
    )
    wanted = [norm_table_name(F.lit(name)) for name in COUNTRY_TABLES]
    found = tables.groupBy("path").agg(
        F.bool_or(F.col("name_norm") == "participantslista").alias("_positions"),
        F.bool_or(F.col("name_norm").isin(*wanted)).alias("_country"),
        F.array_sort(F.collect_set("name_norm")).alias("seen"),
    )
    embedded = records.groupBy("path").agg(F.count(F.lit(1)).alias("_records"))
    joined = (
        titles.join(found, "path", "left").join(headers, "path", "left").join(embedded, "path", "left")
    )

    def absent(name: str) -> Column:
        return ~F.coalesce(F.col(name), F.lit(False))

    full = errors_of(
        (text("a1") == "", "Participants!A1 (eid + title)"),
        (text("a2") == "", "Participants!A2 (dates + location)"),
        (text("b15") == "", "Cost Overview!B15 (Total Cost)"),
        (absent("_positions"), "Table 'ParticipantsLista'"),
        (absent("_country"), "At least one country table (tableAlb, tableBih, tableCro, etc.)"),
    )
    missing = (
        F.when(F.col("_records") > 0, F.array().cast("array<string>"))
        .when(~F.col("_list"), F.array(F.lit("Sheet 'Participants'")))
        .when(~F.col("_cost"), F.array(F.lit("Sheet 'COST Overview'")))
        .otherwise(full)
    )
    seen = F.coalesce("seen", F.array().cast("array<string>"))
    return joined.select("path", missing.alias("missing"), seen.alias("seen"), F.coalesce("_records", F.lit(0)).alias("records")).withColumn(
        "ok", F.size("missing") == 0
    )


def import_tables_present(sheets: DataFrame, tables: DataFrame, require_online: bool = False) -> DataFrame:
    """Workbooks with the required tables they lack."""
    needed = ["ParticipantsLista", *(["ParticipantsList"] if require_online else [])]
    has = {n: F.bool_or(F.coalesce(F.col("name_norm") == n.lower(), F.lit(False))).alias(n) for n in needed}
    joined = sheets.select("path").distinct().join(tables.select("path", "name_norm"), "path", "left")
    return joined.groupBy("path").agg(*has.values()).select(
        "path", errors_of(*[(~F.col(n), f"Required table '{n}' not found") for n in needed]).alias("errors")
    )


def unknown_items(df: DataFrame, items: str, keys: Sequence[str], known: DataFrame, code: str = "cid") -> DataFrame:
    """Items of an array column that the known codes lack, one row per key and item."""
    single = df.select(*keys, F.explode(items).alias("item")).distinct()
    return single.join(known.select(F.col(code).alias("item")), "item", "left_anti").select(*keys, "item")
