"""Bulk load of the three flat sheets into the stored tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rollbook.functions import dates, enums, names
from rollbook.functions.phones import normalize_phone
from rollbook.functions.text import blank_to_null, first_non_blank, split_location, split_multi, text
from rollbook.operators import match, merge, mutate, reports, sequence, tables, validate
from rollbook.schemas import IBAN_TYPES, PROFILE_FIELDS, SNAPSHOT_FIELDS, TRANSPORTS
from rollbook.session import checkpointed, staged

_CODE = r"^[A-Za-z]\d{3}$"


@dataclass
class Load:
    """New content of the stored tables and the rows that were left out."""

    countries: DataFrame
    participants: DataFrame
    events: DataFrame
    participant_events: DataFrame
    rosters: DataFrame
    rejects: DataFrame


def _col(df: DataFrame, name: str) -> Column:
    """A source column, null when the sheet does not have it."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def _cols(df: DataFrame, *found: str) -> Column:
    return first_non_blank(*[_col(df, name) for name in found])


def source_events(sheet: DataFrame, now: Column) -> DataFrame:
    """Events of the sheet; a repeated eid takes its last row."""
    location = split_location(_col(sheet, "Location"))
    hint = location["country_hint"]
    code, name = _col(sheet, "Country Code"), _col(sheet, "Country")
    country = (
        F.when(code.isNotNull(), F.coalesce(blank_to_null(code), hint))
        .when(name.isNotNull(), F.coalesce(blank_to_null(name), hint))
        .otherwise(hint)
    )
    rows = sheet.select(
        "row_no",
        text(_col(sheet, "Event")).alias("eid"),
        text(_col(sheet, "Title")).alias("title"),
        dates.snapshot_ts(_col(sheet, "Date From")).alias("start_date"),
        dates.snapshot_ts(_col(sheet, "Date To")).alias("end_date"),
        location["place"].alias("place"),
        F.when(country.rlike(_CODE), F.upper(country)).otherwise(country).alias("country"),
        F.lit("Training").alias("type"),
        enums.cost(_col(sheet, "Cost")).alias("cost"),
    ).filter("eid <> ''")
    last = merge.last_row(rows, ["eid"], "row_no")
    log = mutate.import_audit("eid", F.col("eid"), "initial_import", now, "Events", F.col("row_no") + 1)
    return last.withColumn("_audit", log).drop("row_no")


def source_countries(sheet: DataFrame) -> DataFrame:
    """Countries of the sheet; a missing code is the row's number."""
    code = F.upper(text(F.coalesce(_col(sheet, "CID"), _col(sheet, "Country ID"), _col(sheet, "Country Code"))))
    iso = blank_to_null(F.coalesce(_col(sheet, "ISO"), _col(sheet, "ISO3"), _col(sheet, "ISO 3")))
    return sheet.select(
        F.when(code == "", F.format_string("C%03d", "row_no")).otherwise(code).alias("cid"),
        text(_col(sheet, "Country")).alias("country"),
        iso.alias("iso"),
        F.col("row_no").alias("ord"),
    )


def source_rows(sheet: DataFrame) -> DataFrame:
    """Participant rows with cleaned columns; country columns are still text."""

    def plain(*found: str) -> Column:
        return _cols(sheet, *found)

    name = names.normalize_name(text(_col(sheet, "Name")), comma=False)
    tokens = split_multi(plain("Citizenships", "Citizenship"))
    columns = {
        "name": name,
        "event_id": plain("Event"),
        "rep_text": plain("Representing Country", "Country", "Country Code"),
        "birth_text": plain("Birth Country", "Birth Country Code"),
        "citizen_texts": tokens,
        "gender": enums.gender(_col(sheet, "Gender"), "initial"),
        "grade": enums.grade(_col(sheet, "Grade"), "load"),
        "dob": dates.snapshot_ts(_col(sheet, "DOB")).cast("date"),
        "pob": F.coalesce(plain("POB", "Place of Birth"), F.lit("")),
        "email": plain("Email"),
        "phone": plain("Phone"),
        "position": plain("Position"),
        "organization": plain("Organization"),
        "unit": plain("Unit"),
        "rank": plain("Rank"),
        "diet_restrictions": plain("Diet Restrictions", "Dietary Restrictions"),
        "bio_short": plain("Bio", "Bio Short", "Biography"),
        "intl_authority": enums.to_bool(plain("International Authority", "Intl Authority"), "load"),
        "source_table": plain("Table"),
        "transportation": enums.enum_match(_col(sheet, "Transportation"), TRANSPORTS),
        "transport_other": plain("Transportation Other"),
        "traveling_from": plain("Traveling From"),
        "returning_to": plain("Returning To"),
        "travel_doc_type": enums.doc_type(plain("Travel Doc Type", "Travel Document Type"), "load"),
        "travel_doc_issue_date": dates.snapshot_ts(plain("Travel Doc Issue Date", "Travel Document Issue Date")),
        "travel_doc_expiry_date": dates.snapshot_ts(plain("Travel Doc Expiry Date", "Travel Document Expiry Date")),
        "travel_doc_issued_by": plain("Travel Doc Issued By", "Travel Document Issued By"),
        "bank_name": plain("Bank Name"),
        "iban": plain("IBAN"),
        "iban_type": enums.enum_match(_col(sheet, "IBAN Type"), IBAN_TYPES),
        "swift": plain("SWIFT"),
    }
    return sheet.select("row_no", *[value.alias(key) for key, value in columns.items()])


def with_country_codes(rows: DataFrame, countries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with codes for their represented, birth and citizenship countries, and the grown country table.

    A missing birth country and missing citizenships are the represented country.
    """
    named = ["rep_text", "birth_text", "citizen_texts"]
    # Rows that name the same countries are coded once; the first of them says when a name was seen.
    groups = staged(rows.groupBy(*named).agg(F.min(F.struct("row_no"))["row_no"].alias("row_no")))
    texts = F.concat(F.array("rep_text", "birth_text"), "citizen_texts")
    mentions = groups.select("row_no", *named, F.posexplode(texts).alias("slot", "label")).filter("label is not null")
    mentions = mentions.withColumn("mention_no", F.struct("row_no", "slot"))
    grown, coded = mutate.ensure_countries(mentions, "label", "mention_no", countries)

    def at(slot: int) -> Column:
        return F.max(F.when(F.col("slot") == slot, F.col("cid")))

    citizen = F.struct("slot", "cid")
    listed = F.array_sort(F.collect_list(F.when(F.col("slot") > 1, citizen)))
    per_group = coded.groupBy(*named).agg(at(0).alias("rep"), at(1).alias("birth"), listed.alias("_listed"))
    codes = per_group.select(*[F.col(c).alias(f"_{c}") for c in named], "rep", "birth", F.array_distinct("_listed.cid").alias("_citizens"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in named])
    # A row without a number has no codes.
    joined = rows.join(codes, F.col("row_no").isNotNull() & same, "left").drop(*[f"_{c}" for c in named])
    citizens = F.when(F.size("_citizens") > 0, F.col("_citizens")).otherwise(F.array("rep"))
    resolved = joined.withColumns(
        {
            "representing_country": F.col("rep"),
            "birth_country": F.coalesce("birth", "rep"),
            "citizenships": F.when(F.col("rep").isNotNull(), citizens),
        }
    )
    return resolved.drop("rep", "birth", "_citizens", "rep_text", "birth_text", "citizen_texts"), grown


def merged_participants(rows: DataFrame, events: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """One participant per name and country, and the rows that have a number, with their ``pid``.

    The newest event decides the profile, citizenships are united and people are numbered
    in order of first appearance.
    """
    keys = ["name_key", "representing_country"]
    dated = match.with_event_date(rows, events).withColumn("name_key", F.lower("name"))
    newest = [*PROFILE_FIELDS, "source_row", "source_table"]
    profiles = merge.newest_wins(
        dated.withColumn("source_row", F.col("row_no")), keys, "event_date", "row_no", newest, ["name"]
    )
    citizens = merge.union_arrays(dated, keys, "citizenships", "row_no")
    numbered = checkpointed(sequence.number_first_seen(dated, keys, "row_no", "pid", "P%04d"))
    people = profiles.join(citizens, keys, "left").join(numbered, keys)
    log = mutate.import_audit(
        "grade", F.col("grade"), "import", now, "Participants", F.col("source_row") + 1, F.col("source_table")
    )
    known = rows.filter("row_no is not null").withColumn("name_key", F.lower("name")).join(numbered.select(*keys, "pid"), keys)
    shaped = people.withColumns(
        {"_audit": log, "created_at": now.cast("timestamp"), "updated_at": now.cast("timestamp"), "ord": F.col("first_seen")}
    )
    return shaped, known


def load(participants: DataFrame, countries: DataFrame, events: DataFrame, now: Column | None = None) -> Load:
    """Load the sheets; every sheet has its row numbers, 1 first, in ``row_no``."""
    now = F.current_timestamp() if now is None else now
    listed = source_countries(countries)
    event_rows = match.event_country(source_events(events, now), listed)
    raw, grown = with_country_codes(source_rows(participants), listed)
    # Every result below reads these rows: they are resolved once.
    raw = staged(raw)
    rows, row_rejects = validate.validate(raw, validate.load_row_rules(F.col("row_no") + 1))
    people, known = merged_participants(rows, event_rows, now)
    good, bad = validate.validate(people, validate.participant_rules(allow_missing_dob=True))
    good = good.withColumns({"name": names.display_name("name"), "phone": normalize_phone("phone")})

    attended = known.filter(F.col("event_id").isNotNull()).withColumnRenamed("pid", "participant_id").select(
        "participant_id", "event_id", "row_no", *SNAPSHOT_FIELDS
    )
    merged = merge.last_non_blank(attended, ["participant_id", "event_id"], "row_no", SNAPSHOT_FIELDS)
    filled = merged.withColumns(enums.load_defaults())
    snapshots, bad_snapshots = validate.validate(filled, validate.snapshot_rules())

    rosters = reports.rosters(event_rows, snapshots)
    stored_events = event_rows.join(rosters, "eid").select(
        *event_rows.columns,
        "participants",
        now.cast("timestamp").alias("created_at"),
        now.cast("timestamp").alias("updated_at"),
    )

    def report(df: DataFrame, kind: str, key: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("record"), key.cast("string").alias("key"), "errors")

    parts = [
        report(row_rejects, "row", F.col("row_no") + 1),
        report(bad, "participant", F.concat_ws("/", "pid", "source_row")),
        report(bad_snapshots, "participant_event", F.concat_ws("/", "participant_id", "event_id")),
        report(
            validate.validate(event_rows.withColumn("participants", F.array().cast("array<string>")), validate.event_rules())[1],
            "event", F.col("eid"),
        ),
    ]
    rejects = reduce(DataFrame.unionByName, parts)
    return Load(grown, good, stored_events, snapshots, rosters, rejects)


def load_if_needed(spark, root: str, sheets: dict[str, DataFrame]) -> bool:
    """Run the load and store its tables, unless the stored tables are filled already."""
    from rollbook.sources import stored

    current = {name: stored.read_table(spark, root, name) for name in ("events", "participants", "countries")}
    source = sheets["Events"].select(F.col("Event").alias("eid"))
    decision = tables.should_load(current["events"], current["participants"], current["countries"], source)
    if not decision.first()["load"]:
        return False
    result = load(sheets["Participant"], sheets["Country"], sheets["Events"])
    stored.reload(
        spark,
        root,
        {
            "countries": result.countries,
            "participants": result.participants,
            "participant_events": result.participant_events,
            "events": result.events,
        },
    )
    return True
