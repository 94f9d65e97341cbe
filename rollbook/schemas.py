"""Column types of the stored tables and the fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

# Labels that stored data and workbooks use.
GENDERS = ("Male", "Female")
GRADES = {0: "Black List", 1: "Normal", 2: "Excellent"}
DEFAULT_GRADE = 1
EVENT_TYPES = ("Training", "Workshop", "Study trip", "Other")
TRANSPORTS = (
    "Personal Vehicle (POV)",
    "Government (Official) Vehicle (GOV)",
    "Air (Airplane)",
    "Other",
)
DOC_TYPES = ("Passport", "ID Card")
IBAN_TYPES = ("EURO", "USD", "Multi-currency")
ATTEMPTS = ("pre", "post")
WORKBOOK_ZONE = "Europe/Zagreb"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


S, L, I, D, B, TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)
STRINGS = T.ArrayType(S)

AUDIT = T.ArrayType(
    T.StructType(
        [
            T.StructField("ts", TS),
            T.StructField("actor", S),
            T.StructField("field", S),
            T.StructField("from", S),
            T.StructField("to", S),
            T.StructField("source", _struct(sheet=S, row=L, table=S)),
        ]
    )
)

COUNTRIES = _struct(cid=S, country=S, iso=S, ord=L)

PROFILE_FIELDS = (
    "position grade gender dob pob birth_country email phone diet_restrictions "
    "organization unit rank intl_authority bio_short"
).split()

PARTICIPANTS = T.StructType(
    _struct(
        pid=S, representing_country=S, gender=S, grade=I, name=S, dob=T.DateType(), pob=S, birth_country=S,
        citizenships=STRINGS, email=S, phone=S, diet_restrictions=S, organization=S, unit=S, position=S, rank=S,
        intl_authority=B, bio_short=S, created_at=TS, updated_at=TS, ord=L,
    ).fields
    + [T.StructField("_audit", AUDIT)]
)

EVENTS = T.StructType(
    _struct(
        eid=S, title=S, start_date=TS, end_date=TS, place=S, country=S, type=S, cost=D, participants=STRINGS,
        created_at=TS, updated_at=TS,
    ).fields
    + [T.StructField("_audit", AUDIT)]
)

SNAPSHOT_KEYS = ("participant_id", "event_id")
SNAPSHOT_FIELDS = (
    "transportation transport_other traveling_from returning_to travel_doc_type travel_doc_issue_date "
    "travel_doc_expiry_date travel_doc_issued_by bank_name iban iban_type swift"
).split()

PARTICIPANT_EVENTS = _struct(
    event_id=S, participant_id=S, transportation=S, transport_other=S, traveling_from=S, returning_to=S,
    travel_doc_type=S, travel_doc_issue_date=TS, travel_doc_expiry_date=TS, travel_doc_issued_by=S, bank_name=S,
    iban=S, iban_type=S, swift=S,
)

TESTS = _struct(eid=S, pid=S, type=S, score=D)

TABLES = {
    "countries": (COUNTRIES, ("cid",)),
    "participants": (PARTICIPANTS, ("pid",)),
    "events": (EVENTS, ("eid",)),
    "participant_events": (PARTICIPANT_EVENTS, SNAPSHOT_KEYS),
    "tests": (TESTS, ("eid", "pid", "type")),
}

#: Labels shown for a snapshot, in display order.
SNAPSHOT_LABELS = {
    "travel_doc_type": "Travel Document Type",
    "travel_doc_issue_date": "Travel Document Issue Date",
    "travel_doc_expiry_date": "Travel Document Expiry Date",
    "travel_doc_issued_by": "Travel Document Issued By",
    "transportation": "Transportation",
    "transport_other": "Transportation (Other)",
    "traveling_from": "Traveling From",
    "returning_to": "Returning To",
    "bank_name": "Bank Name",
    "iban": "IBAN",
    "iban_type": "IBAN Type",
    "swift": "SWIFT",
}
SNAPSHOT_COUNTRY_FIELDS = ("travel_doc_issued_by", "traveling_from", "returning_to")

# Workbook tables that hold the attendees of one country, with its label.
COUNTRY_TABLES = {
    "tableAlb": "Albania, Europe & Eurasia",
    "tableBih": "Bosnia and Herzegovina, Europe & Eurasia",
    "tableCro": "Croatia, Europe & Eurasia",
    "tableKos": "Kosovo, Europe & Eurasia",
    "tableMne": "Montenegro, Europe & Eurasia",
    "tableNmk": "North Macedonia, Europe & Eurasia",
    "tableSer": "Serbia, Europe & Eurasia",
}
