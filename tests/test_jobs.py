"""Import, upload, load and storage jobs on small workbooks and bundles."""

from __future__ import annotations

import io
import json
import zipfile
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rollbook.operators import validate
from rollbook.plans import bulk_load, catalog_jobs, sample_workbooks, upload, workbook_import
from rollbook.schemas import COUNTRIES, EVENTS, PARTICIPANT_EVENTS, PARTICIPANTS
from rollbook.sources import ledger, preview, stored, workbooks, xlsx
from rollbook.streaming import file_arrival

ONLINE = ["Name", "Middle name", "Last name", "Gender", "Date of Birth (DOB)", "Transportation", "Traveling from"]


def make_workbook(travel="Bus", online_travel="Air", gender="Mr", with_travel=True, cost=100):
    main, overview, listed, online = (sample_workbooks.Sheet(t) for t in ("Participants", "COST Overview", "List", "MAIN ONLINE"))
    main.put(1, 1, "E1 TITLE")
    main.put(2, 1, "JUNE 1 - 3 - Zagreb")
    overview.put(15, 2, cost)
    header = ["Name and  Last Name", "Travel", "Traveling from", "Grade (0 - BL, 1 - Pass, 2 - Excel)"]
    rows = [header, ["Doe, John", travel, None, 2], [None, None, None, None], ["TOTAL", None, None, 1]]
    main.table("tableAlb", 4, rows if with_travel else [[r[0], *r[2:]] for r in rows], left=2)
    listed.table("ParticipantsLista", 1, [["Name (Latin)", "Position", "Phone", "Email"], ["DOE, John", "Chief", "00385 1 234567", None]])
    online.table("ParticipantsList", 1, [ONLINE, ["John", None, "Doe", gender, "5.1.1990", online_travel, "Split"]])
    return sample_workbooks.workbook([main, overview, listed, online])


@pytest.fixture(scope="module")
def countries(spark):
    return spark.createDataFrame([("C117", "Kosovo", None, 1), ("C181", "North Macedonia", None, 2)], COUNTRIES)


def people(spark, *rows):
    known = [f.name for f in PARTICIPANTS.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in known) for r in rows], PARTICIPANTS)


def test_transport_gender_and_matching(spark, countries):
    cases = {
        "a.xlsx": make_workbook(),
        "b.xlsx": make_workbook(travel=None),
        "c.xlsx": make_workbook(with_travel=False, gender="Ms"),
    }
    files = spark.createDataFrame(list(cases.items()), "path string, content binary")
    known = people(
        spark,
        {"pid": "P0007", "name": "John DOE", "representing_country": "Albania, Europe & Eurasia", "dob": date(1990, 1, 5), "ord": 1},
    )
    content = workbooks.read_workbooks(files)
    found = {r["path"]: r for r in workbook_import.attendees(content, countries, known).collect()}
    assert {p: r["transportation"] for p, r in found.items()} == {"a.xlsx": "Bus", "b.xlsx": "", "c.xlsx": "Air"}
    assert {p: r["gender"] for p, r in found.items()} == {"a.xlsx": "Male", "b.xlsx": "Male", "c.xlsx": "Female"}
    row = found["a.xlsx"]
    assert (row["name"], row["position"], row["phone"], row["grade"]) == ("John DOE", "Chief", "+3851234567", 2)
    assert (row["pid"], row["dob"], row["traveling_from"]) == ("P0007", "1990-01-05", "Split")


def test_checks_and_rejects(spark, countries):
    bare = sample_workbooks.workbook([sample_workbooks.Sheet("Participants")])
    files = spark.createDataFrame(
        [("ok.xlsx", make_workbook()), ("bare.xlsx", bare), ("old.xls", b"x"), ("bad.xlsx", b"no zip"), ("costless.xlsx", make_workbook(cost=None))],
        "path string, content binary",
    )
    result = workbook_import.import_workbooks(files, countries, people(spark))
    checks = {r["path"]: r for r in result.checks.collect()}
    assert checks["ok.xlsx"]["ok"] and checks["ok.xlsx"]["seen"] == ["participantslist", "participantslista", "tablealb"]
    assert checks["bare.xlsx"]["missing"] == ["Sheet 'COST Overview'"]
    assert checks["costless.xlsx"]["missing"] == ["Cost Overview!B15 (Total Cost)"]
    assert {r["path"] for r in result.rejects.collect()} == {"bare.xlsx", "old.xls", "bad.xlsx", "costless.xlsx"}
    event = result.events.filter("path = 'ok.xlsx'").first()
    assert (event["eid"], event["title"], event["place"], event["cost"]) == ("E1", "TITLE", "Zagreb", 100.0)
    missing = {r["path"]: r["errors"] for r in validate.import_tables_present(
        workbooks.workbook_sheets(workbooks.read_workbooks(files)), workbooks.workbook_tables(workbooks.read_workbooks(files))).collect()}
    assert missing["ok.xlsx"] == [] and missing["bare.xlsx"] == ["Required table 'ParticipantsLista' not found"]


def cut_short(book: bytes, part: str) -> bytes:
    """The workbook with half of one part."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            data = old.read(name)
            new.writestr(name, data[: len(data) // 2] if name == part else data)
    return out.getvalue()


def test_every_part_of_a_workbook_is_read_once(monkeypatch):
    read = Counter()
    opened = zipfile.ZipFile.open

    def counted(book, name, *args, **kwargs):
        read[getattr(name, "filename", name)] += 1
        return opened(book, name, *args, **kwargs)

    data = make_workbook()
    monkeypatch.setattr(zipfile.ZipFile, "open", counted)
    kinds = Counter(row["kind"] for row in xlsx.content(data))
    assert kinds["sheet"] == 4 and kinds["row"] > 0 and kinds["cell"] == 3
    assert read["xl/workbook.xml"] == 1 and set(read.values()) == {1}


def test_refused_workbooks_are_not_imported(spark, countries):
    good = make_workbook()
    with zipfile.ZipFile(io.BytesIO(good)) as book:
        part = sorted(n for n in book.namelist() if n.startswith("xl/worksheets/sheet"))[-1]
    files = spark.createDataFrame(
        [("cut.xlsx", cut_short(good, part)), ("costless.xlsx", make_workbook(cost=None)), ("ok.xlsx", good), ("null.xlsx", None)],
        "path string, content binary",
    )
    result = workbook_import.import_workbooks(files, countries, people(spark))
    assert {r["path"] for r in result.events.collect()} == {r["path"] for r in result.attendees.collect()} == {"ok.xlsx"}
    assert {r["path"] for r in result.rejects.collect()} == {"cut.xlsx", "costless.xlsx", "null.xlsx"}


def full_workbook(tables, eid="E1"):
    """A workbook whose attendees have everything that an upload asks for, in the given country tables."""
    main, overview, listed, online = (sample_workbooks.Sheet(t) for t in ("Participants", "COST Overview", "List", "MAIN ONLINE"))
    main.put(1, 1, f"{eid} TITLE")
    main.put(2, 1, "JUNE 1 - 3 - Zagreb")
    overview.put(15, 2, 100)
    header = ["Name and  Last Name", "Travel", "Traveling from", "Grade (0 - BL, 1 - Pass, 2 - Excel)"]
    names = ["Name (Latin)", "Position", "Phone", "Email"]
    details = [*ONLINE, "Place Of Birth (POB)", "Country of Birth", "Citizenship(s)", "Traveling document type", "Returning to", "IBAN Type"]
    people_rows, online_rows = [names], [details]
    for k, table in enumerate(tables):
        person = f"Doe{chr(97 + k)}"
        main.table(table, 4 + 5 * k, [header, [f"{person}, John", "Air (Airplane)", "Split", 2], ["TOTAL", None, None, 1]], left=2)
        people_rows.append([f"{person.upper()}, John", "Chief", "00385 1 234567", None])
        online_rows.append(["John", None, person, "Mr", f"{k + 1}.1.1990", "Air (Airplane)", "Split", "Split", "Kosovo", "Kosovo", "Passport", "Split", "EURO"])
    listed.table("ParticipantsLista", 1, people_rows)
    online.table("ParticipantsList", 1, online_rows)
    return sample_workbooks.workbook([main, overview, listed, online])


def test_import_to_upload_loses_nothing(spark):
    """One country table, which may be any, or several: every event, roster, link and person arrives."""
    names = ["Kosovo", *[f"{land}, Europe & Eurasia" for land in ("Albania", "Croatia", "Serbia")]]
    countries = spark.createDataFrame([(f"C00{k}", name, None, k) for k, name in enumerate(names)], COUNTRIES)
    kinds = {"a.xlsx": ["tableAlb"], "b.xlsx": ["tableCro"], "c.xlsx": ["tableAlb", "tableCro", "tableSer"]}
    books = [(path, full_workbook(tables, f"E{no}")) for no, (path, tables) in enumerate(kinds.items())]
    files = spark.createDataFrame([*books, ("d.xlsx", make_workbook(cost=None))], "path string, content binary")
    found = workbook_import.import_workbooks(files, countries, people(spark))
    assert [r["path"] for r in found.rejects.collect()] == ["d.xlsx"]
    bundles = preview.preview_bundles(found.events, found.attendees, found.snapshots)
    empty = [spark.createDataFrame([], schema) for schema in (PARTICIPANTS, PARTICIPANT_EVENTS, EVENTS)]
    result = upload.upload(bundles, *empty)
    assert result.rejects.collect() == []
    rosters = {r["eid"]: len(r["participants"]) for r in result.events.collect()}
    assert rosters == {"E0": 1, "E1": 1, "E2": 3}
    links = {(r["event_id"], r["participant_id"]) for r in result.participant_events.collect()}
    assert links == {(r["eid"], pid) for r in result.events.collect() for pid in r["participants"]}
    assert {pid for _, pid in links} == {r["pid"] for r in result.participants.collect()}


def test_bundles_of_a_stored_event_with_blanks(spark, tmp_path):
    first = run_upload(spark, tmp_path, [bundle("a")])
    eid = first.events.first()["eid"]
    padded = preview.preview_bundles(
        spark.createDataFrame([("b", f"  {eid} ")], "path string, eid string"), spark.createDataFrame([], "path string, row_no long, name string")
    )
    checked = validate.bundle_rules(padded, first.events).first()
    assert checked["errors"] == ["Event has already been uploaded"]


XML = """<data xmlns="urn:x"><participant><pid>P0001</pid><representing_country>C117</representing_country><gender>F</gender><grade>2</grade>
<name>Ana Kos</name><dob>1990-01-05</dob><pob>Pec</pob><birth_country>C117</birth_country><citizenships>C117</citizenships></participant>
<participant_event><event_id>E1</event_id><participant_id>P0001</participant_id><transportation>Air (Airplane)</transportation>
<traveling_from>Pec</traveling_from><returning_to>Pec</returning_to><travel_doc_type>Passport</travel_doc_type></participant_event>
<event><eid>E1</eid><title>T</title><start_date>2024-05-01</start_date><place><city>Pec</city><city>Prizren</city></place></event></data>"""


def test_embedded_records(spark, countries):
    book = sample_workbooks.workbook([sample_workbooks.Sheet("x")], (XML, "<not closed"))
    files = spark.createDataFrame([("x.xlsx", book)], "path string, content binary")
    content = workbooks.read_workbooks(files)
    found = workbook_import.embedded_records(content)
    row = found.attendees.collect()
    assert len(row) == 1 and (row[0]["grade"], row[0]["transportation"], row[0]["name"]) == (2, "Air (Airplane)", "Ana KOS")
    assert len([c for c in found.attendees.columns if c != "path"]) == 32
    fields = workbooks.custom_xml_records(content, "event").first()["fields"]
    assert fields["place_city"] == "Pec; Prizren"
    result = workbook_import.import_workbooks(files, countries, people(spark))
    assert result.checks.first()["ok"] and result.snapshots.count() == 1


def test_ledger(spark):
    rows = spark.createDataFrame(
        [
            ("HR", 1, "1. Lost Entry", None), ("HR", 2, "PFE13M1 First event", "Split, May"), ("HR", 3, "1. Ann Lee, Chief", None),
            ("HR", 4, "note", None), ("HR", 5, "2.  Bob – Clerk", None), ("HR", 6, "PFE14M2 Second", None), ("HR", 7, "1. Cy", None),
            ("RS", 1, "1. Nobody", None),
        ],
        "sheet string, row_no long, first string, second string",
    )
    events, entries = ledger.extract_ledger(rows.repartition(3), block=3)
    assert sorted((r["Event"], r["Title"], r["LocationDate"]) for r in events.collect()) == [
        ("PFE13M1", "First event", "Split, May"), ("PFE14M2", "Second", "")]
    assert sorted((r["Event"], r["Name"], r["Position"], r["Country"]) for r in entries.collect()) == [
        ("PFE13M1", "Ann Lee", "Chief", "HR"), ("PFE13M1", "Bob", "Clerk", "HR"), ("PFE14M2", "Cy", "", "HR")]


JANE = {
    "name": "Jane Doe", "representing_country": "HR", "gender": "Female", "grade": "1", "dob": "1990-01-01", "pob": "Zagreb",
    "birth_country": "HR", "citizenships": ["HR"], "phone": "00385 1 234 5678", "transportation": "Air (Airplane)",
    "traveling_from": "Zagreb", "returning_to": "Zagreb", "travel_doc_type": "Passport",
}


def bundle(path, eid="E1", attendees=(JANE,), supplied=()):
    return {
        "path": path, "event": {"eid": eid, "title": "T", "start_date": "2024-05-01", "end_date": "2024-05-03", "place": "Zagreb"},
        "participants": list(attendees), "participant_events": list(supplied),
    }


def run_upload(spark, tmp_path, bundles, known=(), old_events=()):
    file = tmp_path / "bundles.json"
    file.write_text("\n".join(json.dumps(b) for b in bundles))
    links = spark.createDataFrame([], PARTICIPANT_EVENTS)
    events = spark.createDataFrame([(e,) + (None,) * (len(EVENTS.fields) - 1) for e in old_events], EVENTS)
    return upload.upload(preview.read_preview(spark, str(file)), people(spark, *known), links, events)


def test_upload_of_a_new_person(spark, tmp_path):
    result = run_upload(spark, tmp_path, [bundle("a")])
    person = result.participants.first()
    assert (person["pid"], person["name"], person["phone"]) == ("P0001", "Jane DOE", "+38512345678")
    assert [r["participants"] for r in result.events.collect()] == [["P0001"]]
    assert [(r["participant_id"], r["event_id"], r["traveling_from"]) for r in result.participant_events.collect()] == [("P0001", "E1", "Zagreb")]
    assert result.rejects.count() == 0


def test_upload_of_a_known_person(spark, tmp_path):
    known = {"pid": "P1234", "name": "Jane DOE", "representing_country": "HR", "dob": date(1990, 1, 1), "position": "Chief", "ord": 1}
    given = {"participant_id": "P1234", "transportation": "Other", "transport_other": "Bus", "travelling_from": "Split",
             "returning_to": "Split", "travel_doc_type": "ID Card"}
    result = run_upload(spark, tmp_path, [bundle("a", supplied=[given])], [known])
    person = result.participants.collect()
    assert len(person) == 1 and (person[0]["pid"], person[0]["phone"], person[0]["position"]) == ("P1234", "+38512345678", "Chief")
    assert result.participant_events.first()["traveling_from"] == "Split"


def test_upload_types_events_and_attendees_once(spark, tmp_path, monkeypatch):
    calls = []
    for name in ("_event_rows", "_people"):
        def counted(bundles, name=name, plain=getattr(upload, name)):
            calls.append(name)
            return plain(bundles)

        monkeypatch.setattr(upload, name, counted)
    result = run_upload(spark, tmp_path, [bundle("a"), bundle("b", "E2", [JANE, {**JANE, "name": "Bob Roe"}])])
    assert sorted(calls) == ["_event_rows", "_people"]
    assert {r["eid"]: r["participants"] for r in result.events.collect()} == {"E1": ["P0001"], "E2": ["P0001", "P0002"]}


def test_latest_snapshot_of_a_person_in_a_bundle(spark):
    def fields(value):
        return dict.fromkeys(upload.SNAPSHOT_FIELDS, value) if value else None

    texts = ", ".join(f"{n} string" for n in upload.SNAPSHOT_FIELDS)
    rows = [("a", 0, "P1", fields("one")), ("a", 1, "P1", fields("two")), ("a", 2, "P1", None), ("a", 3, "P2", fields("own")), ("a", 4, "P3", None), ("b", 0, "P1", fields("b"))]
    given = [{"path": "a", "row_no": k, "pid": pid, **fields(value)} for k, pid, value in ((0, "P2", "first"), (1, "P2", "last"), (2, "P9", "nobody"))]
    found = upload._latest_snapshots(
        spark.createDataFrame(rows, f"path string, row_no bigint, pid string, own struct<{texts.replace(' string', ':string')}>"),
        spark.createDataFrame(given, f"path string, row_no bigint, pid string, {texts}"),
    )
    assert {(r["path"], r["pid"]): r["snapshot"]["iban"] for r in found.collect()} == {("a", "P1"): "two", ("a", "P2"): "last", ("b", "P1"): "b"}


def test_upload_refuses_whole_bundles(spark, tmp_path):
    bad = {**JANE, "name": "Bad One", "phone": "123"}
    result = run_upload(
        spark, tmp_path,
        [bundle("a", "E1"), bundle("b", "E2", [JANE, bad]), bundle("c", "E9"), bundle("d", "E1"), {"path": "e", "participants": []}],
        old_events=["E9"],
    )
    errors = {r["path"]: r["errors"] for r in result.rejects.collect()}
    assert errors == {
        "b": ["phone invalid"], "c": ["Event has already been uploaded"], "d": ["Event is also in an earlier bundle"],
        "e": ["Event data is missing from the preview payload"],
    }
    assert sorted(r["eid"] for r in result.events.collect()) == ["E1", "E9"]
    assert result.participants.count() == 1


def test_undated_people_are_taken_once(spark, tmp_path):
    known = [
        {"pid": "P0001", "name": "Jane DOE", "representing_country": "HR", "ord": 1},
        {"pid": "P0002", "name": "Jane DOE", "representing_country": "HR", "ord": 2},
    ]
    janes = [{**JANE, "dob": f"199{i}-01-01"} for i in range(3)]
    result = run_upload(spark, tmp_path, [bundle("a", attendees=janes)], known)
    assert result.events.first()["participants"] == ["P0001", "P0002", "P0003"]


def test_preview_round_trip(spark, tmp_path):
    events = spark.createDataFrame([("a", "E1", "T")], "path string, eid string, title string")
    attendees = spark.range(1, 26).selectExpr("'a' path", "id row_no", "concat('N', id) name")
    bundles = preview.preview_bundles(events, attendees.withColumn("row_no", F.col("row_no") * (1 << 21)))
    preview.write_preview(bundles, str(tmp_path / "p"))
    back = preview.read_preview(spark, str(tmp_path / "p"))
    assert [(r["participants_count"], r["participants"][24]["name"]) for r in back.collect()] == [(25, "N25")]
    assert preview.preview_counts(back).first()["participants_count"] == 25


def sheets(spark):
    people_sheet = spark.createDataFrame(
        [
            (1, "Ann Lee", "Croatia", "F", "0", "Chief", "E1", None, "HR, Serbia"),
            (2, "ann lee", "Croatia", "F", "2", "Boss", "E2", "Air (airplane)", None),
            (3, "Ann Lee", "Serbia", "F", "1", None, "E1", None, None),
            (4, "Bob", "Newland", "M", "x", None, None, None, None),
            (5, "Cy", "Croatia", None, "1", None, None, None, None),
        ],
        "row_no long, Name string, `Representing Country` string, Gender string, Grade string, Position string, Event string, "
        "Transportation string, Citizenships string",
    )
    country_sheet = spark.createDataFrame([(1, "Croatia", None, "HR"), (2, "Serbia", "C009", None)], "row_no long, Country string, CID string, ISO string")
    event_sheet = spark.createDataFrame(
        [(1, "E1", "One", "Split, Croatia", "1.5.2024"), (2, "E2", "Two", "Zagreb C009", "2025-01-01"), (3, "E3", "Three", "Online", None)],
        "row_no long, Event string, Title string, Location string, `Date From` string",
    )
    return {"Participant": people_sheet, "Country": country_sheet, "Events": event_sheet}


def test_bulk_load(spark):
    source = sheets(spark)
    result = bulk_load.load(*(source[n].repartition(3) for n in ("Participant", "Country", "Events")), now=F.lit("2025-01-01"))
    found = {r["pid"]: r for r in result.participants.collect()}
    assert sorted(found) == ["P0001", "P0002", "P0003"]
    assert (found["P0001"]["grade"], found["P0001"]["position"], found["P0001"]["citizenships"]) == (2, "Boss", ["C001", "C009"])
    assert found["P0003"]["representing_country"] == "C010" and found["P0001"]["_audit"][0]["source"]["row"] == 3
    events = {r["eid"]: r for r in result.events.collect()}
    assert (events["E1"]["country"], events["E1"]["place"], events["E1"]["participants"]) == ("C001", "Split", ["P0001", "P0002"])
    assert (events["E2"]["country"], events["E3"]["participants"]) == ("C009", [])
    links = {(r["participant_id"], r["event_id"]): r for r in result.participant_events.collect()}
    assert links["P0001", "E2"]["transportation"] == "Air (Airplane)" and links["P0001", "E1"]["transport_other"] == "Unspecified"
    assert [r["errors"] for r in result.rejects.collect()] == [["Row 6: missing mandatory field 'Gender'"]]


def test_stored_tables(spark, tmp_path):
    root = str(tmp_path / "store")
    assert stored.read_table(spark, root, "countries").count() == 0
    assert bulk_load.load_if_needed(spark, root, sheets(spark))
    assert stored.read_table(spark, root, "participants").count() == 3
    assert not bulk_load.load_if_needed(spark, root, {**sheets(spark), "Events": sheets(spark)["Events"].limit(2)})
    countries = spark.createDataFrame([("C001", "Twice", None, 9), ("C050", "New", None, 10), ("C050", "New", None, 11)], COUNTRIES)
    before = stored.read_table(spark, root, "countries").count()
    stored.append(spark, root, "countries", countries)
    after = stored.read_table(spark, root, "countries")
    assert after.count() == before + 1 and after.filter("country = 'Twice'").count() == 0
    # Writing a table from its own rows is safe: readers keep the version they opened.
    stored.write_table(after.filter("cid <> 'C050'"), root, "countries")
    assert stored.read_table(spark, root, "countries").count() == before


def test_flat_files(spark, tmp_path):
    for name, df in sheets(spark).items():
        df.coalesce(1).write.option("header", "true").csv(str(tmp_path / name))
    back = stored.load_flat(spark, str(tmp_path))
    assert back["Participant"].filter("row_no = 2").first()["Name"] == "ann lee"


def test_file_arrival_is_replayable(spark, tmp_path):
    """Files are uploaded once, also when the stream starts over."""
    inbox, root = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()
    countries = spark.createDataFrame([("C001", "Albania, Europe & Eurasia", None, 1)], COUNTRIES)
    stored.write_table(countries, root, "countries")
    xml = XML.replace("E1", "E2")
    book = sample_workbooks.workbook([sample_workbooks.Sheet("x")], (xml,))
    (inbox / "x.xlsx").write_bytes(book)
    (inbox / "PFE24M1.xlsx").write_bytes(make_workbook())
    for run in range(2):
        file_arrival.start(spark, str(inbox), root, str(tmp_path / f"cp{run}"), available_now=True).awaitTermination()
    events = {r["eid"] for r in stored.read_table(spark, root, "events").collect()}
    # The transport "Bus" of the other workbook is no coded value, so its bundle is refused.
    assert events == {"E2"}
    assert stored.read_table(spark, root, "participants").count() == 1
    rejects = stored.read_table(spark, root, "rejects")
    assert rejects.filter("array_contains(errors, 'Event has already been uploaded')").count() >= 1
    # The same batch of the same stream again changes nothing; nor does one that breaks off.
    names = ("participants", "participant_events", "events", "rejects")
    before = {n: sorted(map(str, stored.read_table(spark, root, n).collect())) for n in names}
    files = spark.createDataFrame([("again.xlsx", bytearray(make_workbook())), ("y.xlsx", bytearray(book))], "path string, content binary")
    version = stored.versions(spark, root)
    file_arrival.process(files, root, 0, str(tmp_path / "cp0"))
    assert stored.versions(spark, root) == version
    with pytest.raises(Exception, match="broken"):
        file_arrival.process(files.withColumn("content", F.raise_error(F.lit("broken")).cast("binary")), root, 1, str(tmp_path / "cp0"))
    assert {n: sorted(map(str, stored.read_table(spark, root, n).collect())) for n in names} == before
    assert file_arrival.process(files, root, 1, str(tmp_path / "cp0")).count() > len(before["rejects"])
    assert isinstance(stored.read_table(spark, root, "events").first()["start_date"], datetime)


def test_kinds_of_content_that_nobody_reads_are_not_handed_on(spark):
    files = spark.createDataFrame([("a.xlsx", make_workbook()), ("bad.xlsx", b"no zip")], "path string, content binary")
    whole = workbooks.read_workbooks(files)
    some = workbooks.staged(files, kinds=("sheet", "cell"))
    assert {r["kind"] for r in some.collect()} == {"sheet", "cell", "reject"}
    for kind in ("sheet", "cell", "reject"):
        assert some.filter(F.col("kind") == kind).collect() == whole.filter(F.col("kind") == kind).collect()


def test_headers_come_from_one_pass_over_the_files(spark, countries, monkeypatch):
    files = spark.createDataFrame([("a.xlsx", make_workbook()), ("bad.xlsx", b"no zip")], "path string, content binary")
    monkeypatch.setattr(catalog_jobs, "event_files", lambda t: files)
    monkeypatch.setattr(catalog_jobs, "land_labels", lambda t: countries)
    found = catalog_jobs.workbook_headers(None)
    assert [(r["path"], r["eid"], r["place"]) for r in found.collect()] == [("a.xlsx", "E1", "Zagreb")]
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()


def countries_workbook():
    """Three attendees, two of whom name the same countries, and one without an online entry."""
    main, overview, listed, online = (sample_workbooks.Sheet(t) for t in ("Participants", "COST Overview", "List", "MAIN ONLINE"))
    header = ["Name and Last Name", "Travel", "Traveling from", "Grade (0 - BL, 1 - Pass, 2 - Excel)"]
    top = main.table("tableKos", 4, [header, ["Doe, John", "Bus", None, 2], ["Roe, Ann", None, None, 1], ["Poe, Eve", None, None, "x"]])
    main.table("tableAlb", top, [header, ["Coe, Sue", "Bus", None, 0]])
    listed.table("ParticipantsLista", 1, [["Name (Latin)", "Position", "Phone", "Email"], ["DOE, John", "Chief", None, None]])
    rows = [
        ["John", None, "Doe", "Mr", None, "North Macedonia", "Kosovo; north maced", "Dieta"],
        ["Ann", None, "Roe", "Ms", None, "North Macedonia", "Kosovo; north maced", None],
        ["Sue", None, "Coe", "Ms", None, "Nowhere", None, "other"],
    ]
    online.table("ParticipantsList", 1, [[*ONLINE[:5], " COUNTRY of Birth", "Citizenship(s)", "Organization"], *rows])
    return sample_workbooks.workbook([main, overview, listed, online])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([("C117", "Kosovo, Europe & Eurasia", None, 1), ("C181", "North Macedonia", None, 2)], COUNTRIES)


def test_countries_of_attendees_are_resolved_once_for_the_same_texts(spark, labels):
    files = spark.createDataFrame([("a.xlsx", countries_workbook()), ("b.xlsx", countries_workbook())], "path string, content binary")
    phrases = spark.createDataFrame([("dieta", "en", "diet", "es")], "phrase string, lang string, translated string, source_lang string")
    found = workbook_import.attendees(workbooks.staged(files), labels, people(spark), phrases)
    told = [(r["path"], r["name"], r["representing_country"], r["birth_country"], r["citizenships"], r["organization"]) for r in found.collect()]
    alb = "Albania, Europe & Eurasia"
    assert sorted(told) == [
        row
        for path in ("a.xlsx", "b.xlsx")
        for row in [
            (path, "Ann ROE", "C117", "C181", ["C117", "C181"], ""), (path, "Eve POE", "C117", "C117", [], ""),
            (path, "John DOE", "C117", "C181", ["C117", "C181"], "diet"), (path, "Sue COE", alb, alb, [], "other"),
        ]
    ]
    # What attendees say is neither taken apart again for every attendee nor shuffled by its texts.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" not in plan


def test_labels_of_a_dry_run_are_resolved_before_the_people_are_joined(spark, labels):
    files = spark.createDataFrame([("a.xlsx", countries_workbook())], "path string, content binary")
    known = people(spark, {"pid": "P0001", "name": "John DOE", "representing_country": "C117", "ord": 1})
    found = workbook_import.dry_run(workbooks.staged(files), labels, known)
    told = {r["name"]: (r["representing_country"], r["position"], r["pid"], r["status"]) for r in found.collect()}
    assert told["John DOE"] == ("C117", "Chief", "P0001", "EXIST") and told["Ann ROE"] == ("C117", "", None, "NEW")
    assert told["Sue COE"] == ("Albania, Europe & Eurasia", "", None, "NEW")
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_exact_headers_ignore_case_and_blanks_and_the_first_counts(spark):
    rows = spark.createDataFrame(
        [({"B": "0", " Name": "1", "NAME ": "2"}, ["B", None, " Name", "NAME "]), ({"Name": "3"}, None), ({"Surname": "4"}, ["Surname"])],
        "cells map<string,string>, headers array<string>",
    )
    found = workbooks.resolve_headers(rows, {"n": "name", "b": "b"}, exact=True)
    assert found.columns == ["cells", "headers", "n", "b"]
    assert [(r["n"], r["b"]) for r in found.collect()] == [("1", "0"), (None, None), (None, None)]


def with_rows(rows: str, frame: str = "<sheetData>{}</sheetData>") -> bytes:
    """The workbook of the tests with the given XML as the rows of its last sheet."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(make_workbook())) as old, zipfile.ZipFile(out, "w") as new:
        last = sorted(n for n in old.namelist() if n.startswith("xl/worksheets/sheet"))[-1]
        for name in old.namelist():
            data = old.read(name).decode()
            if name == last:
                head, _, rest = data.partition("<sheetData>")
                data = head + frame.format(rows) + rest.partition("</sheetData>")[2]
            new.writestr(name, data)
    return out.getvalue()


def told(data: bytes) -> list:
    rows = []
    try:
        for row in xlsx.content(data):
            rows.append(row)
    except Exception as problem:  # noqa: BLE001
        rows.append(f"{type(problem).__name__}: {problem}")
    return rows


_HEADS = '<row r="1"><c r="A1" t="inlineStr"><is><t>Name</t></is></c><c r="C1" t="str"><v>Last name</v></c></row>'


@pytest.mark.parametrize(
    "rows",
    [
        '<row r="2" spans="1:3"><c r="A2" t="inlineStr"><is><t xml:space="preserve"> A &amp;lt; &lt;B&gt; </t></is></c><c r="C2" s="1"><v>1.5</v></c></row>',
        '<row r="2"><c r="A2" s="3"/><c r="C2"><f>1+1</f><v>2</v></c></row><row r="3" s="1" customFormat="1"/><row r="4"><c r="B4" t="b"><v>1</v></c></row>',
        '<row r="2"><c r="A2" t="inlineStr"><v>x</v></c><c r="B2" t="str"><is><t>x</t></is></c><c r="C2" t="e"><v></v></c></row>',
        '<row r="2"><c r="A2" t="s"><v>7</v></c></row>',
        '<row r="2"><c r="A2"><v>1e3</v></c><c r="C2"><v>one</v></c></row>',
        '<row r="2" x14ac:dyDescent="0.25"><c r="A2"><v>1</v></c></row>',
        '<row r="2"><c r="A2"><v>1</v></c>', '<row r="2"><row r="3"></row></row>', '</row><row r="2">', '<c r="A2"><v>1</v></c>',
        '<row r="2"></row></row><row r="3">', '<row r="2"><c r="A2" t="str"><v>a]]></v></c></row>', '<row r="2"><c r="A2" t="str"><v>&b;</v></c></row>',
        '<row r="2"><c r="A2" t="str"><v>a\x01</v></c></row>', '<row r="2"><c r="A2" t="str"><v>\uffff</v></c></row>', '<row r="2"><c r="A2" t="str"><v>a\r\nž</v></c></row>',
        '<row r="2"><!-- <c r="A2"><v>1</v></c> --></row>', '<row r="2"><c r="A2"><is><r><t>rich</t></r></is></c></row>', 'text<row></row>', "",
    ],
)
def test_plain_rows_are_told_as_the_tree_tells_them(monkeypatch, rows):
    data = with_rows(_HEADS + rows)
    found = told(data)
    monkeypatch.setattr(xlsx, "_plain", lambda data: None)
    assert found == told(data) and len(found) > 10


def test_frames_that_are_not_plain_are_read_as_trees(monkeypatch):
    row = _HEADS + '<row r="2"><c r="A2"><v>1</v></c></row>'
    frames = [
        "<?x <sheetData>{0}</sheetData> ?><sheetData>{0}{0}</sheetData>", "<!-- <sheetData></sheetData> --><sheetData>{0}</sheetData>",
        '<sheetData xmlns="urn:x">{0}</sheetData>', '<x xmlns="urn:x"><sheetData>{0}</sheetData></x>', "<sheetData>{0}</sheetData><row/>",
        "<x><sheetData>{0}</sheetData></x>", "<sheetData>{0}</sheetData><![CDATA[<row>]]>",
    ]
    books = [with_rows(row, frame) for frame in frames]
    found = [told(book) for book in books]
    monkeypatch.setattr(xlsx, "_plain", lambda data: None)
    assert found == [told(book) for book in books]


def test_plain_rows_are_not_made_into_trees(monkeypatch):
    trees, made = [], xlsx._tree
    monkeypatch.setattr(xlsx, "_tree", lambda data: trees.append(made(data)) or trees[-1])
    kinds = Counter(row["kind"] for row in xlsx.content(make_workbook()))
    assert kinds["row"] > 0 and kinds["cell"] == 3
    assert not [node for tree in trees for node in tree.iter() if node.tag.endswith(("}row", "}c"))]


def test_maps_of_a_batch_keep_what_is_missing_and_what_is_empty():
    rows = [{"path": "a", "kind": "row", "cells": {"x": "1", "y": None}, "types": {}, "headers": ["x"]}, {"path": "b", "kind": "sheet"}, {"path": None, "kind": "cell", "cells": {"z": "ž"}}]
    found = workbooks._batch(rows).to_pylist()
    assert [r["cells"] for r in found] == [[("x", "1"), ("y", None)], None, [("z", "ž")]]
    assert [r["types"] for r in found] == [[], None, None] and [r["headers"] for r in found] == [["x"], None, None]


def test_written_workbooks_are_sound_archives():
    book = sample_workbooks.workbook([sample_workbooks.Sheet("A & B")], ("<a>ž</a>",))
    with zipfile.ZipFile(io.BytesIO(book)) as parts:
        assert parts.testzip() is None
        assert parts.namelist() == ["xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/worksheets/sheet1.xml", "customXml/item1.xml"]
        assert parts.read("customXml/item1.xml").decode() == "<a>ž</a>"
