"""Whole jobs: workbook import, embedded records, bulk load, preview and upload."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, functions as F

from rollbook.operators import validate
from rollbook.plans import bulk_load, upload, workbook_import
from rollbook.plans.bindings import Tables
from rollbook.plans.catalog import query
from rollbook.plans.catalog_match import known_phrases, lands
from rollbook.plans.catalog_read import days
from rollbook.plans.catalog_text import choose
from rollbook.plans.sample_workbooks import Sheet, workbook, workbook_files
from rollbook.schemas import COUNTRY_TABLES, EVENTS, PARTICIPANT_EVENTS, PARTICIPANTS
from rollbook.sources import preview, workbooks

#: Customers per workbook: an event with more of them becomes several workbooks.
PER_FILE = 2000

_TABLES = list(COUNTRY_TABLES)
_TRAVEL = ["Name and Last Name", "Travel", "Traveling from", "Grade (0 - BL, 1 - Pass, 2 - Excel)"]
_LISTED = ["No.", "Name (LAST, First, Middle)", "Position", "Phone", "email"]
_ONLINE = [
    "Name", "Middle name", "Last name", "Gender", "Date of Birth (DOB)", "Country of Birth", "Citizenship(s)",
    "Traveling document type", "Transportation", "Traveling from", "Organization",
]


def _country_table(no: int, people: list[dict]) -> list[list]:
    """Attendees of one country; the last table has no Travel column."""
    rows = []
    for p in people:
        k = p["k"]
        name = f"Smith{k}, Ann  Mary" if k % 3 == 0 else f"Ann Mary Smith{k}"
        grade = k % 4 if k % 4 < 3 else "x"
        rows.append([name, "Bus" if k % 2 else None, None if k % 5 else "Split", grade])
    rows.append(["TOTAL", None, None, len(people)])
    table = [_TRAVEL, *rows]
    return [[r[0], *r[2:]] for r in table] if no == 6 else table


def build_workbook(row: dict) -> bytes:
    """The workbook of one event, from a row with its header texts and its people."""
    people = [p if isinstance(p, dict) else p.asDict() for p in row["people"]]
    main, cost, listed, online = Sheet("Participants"), Sheet("COST Overview"), Sheet("List"), Sheet("MAIN ONLINE")
    main.put(1, 1, row["a1"])
    main.put(2, 1, row["a2"])
    cost.put(15, 2, row["cost"])
    top = 4
    for no, name in enumerate(_TABLES):
        group = [p for p in people if p["k"] % 7 == no]
        if group:
            top = main.table(name, top, _country_table(no, group))
    listed.table(
        "ParticipantsLista",
        1,
        [_LISTED]
        + [
            [i, f"Smith{p['k']}, Ann Mary", f" {p['segment']} ", f"00385 {p['k']:08d}", f"u{p['k']}@example.org"]
            for i, p in enumerate(people, 1)
            if p["k"] % 4 != 1
        ],
    )
    online.table(
        "ParticipantsList",
        2,
        [_ONLINE]
        + [
            [
                "Ann", "Mary", f"Smith{p['k']}", "Ms.", 20000 + p["k"] % 9000, "Kosovo, World", "NATION_9; R. Serbia",
                "Passport no", "Air", "Zadar", "Dieta vegetariana",
            ]
            for p in people
            if p["k"] % 5 != 2
        ],
    )
    return workbook([main, cost, listed, online])


def event_files(t: Tables) -> DataFrame:
    """One workbook per event and block of customers, over all order lines."""
    pairs = (
        t.raw("lineitem")
        .select("l_orderkey", "l_partkey")
        .join(t.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select("l_partkey", "o_custkey")
        .distinct()
        .join(t.raw("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    )
    person = F.struct(F.col("o_custkey").alias("k"), "segment")
    grouped = pairs.groupBy("l_partkey", F.floor(F.col("o_custkey") / PER_FILE).alias("block")).agg(
        F.array_sort(F.collect_list(person)).alias("people")
    )
    rows = grouped.join(t.raw("part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.format_string("up/PFE25M%d-%d-%d.xlsx", F.col("p_partkey") % 10, "p_partkey", "block").alias("path"),
        F.format_string("E%05d %s", "p_partkey", "p_name").alias("a1"),
        F.format_string("JUNE %d - 28 - %s, NATION_9", F.col("p_partkey") % 28 + 1, "p_brand").alias("a2"),
        F.col("p_retailprice").alias("cost"),
        "people",
    )
    return workbook_files(rows, build_workbook)


def land_labels(t: Tables) -> DataFrame:
    """Countries of which one is named like its workbook table."""
    name = F.when(F.col("ord") == 3, "Kosovo, Europe & Eurasia").otherwise(F.col("country"))
    return lands(t).withColumn("country", name)


def known_people(t: Tables) -> DataFrame:
    """Stored people with the names of the workbooks, for every customer."""
    k = F.col("c_custkey")
    serial = F.date_add(F.lit("1899-12-30").cast("date"), (20000 + k % 9000).cast("int"))
    label = F.when(F.lit(False), "")
    for no, text in enumerate(COUNTRY_TABLES.values()):
        label = label.when(k % 7 == no, "C003" if no == 3 else text)
    return t.raw("customer").select(
        F.format_string("P%04d", k).alias("pid"),
        F.format_string("Ann Mary SMITH%d", k).alias("name"),
        label.alias("representing_country"),
        F.when(k % 6 == 0, F.lit("1970-01-01").cast("date")).when(k % 6 < 4, serial).alias("dob"),
        k.alias("ord"),
    )


_FILES = """select distinct l_partkey, o_custkey k, o_custkey // 2000 block from lineitem join orders on l_orderkey = o_orderkey"""
_PATH = "printf('up/PFE25M%d-%d-%d.xlsx', l_partkey % 10, l_partkey, block)"
_LABEL = "case k % 7 " + " ".join(f"when {i} then '{'C003' if i == 3 else n}'" for i, n in enumerate(COUNTRY_TABLES.values())) + " end"
_BOOKS = f"select distinct l_partkey, block from ({_FILES})"


@query(
    "workbook_sheets",
    "",
    f"""select {_PATH} path, sheet, sheet_no from ({_BOOKS}), (values ('Participants', 1), ('COST Overview', 2), ('List', 3),
    ('MAIN ONLINE', 4)) s(sheet, sheet_no)""",
)
def workbook_sheets(t: Tables) -> DataFrame:
    return workbooks.workbook_sheets(workbooks.read_workbooks(event_files(t), "sheet")).drop("part")


@query(
    "workbook_tables",
    "",
    f"""select {_PATH} path, name_norm, count(*) n_tables from (select distinct l_partkey, block, 'table' ||
    ['alb', 'bih', 'cro', 'kos', 'mne', 'nmk', 'ser'][k % 7 + 1] name_norm from ({_FILES})
    union all select l_partkey, block, 'participantslista' from ({_BOOKS})
    union all select l_partkey, block, 'participantslist' from ({_BOOKS})) group by l_partkey, block, name_norm""",
)
def workbook_tables(t: Tables) -> DataFrame:
    found = workbooks.workbook_tables(workbooks.read_workbooks(event_files(t), "table"))
    return found.groupBy("path", "name_norm").agg(F.count(F.lit(1)).alias("n_tables"))


@query(
    "workbook_rows",
    "",
    f"""select {_PATH} path, 'participantslista' name_norm, printf('Smith%d, Ann Mary', k) first_cell, 5 filled from ({_FILES}) where k % 4 <> 1
    union all select {_PATH}, 'participantslist', 'Ann', 11 from ({_FILES}) where k % 5 <> 2""",
)
def workbook_rows(t: Tables) -> DataFrame:
    rows = workbooks.table_rows(workbooks.read_workbooks(event_files(t), "row"))
    named = workbooks.rows_of(rows, "ParticipantsLista", "ParticipantsList")
    first = F.coalesce(*[F.try_element_at("cells", F.lit(h)) for h in ("Name (LAST, First, Middle)", "Name")])
    return named.select("path", "name_norm", first.alias("first_cell"), F.size("cells").alias("filled"))


@query(
    "workbook_headers",
    "",
    f"""select {_PATH} path, printf('E%05d', l_partkey) eid, p_name title, printf('2025-06-%02d', l_partkey % 28 + 1) start_date,
    '2025-06-28' end_date, p_brand place, 'C009' country, p_retailprice as cost from ({_BOOKS}) join part on p_partkey = l_partkey""",
)
def workbook_headers(t: Tables) -> DataFrame:
    content = workbooks.staged(event_files(t), kinds=("cell",))
    return days(workbook_import.event_records(content, land_labels(t)), "start_date", "end_date").drop("type")


@query(
    "workbook_checks",
    "",
    f"""select {_PATH} path, true ok, 0 missing, count(distinct k % 7)::int + 2 seen from ({_FILES}) group by l_partkey, block""",
)
def workbook_checks(t: Tables) -> DataFrame:
    content = workbooks.staged(event_files(t), kinds=("sheet", "table", "cell", "record"))
    checks = validate.check_workbooks(
        workbooks.workbook_sheets(content), workbooks.workbook_tables(content), workbooks.event_headers(content),
        workbooks.custom_xml_records(content),
    )
    return checks.select("path", "ok", F.size("missing").alias("missing"), F.size("seen").alias("seen"))


_DOB = "strftime(date '1899-12-30' + (20000 + k % 9000)::int, '%Y-%m-%d')"


@query(
    "import_attendees",
    "",
    f"""select {_PATH} path, printf('Ann Mary SMITH%d', k) as name, {_LABEL} representing_country,
    case when k % 7 = 6 then case when k % 5 <> 2 then 'Air' else '' end when k % 2 = 1 then 'Bus' else '' end transportation,
    case when k % 5 = 0 then 'Split' when k % 5 <> 2 then 'Zadar' else '' end traveling_from,
    case k % 4 when 0 then 0 when 1 then 1 when 2 then 2 else 1 end grade,
    case when k % 4 <> 1 then c_mktsegment else '' end as position,
    case when k % 4 <> 1 then '+385' || lpad(k::varchar, 8, '0') else '' end phone,
    case when k % 4 <> 1 then 'u' || k || '@example.org' else '' end email,
    case when k % 5 <> 2 then 'Female' else '' end gender, case when k % 5 <> 2 then {_DOB} else '' end dob,
    case when k % 5 <> 2 then 'C003' else {_LABEL} end birth_country, case when k % 5 <> 2 then 'C009,C006' else '' end citizenships,
    case when k % 5 <> 2 then 'Passport' else 'ID Card' end travel_doc_type,
    case when k % 5 <> 2 then 'vegetarian diet' else '' end organization,
    case when k % 6 in (4, 5) or (k % 6 <> 0 and k % 5 <> 2) then printf('P%04d', k) end pid
    from ({_FILES}) join customer on c_custkey = k""",
)
def import_attendees(t: Tables) -> DataFrame:
    content = workbooks.staged(event_files(t), kinds=("row",))
    found = workbook_import.attendees(content, land_labels(t), known_people(t), known_phrases(t))
    return found.select(
        "path", "name", "representing_country", "transportation", "traveling_from", "grade", "position", "phone", "email",
        "gender", "dob", "birth_country", F.array_join("citizenships", ",").alias("citizenships"), "travel_doc_type",
        "organization", "pid",
    )


@query(
    "import_dry_run",
    "",
    f"""select {_PATH} path, printf('Ann Mary SMITH%d', k) as name, case k % 4 when 3 then 'x' else (k % 4)::varchar end grade,
    case when k % 4 <> 1 then c_mktsegment else '' end as position, case when k % 6 in (4, 5) then printf('P%04d', k) end pid,
    case when k % 6 in (4, 5) then 'EXIST' else 'NEW' end status from ({_FILES}) join customer on c_custkey = k
    union all select {_PATH}, 'TOTAL', count(*)::varchar, '', null, 'NEW' from ({_FILES}) group by l_partkey, block, k % 7""",
)
def import_dry_run(t: Tables) -> DataFrame:
    content = workbooks.staged(event_files(t), kinds=("row",))
    found = workbook_import.dry_run(content, land_labels(t), known_people(t))
    return found.select("path", "name", "grade", "position", "pid", "status")


# --- embedded records ----------------------------------------------------------------

_PERSON_XML = """<participant><pid>P{k:04d}</pid><representing_country>C{n:03d}</representing_country><gender>{g}</gender>
<grade>{grade}</grade><name>Ann Smith{k}</name><dob>{dob}</dob><pob>Split</pob><birth_country>C001</birth_country>
<citizenships>C001</citizenships><citizenships>C002; C001</citizenships><intl_authority>Yes</intl_authority><phone>{phone}</phone></participant>"""
_VISIT_XML = """<participant_event><event_id>E{e:05d}</event_id><participant_id>P{k:04d}</participant_id>
<transportation>{move}</transportation><traveling_from>Split</traveling_from><returning_to>Zadar</returning_to>
<travel_doc_type>Passport</travel_doc_type><travel_doc_issue_date>2020-01-15</travel_doc_issue_date></participant_event>"""


def build_embedded(row: dict) -> bytes:
    """A workbook whose content is one custom XML part."""
    people = [p if isinstance(p, dict) else p.asDict() for p in row["people"]]
    part = [f"<event><eid>E{row['e']:05d}</eid><title>{escape(row['title'])}</title><start_date>2024-07-01</start_date><type>training</type><cost>12.5</cost></event>"]
    for p in people:
        k = p["k"]
        part.append(
            _PERSON_XML.format(
                k=k, n=p["nation"], g="mr." if k % 2 else "x" if k % 10 == 0 else "F", grade=k % 4,
                dob="someday" if k % 7 == 3 else "5.1.1990", phone="123" if k % 11 == 4 else "00385 1234567",
            )
        )
        part.append(_VISIT_XML.format(e=row["e"], k=k, move="Other" if k % 5 == 1 else "Air (Airplane)"))
    return workbook([Sheet("Notes")], (f"<data>{''.join(part)}</data>", "<broken>"))


def embedded_files(t: Tables) -> DataFrame:
    """One file per nation and block of customers, with the records of those customers."""
    person = F.struct(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    grouped = (
        t.raw("customer")
        .groupBy("c_nationkey", F.floor(F.col("c_custkey") / PER_FILE).alias("block"))
        .agg(F.array_sort(F.collect_list(person)).alias("people"))
    )
    rows = grouped.select(
        F.format_string("xml/%d-%d.xlsx", "c_nationkey", "block").alias("path"),
        (F.col("c_nationkey") + 100 * F.col("block")).alias("e"),
        F.lit("A & B").alias("title"),
        "people",
    )
    return workbook_files(rows, build_embedded)


_XML_PATH = "printf('xml/%d-%d.xlsx', c_nationkey, c_custkey // 2000)"


@query(
    "custom_xml_records",
    "",
    f"""select {_XML_PATH} path, 'participant' record, printf('P%04d', c_custkey) key, 'C001; C002; C001' citizenships from customer
    union all select {_XML_PATH}, 'participant_event', printf('P%04d', c_custkey), null from customer
    union all select distinct {_XML_PATH}, 'event', null, null from customer""",
)
def custom_xml_records(t: Tables) -> DataFrame:
    records = workbooks.custom_xml_records(workbooks.read_workbooks(embedded_files(t)))
    field = {n: F.try_element_at("fields", F.lit(n)) for n in ("pid", "participant_id", "citizenships")}
    return records.select(
        "path", "record", F.coalesce(field["pid"], field["participant_id"]).alias("key"),
        field["citizenships"].alias("citizenships"),
    )


_XML_BAD = "(k % 7 = 3 or k % 11 = 4 or (k % 2 = 0 and k % 10 = 0))"


@query(
    "xml_attendees",
    "",
    f"""select {_XML_PATH} path, printf('P%04d', k) pid, printf('Ann SMITH%d', k) as name, case when k % 2 = 1 then 'Male' else 'Female' end gender,
    case when k % 4 = 3 then 1 else (k % 4)::int end grade, '1990-01-05' dob, '+3851234567' phone, 'C001,C002' citizenships, true intl_authority,
    printf('E%05d', c_nationkey + 100 * (k // 2000)) event_id, 'Air (Airplane)' transportation, '2020-01-14 23:00' issued
    from (select *, c_custkey k from customer) where not {_XML_BAD} and k % 5 <> 1""",
)
def xml_attendees(t: Tables) -> DataFrame:
    found = workbook_import.embedded_records(workbooks.staged(embedded_files(t)))
    return days(found.attendees, "dob").select(
        "path", "pid", "name", "gender", "grade", "dob", "phone", F.array_join("citizenships", ",").alias("citizenships"),
        "intl_authority", "event_id", "transportation",
        F.date_format("travel_doc_issue_date", "yyyy-MM-dd HH:mm").alias("issued"),
    )


@query(
    "xml_rejects",
    "",
    f"""select {_XML_PATH} path, 'participant' record, count(*) n from (select *, c_custkey k from customer) where {_XML_BAD} group by 1
    union all select {_XML_PATH}, 'participant_event', count(*) from customer where c_custkey % 5 = 1 group by 1""",
)
def xml_rejects(t: Tables) -> DataFrame:
    found = workbook_import.embedded_records(workbooks.staged(embedded_files(t)))
    return found.rejects.groupBy("path", "record").agg(F.count(F.lit(1)).alias("n"))


# --- bulk load -----------------------------------------------------------------------

_NAME = ("'Ann  smith'", "'BOB SMITH'", "'Eva'", "'Smith, Jo'")
_REP = ("'NATION_1'", "'c004'", "'Newland'", "' nation_2 '")


def sheets(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three flat sheets: orders are participant rows, nations countries, parts events."""
    k, c = "o_orderkey", "o_custkey"
    people = t.raw("orders").select(
        (F.col(k) + 1).alias("row_no"),
        F.concat(choose(c, *_NAME), F.lit(" "), F.floor(F.col(c) / 4).cast("string"), F.lit("x")).alias("Name"),
        choose(c, *_REP).alias("Representing Country"),
        F.when(F.col(k) % 97 != 5, choose(k, "'Male'", "'f'", "'Ms'")).alias("Gender"),
        (F.col(k) % 4).cast("string").alias("Grade"),
        F.lit("1980-05-06").alias("DOB"),
        F.col("o_orderpriority").alias("Position"),
        F.when(F.col(k) % 3 == 0, "NATION_5, Newland").alias("Citizenships"),
        F.when(F.col(k) % 5 != 0, F.format_string("E%05d", F.col(k) % 300)).alias("Event"),
        F.when(F.col(k) % 2 == 0, "air (AIRPLANE)").alias("Transportation"),
        F.when(F.col(k) % 7 == 0, F.col("o_orderstatus")).alias("Traveling From"),
        F.lit("00385 1 2345678").alias("Phone"),
    )
    countries = t.raw("nation").select(
        (F.col("n_nationkey") + 1).cast("bigint").alias("row_no"), F.col("n_name").alias("Country"),
        F.when(F.col("n_nationkey") % 2 == 0, F.format_string("c%03d", F.col("n_nationkey") + 1)).alias("CID"),
    )
    events = t.raw("part").select(
        (F.col("p_partkey") + 1).alias("row_no"),
        F.format_string("E%05d", F.col("p_partkey")).alias("Event"),
        F.col("p_name").alias("Title"),
        F.concat(F.col("p_brand"), F.lit(", nation_7")).alias("Location"),
        F.when(F.col("p_partkey") % 6 != 0, F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 150).cast("int")), "dd.MM.yyyy")).alias("Date From"),
        F.col("p_retailprice").cast("string").alias("Cost"),
    )
    return people, countries, events


_ROWS = f"""select o_orderkey + 1 row_no, o_custkey, o_orderpriority prio, o_orderkey k,
    case o_custkey % 4 when 0 then 'Ann smith ' || o_custkey // 4 || 'X' when 1 then 'BOB SMITH ' || o_custkey // 4 || 'X'
     when 2 then 'Eva ' || o_custkey // 4 || 'X' else 'Smith, Jo ' || o_custkey // 4 || 'X' end as name,
    case o_custkey % 4 when 0 then 'C002' when 1 then 'C004' when 2 then 'C026' else 'C003' end rep,
    case o_orderkey % 3 when 1 then 'Female' else 'Male' end gender,
    case when o_orderkey % 4 = 3 then 1 else (o_orderkey % 4)::int end grade,
    case when o_orderkey % 5 <> 0 then printf('E%05d', o_orderkey % 300) end event_id,
    case when o_orderkey % 5 <> 0 and (o_orderkey % 300) % 6 <> 0 and exists (select 1 from part where p_partkey = o_orderkey % 300)
     then date '2020-01-01' + ((o_orderkey % 300) % 150)::int end d,
    case when o_orderkey % 3 = 0 then 1 else 0 end extra from orders where o_orderkey % 97 <> 5"""


@query(
    "bulk_load_participants",
    "",
    f"""select printf('P%04d', row_number() over (order by min(row_no))) pid, any_value(case when name like 'Smith,%' then name[8:] || ' SMITH' else name end) as name, rep representing_country,
    arg_max(prio, (coalesce(d, date '0001-01-01'), -row_no)) as position, arg_max(grade, (coalesce(d, date '0001-01-01'), -row_no)) grade,
    arg_max(gender, (coalesce(d, date '0001-01-01'), -row_no)) gender,
    arg_max(row_no, (coalesce(d, date '0001-01-01'), -row_no)) + 1 source_row, '+38512345678' phone,
    case when max(extra) = 0 then rep when rep = 'C026' then case when min(row_no) filter (extra = 1) <= min(row_no)
       then 'C006,C026' else 'C026,C006' end
     when min(extra) = 1 then 'C006,C026' when min(row_no) filter (extra = 1) < min(row_no) filter (extra = 0) then 'C006,C026,' || rep
     else rep || ',C006,C026' end citizenships
    from ({_ROWS}) group by lower(name), rep""",
)
def bulk_load_participants(t: Tables) -> DataFrame:
    result = bulk_load.load(*sheets(t), now=F.lit("2025-01-01"))
    return result.participants.select(
        "pid", "name", "representing_country", "position", "grade", "gender",
        F.element_at("_audit", 1)["source"]["row"].alias("source_row"), "phone",
        F.array_join("citizenships", ",").alias("citizenships"),
    )


@query(
    "bulk_load_snapshots",
    "",
    f"""select pid, event_id, case when bool_or(k % 2 = 0) then 'Air (Airplane)' else 'Other' end transportation,
    case when not bool_or(k % 2 = 0) then 'Unspecified' end transport_other, 'Passport' travel_doc_type,
    coalesce(arg_max(st, row_no) filter (k % 7 = 0), 'Unknown') traveling_from
    from (select *, (select o_orderstatus from orders where o_orderkey = k) st from ({_ROWS}))
    join (select lower(name) ln, rep, printf('P%04d', row_number() over (order by min(row_no))) pid from ({_ROWS}) group by 1, 2) n
    on n.ln = lower(name) and n.rep = _0.rep where event_id is not null group by 1, 2""".replace("_0.rep", "r.rep").replace(
        f"from ({_ROWS}))\n    join", f"from ({_ROWS})) r\n    join"
    ),
)
def bulk_load_snapshots(t: Tables) -> DataFrame:
    result = bulk_load.load(*sheets(t), now=F.lit("2025-01-01"))
    return result.participant_events.select(
        F.col("participant_id").alias("pid"), "event_id", "transportation", "transport_other", "travel_doc_type", "traveling_from"
    )


@query(
    "bulk_load_events",
    "",
    f"""select printf('E%05d', p_partkey) eid, p_name title, p_brand place, 'C008' country, 'Training' "type", p_retailprice as cost,
    case when p_partkey % 6 <> 0 then strftime(date '2020-01-01' + (p_partkey % 150)::int, '%Y-%m-%d') end start_date,
    coalesce(roster, '') roster from part left join
    (select event_id, string_agg(distinct pid, ',' order by pid) roster from ({_ROWS}) r
     join (select lower(name) ln, rep, printf('P%04d', row_number() over (order by min(row_no))) pid from ({_ROWS}) group by 1, 2) n
     on n.ln = lower(name) and n.rep = r.rep where event_id is not null group by 1) on event_id = printf('E%05d', p_partkey)""",
)
def bulk_load_events(t: Tables) -> DataFrame:
    result = bulk_load.load(*sheets(t), now=F.lit("2025-01-01"))
    roster = F.array_join("participants", ",").alias("roster")
    return days(result.events, "start_date").select("eid", "title", "place", "country", "type", "cost", "start_date", roster)


@query(
    "bulk_load_rejects",
    "",
    """select 'row' record, (o_orderkey + 2)::varchar key, 'Row ' || (o_orderkey + 2) || ': missing mandatory field ''Gender''' errors
    from orders where o_orderkey % 97 = 5""",
)
def bulk_load_rejects(t: Tables) -> DataFrame:
    result = bulk_load.load(*sheets(t), now=F.lit("2025-01-01"))
    return result.rejects.withColumn("errors", F.array_join("errors", ";"))


# --- preview and upload --------------------------------------------------------------

_MOVE = ("'Air (Airplane)'", "'Other'", "'Air (Airplane)'", "'Personal Vehicle (POV)'")


def bundles(t: Tables) -> DataFrame:
    """A preview bundle per order, whose attendees are the order's lines."""
    lines = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    person = F.col("l_suppkey")
    number = F.floor(F.col("l_linenumber") * 100000 + F.col("l_partkey"))
    attendees = lines.select(
        "o_orderkey",
        (F.row_number().over(_within_order())).cast("bigint").alias("row_no"),
        F.format_string("Jane Doe%d", person).alias("name"),
        F.lit("C001").alias("representing_country"),
        F.when(F.col("o_orderkey") % 50 == 7, "x").otherwise("Female").alias("gender"),
        F.lit("1").alias("grade"),
        F.format_string("19%02d-01-01", 10 + person % 90).alias("dob"),
        F.lit("Zagreb").alias("pob"),
        F.lit("C001").alias("birth_country"),
        F.array(F.lit("C001")).alias("citizenships"),
        F.format_string("00385%09d", number).alias("phone"),
        F.lit("Air (Airplane)").alias("transportation"),
        F.lit("Zagreb").alias("traveling_from"),
        F.lit("Zagreb").alias("returning_to"),
        F.lit("Passport").alias("travel_doc_type"),
    )
    events = t.raw("orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 41 != 3, F.format_string("N%06d", "o_orderkey")).alias("eid"),
        F.col("o_orderpriority").alias("title"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("end_date"),
        F.lit("Zagreb").alias("place"),
        F.when(F.col("o_orderkey") % 3 == 0, "Party").otherwise("Workshop").alias("type"),
        F.col("o_totalprice").alias("cost"),
    )
    # Gathered by the key that the lines are dealt by already; the path is made once for each bundle.
    whole = preview.preview_bundles(events, attendees, keys=("o_orderkey",))
    return whole.withColumn("o_orderkey", F.format_string("up/%d", "o_orderkey")).withColumnRenamed("o_orderkey", "path")


def _within_order():
    """Lines of one order in a fixed order; an order has a handful of lines."""
    from pyspark.sql import Window

    return Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")


def stored_janes(t: Tables) -> DataFrame:
    """Stored people for every supplier: by turns with, without and with another date of birth."""
    k = F.col("s_suppkey")
    born = F.format_string("19%02d-01-01", 10 + k % 90).cast("date")
    rows = t.raw("supplier").select(
        F.format_string("P%04d", k).alias("pid"),
        F.format_string("Jane DOE%d", k).alias("name"),
        F.lit("C001").alias("representing_country"),
        F.when(k % 3 == 0, born).when(k % 3 == 1, F.lit("2001-01-01").cast("date")).alias("dob"),
        F.lit("Male").alias("gender"),
        F.lit(2).alias("grade"),
        F.lit("old").alias("position"),
        k.alias("ord"),
    )
    return shaped(rows, PARTICIPANTS)


def shaped(rows: DataFrame, schema) -> DataFrame:
    return rows.select(
        *[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def stored_orders(t: Tables) -> DataFrame:
    """Events that are stored already: every order of one status, under its bundle's eid."""
    rows = t.raw("orders").filter("o_orderstatus = 'P'").select(
        F.format_string("N%06d", "o_orderkey").alias("eid"), F.lit("old").alias("title")
    )
    return shaped(rows, EVENTS)


def uploaded(t: Tables) -> upload.Upload:
    none = shaped(stored_orders(t).filter(F.lit(False)), PARTICIPANT_EVENTS)
    return upload.upload(bundles(t), stored_janes(t), none, stored_orders(t), F.lit("2025-01-01"))


_GOOD = "o_orderkey % 41 <> 3 and o_orderstatus <> 'P'"
_USED = f"""select o_orderkey, l_suppkey, row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 r,
    l_linenumber * 100000 + l_partkey num from lineitem join orders on l_orderkey = o_orderkey
    where {_GOOD} and o_orderkey % 50 <> 7"""
_PIDS = f"""select l_suppkey, case when l_suppkey % 3 <> 1 then printf('P%04d', l_suppkey) else printf('P%04d',
    (select max(s_suppkey) from supplier) + row_number() over (partition by l_suppkey % 3 = 1 order by first_at)) end pid
    from (select l_suppkey, min({{'p': 'up/' || o_orderkey, 'r': r}}) first_at from ({_USED}) group by 1)"""


@query(
    "preview_counts",
    "",
    """select case when o_orderkey % 41 <> 3 then printf('N%06d', o_orderkey) end eid, coalesce(n, 0)::bigint participants_count,
    0::bigint participant_events_count from orders left join (select l_orderkey, count(*) n from lineitem group by 1) on l_orderkey = o_orderkey
    where o_orderkey % 41 <> 3 union all select null, count(l_orderkey)::bigint, 0::bigint from orders left join lineitem on l_orderkey = o_orderkey
    where o_orderkey % 41 = 3""",
)
def preview_counts(t: Tables) -> DataFrame:
    return preview.preview_counts(bundles(t))


@query(
    "upload_participants",
    "",
    f"""select pid, 'Jane DOE' || l_suppkey as name, 'Female' gender, 1 grade, printf('19%02d-01-01', 10 + l_suppkey % 90) dob,
    case when l_suppkey % 3 <> 1 then 'old' end as position, '+385' || lpad(arg_max(num, {{'p': 'up/' || o_orderkey, 'r': r}})::varchar, 9, '0') phone
    from ({_USED}) join ({_PIDS}) using (l_suppkey) group by pid, l_suppkey
    union all select printf('P%04d', s_suppkey), 'Jane DOE' || s_suppkey, 'Male', 2,
     case s_suppkey % 3 when 0 then printf('19%02d-01-01', 10 + s_suppkey % 90) when 1 then '2001-01-01' end, 'old', null
    from supplier where s_suppkey % 3 = 1 or s_suppkey not in (select l_suppkey from ({_USED}))""",
)
def upload_participants(t: Tables) -> DataFrame:
    return days(uploaded(t).participants, "dob").select("pid", "name", "gender", "grade", "dob", "position", "phone")


@query(
    "upload_links",
    "",
    f"""select distinct pid participant_id, printf('N%06d', o_orderkey) event_id, 'Zagreb' traveling_from
    from ({_USED}) join ({_PIDS}) using (l_suppkey)""",
)
def upload_links(t: Tables) -> DataFrame:
    return uploaded(t).participant_events.select("participant_id", "event_id", "traveling_from")


@query(
    "upload_events",
    "",
    f"""select printf('N%06d', o_orderkey) eid, 'old' title, null "type", '' roster from orders where o_orderstatus = 'P'
    union all select printf('N%06d', o_orderkey), o_orderpriority, case when o_orderkey % 3 = 0 then 'Other' else 'Workshop' end, coalesce(roster, '')
    from orders left join (select o_orderkey, string_agg(pid, ',' order by r) roster from ({_USED}) join ({_PIDS}) using (l_suppkey) group by 1)
    using (o_orderkey) where {_GOOD} and (o_orderkey % 50 <> 7 or o_orderkey not in (select l_orderkey from lineitem))""",
)
def upload_events(t: Tables) -> DataFrame:
    roster = F.coalesce(F.array_join("participants", ","), F.lit(""))
    return uploaded(t).events.select("eid", "title", "type", roster.alias("roster"))


@query(
    "upload_rejects",
    "",
    """select printf('up/%d', o_orderkey) path, case when o_orderkey % 41 = 3 then 'Event is missing an eid'
    when o_orderstatus = 'P' then 'Event has already been uploaded' else 'gender unknown' end errors from orders
    where o_orderkey % 41 = 3 or o_orderstatus = 'P' or (o_orderkey % 50 = 7 and o_orderkey in (select l_orderkey from lineitem))""",
)
def upload_rejects(t: Tables) -> DataFrame:
    return uploaded(t).rejects.select("path", F.array_join("errors", ";").alias("errors"))
