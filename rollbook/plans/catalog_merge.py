"""Merges, numbering, carry-forward, validation and keyed changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollbook.operators import merge, mutate, reports, sequence, tables, validate
from rollbook.plans.bindings import Tables
from rollbook.plans.catalog import query
from rollbook.plans.catalog_text import choose, choose_sql
from rollbook.sources.ledger import extract_ledger


@query(
    "newest_wins",
    "",
    """select user_id, event_type, arg_max(value, (d, -event_id)) as value, arg_max(props, (d, -event_id)) props,
    min(event_id) first_id, arg_min(strftime(ts, '%Y-%m-%d'), event_id) first_day from
    (select *, ts::date d from events) group by 1, 2""",
)
def newest_wins(t: Tables) -> DataFrame:
    rows = t.raw("events").withColumns(
        {"day": F.col("ts").cast("date"), "first_day": F.date_format("ts", "yyyy-MM-dd"), "first_id": F.col("event_id")}
    )
    return merge.newest_wins(
        rows, ["user_id", "event_type"], "day", "event_id", ["value", "props"], ["first_id", "first_day"]
    )


@query(
    "citizenship_union",
    "",
    """select user_id, string_agg(item, ',' order by seen) items from (select user_id, item, min(event_id * 2 + pos) seen
    from (select user_id, event_id, unnest([props, event_type]) item, unnest([0, 1]) pos from events)
    group by 1, 2) group by 1""",
)
def citizenship_union(t: Tables) -> DataFrame:
    rows = t.raw("events").select("user_id", "event_id", F.array("props", "event_type").alias("items"))
    united = merge.union_arrays(rows, ["user_id"], "items", "event_id")
    return united.withColumn("items", F.array_join("items", ","))


_BLANKS = ("props", None, "'  '", "event_type")


@query(
    "last_non_blank",
    "",
    f"""select user_id, event_type, arg_max(a, event_id) filter (trim(a) <> '') a,
    arg_max(b, event_id) filter (trim(b) <> '') b, arg_max(value, event_id) as value from
    (select *, {choose_sql('event_id', *_BLANKS)} a, {choose_sql('(event_id + user_id)', *_BLANKS)} b from events)
    group by 1, 2""",
)
def last_non_blank(t: Tables) -> DataFrame:
    rows = t.raw("events").withColumns(
        {"a": choose("event_id", *_BLANKS), "b": choose("(event_id + user_id)", *_BLANKS)}
    )
    return merge.last_non_blank(rows, ["user_id", "event_type"], "event_id", ["a", "b", "value"])


@query(
    "carry_forward",
    "",
    """select event_id, user_id, last_value(case when event_type = 'error' then props end ignore nulls)
    over (partition by user_id order by event_id) header from events""",
)
def carry_forward(t: Tables) -> DataFrame:
    rows = t.raw("events").select(
        "event_id", "user_id", F.when(F.col("event_type") == "error", F.col("props")).alias("header")
    )
    return sequence.carry_forward(rows, ["user_id"], "event_id", "header", block=1000)


_LEDGER_LINES = (
    "'PFE' || lpad(cast(event_id % 30 as varchar(9)), 2, '0') || 'M' || (event_id % 9) || '  ' || event_type",
    "event_id || '. ' || props || ' , x'",
    "event_id || '. Ann - ' || event_type",
    "'note ' || props",
    "event_id || '. Bob – ' || props",
)


@query(
    "ledger",
    "",
    f"""select sheet, row_no, ev as "Event", trim(case when contains(e, ',') then split_part(e, ',', 1)
    when contains(e, ' – ') then split_part(e, ' – ', 1) when contains(e, ' - ') then split_part(e, ' - ', 1) else e end) as "Name",
    trim(case when contains(e, ',') then substr(e, strpos(e, ',') + 1) when contains(e, ' – ') then substr(e, strpos(e, ' – ') + 3)
    when contains(e, ' - ') then substr(e, strpos(e, ' - ') + 3) else '' end) as "Position" from
    (select *, last_value(code ignore nulls) over (partition by sheet order by row_no) ev,
    regexp_extract(line, '^[0-9]+\\.\\s+(.*)', 1) e from
    (select 's' || user_id % 4 sheet, event_id row_no, line, nullif(regexp_extract(line, '^(PFE[0-9]{{2}}M[0-9])\\s', 1), '') code
    from (select *, {choose_sql('event_id', *_LEDGER_LINES)} line from events))) where ev is not null and e <> ''""",
)
def ledger(t: Tables) -> DataFrame:
    rows = t.raw("events").select(
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("sheet"),
        F.col("event_id").alias("row_no"),
        choose("event_id", *_LEDGER_LINES).alias("first"),
        F.lit(None).cast("string").alias("second"),
    )
    _, people = extract_ledger(rows, block=1500)
    return people.select("sheet", "row_no", "Event", "Name", "Position")


@query(
    "ledger_events",
    "",
    f"""select 's' || user_id % 4 sheet, event_id row_no, code "Event", trim(substr(line, strpos(line, ' '))) as "Title", '' as "LocationDate"
    from (select *, nullif(regexp_extract(line, '^(PFE[0-9]{{2}}M[0-9])\\s', 1), '') code
    from (select *, {choose_sql('event_id', *_LEDGER_LINES)} line from events)) where code is not null""",
)
def ledger_events(t: Tables) -> DataFrame:
    rows = t.raw("events").select(
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("sheet"),
        F.col("event_id").alias("row_no"),
        choose("event_id", *_LEDGER_LINES).alias("first"),
        F.lit(None).cast("string").alias("second"),
    )
    events, _ = extract_ledger(rows, block=1500)
    return events


@query(
    "pid_numbering",
    "",
    """select o_custkey, min(o_orderkey) first_seen,
    printf('P%04d', row_number() over (order by min(o_orderkey))) pid from orders group by 1""",
)
def pid_numbering(t: Tables) -> DataFrame:
    return sequence.number_first_seen(t.raw("orders"), ["o_custkey"], "o_orderkey", "pid", "P%04d")


@query(
    "global_rank",
    "",
    "select event_id, row_number() over (order by value desc, event_id) as rank from events",
)
def global_rank(t: Tables) -> DataFrame:
    rows = t.raw("events").select("event_id", "value")
    return sequence.global_rank(rows, [F.col("value").desc(), F.col("event_id").asc()]).drop("value")


_LABELS = (
    "'nation_' || o_custkey % 40", "' Land ' || o_custkey % 13", "'c0' || (10 + o_custkey % 30)", "''", None, "'LAND ' || o_custkey % 13",
)


_LABELLED = f"select o_orderkey, {choose_sql('o_orderkey', *_LABELS)} raw from orders"


@query(
    "group_rank",
    "",
    "select event_id, event_type, row_number() over (partition by event_type order by value, event_id) as rank from events",
)
def group_rank(t: Tables) -> DataFrame:
    rows = t.raw("events").select("event_id", "event_type", "value")
    return sequence.group_rank(rows, ["event_type"], ["value", "event_id"]).drop("value")


@query(
    "country_get_or_create",
    "v_countries",
    f"""select o_orderkey, cid from (select o_orderkey, trim(raw) txt from (select o_orderkey, {choose_sql('o_orderkey', *_LABELS)} raw from orders))
    left join (select k, coalesce(known, printf('C%03d', 39 + row_number() over (partition by known is null order by first_seen))) cid
     from (select lower(txt) k, min(o_orderkey) first_seen, case when regexp_full_match(upper(any_value(txt)), '[A-Z][0-9]{{3}}')
      then upper(any_value(txt)) else any_value(c.cid) end known
      from (select o_orderkey, trim(raw) txt from (select o_orderkey, {choose_sql('o_orderkey', *_LABELS)} raw from orders))
      left join v_countries c on lower(c.country) = lower(txt) where txt <> '' group by 1)) on k = lower(txt)""",
)
def country_get_or_create(t: Tables) -> DataFrame:
    labels = t.raw("orders").select("o_orderkey", choose("o_orderkey", *_LABELS).alias("label"))
    _, mapped = mutate.ensure_countries(labels, "label", "o_orderkey", t.countries)
    return mapped.select("o_orderkey", "cid")


@query(
    "country_table_after_create",
    "v_countries",
    f"""select country, cid from v_countries union all select txt, case when coded then upper(txt)
    else printf('C%03d', (select greatest((select count(*) from v_countries), (select max(substr(cid, 2)::bigint) from v_countries),
     (select max(substr(upper(trim(raw)), 2)::bigint) from ({_LABELLED}) where regexp_full_match(upper(trim(raw)), 'C[0-9]{{3}}'))))
     + row_number() over (partition by coded order by seen)) end
    from (select arg_min(txt, o_orderkey) txt, min(o_orderkey) seen, regexp_full_match(upper(any_value(txt)), '[A-Z][0-9]{{3}}') coded
    from (select o_orderkey, trim(raw) txt from ({_LABELLED}))
    where txt <> '' and lower(txt) not in (select lower(country) from v_countries)
    and upper(txt) not in (select cid from v_countries) group by lower(txt))""",
)
def country_table_after_create(t: Tables) -> DataFrame:
    labels = t.raw("orders").select("o_orderkey", choose("o_orderkey", *_LABELS).alias("label"))
    extended, _ = mutate.ensure_countries(labels, "label", "o_orderkey", t.countries)
    return extended.select("country", "cid")


@query(
    "country_numbers_legacy",
    "v_countries",
    f"""select o_orderkey, case when k = '' then 'c000' else coalesce(c.cid, n.cid) end cid from
    (select o_orderkey, lower(trim(coalesce(raw, ''))) k from (select o_orderkey, {choose_sql('o_orderkey', *_LABELS)} raw from orders))
    left join v_countries c on lower(c.country) = k left join (select k, printf('c%03d', 25 + row_number() over (order by min(o_orderkey))) cid
     from (select o_orderkey, lower(trim(coalesce(raw, ''))) k from (select o_orderkey, {choose_sql('o_orderkey', *_LABELS)} raw from orders))
     where k <> '' and k not in (select lower(country) from v_countries) group by 1) n using (k)""",
)
def country_numbers_legacy(t: Tables) -> DataFrame:
    labels = t.raw("orders").select("o_orderkey", choose("o_orderkey", *_LABELS).alias("label"))
    return mutate.ensure_countries_legacy(labels, "label", "o_orderkey", t.countries).select("o_orderkey", "cid")


@query(
    "next_pid",
    "v_participants",
    "select printf('P%04d', max(ord) + 1) next_pid from v_participants",
)
def next_pid(t: Tables) -> DataFrame:
    return merge.next_pid(t.participants)


# --- validation ----------------------------------------------------------------------

_BAD_COUNTRY = ("representing_country", "'X'", "representing_country")
_BAD_EMAIL = ("email", "'nobody'", "'a@b'", None, "email")
_BAD_PHONE = ("phone", "'123'", "''", "phone")


@query(
    "participant_rejects",
    "v_participants",
    f"""select pid, array_to_string(list_filter([
    case when length(c) < 2 then 'representing_country length' end,
    case when ord % 7 = 3 then 'gender unknown' end,
    case when m in ('nobody', 'a@b') then 'email invalid' end,
    case when f = '123' then 'phone invalid' end,
    case when ord % 11 = 5 then 'dob is required' end], lambda x: x is not null), ';') errors
    from (select *, {choose_sql('ord', *_BAD_COUNTRY)} c, {choose_sql('ord', *_BAD_EMAIL)} m, {choose_sql('ord', *_BAD_PHONE)} f
    from v_participants) where length(c) < 2 or ord % 7 = 3 or m in ('nobody', 'a@b') or f = '123' or ord % 11 = 5""",
)
def participant_rejects(t: Tables) -> DataFrame:
    damaged = t.participants.withColumns(
        {
            "representing_country": choose("ord", *_BAD_COUNTRY),
            "gender": F.when(F.col("ord") % 7 != 3, F.col("gender")),
            "email": choose("ord", *_BAD_EMAIL),
            "phone": choose("ord", *_BAD_PHONE),
            "dob": F.when(F.col("ord") % 11 != 5, F.col("dob")),
        }
    )
    _, rejects = validate.validate(damaged, validate.participant_rules())
    return rejects.select("pid", F.array_join("errors", ";").alias("errors"))


@query(
    "snapshot_rejects",
    "v_snapshots",
    """select participant_id, event_id, array_to_string(list_filter([
    case when transportation = 'Other' and transport_other is null then 'transport_other required' end,
    case when travel_doc_issue_date > travel_doc_expiry_date then 'issue date after expiry date' end],
    lambda x: x is not null), ';') errors from v_snapshots where (transportation = 'Other' and transport_other is null)
    or travel_doc_issue_date > travel_doc_expiry_date""",
)
def snapshot_rejects(t: Tables) -> DataFrame:
    _, rejects = validate.validate(t.snapshots, validate.snapshot_rules())
    return rejects.select("participant_id", "event_id", F.array_join("errors", ";").alias("errors"))


@query(
    "event_rejects",
    "v_events",
    """select eid, array_to_string(list_filter([case when start_date > end_date - interval 2 day then 'start_date after end_date' end,
    case when eid like '%3' then 'blank participant' end], lambda x: x is not null), ';') errors from v_events
    where start_date > end_date - interval 2 day or eid like '%3'""",
)
def event_rejects(t: Tables) -> DataFrame:
    damaged = t.events.withColumns(
        {
            "end_date": F.col("end_date") - F.expr("interval 2 days"),
            "participants": F.when(F.col("eid").endswith("3"), F.array(F.lit("P1"), F.lit(" "))).otherwise(F.col("participants")),
        }
    )
    _, rejects = validate.validate(damaged, validate.event_rules())
    return rejects.select("eid", F.array_join("errors", ";").alias("errors"))


@query(
    "score_rejects",
    "v_tests",
    """select eid, pid, "type", score, 'score negative' errors from (select eid, pid, "type", score - 25 score from v_tests) where score < 0""",
)
def score_rejects(t: Tables) -> DataFrame:
    shifted = t.tests.withColumn("score", F.col("score") - 25)
    _, rejects = validate.validate(shifted, validate.score_rules())
    return rejects.withColumn("errors", F.array_join("errors", ";"))


_CID = ("cid", "'C1'", "lower(cid)")


@query(
    "country_rejects",
    "v_countries",
    f"""select ord, array_to_string(list_filter([case when length(c) <> 4 then 'cid length' end,
    case when length(n) < 2 then 'country too short' end], lambda x: x is not null), ';') errors
    from (select ord, {choose_sql('ord', *_CID)} c, case when ord % 4 = 0 then 'X' else country end n from v_countries)
    where length(c) <> 4 or length(n) < 2""",
)
def country_rejects(t: Tables) -> DataFrame:
    damaged = t.countries.withColumns(
        {"cid": choose("ord", *_CID), "country": F.when(F.col("ord") % 4 == 0, "X").otherwise(F.col("country"))}
    )
    _, rejects = validate.validate(damaged, validate.country_rules())
    return rejects.select("ord", F.array_join("errors", ";").alias("errors"))


@query(
    "link_rejects",
    "v_links",
    """select event_id, participant_id, case when event_id like '%7' then 'participant_id is required' end errors
    from v_links where event_id like '%7'""",
)
def link_rejects(t: Tables) -> DataFrame:
    """Links in the short column names that payloads may use, some without a participant."""
    payload = t.links.select(
        F.col("event_id").alias("eid"), F.when(~F.col("event_id").endswith("7"), F.col("participant_id")).alias("pid"),
        F.col("participant_id").alias("kept"),
    )
    _, rejects = validate.validate(tables.canonical_keys(payload), validate.link_rules())
    return rejects.select("event_id", F.col("kept").alias("participant_id"), F.array_join("errors", ";").alias("errors"))


_EDIT_START = ("'2024-05-01'", "'2024-13-01'", "'01.05.2024'", "''")
_EDIT_END = ("'2024-05-03'", "'2024-04-30'", "'x'")


@query(
    "event_edit_rejects",
    "",
    f"""select p_partkey, array_to_string(list_filter([case when title = '' then 'Title is required.' end,
    case when s <> '' and try_strptime(s, '%Y-%m-%d') is null then 'start_date: Enter a valid date in YYYY-MM-DD format.' end,
    case when e <> '' and try_strptime(e, '%Y-%m-%d') is null then 'end_date: Enter a valid date in YYYY-MM-DD format.' end,
    case when try_strptime(s, '%Y-%m-%d') > try_strptime(e, '%Y-%m-%d') then 'End date must be on or after the start date.' end],
    lambda x: x is not null), ';') errors from (select p_partkey, case when p_size = 7 then '' else p_name end title,
    {choose_sql('p_partkey', *_EDIT_START)} s, {choose_sql('p_partkey', *_EDIT_END)} e from part)""",
)
def event_edit_rejects(t: Tables) -> DataFrame:
    forms = t.raw("part").select(
        "p_partkey",
        F.when(F.col("p_size") == 7, "").otherwise(F.col("p_name")).alias("title"),
        choose("p_partkey", *_EDIT_START).alias("start_date"),
        choose("p_partkey", *_EDIT_END).alias("end_date"),
    )
    return forms.select("p_partkey", F.array_join(validate.event_edit_rules(), ";").alias("errors"))


# --- keyed changes -------------------------------------------------------------------

#: A change set of half the stored people and as many new ones.
_DELTA = """select case when ord % 2 = 0 then pid else 'N' || pid end pid, case when ord % 3 = 0 then null else 'New ' || name end as name,
    case when ord % 5 = 0 then null else 'Chief' end as position, ord from v_participants"""
_BASE = "select pid, name, position, grade, representing_country from v_participants"


def base(t: Tables) -> DataFrame:
    return t.participants.select("pid", "name", "position", "grade", "representing_country")


def delta(t: Tables) -> DataFrame:
    return t.participants.select(
        F.when(F.col("ord") % 2 == 0, F.col("pid")).otherwise(F.concat(F.lit("N"), "pid")).alias("pid"),
        F.when(F.col("ord") % 3 != 0, F.concat(F.lit("New "), "name")).alias("name"),
        F.when(F.col("ord") % 5 != 0, "Chief").alias("position"),
    )


@query(
    "upsert_keep",
    "v_participants",
    f"""select pid, coalesce(d.name, b.name) as name, coalesce(d.position, b.position) as position, b.grade, b.representing_country
    from ({_BASE}) b full join ({_DELTA}) d using (pid)""",
)
def upsert_keep(t: Tables) -> DataFrame:
    return mutate.upsert(base(t), delta(t), ["pid"])


@query(
    "upsert_overwrite",
    "v_participants",
    f"""select pid, case when d.ord is not null then d.name else b.name end as name,
    case when d.ord is not null then d.position else b.position end as position, b.grade, b.representing_country
    from ({_BASE}) b full join ({_DELTA}) d using (pid)""",
)
def upsert_overwrite(t: Tables) -> DataFrame:
    return mutate.upsert(base(t), delta(t), ["pid"], nulls="overwrite")


@query(
    "test_scores",
    "v_tests",
    """select eid, pid, "type", coalesce(d.score, b.score) score from (select eid, pid, "type", max(score) score from v_tests group by 1, 2, 3) b
    full join (select eid, pid, case when "type" = 'pre' then 'post' else 'pre' end "type", max(score) + 100 score from v_tests
     where substr(pid, 2)::bigint % 2 = 0 group by 1, 2, 3) d using (eid, pid, "type")""",
)
def test_scores(t: Tables) -> DataFrame:
    """Every second participant gets new scores of the other kind, the highest of them last."""
    stored = t.tests.groupBy("eid", "pid", "type").agg(F.max("score").alias("score"))
    other = F.when(F.col("type") == "pre", "post").otherwise("pre").alias("type")
    new = t.tests.where(F.substring("pid", 2, 20).cast("bigint") % 2 == 0)
    rows = new.select("eid", "pid", other, (F.col("score") + 100).alias("score"), F.col("score").alias("order"))
    return mutate.upsert_scores(stored, rows, "order")


@query(
    "insert_missing",
    "v_participants",
    f"""select pid, name, position, grade, representing_country from ({_BASE}) union all
    select pid, name, position, null, null from ({_DELTA}) d where pid not in (select pid from v_participants)""",
)
def insert_missing(t: Tables) -> DataFrame:
    return mutate.insert_missing(base(t), delta(t), ["pid"])


@query(
    "patch_rows",
    "v_participants",
    f"""select pid, coalesce(d.name, b.name) as name, coalesce(d.position, b.position) as position, b.grade, b.representing_country
    from ({_BASE}) b left join ({_DELTA}) d using (pid)""",
)
def patch_rows(t: Tables) -> DataFrame:
    return mutate.patch(base(t), delta(t), ["pid"])


@query(
    "delete_keys",
    "v_participants",
    f"select * from ({_BASE}) where pid not in (select pid from ({_DELTA}))",
)
def delete_keys(t: Tables) -> DataFrame:
    return mutate.delete(base(t), delta(t), ["pid"])


_SNAP = "transportation transport_other traveling_from returning_to travel_doc_type bank_name iban_type".split()


@query(
    "bulk_upsert",
    "v_attendance",
    f"""select participant_id, event_id, {', '.join(f"coalesce(arg_max({c}, k) filter (u and {c} is not null), arg_max({c}, k) filter (not u)) {c}" for c in _SNAP)}
    from (select *, (l_orderkey, l_linenumber, l_suppkey, l_quantity) k, l_linenumber > 3 u from v_attendance
    qualify u or row_number() over (partition by participant_id, event_id, l_linenumber > 3
    order by l_orderkey desc, l_linenumber desc, l_suppkey desc, l_quantity desc) = 1) group by 1, 2""",
)
def bulk_upsert(t: Tables) -> DataFrame:
    """Early lines are the stored snapshots, later lines the ordered changes."""
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]
    keys = ["participant_id", "event_id"]
    rows = t.attendance_rows.select(*keys, *_SNAP, *order)
    stored = merge.last_row(rows.filter("l_linenumber <= 3"), keys, order).drop(*order)
    changes = rows.filter("l_linenumber > 3").withColumn("_order", F.struct(*order)).drop(*order)
    return mutate.bulk_upsert(stored, changes, keys, "_order")


@query(
    "register_links",
    "v_links",
    """select participant_id, event_id, case when (hash_key % 3) = 0 then 'Split' end traveling_from from
    (select *, substr(participant_id, 2)::bigint + substr(event_id, 2)::bigint hash_key from v_links)""",
)
def register_links(t: Tables) -> DataFrame:
    """Every third link brings a detail; the others only guarantee that the link exists."""
    number = F.substring("participant_id", 2, 20).cast("bigint") + F.substring("event_id", 2, 20).cast("bigint")
    detail = F.when(number % 3 == 0, "Split").alias("traveling_from")
    rows = t.links.select("participant_id", "event_id", detail, number.alias("_order"))
    stored = t.links.filter(F.lit(False)).withColumn("traveling_from", F.lit(None).cast("string"))
    return mutate.register_links(stored, rows, "_order")


@query(
    "patched_people",
    "v_participants",
    """select pid, case when ord % 4 = 1 and ord % 3 <> 2 then 'Chief' else position end as position,
    case when ord % 4 = 1 and ord % 3 = 2 then 'phone invalid' end errors from v_participants""",
)
def patched_people(t: Tables) -> DataFrame:
    """Every fourth person gets a new position; a bad phone in the change set undoes the change."""
    people = t.participants.withColumn("name", F.lit("Ann LEE"))
    changes = t.participants.select(
        F.when(F.col("ord") % 4 == 1, F.col("pid")).otherwise(F.concat(F.lit("N"), "pid")).alias("pid"),
        F.lit("Chief").alias("position"),
        F.when(F.col("ord") % 3 == 2, "123").alias("phone"),
    )
    patched, bad = mutate.patch_participants(people, changes)
    errors = bad.select("pid", F.array_join("errors", ";").alias("errors"))
    return patched.join(errors, "pid", "left").select("pid", "position", "errors")


@query(
    "phone_maintenance",
    "v_participants",
    """select pid, stored, case when s = 1 then null else '+385' || lpad(ord::varchar, 8, '0') end normalized,
    case s when 0 then 'ok' when 1 then 'invalid' else 'changed' end status from
    (select pid, ord, ord % 3 s, case ord % 3 when 0 then phone when 1 then 'x' || ord else '00' || substr(phone, 2) end stored from v_participants)""",
)
def phone_maintenance(t: Tables) -> DataFrame:
    options = ("phone", "'x' || ord", "'00' || substr(phone, 2)")
    return mutate.renormalize_phones(t.participants.withColumn("phone", choose("ord", *options)))


@query(
    "legacy_events",
    "v_events",
    """select eid, coalesce(strftime(start_date, '%Y-%m-%d'), '') start_date, place, embedded::int participants from v_events""",
)
def legacy_events(t: Tables) -> DataFrame:
    """Events whose even numbers are stored under the older column names."""
    old = F.substring("eid", -1, 1).isin("0", "2", "4", "6", "8")
    moved = {"dateFrom": "start_date", "location": "place", "participant_ids": "participants"}
    stored = t.events.withColumns({new: F.when(old, F.col(c)) for new, c in moved.items()})
    stored = stored.withColumns({c: F.when(~old, F.col(c)) for c in moved.values()})
    upgraded = tables.upgrade_events(stored)
    return upgraded.select(
        "eid", F.coalesce(F.date_format("start_date", "yyyy-MM-dd"), F.lit("")).alias("start_date"), "place",
        F.size("participants").alias("participants"),
    )


# --- edits with audit ----------------------------------------------------------------

_FORM = {
    "name": ("name", "'Edith ' || name", "name", None),
    "position": ("position", "'Boss'"),
    "representing_country": ("representing_country", "lower('NATION_3')", "'Nowhere'", "representing_country"),
    "birth_country": ("birth_country", "'Yug'", "birth_country"),
    "grade": (None, "'2'", "'x'", "'0'", None),
    "gender": ("gender", "'Male'"),
    "dob": ("'1980-02-03'", "'3.2.1980'"),
    "pob": ("pob", "'Rijeka'"),
    "email": ("email", None),
    "phone": ("phone", "phone"),
    "intl_authority": (None, "'on'", "'no'"),
}
_NULLS = ("diet_restrictions", "organization", "unit", "rank", "bio_short")


def form_sql() -> str:
    columns = ", ".join(f"{choose_sql('ord', *v)} f_{c}" for c, v in _FORM.items())
    return f"select *, {columns} from v_participants"


def edit_forms(t: Tables) -> DataFrame:
    people = t.participants
    forms = people.select("pid", "citizenships", *[choose("ord", *v).cast("string").alias(c) for c, v in _FORM.items()])
    forms = forms.withColumn("citizenships", F.filter("citizenships", lambda c: ~c.isin("C025", "C026", "C027")))
    return forms.withColumns({c: F.lit(None).cast("string") for c in _NULLS})


def stored_people(t: Tables) -> DataFrame:
    columns = {c: F.lit(None).cast("string") for c in _NULLS}
    columns["intl_authority"] = F.lit(None).cast("boolean")
    columns["updated_at"] = F.lit(None).cast("timestamp")
    audit = "array<struct<ts:timestamp,actor:string,field:string,from:string,to:string,source:struct<sheet:string,row:bigint,table:string>>>"
    columns["_audit"] = F.array().cast(audit)
    return t.participants.withColumns(columns)


_ERRORS = """list_filter([case when f_name is null then 'Name is required.' end,
    case when f_representing_country = 'Nowhere' then 'Invalid country selection for ''representing_country''.' end,
    case when birth is null then 'Invalid country selection for ''birth_country''.' end,
    case when f_grade = 'x' then 'Invalid grade selection.' end], lambda x: x is not null)"""
_EDITED = f"""select *, case when f_representing_country = 'nation_3' then 'C003' when f_representing_country <> 'Nowhere'
    then representing_country end rep, case when f_birth_country = 'Yug' then case when f_representing_country = 'nation_3' then 'C003'
    when f_representing_country <> 'Nowhere' then representing_country end else birth_country end birth from ({form_sql()})"""


@query(
    "edit_rejects",
    "v_participants",
    f"select pid, array_to_string({_ERRORS}, ';') errors from ({_EDITED}) where len({_ERRORS}) > 0",
)
def edit_rejects(t: Tables) -> DataFrame:
    _, rejects = mutate.apply_edits(stored_people(t), edit_forms(t), t.countries, "web", F.lit("2025-01-01"))
    return rejects.withColumn("errors", F.array_join("errors", ";"))


_HELD = """list_filter([representing_country, case when birth_country <> representing_country then birth_country end,
    case when third_country not in (representing_country, birth_country) then third_country end], lambda x: x is not null)"""


@query(
    "audit_diff",
    "v_participants",
    f"""select pid, field, "from", "to" from (select pid, unnest(['name', 'position', 'representing_country', 'birth_country', 'grade',
    'gender', 'dob', 'pob', 'email', 'intl_authority', 'citizenships']) field,
    unnest([name, position, representing_country, birth_country, grade::varchar, gender, strftime(dob, '%Y-%m-%dT00:00:00'), pob, email, null,
    '["' || array_to_string({_HELD}, '","') || '"]']) "from",
    unnest([f_name, f_position, rep, birth, coalesce(f_grade, grade::varchar), f_gender, '1980-02-03T00:00:00', f_pob, f_email,
    case f_intl_authority when 'on' then 'true' when 'no' then 'false' end,
    '["' || array_to_string(list_filter({_HELD}, lambda x: x not in ('C025', 'C026', 'C027')), '","') || '"]']) "to"
    from ({_EDITED}) where len({_ERRORS}) = 0) where "from" is distinct from "to" """,
)
def audit_diff(t: Tables) -> DataFrame:
    changes = mutate.audit_changes(stored_people(t), edit_forms(t), t.countries, "web", F.lit("2025-01-01"))
    return changes.select("pid", "field", "from", "to")


@query(
    "edited_people",
    "v_participants",
    f"""select pid, case when good then replace(f_name, 'Customer', 'Customer') else name end as raw_name,
    case when good then rep else representing_country end representing_country,
    case when good then f_email else email end email, case when good then coalesce(f_grade::int, grade) else grade end grade
    from (select *, len({_ERRORS}) = 0 good from ({_EDITED}))""",
)
def edited_people(t: Tables) -> DataFrame:
    updated, _ = mutate.apply_edits(stored_people(t), edit_forms(t), t.countries, "web", F.lit("2025-01-01"))
    # Display names put the last word in capitals; the comparison is on the words as typed.
    typed = F.when(F.col("name").startswith("Edith "), F.concat(F.lit("Edith Customer"), F.substring("name", 15, 99)))
    return updated.select(
        "pid", F.coalesce(typed, F.col("name")).alias("raw_name"), "representing_country", "email", "grade"
    )


@query(
    "import_audit",
    "v_participants",
    """select pid, 'grade' field, 'import' actor, grade::varchar "to", 'Participants' sheet, ord + 2 "row" from v_participants""",
)
def import_audit(t: Tables) -> DataFrame:
    log = mutate.import_audit("grade", F.col("grade"), "import", F.lit("2025-01-01"), "Participants", F.col("ord") + 2)
    return t.participants.select("pid", F.inline(log)).select(
        "pid", "field", "actor", "to", F.col("source.sheet").alias("sheet"), F.col("source.row").alias("row")
    )


@query(
    "roster_scores",
    "v_events v_tests v_links",
    """select e.eid, coalesce(n.n, e.embedded)::bigint participant_count, round(coalesce(a.post, 0) - coalesce(a.pre, 0), 6) gain
    from v_events e left join (select event_id, count(*) n from v_links group by 1) n on n.event_id = e.eid
    left join (select eid, avg(score) filter ("type" = 'pre') pre, avg(score) filter ("type" = 'post') post from v_tests group by 1) a on a.eid = e.eid""",
)
def roster_scores(t: Tables) -> DataFrame:
    counted = reports.with_attendee_count(t.events, t.links).select("eid", "participant_count")
    scores = reports.event_scores_for(t.events, t.tests)
    return counted.join(scores, "eid").select(
        "eid", "participant_count", F.round(F.col("avg_post") - F.col("avg_pre"), 6).alias("gain")
    )
