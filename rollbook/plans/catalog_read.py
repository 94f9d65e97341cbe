"""Read side: searches, pages, rosters, counts and averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollbook.functions import text
from rollbook.operators import paging, reports, tables, validate
from rollbook.plans import screens
from rollbook.plans.bindings import Tables
from rollbook.plans.catalog import query
from rollbook.sources import stored

SUMMARIES = """select e.eid, e.title, e.place, coalesce(c.country, e.country) country, e.country country_code,
    strftime(e.start_date, '%Y-%m-%d') start_date, strftime(e.end_date, '%Y-%m-%d') end_date, e.type, e.cost,
    coalesce(n.n, e.embedded)::bigint participant_count
    from v_events e left join v_countries c on c.cid = e.country
    left join (select event_id, count(*) n from v_links group by 1) n on n.event_id = e.eid"""


def days(df: DataFrame, *names: str) -> DataFrame:
    """Dates as text, the same in every engine."""
    return df.withColumns({name: F.date_format(name, "yyyy-MM-dd") for name in names})


@query(
    "table_counts",
    "v_participants v_events v_countries",
    "select (select count(*) from v_participants) participants, (select count(*) from v_events) events, "
    "(select count(*) from v_countries) countries",
)
def table_counts(t: Tables) -> DataFrame:
    return reports.table_counts(t.participants, t.events, t.countries)


@query(
    "grade_counts",
    "v_participants",
    "select count(*) filter (grade = 0) black_list, count(*) filter (grade = 1) normal, "
    "count(*) filter (grade = 2) excellent from v_participants",
)
def grade_counts(t: Tables) -> DataFrame:
    return reports.grade_counts(t.participants)


@query(
    "top_countries",
    "v_participants",
    "select representing_country, count(*) n from v_participants group by 1 order by n desc, 1 limit 5",
)
def top_countries(t: Tables) -> DataFrame:
    return reports.top_countries(t.participants)


@query(
    "detailed_stats",
    "v_participants v_countries",
    """select count(*) participants_count, count(*) filter (grade = 0) black_list, count(*) filter (grade = 1) normal,
    count(*) filter (grade = 2) excellent, (select count(*) from v_countries) countries_count,
    (select string_agg(representing_country || ':' || n, ',' order by n desc, representing_country) from
     (select count(*) n, representing_country from v_participants group by 2 order by 1 desc, 2 limit 5)) top_countries
    from v_participants""",
)
def detailed_stats(t: Tables) -> DataFrame:
    stats = reports.detailed_stats(t.participants, t.countries)
    return stats.withColumn("top_countries", F.array_join(F.transform("top_countries", lambda x: F.concat_ws(":", x["representing_country"], x["n"])), ","))


@query(
    "latest_event",
    "v_events",
    """select coalesce(nullif(title, ''), eid) latest_event, strftime(start_date, '%Y-%m-%d') latest_event_date
    from v_events order by start_date desc nulls last, eid limit 1""",
)
def latest_event(t: Tables) -> DataFrame:
    return days(reports.latest_event(t.events), "latest_event_date")


@query(
    "dashboard",
    "v_participants v_events v_countries",
    """select (select count(*) from v_participants) participants, (select count(*) from v_events) events,
    (select count(*) from v_countries) countries, coalesce(nullif(title, ''), eid) latest_event,
    strftime(start_date, '%Y-%m-%d') latest_event_date
    from v_events order by start_date desc nulls last, eid limit 1""",
)
def dashboard(t: Tables) -> DataFrame:
    return days(reports.dashboard(t.participants, t.events, t.countries), "latest_event_date")


@query("distinct_events", "v_tests", "select count(distinct eid) as events from v_tests")
def distinct_events(t: Tables) -> DataFrame:
    return reports.distinct_events(t.tests)


@query(
    "attendee_counts", "v_links", "select event_id, count(*) participant_count from v_links group by 1"
)
def attendee_counts(t: Tables) -> DataFrame:
    return reports.attendee_counts(t.links)


@query(
    "roster_arrays",
    "v_events v_links",
    """select e.eid, coalesce(r.participants, '') participants from v_events e left join
    (select event_id, string_agg(participant_id, ',' order by participant_id) participants from v_links group by 1) r
    on r.event_id = e.eid""",
)
def roster_arrays(t: Tables) -> DataFrame:
    return reports.rosters(t.events, t.links).withColumn("participants", F.array_join("participants", ","))


@query(
    "event_avg_scores",
    "v_events v_tests",
    """select e.eid, round(coalesce(avg(score) filter (t.type = 'pre'), 0.0), 6) avg_pre,
    round(coalesce(avg(score) filter (t.type = 'post'), 0.0), 6) avg_post
    from v_events e left join v_tests t on t.eid = e.eid group by 1""",
)
def event_avg_scores(t: Tables) -> DataFrame:
    scores = reports.event_scores_for(t.events, t.tests)
    return scores.withColumns({c: F.round(c, 6) for c in ("avg_pre", "avg_post")})


_FOUND = "regexp_matches(pid, '7|mach', 'i') or regexp_matches(name, '7|mach', 'i') or regexp_matches(position, '7|mach', 'i')"


@query(
    "participant_search",
    "v_participants",
    f"select pid, name, position, grade, representing_country from v_participants where {_FOUND}",
)
def participant_search(t: Tables) -> DataFrame:
    found = tables.search_participants(t.participants, "7|mach")
    return found.select("pid", "name", "position", "grade", "representing_country")


@query(
    "participant_page",
    "v_participants",
    f"""select pid, name, position, grade, total from
    (select *, count(*) over () total from v_participants where {_FOUND})
    order by position desc, pid limit 25 offset 50""",
)
def participant_page(t: Tables) -> DataFrame:
    found = tables.search_participants(t.participants, "7|mach")
    cut = paging.participant_page(found, "position", -1, 50, 25)
    return cut.select("pid", "name", "position", "grade", paging.total(found).alias("total"))


@query(
    "participant_page_by_country",
    "v_participants v_countries",
    """select p.pid, p.name, coalesce(c.country, p.representing_country) country from
    (select * from v_participants order by representing_country desc, pid limit 40 offset 20) p
    left join v_countries c on c.cid = p.representing_country""",
)
def participant_page_by_country(t: Tables) -> DataFrame:
    named = reports.with_country_name(t.participants, "representing_country", t.countries)
    return paging.participant_page_by_country(named, -1, 20, 40).select("pid", "name", "country")


@query(
    "participant_rest",
    "v_participants",
    "select pid, name, position from v_participants order by name desc, pid offset 100",
)
def participant_rest(t: Tables) -> DataFrame:
    """A page without a limit: everything after the first hundred rows."""
    return paging.participant_page(t.participants, "name", -1, 100, 0).select("pid", "name", "position")


@query(
    "participant_list",
    "v_participants v_countries",
    """select p.pid, p.name, p.position, case p.grade when 0 then 'Black List' when 1 then 'Normal' else 'Excellent' end grade,
    coalesce(c.country, p.representing_country) country from
    (select * from v_participants order by grade, pid limit 25 offset 25) p
    left join v_countries c on c.cid = p.representing_country""",
)
def participant_list(t: Tables) -> DataFrame:
    return screens.participant_list(t.participants, t.countries, sort="grade", page=2)


@query(
    "page_count",
    "v_links",
    "select count(*) total, 3 page, greatest(1, ceil(count(*) / 25))::bigint pages from v_links",
)
def page_count(t: Tables) -> DataFrame:
    return paging.page_info(t.links, 3, 25)


@query("event_summaries", "v_events v_links v_countries", SUMMARIES)
def event_summaries(t: Tables) -> DataFrame:
    return days(reports.event_summaries(t.events, t.links, t.countries), "start_date", "end_date")


@query(
    "event_search",
    "v_events v_links v_countries",
    f"""select * from ({SUMMARIES}) where contains(lower(eid), 'ring') or contains(lower(title), 'ring')
    or contains(lower(place), 'ring') or contains(lower(country), 'ring')""",
)
def event_search(t: Tables) -> DataFrame:
    return days(
        tables.search_events(reports.event_summaries(t.events, t.links, t.countries), "RING"), "start_date", "end_date"
    )


@query(
    "event_page",
    "v_events v_links v_countries",
    f"""select * from ({SUMMARIES}) where contains(lower(eid), 'nation_1') or contains(lower(title), 'nation_1')
    or contains(lower(place), 'nation_1') or contains(lower(country), 'nation_1')
    order by start_date desc nulls last, eid limit 25 offset 25""",
)
def event_page(t: Tables) -> DataFrame:
    shown = screens.event_list(t.events, t.links, t.countries, "nation_1", "start_date", -1, page=2)
    return days(shown, "start_date", "end_date")


_ROSTER = """select l.event_id, p.pid, p.name, p.position, p.grade, coalesce(c.country, p.representing_country) country
    from v_links l join v_participants p on p.pid = l.participant_id
    left join v_countries c on c.cid = p.representing_country"""


@query("event_roster", "v_links v_participants v_countries", _ROSTER)
def event_roster(t: Tables) -> DataFrame:
    return reports.roster_of(t.links, t.participants, t.countries)


@query(
    "event_detail",
    "v_links v_participants v_countries",
    f"select pid, name, position, grade, country from ({_ROSTER}) where event_id = 'E00007' order by grade desc, pid",
)
def event_detail(t: Tables) -> DataFrame:
    _, roster = screens.event_detail(
        "E00007", t.events, t.links, t.participants, t.countries, t.tests, "grade", -1
    )
    return roster.drop("event_id")


@query(
    "event_detail_summary",
    "v_events v_links v_countries v_tests",
    f"""select s.*, coalesce((select round(avg(score), 6) from v_tests t where t.eid = s.eid and t."type" = 'pre'), 0.0) avg_pre,
    coalesce((select round(avg(score), 6) from v_tests t where t.eid = s.eid and t."type" = 'post'), 0.0) avg_post
    from ({SUMMARIES}) s where eid = 'E00007'""",
)
def event_detail_summary(t: Tables) -> DataFrame:
    summary, _ = screens.event_detail("E00007", t.events, t.links, t.participants, t.countries, t.tests)
    return days(summary, "start_date", "end_date").withColumns({c: F.round(c, 6) for c in ("avg_pre", "avg_post")})


@query(
    "participant_detail",
    "v_participants v_countries",
    """select p.pid, p.name, p.position, p.grade, p.email, p.phone, p.representing_country, coalesce(c.country, p.representing_country) representing_country_name,
    coalesce(b.country, p.birth_country) birth_country_name, (select string_agg(coalesce(n.country, code), ',' order by pos) from
     (select unnest(list_distinct_in_order) code, generate_subscripts(list_distinct_in_order, 1) pos from
      (select list_filter([p.representing_country, case when p.birth_country <> p.representing_country then p.birth_country end,
       case when p.third_country not in (p.representing_country, p.birth_country) then p.third_country end], lambda x: x is not null) list_distinct_in_order))
     left join v_countries n on n.cid = code) citizenship_names
    from v_participants p left join v_countries c on c.cid = p.representing_country left join v_countries b on b.cid = p.birth_country
    where p.pid = 'P0011'""",
)
def participant_detail(t: Tables) -> DataFrame:
    profile, _ = screens.participant_detail("P0011", t.participants_where(pid="P0011"), t.links, t.events, t.countries)
    names = F.array_join("citizenship_names", ",").alias("citizenship_names")
    return profile.select(
        "pid", "name", "position", "grade", "email", "phone", "representing_country", "representing_country_name", "birth_country_name", names
    )


@query(
    "participant_detail_events",
    "v_links v_events v_countries",
    """select e.eid, e.title, e.place, coalesce(c.country, e.country) country, e.country country_code,
    strftime(e.start_date, '%Y-%m-%d') start_date, strftime(e.end_date, '%Y-%m-%d') end_date
    from v_links l join v_events e on e.eid = l.event_id left join v_countries c on c.cid = e.country where l.participant_id = 'P0011'""",
)
def participant_detail_events(t: Tables) -> DataFrame:
    _, attended = screens.participant_detail("P0011", t.participants_where(pid="P0011"), t.links_where(participant_id="P0011"), t.events, t.countries)
    return days(attended, "start_date", "end_date").drop("participant_id")


@query(
    "participant_events",
    "v_links v_events v_countries",
    """select l.participant_id, e.eid, e.title, e.place, coalesce(c.country, e.country) country, e.country country_code,
    strftime(e.start_date, '%Y-%m-%d') start_date, strftime(e.end_date, '%Y-%m-%d') end_date
    from v_links l join v_events e on e.eid = l.event_id left join v_countries c on c.cid = e.country""",
)
def participant_events(t: Tables) -> DataFrame:
    return days(reports.participant_events_display(t.links, t.events, t.countries), "start_date", "end_date")


_DETAILS = """select s.participant_id, s.event_id, d.field, d.label, d.value from v_snapshots s
    left join v_countries c1 on c1.cid = trim(s.travel_doc_issued_by)
    left join v_countries c2 on c2.cid = trim(s.traveling_from)
    left join v_countries c3 on c3.cid = trim(s.returning_to), lateral (values
    ('travel_doc_type', 'Travel Document Type', nullif(trim(s.travel_doc_type), '')),
    ('travel_doc_issue_date', 'Travel Document Issue Date', strftime(s.travel_doc_issue_date, '%Y-%m-%dT%H:%M:%S')),
    ('travel_doc_expiry_date', 'Travel Document Expiry Date', strftime(s.travel_doc_expiry_date, '%Y-%m-%dT%H:%M:%S')),
    ('travel_doc_issued_by', 'Travel Document Issued By', coalesce(c1.country, nullif(trim(s.travel_doc_issued_by), ''))),
    ('transportation', 'Transportation', nullif(trim(s.transportation), '')),
    ('transport_other', 'Transportation (Other)', nullif(trim(s.transport_other), '')),
    ('traveling_from', 'Traveling From', coalesce(c2.country, nullif(trim(s.traveling_from), ''))),
    ('returning_to', 'Returning To', coalesce(c3.country, nullif(trim(s.returning_to), ''))),
    ('bank_name', 'Bank Name', nullif(trim(s.bank_name), '')), ('iban', 'IBAN', nullif(trim(s.iban), '')),
    ('iban_type', 'IBAN Type', nullif(trim(s.iban_type), '')), ('swift', 'SWIFT', nullif(trim(s.swift), ''))
    ) d(field, label, value)"""


@query(
    "snapshot_details",
    "v_snapshots v_countries",
    f"select field, label, value, count(*) n, sum(substr(participant_id, 2)::bigint)::bigint key_sum from ({_DETAILS}) group by 1, 2, 3",
)
def snapshot_details(t: Tables) -> DataFrame:
    details = reports.snapshot_details(t.snapshots, t.countries)
    return details.groupBy("field", "label", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.substring("participant_id", 2, 20).cast("bigint")).alias("key_sum")
    )


@query(
    "snapshot_available",
    "v_snapshots",
    """select participant_id, event_id, (travel_doc_type is not null or travel_doc_issue_date is not null) available
    from v_snapshots""",
)
def snapshot_available(t: Tables) -> DataFrame:
    return reports.snapshot_available(reports.snapshot_details(t.snapshots, t.countries))


@query(
    "country_refs",
    "v_participants",
    """select pid, (select string_agg(x, ',' order by x) from
    (select distinct unnest([representing_country, birth_country, third_country]) x)) refs from v_participants""",
)
def country_refs(t: Tables) -> DataFrame:
    refs = tables.country_refs("representing_country", "birth_country", "citizenships")
    return t.participants.select("pid", F.array_join(refs, ",").alias("refs"))


_NAMES = """select p.pid, coalesce(r.country, p.representing_country) representing_country_name,
    coalesce(b.country, p.birth_country) birth_country_name,
    coalesce(r.country, p.representing_country)
    || case when p.birth_country <> p.representing_country then ',' || coalesce(b.country, p.birth_country) else '' end
    || case when p.third_country not in (p.representing_country, p.birth_country)
       then ',' || coalesce(o.country, p.third_country) else '' end citizenship_names
    from v_participants p left join v_countries r on r.cid = p.representing_country
    left join v_countries b on b.cid = p.birth_country left join v_countries o on o.cid = p.third_country"""


@query("country_names", "v_participants v_countries", _NAMES)
def country_names(t: Tables) -> DataFrame:
    named = reports.with_country_names(t.participants, t.countries)
    return named.select(
        "pid", "representing_country_name", "birth_country_name",
        F.array_join("citizenship_names", ",").alias("citizenship_names"),
    )


@query(
    "merged_attendees",
    "v_participants v_snapshots",
    """select s.participant_id pid, s.event_id, p.name, p.gender, p.grade, strftime(p.dob, '%Y-%m-%d') dob, p.position,
    s.transportation, s.traveling_from, s.travel_doc_type, s.bank_name
    from v_snapshots s join v_participants p on p.pid = s.participant_id""",
)
def merged_attendees(t: Tables) -> DataFrame:
    people = t.participants
    for name in ("diet_restrictions", "unit", "rank", "bio_short"):
        people = people.withColumn(name, F.lit(None).cast("string"))
    people = people.withColumn("intl_authority", F.lit(None).cast("boolean"))
    merged = reports.merge_attendee(people, t.snapshots, order="ord")
    return days(merged, "dob").select(
        "pid", "event_id", "name", "gender", "grade", "dob", "position", "transportation", "traveling_from",
        "travel_doc_type", "bank_name",
    )


@query(
    "unique_violations",
    "v_attendance",
    "select participant_id, event_id, count(*) n from v_attendance group by 1, 2 having count(*) > 1",
)
def unique_violations(t: Tables) -> DataFrame:
    return tables.assert_unique(t.attendance_rows, ["participant_id", "event_id"])


@query(
    "distinct_links",
    "v_attendance",
    "select distinct participant_id, event_id from v_attendance",
)
def distinct_links(t: Tables) -> DataFrame:
    return tables.distinct_links(t.attendance_rows)


@query(
    "people_of_one_country",
    "v_participants",
    "select pid, name from v_participants where representing_country = 'C003'",
)
def people_of_one_country(t: Tables) -> DataFrame:
    return tables.by_country(t.participants_where(representing_country="C003"), "C003").select("pid", "name")


@query("people_of_one_grade", "v_participants", "select pid, name from v_participants where grade = 2")
def people_of_one_grade(t: Tables) -> DataFrame:
    return tables.by_grade(t.participants, 2).select("pid", "name")


@query(
    "links_of_one_event",
    "v_links",
    "select event_id, participant_id from v_links where event_id = 'E00011'",
)
def links_of_one_event(t: Tables) -> DataFrame:
    return tables.participant_ids(t.links_where(event_id="E00011"), "E00011")


@query(
    "links_of_one_person",
    "v_links",
    "select participant_id, event_id from v_links where participant_id = 'P0011'",
)
def links_of_one_person(t: Tables) -> DataFrame:
    return tables.event_ids(t.links_where(participant_id="P0011"), "P0011")


@query(
    "sorted_roster",
    "v_links v_participants v_countries",
    f"select event_id, pid, name, position, grade, country from ({_ROSTER}) order by grade, pid",
)
def sorted_roster(t: Tables) -> DataFrame:
    return paging.sort_roster(reports.roster_of(t.links, t.participants, t.countries, t.events), "grade")


@query("countries_by_name", "v_countries", "select cid, country from v_countries")
def countries_by_name(t: Tables) -> DataFrame:
    return stored.countries_by_name(t.countries).select("cid", "country")


@query(
    "preview_rows",
    "v_participants",
    """select '{"pid":"' || pid || '","name":"' || name || '","grade":' || grade || case when position = 'MACHINERY' then ''
    else ',"position":"' || position || '"' end || '}' preview from v_participants""",
)
def preview_rows(t: Tables) -> DataFrame:
    shown = F.when(F.col("position") != "MACHINERY", F.col("position")).alias("position")
    return reports.to_preview(t.participants.select("pid", "name", F.col("grade").cast("string").alias("grade"), shown))


@query(
    "same_citizenships",
    "v_participants",
    """select pid, birth_country = representing_country or third_country in (birth_country, representing_country) same
    from v_participants""",
)
def same_citizenships(t: Tables) -> DataFrame:
    """Whether the distinct citizenships are the three mentions in another order."""
    listed = F.array("birth_country", "representing_country", F.format_string("C%03d", F.col("ord") % 28))
    return t.participants.select("pid", (~text.same_items("citizenships", listed)).alias("same"))


@query(
    "unknown_citizenships",
    "v_participants v_countries",
    """select distinct pid, item from (select pid, unnest([representing_country, birth_country, third_country]) item
    from v_participants) where item not in (select cid from v_countries)""",
)
def unknown_citizenships(t: Tables) -> DataFrame:
    return validate.unknown_items(t.participants, "citizenships", ["pid"], t.countries)


@query(
    "load_guard",
    "v_participants v_events v_countries v_tests",
    """select *, not ((events > 5 and participants > 10 and countries > 5) or events >= source_events) as load from
    (select (select count(distinct eid) from v_tests) source_events, (select count(*) from v_events) events,
    (select count(*) from v_participants) participants, (select count(*) from v_countries) countries)""",
)
def load_guard(t: Tables) -> DataFrame:
    return tables.should_load(t.events, t.participants, t.countries, t.tests)
