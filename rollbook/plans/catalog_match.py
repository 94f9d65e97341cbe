"""Record linkage: countries in text, name lookups, matching of people, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollbook.functions import names
from rollbook.operators import match, merge, tables
from rollbook.plans.bindings import VIEWS, Tables
from rollbook.plans.catalog import query
from rollbook.plans.catalog_text import choose, choose_sql

_LAND_NAMES = (
    "Albania", "Bosnia and Herzegovina", "Croatia", "Kosovo", "Montenegro", "North Macedonia", "Serbia", "Türkiye",
)
VIEWS["v_lands"] = (
    "select cid, ord, case ord "
    + " ".join(f"when {i} then '{n}'" for i, n in enumerate(_LAND_NAMES))
    + " else country end country from v_countries"
)
_MENTIONS = (
    "'Kosovar'", "'R Serbia'", "'BiH'", "' Hrvatska '", "'makedonija'", "'Turkiye'", "'republika srbija'", "'Crna  Gora'",
    "'n/a'", "'nation_1'", "'TION_2'", "'Freedonia'", "''", None, "'Sjeverna Makedonija'", "'Herzegovina'", "c_name", "'on'",
)
VIEWS["v_mentions"] = f"""select distinct raw from (select {choose_sql('c_custkey', *_MENTIONS)} raw from customer
    union all select unnest(string_split_regex(text, '[^A-Za-z]+')) from documents) where raw is not null"""


def lands(t: Tables) -> DataFrame:
    """Countries of which the first eight have real names."""
    name = F.when(F.lit(False), "")
    for no, land in enumerate(_LAND_NAMES):
        name = name.when(F.col("ord") == no, land)
    return t.countries.withColumn("country", F.coalesce(name, F.col("country")))


def mentions(t: Tables) -> DataFrame:
    """Every word of every document, and one phrase per customer."""
    phrases = t.raw("customer").select(choose("c_custkey", *_MENTIONS).alias("raw"))
    words = t.raw("documents").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("raw"))
    return phrases.unionByName(words).filter(F.col("raw").isNotNull())


@query(
    "country_prefix",
    "v_lands v_mentions",
    """select raw, arg_min(l.cid, l.ord) cid from v_mentions m join v_lands l
    on trim(raw) <> '' and starts_with(lower(l.country), lower(trim(raw))) group by 1""",
)
def country_prefix(t: Tables) -> DataFrame:
    return match.country_first_match(mentions(t), "raw", lands(t)).select("raw", "cid")


@query(
    "country_contains",
    "v_lands v_mentions",
    """select raw, arg_min(l.cid, l.ord) cid from v_mentions m join v_lands l
    on trim(raw) <> '' and contains(lower(l.country), lower(trim(raw))) group by 1""",
)
def country_contains(t: Tables) -> DataFrame:
    return match.country_first_match(mentions(t), "raw", lands(t), "contains").select("raw", "cid")


_ALIAS_ROWS = ", ".join(
    f"({no}, '{pattern}', '{name.lower()}')" for no, (pattern, name) in enumerate(match.ALIASES)
)
_SKIP = ", ".join("'" + s.replace("'", "''") + "'" for s in match.SKIPPED)
_RESOLVED = f"""select raw, arg_min(cid, (stage, ord)) cid from (
    select raw, stage, cid, ord from (select raw, trim(lower(strip_accents(raw))) s, lower(trim(raw)) low from v_mentions) m
    join (select p, pattern, target from (values {_ALIAS_ROWS}) a(p, pattern, target)) a on regexp_matches(s, pattern)
    join v_lands l on starts_with(lower(l.country), target), lateral (select p stage) where s not in ({_SKIP})
    union all select raw, 100, cid, ord from v_mentions join v_lands on trim(raw) <> '' and starts_with(lower(country), lower(trim(raw)))
      where trim(lower(strip_accents(raw))) not in ({_SKIP})
    union all select raw, 101, cid, ord from v_mentions join v_lands on trim(raw) <> '' and contains(lower(country), lower(trim(raw)))
      where trim(lower(strip_accents(raw))) not in ({_SKIP})
    union all select raw, 102, cid, ord from v_mentions join v_lands on trim(raw) <> ''
      and contains(lower(strip_accents(country)), trim(lower(strip_accents(raw)))) where trim(lower(strip_accents(raw))) not in ({_SKIP})
    ) group by 1"""


@query("country_flexible", "v_lands v_mentions", _RESOLVED)
def country_flexible(t: Tables) -> DataFrame:
    return match.resolve_tokens(mentions(t), "raw", lands(t)).select("raw", "cid")


#: Rules that other tables give: one for each nation, found by word, beginning or piece, and one for each supplier.
_RULES = """select n_nationkey as priority, case n_nationkey % 3 when 0 then 'word' when 1 then 'prefix' else 'piece' end as how,
    case n_nationkey % 3 when 2 then substr(lower(n_name), 3) else lower(n_name) end as literal,
    concat(case n_nationkey % 3 when 2 then '' else '^' end, case n_nationkey % 3 when 2 then substr(lower(n_name), 3) else lower(n_name) end,
        case n_nationkey % 3 when 1 then '' else '$' end) as pattern,
    (n_nationkey + 7) % 25 as target from nation
    union all select s_suppkey + 100, 'word', lpad(cast(s_suppkey as {text}), 9, '0'), concat('^customer#', lpad(cast(s_suppkey as {text}), 9, '0'), '$'),
    s_nationkey from supplier"""


@query(
    "country_by_rules",
    "v_lands v_mentions",
    f"""select raw, arg_min(cid, (stage, p, ord)) cid from (
    select raw, 0 stage, priority p, l.cid, l.ord from (select raw, trim(lower(strip_accents(raw))) s from v_mentions) m
    join ({_RULES.format(text='varchar')}) r on regexp_matches(s, pattern) join v_lands t on t.ord = r.target
    join v_lands l on starts_with(lower(l.country), lower(t.country)) where s not in ({_SKIP})
    union all select raw, 1, 0, cid, ord from v_mentions join v_lands on trim(raw) <> '' and starts_with(lower(country), lower(trim(raw)))
      where trim(lower(strip_accents(raw))) not in ({_SKIP})
    ) group by 1""",
)
def country_by_rules(t: Tables) -> DataFrame:
    for name in ("nation", "supplier"):
        t.raw(name).createOrReplaceTempView(name)
    rules = t.spark.sql(_RULES.format(text="string")).join(lands(t).select("ord", "country"), F.col("target") == F.col("ord")).drop("ord", "target")
    return match.resolve_by_rules(mentions(t), "raw", lands(t), rules, strict=True).select("raw", "cid")


_BIRTH = (
    "'Kosovo, World'", "'Hrvatska'", "'Atlantis'", "''", None, "'NATION_12, world'", "'Republika Srbija'",
)


@query(
    "birth_countries",
    "v_lands",
    f"""select c_custkey, case c_custkey % 7 when 0 then 'C003' when 1 then 'C002' when 5 then 'C012' when 6 then 'C006'
    else printf('C%03d', c_nationkey) end birth from customer""",
)
def birth_countries(t: Tables) -> DataFrame:
    rows = t.raw("customer").select(
        "c_custkey", choose("c_custkey", *_BIRTH).alias("raw"), F.format_string("C%03d", "c_nationkey").alias("rep")
    )
    return match.birth_country(rows, "raw", "rep", lands(t), "birth").select("c_custkey", "birth")


_CITIZEN = (
    "'BiH i RH'", "'Serbia, R. Serbia; Kosovo'", "'Atlantis'", "'Makedonija / Srb'", "'Croatia & Montenegro and Croatia'", None,
)


@query(
    "citizenship_codes",
    "",
    """select c_custkey, case c_custkey % 6 when 0 then 'C001,C002' when 1 then 'C006,C003' when 3 then 'C005,C006'
    else 'C002,C004' end codes from customer where c_custkey % 6 in (0, 1, 3, 4)""",
)
def citizenship_codes(t: Tables) -> DataFrame:
    """Rows without any recognised country have no codes and are absent."""
    rows = t.raw("customer").select("c_custkey", F.array(choose("c_custkey", *_CITIZEN)).alias("items"))
    codes = match.citizenship_cids(rows, "items", ["c_custkey"], lands(t))
    return codes.select("c_custkey", F.array_join("citizenships", ",").alias("codes"))


_PLACES = ("country", "cid", "lower(country)", "'Elsewhere'", None)


@query(
    "event_countries",
    "v_events v_countries",
    f"""select e.eid, case e.k when 0 then coalesce(c.cid, e.country) when 1 then e.country when 2 then coalesce(c.cid, lower(e.country))
    when 3 then 'Elsewhere' end country from (select *, substr(eid, 2)::bigint % 5 k from v_events) e
    left join v_countries c on c.cid = e.country""",
)
def event_countries(t: Tables) -> DataFrame:
    """Events whose country is written as a name, a code or something else."""
    named = t.events.join(t.countries.withColumnRenamed("country", "_name"), F.col("country") == F.col("cid"), "left")
    name = F.coalesce("_name", "country")
    kind = F.substring("eid", 2, 20).cast("bigint") % 5
    written = F.when(kind == 0, name).when(kind == 1, F.col("country")).when(kind == 2, F.lower(name)).when(kind == 3, "Elsewhere")
    return match.event_country(named.select("eid", written.alias("country")), t.countries).select("eid", "country")


@query(
    "label_codes",
    "v_lands",
    """select c_custkey, coalesce((select arg_min(cid, ord) from v_lands where starts_with(lower(country), lower(label))), label) cid
    from (select c_custkey, case c_custkey % 4 when 0 then 'Kosovo' when 1 then 'Kosovo, Europe & Eurasia' when 2 then 'nation_2'
    else c_mktsegment end label from customer)""",
)
def label_codes(t: Tables) -> DataFrame:
    options = ("'Kosovo'", "'Kosovo, Europe & Eurasia'", "'nation_2'", "c_mktsegment")
    rows = t.raw("customer").select("c_custkey", choose("c_custkey", *options).alias("label"))
    return match.label_to_cid(rows, "label", lands(t), "cid").select("c_custkey", "cid")


# --- people ------------------------------------------------------------------------

#: Stored people share names in large groups, and some have no date of birth.
_STORED = """select printf('P%04d', c_custkey) pid, c_mktsegment as name, printf('C%03d', c_nationkey % 2) cc,
    case when c_custkey % 50 <> 3 then date '1950-01-01' + (c_custkey * 37 % 2000)::int end dob, c_custkey ord
    from customer"""
_INCOMING = """select o_orderkey, c_mktsegment as name, printf('C%03d', c_nationkey % 3) cc,
    case when o_orderkey % 9 <> 0 then date '1950-01-01' + (o_orderkey * 37 % 2100)::int end dob
    from orders join customer on o_custkey = c_custkey"""


def stored_people(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    day = F.date_add(F.lit("1950-01-01").cast("date"), (key * 37 % 2000).cast("int"))
    return t.raw("customer").select(
        F.format_string("P%04d", key).alias("pid"),
        F.col("c_mktsegment").alias("name"),
        F.format_string("C%03d", F.col("c_nationkey") % 2).alias("representing_country"),
        F.when(key % 50 != 3, day).alias("dob"),
        key.alias("ord"),
    )


def incoming_people(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    day = F.date_add(F.lit("1950-01-01").cast("date"), (key * 37 % 2100).cast("int"))
    joined = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        "o_orderkey",
        F.col("c_mktsegment").alias("name"),
        F.format_string("C%03d", F.col("c_nationkey") % 3).alias("representing_country"),
        F.when(key % 9 != 0, day).alias("dob"),
    )


def _match_sql(accepted: str) -> str:
    return f"""select o_orderkey, (select arg_min(pid, ord) from ({_STORED}) s
    where s.name = i.name and s.cc = i.cc and ({accepted})) matched_pid from ({_INCOMING}) i"""


@query("match_existing_strict", "", _match_sql("s.dob is null or s.dob = i.dob"))
def match_existing_strict(t: Tables) -> DataFrame:
    return match.match_existing(incoming_people(t), stored_people(t), "strict").select("o_orderkey", "matched_pid")


@query("match_existing_lenient", "", _match_sql("i.dob is null or s.dob is null or s.dob = i.dob"))
def match_existing_lenient(t: Tables) -> DataFrame:
    return match.match_existing(incoming_people(t), stored_people(t), "lenient").select("o_orderkey", "matched_pid")


@query(
    "classify",
    "",
    f"""select o_orderkey, p pid, case when p is null then 'NEW' else 'EXIST' end status from (select o_orderkey,
    (select arg_min(pid, ord) from ({_STORED}) s where s.name = i.name and s.cc = i.cc and s.dob is null) p from ({_INCOMING}) i)""",
)
def classify(t: Tables) -> DataFrame:
    return match.classify(incoming_people(t).drop("dob"), stored_people(t)).select("o_orderkey", "pid", "status")


#: A register of people (positions) and a form table (online), both derived from customers.
_FIRST = ("'Ann'", "'Željko'", "'Bob'", "'Eva'")
_MIDDLE = ("'Mary'", "''", "'van'", "''", "'Lu'")
_LAST = "'Smith' || (c_custkey // 3)"


def _people_sql() -> str:
    return f"""select c_custkey k, {choose_sql('c_custkey', *_FIRST)} f, {choose_sql('c_custkey', *_MIDDLE)} m, {_LAST} l,
    c_mktsegment seg, '+385' || lpad(c_custkey::varchar, 8, '0') phone from customer"""


def people(t: Tables) -> DataFrame:
    return t.raw("customer").select(
        F.lit("w").alias("path"),
        F.col("c_custkey").alias("row_no"),
        choose("c_custkey", *_FIRST).alias("first_name"),
        choose("c_custkey", *_MIDDLE).alias("middle_name"),
        F.concat(F.lit("Smith"), F.floor(F.col("c_custkey") / 3).cast("string")).alias("last_name"),
        F.col("c_mktsegment").alias("segment"),
        F.concat(F.lit("+385"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("phone"),
    )


def positions(t: Tables) -> DataFrame:
    first = F.trim(F.concat_ws(" ", "first_name", F.col("middle_name")))
    listed = people(t).select(
        "path", "row_no",
        F.when(F.col("row_no") % 4 != 1, F.concat(F.col("last_name"), F.lit(", "), first)).alias("name_raw"),
        F.concat(F.lit(" "), F.col("segment"), F.lit("  x ")).alias("position"), "phone",
        F.lit(None).cast("string").alias("email"),
    )
    return merge.positions_lookup(listed)


@query(
    "positions_lookup",
    "",
    f"""select key, arg_max(seg || ' x', k) as position, arg_max(phone, k) phone, '' email from
    (select *, trim(lower(l) || '|' || lower(strip_accents(trim(f || ' ' || m)))) key from ({_people_sql()}) where k % 4 <> 1) group by 1""",
)
def positions_lookup(t: Tables) -> DataFrame:
    return positions(t).drop("path")


def online(t: Tables) -> DataFrame:
    named = F.col("row_no") % 3 != 1
    forms = people(t).withColumns({c: F.when(named, F.col(c)) for c in ("first_name", "middle_name", "last_name")})
    empty = (
        "citizenships_raw email travel_doc_type transportation transport_other traveling_from iban_type pob travel_doc_number "
        "returning_to diet_restrictions intl_authority bank_name iban swift travel_doc_issued_by organization unit rank "
        "bio_short position dob dob_kind travel_doc_issue travel_doc_issue_kind travel_doc_expiry travel_doc_expiry_kind"
    ).split()
    forms = forms.withColumns({c: F.lit(None).cast("string") for c in empty})
    forms = forms.withColumns({"gender": F.lit("Mr."), "birth_country_raw": F.concat("segment", F.lit(", World"))})
    return merge.online_lookup(forms)


_ONLINE_SQL = f"""select key, arg_min(seg, (k, kn)) birth_country, arg_min(phone, (k, kn)) phone, min(k) first_row from (
    select *, 0 kn, trim(lower(l) || '|' || lower(strip_accents(trim(f || ' ' || m)))) key from ({_people_sql()}) where k % 3 <> 1
    union all select *, 1, lower(l) || '|' || lower(strip_accents(f)) from ({_people_sql()}) where k % 3 <> 1 and m <> '') group by 1"""


@query(
    "online_lookup",
    "",
    f"select key, birth_country, phone, 'Male' gender from ({_ONLINE_SQL})",
)
def online_lookup(t: Tables) -> DataFrame:
    return online(t).select("key", "online.birth_country", F.col("online.phone_list").alias("phone"), "online.gender")


@query(
    "lookup_join",
    "",
    f"""with p as (select key, arg_max(seg || ' x', k) as position from (select *,
     trim(lower(l) || '|' || lower(strip_accents(trim(f || ' ' || m)))) key from ({_people_sql()}) where k % 4 <> 1) group by 1),
    o as ({_ONLINE_SQL}),
    a as (select k, [lower(strip_accents(x)) for x in string_split(trim(f || ' ' || m) || ' ' || l, ' ') if x <> ''] w from ({_people_sql()})),
    v as (select k, i, w[1] f1, array_to_string(w[2:len(w) - i], ' ') m1, array_to_string(w[len(w) - i + 1:len(w)], ' ') l1
      from (select k, w, unnest(range(1, least(3, len(w) - 1) + 1)) i from a)),
    h as (select k, i, coalesce(oa.birth_country, ob.birth_country) birth_country, coalesce(pa.position, pb.position) as position
      from v left join o oa on oa.key = trim(l1 || '|' || trim(f1 || ' ' || m1)) left join o ob on ob.key = l1 || '|' || f1
      left join p pa on pa.key = trim(l1 || '|' || trim(f1 || ' ' || m1)) left join p pb on pb.key = l1 || '|' || f1)
    select k row_no, b.birth_country, b.position from (select distinct k from a) left join
    (select k, arg_min(coalesce(birth_country, '-'), i) birth_country, arg_min(coalesce(position, '-'), i) as position
     from h where birth_country is not null or position is not null group by 1) b using (k)""",
)
def lookup_join(t: Tables) -> DataFrame:
    whole = F.concat_ws(" ", F.trim(F.concat_ws(" ", "first_name", "middle_name")), "last_name")
    attendees = people(t).select("path", "row_no", whole.alias("name_raw"))
    found = match.lookup_attendees(attendees, online(t), positions(t), ["path", "row_no"])
    hit = F.col("online").isNotNull() | F.col("listed").isNotNull()
    return found.select(
        "row_no",
        F.when(hit, F.coalesce("online.birth_country", F.lit("-"))).alias("birth_country"),
        F.when(hit, F.coalesce("listed.position", F.lit("-"))).alias("position"),
    )


@query(
    "name_parts",
    "",
    f"""select k row_no, trim(lower(l) || '|' || lower(strip_accents(f))) key, upper(l) shown from ({_people_sql()})""",
)
def name_parts(t: Tables) -> DataFrame:
    last_word = F.substring_index(names.display_name(F.concat_ws(" ", "first_name", "last_name")), " ", -1)
    return people(t).select("row_no", names.name_key("last_name", "first_name").alias("key"), last_word.alias("shown"))


# --- events and snapshots ------------------------------------------------------------


@query(
    "new_events",
    "v_events v_links",
    "select eid from v_events where eid not in (select event_id from v_links)",
)
def new_events(t: Tables) -> DataFrame:
    stored = t.links.select(F.col("event_id").alias("eid"))
    return tables.new_events(t.events, stored).select("eid")


@query(
    "known_events",
    "v_events v_links",
    "select eid from v_events where eid in (select event_id from v_links)",
)
def known_events(t: Tables) -> DataFrame:
    stored = t.links.select(F.col("event_id").alias("eid"))
    return tables.known_events(t.events, stored).select("eid")


@query(
    "rows_with_event_date",
    "v_tests v_events",
    """select t.pid, max(strftime(e.start_date, '%Y-%m-%d')) newest, count(*) n from v_tests t left join v_events e
    on e.eid = t.eid group by 1""",
)
def rows_with_event_date(t: Tables) -> DataFrame:
    dated = match.with_event_date(t.tests, t.events, "eid")
    return dated.groupBy("pid").agg(
        F.date_format(F.max("event_date"), "yyyy-MM-dd").alias("newest"), F.count(F.lit(1)).alias("n")
    )


@query(
    "choose_snapshot",
    "v_attendance v_links",
    """select l.participant_id, l.event_id, case when substr(l.participant_id, 2)::bigint % 3 = 0 then 'own' else s.traveling_from end traveling_from
    from v_links l join (select participant_id, event_id, arg_max(traveling_from, (l_orderkey, l_linenumber, l_suppkey, l_quantity)) traveling_from
     from v_attendance group by 1, 2) s using (participant_id, event_id)""",
)
def choose_snapshot(t: Tables) -> DataFrame:
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").alias("_order")
    keys = ["participant_id", "event_id"]
    silent = F.substring("participant_id", 2, 20).cast("bigint") % 3 == 0
    supplied = t.attendance_rows.select(
        F.when(silent, "nobody").otherwise(F.col("participant_id")).alias("participant_id"), "event_id", "traveling_from", order
    )
    rows = t.links.withColumn("own", F.struct(F.lit("own").alias("traveling_from")))
    chosen = match.choose_snapshot(rows, supplied, keys, "own", "_order")
    return chosen.select(*keys, F.col("snapshot.traveling_from").alias("traveling_from"))


def known_phrases(t: Tables) -> DataFrame:
    """A small phrase table; one phrase has two source languages, and case differs."""
    return t.spark.createDataFrame(
        [("pasaporte", "en", "passport", "es"), ("Dieta vegetariana", "EN", "vegetarian diet", "es"), ("pasaporte", "en", "passport", "pt")],
        "phrase string, lang string, translated string, source_lang string",
    )


_PHRASES = ("'Pasaporte'", "'dieta vegetariana'", "c_name", "''", None)


@query(
    "translate",
    "",
    """select c_custkey, case c_custkey % 5 when 0 then 'passport' when 1 then 'vegetarian diet' when 2 then c_name else '' end phrase
    from customer""",
)
def translate(t: Tables) -> DataFrame:
    rows = t.raw("customer").select("c_custkey", choose("c_custkey", *_PHRASES).alias("phrase"))
    return match.translate(rows, ["phrase"], known_phrases(t))
