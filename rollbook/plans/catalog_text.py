"""Scalar functions over whole texts and over values built from every row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rollbook.functions import dates, enums, names, text
from rollbook.functions.phones import normalize_phone
from rollbook.operators import match
from rollbook.plans.bindings import VIEWS, Tables
from rollbook.plans.catalog import query

VIEWS["v_lines_of_text"] = (
    "select doc_id, line_no, line from (select doc_id, unnest(string_split(text, chr(10))) line, "
    "(generate_subscripts(string_split(text, chr(10)), 1) - 1)::int line_no from documents)"
)


def text_lines(t: Tables) -> DataFrame:
    """Every line of every document."""
    return t.raw("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def digest(c: Column) -> Column:
    """Short fingerprint, so that results over whole texts stay small."""
    return F.md5(F.coalesce(c, F.lit("?")).cast("binary"))


def choose(key: str, *options: str | None) -> Column:
    """SQL expression per remainder of the key: the same text also serves the oracle."""
    cases = " ".join(f"when {i} then {o or 'null'}" for i, o in enumerate(options))
    return F.expr(f"case {key} % {len(options)} {cases} end")


def choose_sql(key: str, *options: str | None) -> str:
    cases = " ".join(f"when {i} then {o or 'null'}" for i, o in enumerate(options))
    return f"case {key} % {len(options)} {cases} end"


_WS = "trim(regexp_replace(line, '[[:space:]]+', ' ', 'g'))"
_CANON = "lower(strip_accents({}))"


@query(
    "whitespace_and_accents",
    "v_lines_of_text",
    f"select doc_id, line_no, md5({_WS}) norm, md5({_CANON.format(_WS)}) canon from v_lines_of_text",
)
def whitespace_and_accents(t: Tables) -> DataFrame:
    cleaned = text.norm_ws("line")
    return text_lines(t).select(
        "doc_id", "line_no", digest(cleaned).alias("norm"), digest(text.canon(cleaned)).alias("canon")
    )


_KEY = f"""case when s = '' then '' when contains(s, ',')
    then trim({_CANON.format("trim(split_part(s, ',', 1))")} || '|' || {_CANON.format("trim(substr(s, strpos(s, ',') + 1))")})
    else trim({_CANON.format("regexp_extract(s, '[^ ]*$')")} || '|' ||
    {_CANON.format("case when contains(s, ' ') then regexp_replace(s, ' [^ ]*$', '') else '' end")}) end"""


@query(
    "name_keys",
    "v_lines_of_text",
    f"select doc_id, line_no, md5({_KEY}) name_key from (select doc_id, line_no, {_WS} s from v_lines_of_text)",
)
def name_keys(t: Tables) -> DataFrame:
    return text_lines(t).select("doc_id", "line_no", digest(names.name_key_from_raw("line")).alias("name_key"))


_ORDERED = "case when contains(s, ',') then trim(trim(substr(s, strpos(s, ',') + 1)) || ' ' || trim(split_part(s, ',', 1))) else s end"
_WORDS = f"list_filter(string_split({_CANON.format(_ORDERED)}, ' '), lambda w: w <> '')"


@query(
    "name_variants",
    "v_lines_of_text",
    f"""select doc_id, line_no, case when len(w) = 1 then 1 else greatest(0, least(3, len(w) - 1))::int end variants,
    md5(case when len(w) = 0 then '' when len(w) = 1 then w[1] || '//' else array_to_string(list_transform(
    range(1, least(3, len(w) - 1) + 1), lambda i: w[1] || '/' || array_to_string(w[2:len(w) - i], ' ') || '/'
    || array_to_string(w[len(w) - i + 1:len(w)], ' ')), ';') end) digest
    from (select doc_id, line_no, {_WORDS} w from (select doc_id, line_no, {_WS} s from v_lines_of_text))""",
)
def name_variants(t: Tables) -> DataFrame:
    readings = text_lines(t).withColumn("v", names.name_variants("line"))
    joined = F.array_join(F.transform("v", lambda v: F.concat_ws("/", v["first"], v["middle"], v["last"])), ";")
    return readings.select("doc_id", "line_no", F.size("v").alias("variants"), digest(joined).alias("digest"))


def _upper(value: str) -> str:
    return f"replace(upper({value}), 'ẞ', 'SS')"


_DISPLAY = f"""case when s = {_upper('s')} and s <> lower(s) then s when not contains(s, ' ') then s
    else regexp_replace(s, '[^ ]*$', '') || {_upper("regexp_extract(s, '[^ ]*$')")} end"""


@query(
    "display_names",
    "v_lines_of_text",
    f"""select doc_id, line_no, md5({_DISPLAY}) display from (select doc_id, line_no, {_ORDERED} s from
    (select doc_id, line_no, {_ORDERED} s from (select doc_id, line_no, {_WS} s from v_lines_of_text)))""",
)
def display_names(t: Tables) -> DataFrame:
    return text_lines(t).select("doc_id", "line_no", digest(names.base_name("line")).alias("display"))


_PHONE = ("'+1 (202) 555-' || c_custkey", "'00387 65 ' || c_custkey || ' 453'", "'123'", None, "'  '", "'0038 ' || c_name")


def _phone_sql(value: str) -> str:
    digits = f"regexp_replace(regexp_replace(regexp_replace(trim({value}), '^00', ''), '^\\+', ''), '[^0-9]', '', 'g')"
    return f"case when length({digits}) between 8 and 15 then '+' || {digits} end"


@query(
    "phones",
    "",
    f"select c_custkey, raw, {_phone_sql('raw')} phone from (select c_custkey, {choose_sql('c_custkey', *_PHONE)} raw from customer)",
)
def phones(t: Tables) -> DataFrame:
    raw = t.raw("customer").select("c_custkey", choose("c_custkey", *_PHONE).alias("raw"))
    return raw.withColumn("phone", normalize_phone("raw"))


@query(
    "phones_in_text",
    "v_lines_of_text",
    f"select doc_id, line_no, {_phone_sql('line')} phone from v_lines_of_text where {_phone_sql('line')} is not null",
)
def phones_in_text(t: Tables) -> DataFrame:
    found = text_lines(t).select("doc_id", "line_no", normalize_phone("line").alias("phone"))
    return found.filter(F.col("phone").isNotNull())


_DAY, _MONTH, _YEAR = "(c_custkey % 31 + 1)", "(c_custkey % 12 + 1)", "(1950 + c_custkey % 60)"
_DATES = (
    f"concat({_YEAR}, '-', {_MONTH}, '-', {_DAY})",
    f"concat({_DAY}, '.', {_MONTH}, '.', {_YEAR})",
    f"concat({_MONTH}, '/', {_DAY}, '/', {_YEAR})",
    f"concat({_YEAR}, '')",
    "'1900-01-01'",
    "'not-a-date'",
    "'  '",
    None,
)


@query(
    "dobs",
    "",
    f"""select c_custkey, raw, strftime(nullif(d, date '1900-01-01'), '%Y-%m-%d') dob,
    trim(coalesce(raw, '')) <> '' and d is null bad from (select *, try_strptime(trim(raw),
    ['%Y-%m-%d', '%d.%m.%Y', '%m/%d/%Y'])::date d from (select c_custkey, {choose_sql('c_custkey', *_DATES)} raw from customer))""",
)
def dobs(t: Tables) -> DataFrame:
    raw = t.raw("customer").select("c_custkey", choose("c_custkey", *_DATES).alias("raw"))
    return raw.select(
        "c_custkey", "raw", F.date_format(dates.normalize_dob("raw"), "yyyy-MM-dd").alias("dob"),
        dates.bad_dob("raw").alias("bad"),
    )


@query(
    "excel_dates",
    "",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
    strftime(timestamp '1899-12-30' + to_microseconds(round_even(l_extendedprice * 86400000000, 0)::bigint),
    '%Y-%m-%d %H:%M:%S.%f') moment, strftime((timestamp '1899-12-30' + to_microseconds(
    round_even(l_extendedprice * 86400000000, 0)::bigint))::date, '%Y-%m-%d') iso from lineitem""",
)
def excel_dates(t: Tables) -> DataFrame:
    moment = dates.excel_datetime("l_extendedprice")
    number = F.col("l_extendedprice").cast("string")
    return t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("moment"),
        dates.iso_date(number, F.lit("n")).alias("iso"),
    )


@query(
    "document_dates",
    "",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
    strftime((l_shipdate::date::timestamp at time zone 'Europe/Zagreb') at time zone 'UTC', '%Y-%m-%d %H:%M') utc from lineitem""",
)
def document_dates(t: Tables) -> DataFrame:
    """Workbook dates belong to the workbook's zone."""
    shown = F.date_format("l_shipdate", "yyyy-MM-dd")
    return t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.date_format(dates.coerce_ts(shown), "yyyy-MM-dd HH:mm").alias("utc"),
    )


_PLACES = (
    "p_name || ' C033'", "p_name || ', Croatia'", "p_name || ' - Serbia'", "p_name || ' / Kosovo / x'",
    "'Online'", "p_brand || ', '", "'  '", "p_name || ',c' || lpad(cast(p_size as varchar(9)), 3, '0')",
)


@query(
    "locations",
    "",
    f"""select p_partkey, raw, case when s = '' then '' when code <> '' then trim(place, ' ,;-')
    when contains(s, ',') then trim(split_part(s, ',', 1)) when contains(s, ' - ') then trim(split_part(s, ' - ', 1))
    when contains(s, ' / ') then trim(split_part(s, ' / ', 1)) else s end place,
    case when s = '' then null when code <> '' then upper(code)
    when contains(s, ',') then nullif(trim(substr(s, strpos(s, ',') + 1)), '')
    when contains(s, ' - ') then nullif(trim(substr(s, strpos(s, ' - ') + 3)), '')
    when contains(s, ' / ') then nullif(trim(substr(s, strpos(s, ' / ') + 3)), '') end country_hint
    from (select *, trim(raw) s, regexp_extract(trim(raw), '^(.*?)[ ,;-]*([A-Za-z][0-9]{{3}})$', 2) code,
    regexp_extract(trim(raw), '^(.*?)[ ,;-]*([A-Za-z][0-9]{{3}})$', 1) place
    from (select p_partkey, {choose_sql('p_partkey', *_PLACES)} raw from part))""",
)
def locations(t: Tables) -> DataFrame:
    raw = t.raw("part").select("p_partkey", choose("p_partkey", *_PLACES).alias("raw"))
    return raw.select("p_partkey", "raw", text.split_location("raw").alias("l")).select("p_partkey", "raw", "l.*")


_TITLES = "concat('PFE25M', p_partkey % 10, '  ', p_name)"
_HEADERS = (
    "concat('JUNE ', p_partkey % 30 + 1, ' - ', p_partkey % 30 + 1, ' - Opatija, CROATIA')",
    "concat('february ', p_partkey % 31 + 1, ' - 28 - ', p_name)",
    "concat('APRIL 3 - ', p_brand)",
    "concat('SMARCH 3 - 4 - ', p_brand, ', ')",
    "''",
)
_MONTH_NO = "list_position(['JANUARY', 'FEBRUARY', 'MARCH', 'APRIL', 'MAY', 'JUNE'], regexp_extract(upper(a2), '^([A-Z]+) ', 1))"


@query(
    "headers",
    "",
    f"""select p_partkey, split_part(a1, ' ', 1) eid, p_name title,
    case when three then strftime(try_cast(printf('2025-%02d-%02d', {_MONTH_NO}, start_day) as date), '%Y-%m-%d') end start_date,
    case when three then strftime(try_cast(printf('2025-%02d-%02d', {_MONTH_NO}, end_day) as date), '%Y-%m-%d') end end_date,
    case when three then trim(split_part(split_part(a2, ' - ', 3), ',', 1)) else '' end place,
    case when three and contains(a2, ',') then nullif(trim(split_part(a2, ',', 2)), '') end country_text
    from (select *, len(string_split(a2, ' - ')) >= 3 three,
    try_cast(regexp_extract(upper(a2), '^[A-Z]+ ([0-9]+)', 1) as int) start_day,
    try_cast(regexp_extract(split_part(a2, ' - ', 2), '([0-9]+)', 1) as int) end_day
    from (select p_partkey, p_name, {_TITLES} a1, {choose_sql('p_partkey', *_HEADERS)} a2 from part))""",
)
def headers(t: Tables) -> DataFrame:
    raw = t.raw("part").select(
        "p_partkey", F.expr(_TITLES).alias("a1"), choose("p_partkey", *_HEADERS).alias("a2")
    )
    parsed = raw.select("p_partkey", dates.event_header("a1", "a2", F.lit(2025)).alias("h")).select("p_partkey", "h.*")
    return parsed.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("start_date", "end_date")})


_GENDER = ("'M'", "' Mr. '", "'Mrs'", "'female'", "'Ms'", "'x'", None, "' '")
_GRADE = ("'0'", "'2.0'", "'5'", "'x'", "' 1 '", None, "'2'")
_BOOL = ("'Yes'", "'no'", "'1'", "'ON'", "'off'", "''", "'maybe'", None, "'TRUE'")
_TYPE = ("'Training'", "'workshop'", "'STUDY TRIP'", "'Study trip'", "'Party'", "''", None)
_DOC = ("'Passport'", "'passport no. 3'", "'ID'", "''", None, "' PASSPORT '")
_MOVE = ("'air (airplane)'", "'Other'", "'Bus'", None)
_COST = ("'12.50'", "'abc'", "' 7 '", "''", None, "'1e3'")


def _all(key: str, table: str) -> str:
    columns = {
        "g": _GENDER, "r": _GRADE, "b": _BOOL, "e": _TYPE, "d": _DOC, "m": _MOVE, "c": _COST,
    }
    return f"select {key}, " + ", ".join(f"{choose_sql(key, *v)} {n}" for n, v in columns.items()) + f" from {table}"


@query(
    "enum_coercions",
    "",
    f"""select o_orderkey,
    case when rtrim(lower(trim(g)), '.') in ('m', 'male', 'man', 'mr') then 'Male'
     when rtrim(lower(trim(g)), '.') in ('f', 'female', 'woman', 'ms', 'mrs') then 'Female' end gender,
    case when lower(trim(g)) like 'm%' then 'Male' when lower(trim(g)) like 'f%' then 'Female' end gender_initial,
    coalesce(case when try_cast(trim(r) as double)::int in (0, 1, 2) then try_cast(trim(r) as double)::int end, 1) grade,
    coalesce(case when trim(r) in ('0', '1', '2') then trim(r)::int end, 1) grade_load,
    case when lower(trim(b)) in ('yes', 'true') then true when lower(trim(b)) in ('no', 'false') then false end flag,
    case when lower(trim(b)) in ('yes', 'true', '1', 'y') then true when lower(trim(b)) in ('no', 'false', '0', 'n') then false end flag_load,
    case when coalesce(trim(b), '') <> '' then lower(trim(b)) in ('true', '1', 'on', 'yes') end flag_form,
    case when e in ('Training', 'Workshop', 'Study trip', 'Other') then e when e = 'workshop' then 'Workshop' end event_type,
    case when e in ('Training', 'Workshop', 'Study trip', 'Other') then e when e <> '' then 'Other' end event_type_upload,
    case when contains(lower(coalesce(d, '')), 'pass') then 'Passport' else 'ID Card' end doc_type,
    case when trim(coalesce(d, '')) = 'Passport' then 'Passport' else 'ID Card' end doc_type_strict,
    case when lower(trim(d)) = 'passport' then 'Passport' when trim(d) <> '' then 'ID Card' end doc_type_load,
    case m when 'air (airplane)' then 'Air (Airplane)' when 'Other' then 'Other' end transport,
    try_cast(trim(c) as double) as cost,
    case coalesce(case when try_cast(trim(r) as double)::int in (0, 1, 2) then try_cast(trim(r) as double)::int end, 1)
     when 0 then 'Black List' when 1 then 'Normal' else 'Excellent' end grade_label
    from ({_all('o_orderkey', 'orders')})""",
)
def enum_coercions(t: Tables) -> DataFrame:
    orders = t.raw("orders")
    options = {"g": _GENDER, "r": _GRADE, "b": _BOOL, "e": _TYPE, "d": _DOC, "m": _MOVE, "c": _COST}
    raw = orders.select("o_orderkey", *[choose("o_orderkey", *v).alias(n) for n, v in options.items()])
    return raw.select(
        "o_orderkey",
        enums.gender("g").alias("gender"),
        enums.gender("g", "initial").alias("gender_initial"),
        enums.grade("r").alias("grade"),
        enums.grade("r", "load").alias("grade_load"),
        enums.to_bool("b").alias("flag"),
        enums.to_bool("b", "load").alias("flag_load"),
        enums.to_bool("b", "form").alias("flag_form"),
        enums.event_type("e").alias("event_type"),
        enums.event_type("e", unknown="Other").alias("event_type_upload"),
        enums.doc_type("d").alias("doc_type"),
        enums.doc_type("d", "strict").alias("doc_type_strict"),
        enums.doc_type("d", "load").alias("doc_type_load"),
        enums.enum_match("m", ("Air (Airplane)", "Other")).alias("transport"),
        enums.cost("c").alias("cost"),
        enums.grade_label(enums.grade("r")).alias("grade_label"),
    )


_EMPTY = ("''", "c_name", None, "'  '")
_OTHER = ("c_mktsegment", "''", "'00385' || lpad(cast(c_custkey as varchar(9)), 8, '0')")


@query(
    "fill_missing",
    "",
    f"""select c_custkey, coalesce(nullif(a, ''), nullif(b, ''), a) filled,
    coalesce(nullif(a, ''), {_phone_sql("nullif(b, '')")}, a) phone,
    coalesce(nullif(trim(a), ''), nullif(trim(b), '')) first_text,
    case when coalesce(a, '') <> '' then a when c_custkey % 5 = 0 then coalesce(b, '') else '' end transport
    from (select c_custkey, {choose_sql('c_custkey', *_EMPTY)} a, {choose_sql('c_custkey', *_OTHER)} b from customer)""",
)
def fill_missing(t: Tables) -> DataFrame:
    raw = t.raw("customer").select(
        "c_custkey", choose("c_custkey", *_EMPTY).alias("a"), choose("c_custkey", *_OTHER).alias("b")
    )
    return raw.select(
        "c_custkey",
        text.fill_missing("a", "b").alias("filled"),
        text.fill_missing("a", "b", phone=True).alias("phone"),
        text.first_non_blank("a", "b").alias("first_text"),
        enums.transport(F.col("a"), F.col("b"), F.col("c_custkey") % 5 != 0).alias("transport"),
    )


_PLAIN = "replace(strip_accents(text), 'ß', 'ss')"


@query(
    "split_countries",
    "",
    f"""select doc_id, len(parts)::int parts, md5(array_to_string(parts, ';')) digest from (select doc_id,
    list_filter(list_transform(string_split_regex(replace(regexp_replace({_PLAIN}, '(?i)\\bR\\.[[:space:]]*', 'R ', 'g'), '&', ' and '),
    '(?i)[;,/]|\\band\\b|\\bi\\b'), lambda x: regexp_replace(x, '^[[:space:]]+|[[:space:]]+$', '', 'g')), lambda x: x <> '') parts from documents)""",
)
def split_countries(t: Tables) -> DataFrame:
    plain = F.replace(text.strip_accents("text"), F.lit("ß"), F.lit("ss"))
    split = t.raw("documents").select("doc_id", text.split_multi_country(plain).alias("parts"))
    return split.select("doc_id", F.size("parts").alias("parts"), digest(F.array_join("parts", ";")).alias("digest"))


@query(
    "split_values",
    "",
    """select doc_id, len(items)::int items, md5(array_to_string(items, ';')) digest from (select doc_id,
    list_filter(list_transform(string_split_regex(text, '[;,]'), lambda x: regexp_replace(x, '^[[:space:]]+|[[:space:]]+$', '', 'g')),
    lambda x: x <> '') items from documents)""",
)
def split_values(t: Tables) -> DataFrame:
    split = t.raw("documents").select("doc_id", text.split_multi("text").alias("items"))
    return split.select("doc_id", F.size("items").alias("items"), digest(F.array_join("items", ";")).alias("digest"))


@query(
    "citizenship_lists",
    "",
    """select doc_id, len(list_distinct(items))::int items,
    md5(array_to_string(list_sort(list_distinct(items)), ';')) digest from (select doc_id,
    list_filter(list_transform(string_split_regex(text, '[;,]'), lambda x: regexp_replace(x, '^[[:space:]]+|[[:space:]]+$', '', 'g')),
    lambda x: x <> '') items from documents)""",
)
def citizenship_lists(t: Tables) -> DataFrame:
    lists = t.raw("documents").select("doc_id", text.citizenships("text").alias("items"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return lists.select(
        "doc_id", F.size(items).alias("items"), digest(F.array_join(F.array_sort(items), ";")).alias("digest")
    )


_LEGACY = ("'BH'", "'hrv'", "'Kosovar'", "' Makedonija '", "'Bosnia Herzegovina'", "'Republika Srbija'", "'Freedonia'", "'croatia'", None)


@query(
    "legacy_countries",
    "",
    f"""select c_custkey, case lower(trim(raw)) when 'bh' then 'Bosnia and Herzegovina' when 'hrv' then 'Croatia'
    when 'kosovar' then 'Kosovo' when 'makedonija' then 'North Macedonia' when 'bosnia herzegovina' then 'Bosnia and Herzegovina'
    when 'republika srbija' then 'Serbia' when 'croatia' then 'Croatia' end country,
    case when raw is not null and lower(trim(raw)) <> 'freedonia' then 'Europe & Eurasia' end region,
    case lower(trim(raw)) when 'hrv' then 'iso' when 'bosnia herzegovina' then 'exact' when 'croatia' then 'exact'
    when 'freedonia' then null else case when raw is not null then 'alias' end end as method
    from (select c_custkey, {choose_sql('c_custkey', *_LEGACY)} raw from customer)""",
)
def legacy_countries(t: Tables) -> DataFrame:
    raw = t.raw("customer").select("c_custkey", choose("c_custkey", *_LEGACY).alias("raw"))
    return raw.select("c_custkey", match.legacy_country("raw").alias("r")).select("c_custkey", "r.country", "r.region", "r.method")


@query(
    "table_names",
    "",
    "select p_partkey, lower(regexp_replace(p_name || '-' || p_brand, '[^0-9a-zA-Z]+', '', 'g')) name_norm from part",
)
def table_names(t: Tables) -> DataFrame:
    return t.raw("part").select(
        "p_partkey", text.norm_table_name(F.concat_ws("-", "p_name", "p_brand")).alias("name_norm")
    )


@query(
    "entries",
    "v_lines_of_text",
    """select doc_id, line_no, md5(trim(name)) as name, md5(trim(position)) as position from (select doc_id, line_no,
    case when contains(line, ',') then split_part(line, ',', 1) when contains(line, ' – ') then split_part(line, ' – ', 1)
     when contains(line, ' - ') then split_part(line, ' - ', 1) else line end as name,
    case when contains(line, ',') then substr(line, strpos(line, ',') + 1)
     when contains(line, ' – ') then substr(line, strpos(line, ' – ') + 3)
     when contains(line, ' - ') then substr(line, strpos(line, ' - ') + 3) else '' end as position
    from (select doc_id, line_no, trim(regexp_replace(line, '[[:space:]]+', ' ', 'g')) line from v_lines_of_text))""",
)
def entries(t: Tables) -> DataFrame:
    lines = text_lines(t).withColumn("e", text.split_entry(text.norm_ws("line")))
    return lines.select("doc_id", "line_no", digest(F.col("e.name")).alias("name"), digest(F.col("e.position")).alias("position"))
