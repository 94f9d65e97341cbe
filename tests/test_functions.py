"""Scalar functions against known values."""

from __future__ import annotations

import unicodedata
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rollbook.functions import dates, enums, names, text
from rollbook.functions.phones import normalize_phone
from rollbook.operators import match


@pytest.mark.parametrize(
    ("a", "b"),
    [("Smith, John Paul", "John Paul Smith"), ("VUÇETAJ Ana", "Vucetaj Ana"), ("Ana Kujača", "ANA KUJACA")],
)
def test_name_keys_agree(evaluate, a, b):
    key = names.name_key_from_raw("x")
    assert evaluate(key, a) == evaluate(key, b)


def test_name_key_shape(evaluate):
    assert evaluate(names.name_key_from_raw("x"), " Smith,  John  Paul ") == "smith|john paul"
    assert evaluate(names.name_key_from_raw("x"), "Cher") == "cher|"
    assert evaluate(names.name_key_from_raw("x"), None) == ""


def test_name_variants(evaluate):
    found = [tuple(v) for v in evaluate(names.name_variants("x"), "John Michael Van Der Meer")]
    assert found == [
        ("john", "michael van der", "meer"),
        ("john", "michael van", "der meer"),
        ("john", "michael", "van der meer"),
    ]
    assert [tuple(v) for v in evaluate(names.name_variants("x"), "Šime")] == [("sime", "", "")]
    assert evaluate(names.name_variants("x"), "  ") == []


@pytest.mark.parametrize(
    ("raw", "shown"),
    [
        ("SMITH, John", "John SMITH"), ("Jane Doe", "Jane DOE"), ("john smith", "john SMITH"), ("JANE DOE", "JANE DOE"),
        ("Cher", "Cher"), ("", ""), ("  ann   mary  lee ", "ann mary LEE"),
    ],
)
def test_display_name(evaluate, raw, shown):
    assert evaluate(names.display_name("x"), raw) == shown


def test_loader_name_keeps_comma(evaluate):
    assert evaluate(names.normalize_name("x", comma=False), "Smith, John") == "Smith, JOHN"


@pytest.mark.parametrize("word", ["Kujača", "Đuro", "ŁÓDŹ", "Ångström", "ấ", "été", "ΐ", "İzmir", "Größe"])
def test_canon_is_decomposition_without_marks(evaluate, word):
    plain = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).lower()
    assert evaluate(text.canon("x"), word) == plain


def test_whitespace(evaluate):
    assert evaluate(text.norm_ws("x"), " a \t\n b\x1f c ") == "a b c"
    assert evaluate(text.norm_ws("x"), None) == ""


@pytest.mark.parametrize(
    ("raw", "phone"),
    [
        ("+1 (202) 555-1234", "+12025551234"), ("00387 65 318 453", "+38765318453"), ("123", None), (None, None),
        ("1234567890123456", None), ("nan", None),
    ],
)
def test_phone(evaluate, raw, phone):
    assert evaluate(normalize_phone("x"), raw) == phone


@pytest.mark.parametrize(
    ("raw", "kind", "day"),
    [
        ("1990-01-05", None, date(1990, 1, 5)), ("43831", "n", date(2020, 1, 1)), ("1900-01-01", None, None),
        ("not-a-date", None, None), ("2024", None, None), ("31.02.2020", None, None), ("5.1.1990", None, date(1990, 1, 5)),
        ("1/5/1990", None, date(1990, 1, 5)), ("1985-05-05T00:30:00+02:00", None, date(1985, 5, 4)), ("-1", "n", None),
        ("19900105", None, date(1990, 1, 5)),
    ],
)
def test_dob(evaluate, raw, kind, day):
    expression = dates.normalize_dob("x", "k" if kind else None)
    assert evaluate(expression, raw, kind) == day


def test_bad_dob(evaluate):
    assert evaluate(dates.bad_dob("x"), "not-a-date") is True
    assert evaluate(dates.bad_dob("x"), " ") is False
    assert evaluate(dates.bad_dob("x"), "1.2.2020") is False


def test_iso_date(evaluate):
    assert evaluate(dates.iso_date("x", "k"), "45000", "n") == "2023-03-15"
    assert evaluate(dates.iso_date("x"), None) == ""
    assert evaluate(dates.iso_date("x"), "2024-06-01T23:30:00Z") == "2024-06-02"


def test_workbook_dates_follow_daylight_saving(evaluate):
    assert evaluate(dates.coerce_ts("x"), "2024-07-01") == datetime(2024, 6, 30, 22)
    assert evaluate(dates.coerce_ts("x"), "2024-01-15") == datetime(2024, 1, 14, 23)
    assert evaluate(dates.snapshot_ts("x"), "2024-07-01") == datetime(2024, 7, 1)


@pytest.mark.parametrize(
    ("raw", "place", "hint"),
    [
        ("Zagreb C033", "Zagreb", "C033"), ("Opatija, Croatia", "Opatija", "Croatia"), ("Online", "Online", None),
        ("", "", None), ("A / B", "A", "B"), ("A\\B", "A", "B"), ("Split - c001", "Split", "C001"),
    ],
)
def test_location(evaluate, raw, place, hint):
    assert tuple(evaluate(text.split_location("x"), raw)) == (place, hint)


def test_event_header(evaluate):
    found = evaluate(dates.event_header(F.lit("PFE25M2  TITLE OF EVENT"), "x", F.lit(2025)), "JUNE 23 - 27 - Opatija, CROATIA")
    assert tuple(found) == ("PFE25M2", "TITLE OF EVENT", date(2025, 6, 23), date(2025, 6, 27), "Opatija", "CROATIA")


def test_year(evaluate):
    assert evaluate(dates.year_from_name("x"), "pfe19m2 list.xlsx") == 2019
    assert evaluate(dates.year_from_name("x"), "list.xlsx") >= 2025


@pytest.mark.parametrize(
    ("raw", "parts"),
    [
        ("BiH i RH", ["BiH", "RH"]), ("Bosnia and Herzegovina, R. Serbia", ["Bosnia", "Herzegovina", "R Serbia"]),
        ("Makedonija / Srbija", ["Makedonija", "Srbija"]), ("A&B", ["A", "B"]), (None, []), ("Finland", ["Finland"]),
    ],
)
def test_split_multi_country(evaluate, raw, parts):
    assert evaluate(text.split_multi_country("x"), raw) == parts


@pytest.mark.parametrize(
    ("raw", "sex"),
    [("M", "Male"), (" Mr. ", "Male"), ("Mrs", "Female"), ("female", "Female"), ("x", None), (" ", None), (None, None)],
)
def test_gender(evaluate, raw, sex):
    assert evaluate(enums.gender("x"), raw) == sex


def test_gender_by_first_letter(evaluate):
    assert evaluate(enums.gender("x", "initial"), "Ms") == "Male"


@pytest.mark.parametrize(("raw", "label"), [("0", "Black List"), ("1", "Normal"), ("2", "Excellent"), ("99", None), (None, None)])
def test_grade_label(evaluate, raw, label):
    assert evaluate(enums.grade_label("x"), raw) == label


def test_grade_variants(evaluate):
    assert evaluate(enums.grade("x"), "2.9") == 2
    assert evaluate(enums.grade("x"), "nan") == 1
    assert evaluate(enums.grade("x", "load"), "2.0") == 1
    assert evaluate(enums.grade("x", "load", "k"), "2.0", "n") == 2
    assert evaluate(enums.grade("x", "cell", "k"), "2", "s") == 1
    assert evaluate(enums.grade("x", "cell", "k"), "7", "n") == 7


@pytest.mark.parametrize(
    ("raw", "country"),
    [
        ("BH", "Bosnia and Herzegovina"), ("hrv", "Croatia"), ("Kosovar", "Kosovo"), ("Makedonija", "North Macedonia"),
        ("Bosnia Herzegovina", "Bosnia and Herzegovina"), ("Republika Srbija", "Serbia"), ("Freedonia", None),
    ],
)
def test_legacy_country(evaluate, raw, country):
    found = evaluate(match.legacy_country("x"), raw)
    assert (found and found["country"]) == country


def test_table_names(evaluate):
    assert evaluate(text.norm_table_name("x"), "Table Alb") == "tablealb"
    assert evaluate(text.norm_table_name("x"), "table-Alb") == "tablealb"
    assert evaluate(text.norm_table_name("x"), None) == ""


def test_citizenships(evaluate):
    assert evaluate(text.citizenships("x"), "HR; BA,HR ,") == ["HR", "BA"]
    assert evaluate(text.citizenships("x"), " ; ") is None


def test_entry(evaluate):
    assert tuple(evaluate(text.split_entry("x"), "Ann Lee – Chief")) == ("Ann Lee", "Chief")
    assert tuple(evaluate(text.split_entry("x"), "Ann - x, y")) == ("Ann - x", "y")


def test_resolve_country(spark):
    countries = spark.createDataFrame(
        [("C117", "Kosovo", 1), ("C181", "North Macedonia", 2), ("C200", "Türkiye", 3)], "cid string, country string, ord long"
    )
    tokens = spark.createDataFrame(
        [(x,) for x in ["Makedonija", "Kos", "North Macedonia", "Turkiye", "Serbia", "n/a", "macedonia", ""]], "t string"
    )
    found = {r["t"]: r["cid"] for r in match.resolve_tokens(tokens, "t", countries).collect()}
    assert found == {
        "Makedonija": "C181", "Kos": "C117", "North Macedonia": "C181", "Turkiye": "C200", "macedonia": "C181",
    }


def test_an_added_rule_changes_the_result(spark):
    countries = spark.createDataFrame([("C1", "Croatia", 1), ("C2", "Kosovo", 2), ("C3", "Türkiye", 3)], "cid string, country string, ord long")
    texts = ["Hrvatska", "R. Hrvatska", "crohrv", "Kos", "anatolia", "New Anatolia", "n/a", "", None, "x" * 20000]
    tokens = spark.createDataFrame([(x,) for x in texts], "t string")
    schema = "priority int, how string, literal string, pattern string, country string"
    rules = [(1, "word", "hrvatska", r"\bhrvatska\b", "Croatia"), (2, "prefix", "kos", "^kos", "Kosovo"), (0, "word", None, "k", "Croatia"), (None, "piece", "kos", "k", "Croatia")]

    def found(rules):
        rows = match.resolve_by_rules(tokens, "t", countries, spark.createDataFrame(rules, schema)).collect()
        return {r.t: r.cid for r in rows}

    before = {"Hrvatska": "C1", "R. Hrvatska": "C1", "Kos": "C2"}
    assert found(rules) == before
    assert found([*rules, (3, "piece", "anatol", "anatol(ia)?$|anatolia", "Türk")]) == {**before, "anatolia": "C3", "New Anatolia": "C3"}
    assert found([*rules, (0, "piece", "hrv", "hrv", "Kos")]) == {**before, "Hrvatska": "C2", "R. Hrvatska": "C2", "crohrv": "C2"}
    assert found([]) == {"Kos": "C2"}


@pytest.mark.parametrize(
    ("value", "phone"),
    [("0038512345678", "+38512345678"), ("+38512345678", "+38512345678"), ("12345678", "+12345678"), ("001234567", None),
     ("00123456789012345", "+123456789012345"), ("001234567890123456", None), ("+0012345678", "+0012345678"), ("12345678\n", "+12345678"),
     ("1234567", None), ("00+38512345678", "+38512345678"), (" 0038512345678", "+38512345678"), ("\u0661\u0662345678", "+\u0661\u0662345678")],
)
def test_phones_of_digits_alone_and_others(evaluate, value, phone):
    assert evaluate(normalize_phone("x"), value) == phone


@pytest.mark.parametrize(
    ("value", "day", "bad"),
    [("1990-01-02", date(1990, 1, 2), False), ("1990-1-2", date(1990, 1, 2), False), (" 1990-01-02\n", date(1990, 1, 2), False), ("1990-02-30", None, True),
     ("0000-01-01", None, True), ("1900-01-01", None, False), ("1990-01-02T23:30:00-02:00", date(1990, 1, 3), False), ("", None, False), (None, None, False)],
)
def test_plain_dates_and_others(evaluate, value, day, bad):
    assert evaluate(dates.normalize_dob("x"), value) == day
    assert evaluate(dates.bad_dob("x"), value) is bad
    if day and "T" not in value:
        assert evaluate(dates.snapshot_ts("x"), value) == datetime(day.year, day.month, day.day)


def test_blank_columns(evaluate):
    shown = {" ": None, "": None, None: None, "a": "a", "a b": "a b", " a": "a", "a\u2003": "a", "é": "é", "a\x7f": "a\x7f", "\x1fa": "a"}
    assert {k: evaluate(text.blank_to_null("x"), k) for k in shown} == shown
