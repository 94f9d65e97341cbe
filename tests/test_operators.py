"""Operators on small inputs: order of input rows, hot keys and repeated runs do not matter."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rollbook.operators import match, merge, mutate, paging, reports, sequence, tables, validate


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows belong to one key."""
    rng = random.Random(7)
    data = [
        (i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.randrange(5), rng.choice([None, "", "  ", f"v{i}"]))
        for i in range(3000)
    ]
    rng.shuffle(data)
    return spark.createDataFrame(data, "no long, key string, day int, value string"), sorted(data)


def test_sequence_by_blocks(hot):
    df, data = hot
    firsts: dict[str, int] = {}
    for no, key, _, _ in data:
        firsts.setdefault(key, no)
    expected = sorted((k, i) for i, k in enumerate(sorted(firsts, key=firsts.get), 1))
    assert rows_of(sequence.number_first_seen(df.repartition(7), ["key"], "no", "n"), "key", "n") == expected
    paired = df.withColumn("at", F.struct(F.floor(F.col("no") / 3).alias("a"), (F.col("no") % 3).alias("b")))
    assert rows_of(sequence.number_first_seen(paired.repartition(7), ["key"], "at", "n"), "key", "n") == expected
    for block in (7, 1 << 20):
        numbered = sequence.sequence(df.repartition(7), "no", "n", block=block)
        assert rows_of(numbered, "no", "n") == [(no, k) for k, (no, *_) in enumerate(data, 1)]


def test_null_keys_are_one_group(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, None, None), (4, "a", None)], "no long, part string, value string")
    filled = sequence.carry_forward(rows.repartition(3), ["part"], "no", "value", block=2)
    assert rows_of(filled, "no", "value") == [(1, "x"), (2, "y"), (3, "y"), (4, "x")]
    ranked = sequence.group_rank(rows.repartition(3), ["part"], ["no"])
    assert rows_of(ranked, "no", "rank") == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_phrases_with_several_sources(spark):
    known = spark.createDataFrame(
        [("Hola", "en", "hello", "es"), ("hola", "en", "hi", "pt"), ("hola", "de", "hallo", "es")],
        "phrase string, lang string, translated string, source_lang string",
    )
    rows = spark.createDataFrame([(1, "HOLA"), (2, "other"), (3, None)], "no long, t string")
    assert rows_of(match.translate(rows, ["t"], known), "no", "t") == [(1, "hello"), (2, "other"), (3, "")]
    verified = match.translate(rows, ["t"], known, input_lang="pt")
    assert rows_of(verified, "no", "t", "t_verified") == [(1, "hi", True), (2, "other", False), (3, "", False)]
    assert rows_of(match.translate(rows, ["t"], None), "no", "t") == [(1, "HOLA"), (2, "other"), (3, "")]


def test_one_row_of_a_repeated_new_key(spark):
    base = spark.createDataFrame([("a", 1)], "k string, v long")
    new = spark.createDataFrame([("b", 5), ("b", 3), ("a", 0), ("c", None)], "k string, v long")
    for parts in (1, 7):
        assert rows_of(mutate.insert_missing(base, new.repartition(parts), ["k"]).fillna(-1), "k", "v") == [("a", 1), ("b", 3), ("c", -1)]


def test_known_countries_that_differ_in_case_only(spark):
    countries = spark.createDataFrame([("C001", "Serbia", 1), ("C002", "SERBIA", 2)], "cid string, country string, ord long")
    labels = spark.createDataFrame([("serbia", 1), ("Malta", 2)], "label string, no long")
    assert rows_of(mutate.ensure_countries_legacy(labels, "label", "no", countries), "no", "cid") == [(1, "C001"), (2, "c003")]


def test_top_countries_and_statistics_agree_on_ties(spark):
    people = spark.createDataFrame([(c, 1) for c in "CBAABCD"], "representing_country string, grade int")
    countries = spark.createDataFrame([("A", "a", 1)], "cid string, country string, ord long")
    top = [(r["n"], r["representing_country"]) for r in reports.top_countries(people).collect()]
    stats = reports.detailed_stats(people, countries).first()["top_countries"]
    assert top == [(r["n"], r["representing_country"]) for r in stats] == [(2, "A"), (2, "B"), (2, "C"), (1, "D")]


def test_carry_forward_by_blocks(hot):
    df, data = hot
    last: dict[str, str] = {}
    expected = []
    for no, key, _, value in data:
        last[key] = value if value is not None else last.get(key)
        expected.append((no, last[key] or ""))
    for block in (11, 500, 1 << 20):
        filled = sequence.carry_forward(df.repartition(5), ["key"], "no", "value", block=block)
        assert rows_of(filled.withColumn("value", F.coalesce("value", F.lit(""))), "no", "value") == sorted(expected)


def test_global_rank(hot):
    df, data = hot
    ranked = sequence.global_rank(df.repartition(6), [F.col("day").desc(), F.col("no").asc()], "rank", parts=5)
    order = sorted(data, key=lambda r: (-r[2], r[0]))
    assert rows_of(ranked, "rank", "no") == [(i, r[0]) for i, r in enumerate(order, 1)]


@pytest.mark.parametrize(("skip", "limit"), [(0, 10), (20, 10), (30, 0), (0, 0), (9_995, 10), (2_995, 20_000)])
def test_page(hot, skip, limit):
    df, data = hot
    cut = paging.page(df, [F.col("day").asc(), F.col("no").asc()], skip, limit)
    order = [r[0] for r in sorted(data, key=lambda r: (r[2], r[0]))]
    assert [r["no"] for r in cut.collect()] == order[skip : skip + limit if limit else None]


def test_newest_wins_takes_earliest_of_equal_days(hot):
    df, data = hot
    best: dict[str, tuple] = {}
    for no, key, day, value in data:
        if key not in best or day > best[key][1]:
            best[key] = (no, day)
    found = merge.newest_wins(df.repartition(7), ["key"], "day", "no", ["no", "day"])
    assert rows_of(found, "key", "no") == sorted((k, v[0]) for k, v in best.items())


def test_missing_date_is_oldest(spark):
    df = spark.createDataFrame([(1, "a", None, "x"), (2, "a", 5, "y"), (3, "a", None, "z")], "no long, k string, d int, v string")
    assert merge.newest_wins(df, ["k"], "d", "no", ["v"]).first()["v"] == "y"


def test_last_non_blank(hot):
    df, data = hot
    last: dict[str, str] = {}
    for _, key, _, value in data:
        if value and value.strip():
            last[key] = value
    found = merge.last_non_blank(df.repartition(3), ["key"], "no", ["value"])
    assert rows_of(found, "key", "value") == sorted(last.items())


def test_union_arrays_keeps_order(spark):
    df = spark.createDataFrame([(2, "a", ["y", "x"]), (1, "a", ["x", "z"]), (3, "b", ["q"])], "no long, k string, i array<string>")
    assert rows_of(merge.union_arrays(df.repartition(4), ["k"], "i", "no"), "k", "i") == [("a", ["x", "z", "y"]), ("b", ["q"])]


def test_match_existing_hot_name(spark):
    """Thousands of equal names on both sides stay one row each."""
    stored = spark.range(3000).selectExpr(
        "format_string('P%04d', id) pid", "'Ann LEE' name", "'C1' representing_country",
        "case when id % 1000 = 999 then null else date_add(date'1990-01-01', cast(id % 700 as int)) end dob", "id ord",
    )
    incoming = spark.range(3000).selectExpr(
        "id", "'Ann LEE' name", "'C1' representing_country",
        "case when id % 10 = 0 then null else date_add(date'1990-01-01', cast(id % 800 as int)) end dob",
    )
    strict = match.match_existing(incoming, stored, "strict")
    assert strict.count() == 3000
    found = {r["id"]: r["matched_pid"] for r in strict.collect()}
    assert found[1] == "P0001" and found[701] == "P0999" and found[0] == "P0999" and found[2401] == "P0001"
    lenient = {r["id"]: r["matched_pid"] for r in match.match_existing(incoming, stored, "lenient").collect()}
    assert lenient[0] == "P0000" and lenient[701] == "P0999"


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, n int, v string")
    delta = spark.createDataFrame([("b", None, "y"), ("c", 3, None)], "k string, n int, v string")
    once = mutate.upsert(base, delta, ["k"])
    assert rows_of(once.fillna("", ["v"]), "k", "n", "v") == [("a", 1, "x"), ("b", 2, "y"), ("c", 3, "")]
    assert rows_of(mutate.upsert(once, delta, ["k"]).fillna("", ["v"]), "k", "n", "v") == rows_of(once.fillna("", ["v"]), "k", "n", "v")
    over = mutate.upsert(base, delta, ["k"], nulls="overwrite").fillna({"v": "", "n": 0})
    assert rows_of(over, "k", "n", "v") == [("a", 1, "x"), ("b", 0, "y"), ("c", 3, "")]


def test_upsert_of_named_columns(spark):
    base = spark.createDataFrame([("a", 1, "x")], "k string, n int, v string")
    delta = spark.createDataFrame([("a", None, None, ["v"])], "k string, n int, v string, present array<string>")
    assert mutate.upsert(base, delta, ["k"], nulls="overwrite", present="present").first().asDict() == {"k": "a", "n": 1, "v": None}


def test_insert_missing_never_overwrites(spark):
    base = spark.createDataFrame([("p", "e", "kept")], "participant_id string, event_id string, traveling_from string")
    delta = spark.createDataFrame([("p", "e"), ("q", "e"), ("q", "e")], "participant_id string, event_id string")
    added = mutate.insert_missing(base, delta, ["participant_id", "event_id"])
    assert rows_of(added.fillna(""), "participant_id", "traveling_from") == [("p", "kept"), ("q", "")]


def test_scores(spark):
    tests = spark.createDataFrame(
        [("E", "a", "pre", 80.0), ("E", "b", "pre", 90.0), ("E", "a", "post", 85.0), ("E", "b", "post", 95.0)],
        "eid string, pid string, type string, score double",
    )
    events = spark.createDataFrame([("E",), ("F",)], "eid string")
    assert rows_of(reports.event_scores_for(events, tests), "eid", "avg_pre", "avg_post") == [("E", 85.0, 90.0), ("F", 0.0, 0.0)]


def test_names_of(spark):
    """Null items, repeats, unknown codes and a repeated cid."""
    countries = spark.createDataFrame([("C1", "One", 1), ("C2", "Two", 2), ("C2", "Again", 3)], "cid string, country string, ord long")
    people = spark.createDataFrame([("p", ["C2", "C9", None, "C1", "C2"]), ("q", None), ("r", [])], "pid string, codes array<string>")
    found = rows_of(reports.names_of(people, "codes", ["pid"], countries, "names"), "pid", "names")
    assert found == [("p", ["Two", "C9", None, "One", "Two"]), ("q", None), ("r", [])]


def test_rosters_cover_everyone(spark):
    links = spark.range(12_500).selectExpr("format_string('P%04d', id) participant_id", "'E1' event_id")
    events = spark.createDataFrame([("E1",), ("E2",)], "eid string")
    found = reports.rosters(events, links.unionAll(links)).orderBy("eid").collect()
    assert [(r["eid"], len(r["participants"])) for r in found] == [("E1", 12_500), ("E2", 0)]


def test_country_numbers_start_above_those_in_use(spark):
    countries = spark.createDataFrame([("C001", "Serbia", 1), ("C007", "Croatia", 2)], "cid string, country string, ord long")
    labels = spark.createDataFrame(
        [(1, "Serbia"), (2, "Newland"), (3, None), (4, "NEWLAND "), (5, "c009"), (6, "Oldland")], "no long, label string"
    )
    grown, mapped = mutate.ensure_countries(labels, "label", "no", countries)
    codes = {r["no"]: r["cid"] for r in mapped.collect()}
    assert codes == {1: "C001", 2: "C010", 3: None, 4: "C010", 5: "C009", 6: "C011"}
    assert grown.count() == 5
    legacy = mutate.ensure_countries_legacy(labels, "label", "no", spark.createDataFrame([("c001", "Serbia", 1)], "cid string, country string, ord long"))
    assert {r["no"]: r["cid"] for r in legacy.collect()} == {1: "c001", 2: "c002", 3: "c000", 4: "c002", 5: "c003", 6: "c004"}


def test_snapshot_rules(spark):
    from rollbook.schemas import PARTICIPANT_EVENTS

    rows = spark.createDataFrame(
        [
            ("E", "P1", "Other", None, "a", "b", "Passport", *[None] * 7),
            ("E", "P2", "Air (Airplane)", None, "a", "b", "Visa", *[None] * 7),
            ("E", "P3", "Air (Airplane)", None, "a", "b", "Passport", *[None] * 7),
        ],
        PARTICIPANT_EVENTS,
    )
    valid, rejects = validate.validate(rows, validate.snapshot_rules())
    assert rows_of(valid, "participant_id") == [("P3",)]
    assert rows_of(rejects, "participant_id", "errors") == [("P1", ["transport_other required"]), ("P2", ["travel_doc_type unknown"])]


def test_upgrade_events(spark):
    old = spark.createDataFrame(
        [("E", None, "Zagreb", [], ["P1"])], "eid string, place string, location string, participants array<string>, participant_ids array<string>"
    )
    row = tables.upgrade_events(old).first()
    assert (row["place"], row["participants"]) == ("Zagreb", ["P1"])


def test_extract_snapshot_by_presence(spark):
    df = spark.createDataFrame([({"travelling_from": "Split"},), ({"name": "x"},), ({"iban": None},)], "m map<string,string>")
    found = [r["s"] for r in df.select(tables.extract_snapshot("m").alias("s")).collect()]
    assert found[0]["traveling_from"] == "Split" and found[1] is None and found[2] is not None


def test_keys_of_rules_are_made_for_different_texts_only(spark):
    lands = spark.createDataFrame([("C001", "Albania", 1)], "cid string, country string, ord long")
    rules = spark.createDataFrame([(1, "piece", "bani", "bani", "Albania"), (2, "word", "alb", "^alb", "Albania")], "priority int, how string, literal string, pattern string, country string")
    names = F.array(*[F.lit(v) for v in ("xbanix", "alb of", "Abani", "x", None)])
    texts = spark.range(10).select(F.get(names, (F.col("id") % 5).cast("int")).alias("raw"))
    found = match.resolve_by_rules(texts, "raw", lands, rules, strict=True)
    assert {r.raw: r.cid for r in found.collect()} == {"xbanix": "C001", "alb of": "C001", "Abani": "C001"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The words are cut in one place of the plan, not in a filter below the distinct as well.
    assert plan.count(r"[^\p{L}\p{N}_]+") == 1


def test_stored_events_are_put_together_before_the_join(spark):
    incoming = spark.createDataFrame([("E1",), ("E1",), ("E2",), (None,)], "eid string")
    stored = spark.createDataFrame([("E1",)] * 5 + [(None,)], "eid string")
    known, fresh = tables.known_events(incoming, stored), tables.new_events(incoming, stored)
    assert [r.eid for r in known.collect()] == ["E1", "E1"] and {r.eid for r in fresh.collect()} == {"E2", None}
    for found in (known, fresh):
        assert "Aggregate [eid" in found._jdf.queryExecution().optimizedPlan().toString()
