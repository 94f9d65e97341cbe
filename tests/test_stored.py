"""Stored tables: versions of the whole database, keyed changes, lookups that skip files, retention."""

from __future__ import annotations

import glob
import random

import pytest
from pyspark.sql import functions as F

from rollbook.operators import mutate
from rollbook.schemas import COUNTRIES, PARTICIPANT_EVENTS, PARTICIPANTS
from rollbook.sources import stored


def people(spark, *rows):
    """Participants from pid, country, name and position."""
    df = spark.createDataFrame(rows, "pid string, representing_country string, name string, position string")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in PARTICIPANTS.fields])


def crowd(spark, count=300):
    return people(spark, *[(f"P{k:04d}", f"C{k % 7:03d}", f"Name {k}", "x" if k % 3 else None) for k in range(count)])


def told(df):
    return sorted(map(str, df.select("pid", "representing_country", "name", "position").collect()))


def test_a_broken_reload_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    countries = spark.createDataFrame([("C001", "One", None, 1)], COUNTRIES)
    stored.reload(spark, root, {"countries": countries, "participants": crowd(spark, 5)})
    broken = people(spark, ("P9", "C001", "New", None)).withColumn("name", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        stored.reload(spark, root, {"countries": countries.limit(0), "participants": broken})
    assert stored.read_table(spark, root, "countries").count() == 1 and stored.read_table(spark, root, "participants").count() == 5
    assert stored.versions(spark, root) == [1]


def test_two_writers_lose_nothing(spark, tmp_path):
    root = str(tmp_path)
    stored.write_table(crowd(spark, 3), root, "participants")
    slow, fast = stored.Change(spark, root), stored.Change(spark, root)
    slow.append("participants", people(spark, ("A", "C001", "slow", None), ("B", "C001", "slow", None)))
    fast.append("participants", people(spark, ("A", "C001", "fast", None)))
    assert fast.commit() and not slow.commit()
    # The one that was refused starts again and finds the other's row.
    runs = []

    def work(change):
        if not runs:
            stored.append(spark, root, "participants", people(spark, ("B", "C001", "between", None)))
        runs.append(change.base["version"])
        change.append("participants", people(spark, ("A", "C001", "slow", None), ("B", "C001", "slow", None), ("C", "C001", "slow", None)))

    stored.transact(spark, root, work)
    assert runs == [2, 3]
    names = {r.pid: r.name for r in stored.read_table(spark, root, "participants").collect()}
    assert (names["A"], names["B"], names["C"], len(names)) == ("fast", "between", "slow", 6)

    def always_late(change):
        stored.append(spark, root, "countries", spark.createDataFrame([], COUNTRIES))

    with pytest.raises(stored.ConcurrentChange):
        stored.transact(spark, root, always_late, tries=2)


def test_random_changes_equal_full_joins(spark, tmp_path):
    root, chance = str(tmp_path), random.Random(3)
    plain = crowd(spark)
    stored.write_table(plain, root, "participants")
    for step in range(3):
        picked = chance.sample(range(330), 12)
        delta = people(spark, *[(f"P{k:04d}", chance.choice(["C001", "C005", None]), f"Step {step} {k}", chance.choice([None, "Boss"])) for k in picked])
        delta = delta.select("pid", "representing_country", "name", "position")
        many = delta.withColumn("n", F.lit(1)).unionByName(delta.select("pid", "representing_country", F.lit(None).cast("string").alias("name"), "position", F.lit(2).alias("n")))
        nulls = ["keep", "overwrite"][step % 2]
        gone = people(spark, (f"P{chance.randrange(330):04d}", None, None, None), (f"P{picked[0]:04d}", None, None, None))
        change = stored.Change(spark, root)
        change.upsert("participants", delta, nulls)
        change.delete("participants", gone)
        change.bulk_upsert("participants", many, "n")
        chiefs = [f"P{k:04d}" for k in picked[:3]]
        change.patch("participants", spark.createDataFrame([(p, "Chief") for p in [*chiefs, "nobody"]], "pid string, position string"))
        if step == 1:
            change.compact("participants")
        assert change.commit()
        plain = mutate.delete(mutate.upsert(plain, delta, ["pid"], nulls), gone, ["pid"])
        plain = mutate.bulk_upsert(plain, many, ["pid"], "n").withColumn("position", F.when(F.col("pid").isin(chiefs), "Chief").otherwise(F.col("position")))
        plain = spark.createDataFrame(plain.collect(), PARTICIPANTS)
        assert told(stored.read_table(spark, root, "participants")) == told(plain)
        for key in ({"pid": f"P{picked[1]:04d}"}, {"representing_country": "C005"}):
            condition = F.lit(True)
            for c, v in key.items():
                condition = condition & (F.col(c) == v)
            assert told(stored.lookup(spark, root, "participants", **key)) == told(plain.filter(condition))
    assert told(stored.read_table(spark, root, "participants", version=1)) == told(crowd(spark))


def test_a_change_of_two_rows_writes_two_files_and_lookups_skip_files(spark, tmp_path):
    root = str(tmp_path)
    stored.write_table(crowd(spark, 2000), root, "participants")
    whole = glob.glob(f"{root}/participants/*/*/*/*.parquet")
    assert len(whole) > 16
    stored.transact(spark, root, lambda c: c.upsert("participants", people(spark, ("P0001", "C001", "New", None), ("P0002", "C002", "New", None))))
    assert len(glob.glob(f"{root}/participants/*/*/*/*.parquet")) - len(whole) <= 2
    stored.transact(spark, root, lambda c: c.compact("participants"))
    entry = stored.manifest(spark, root)["tables"]["participants"]
    assert not entry["changes"] and len(entry["parts"]) == 2 and len(entry["parts"][1]["live"]) <= 2
    for key, share in (({"pid": "P0003"}, 1 / 16), ({"representing_country": "C003"}, 1 / 4)):
        found = stored.lookup(spark, root, "participants", **key)
        assert found.count() == stored.read_table(spark, root, "participants").filter(F.col(next(iter(key))) == next(iter(key.values()))).count()
        plan = found._jdf.queryExecution().executedPlan().toString()
        column, value = next(iter(key.items()))
        assert f"EqualTo({column},{value})" in plan and "PartitionFilters: [isnotnull(" in plan
        read = found._jdf.queryExecution().executedPlan().collectLeaves()
        files = sum(read.apply(k).metrics().apply("numFiles").value() for k in range(read.size()) if read.apply(k).metrics().contains("numFiles"))
        assert files <= share * len(whole) * 1.5


def test_snapshots_by_two_keys(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(f"P{k % 50:04d}", f"E{k % 31:05d}", f"C{k % 9:03d}") for k in range(1000)], "participant_id string, event_id string, traveling_from string")
    links = mutate.one_per_key(rows, ["participant_id", "event_id"])
    stored.write_table(links, root, "participant_events")
    change = rows.limit(1).withColumn("traveling_from", F.lit("Split"))
    stored.transact(spark, root, lambda c: c.upsert("participant_events", change))
    assert stored.lookup(spark, root, "participant_events", participant_id="P0000", event_id="E00000").first()["traveling_from"] == "Split"
    assert stored.lookup(spark, root, "participant_events", event_id="E00003").count() == links.filter("event_id = 'E00003'").count()
    assert stored.read_table(spark, root, "participant_events").schema == PARTICIPANT_EVENTS


def test_retention_keeps_what_is_named(spark, tmp_path):
    root = str(tmp_path)
    for count in (3, 4, 5):
        stored.write_table(crowd(spark, count), root, "participants")
    assert stored.retain(spark, root, keep=2, older_than_hours=24) == 1 and len(glob.glob(f"{root}/participants/*")) == 3
    assert stored.retain(spark, root, keep=1, older_than_hours=-1) == 3
    assert stored.versions(spark, root) == [3] and stored.read_table(spark, root, "participants").count() == 5


def test_rows_of_split_files_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x,y\n" + "".join(f"{k},{'w' * (k % 50)}\n" for k in range(20_000, 40_000)))
    (tmp_path / "a.csv").write_text("x,y\n" + "".join(f"{k},\n" for k in range(20_000)))
    (tmp_path / "c.csv").write_text("x,y\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        df = spark.read.option("header", "true").csv(str(tmp_path))
        assert df.rdd.getNumPartitions() > 8
        numbered = stored.numbered_rows(df)
        assert numbered.filter("row_no <> cast(x as long) + 1").count() == 0 and numbered.count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_formatted_keys_reach_the_scan_as_numbers(spark):
    from rollbook.plans.bindings import Tables
    from rollbook.plans.catalog import QUERIES, load_all

    load_all()

    t = Tables(spark, "/root/testdata/sf0.001")
    for name, pushed in (
        ("people_of_one_country", "EqualTo(c_nationkey,3)"), ("links_of_one_event", "EqualTo(l_partkey,11)"), ("links_of_one_person", "EqualTo(o_custkey,11)"),
    ):
        assert pushed in QUERIES[name](t)._jdf.queryExecution().executedPlan().toString()
    for value in ("C3", "C0003", "P003", "", "Cx"):
        assert t.participants_where(representing_country=value).count() == 0
