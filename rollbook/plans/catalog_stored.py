"""Stored tables: reload, keyed changes, lookups and the load of flat files, each on a database of its own in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from rollbook.plans import bulk_load
from rollbook.plans.bindings import Tables
from rollbook.plans.catalog import ORACLES, query
from rollbook.plans.catalog_jobs import sheets
from rollbook.plans.catalog_merge import delta
from rollbook.session import shared_folder, staged
from rollbook.sources import stored


def database(t: Tables) -> str:
    """A new folder for stored tables."""
    return f"{shared_folder(t.spark)}/database-{uuid.uuid4().hex}"


@query(
    "reload_then_read",
    "v_participants v_snapshots v_events",
    """select p.pid, p.position || ' again' as position, p.representing_country, count(s.event_id) events, count(e.eid) held
    from v_participants p left join v_snapshots s on s.participant_id = p.pid left join v_events e on e.eid = s.event_id
    group by 1, 2, 3""",
)
def reload_then_read(t: Tables) -> DataFrame:
    """All tables are stored, then replaced together; one version of them is read back."""
    root = database(t)
    content = {"countries": t.countries, "participants": t.participants, "participant_events": t.snapshots, "events": t.events}
    stored.reload(t.spark, root, content)
    again = stored.read_table(t.spark, root, "participants").withColumn("position", F.concat("position", F.lit(" again")))
    stored.reload(t.spark, root, {"participants": again, "events": stored.read_table(t.spark, root, "events")})
    found = stored.read_tables(t.spark, root, ["participants", "participant_events", "events"])
    held = found["participant_events"].join(found["events"].select(F.col("eid").alias("event_id"), F.lit(1).alias("held")), "event_id", "left")
    counts = held.groupBy(F.col("participant_id").alias("pid")).agg(F.count("event_id").alias("events"), F.count("held").alias("held"))
    people = found["participants"].select("pid", "position", "representing_country").join(counts, "pid", "left")
    return people.fillna(0, ["events", "held"])


_CHANGED = """select coalesce(b.pid, d.pid) pid, coalesce(d.name, b.name) as name, case when coalesce(b.pid, d.pid) like '%1' then 'Patched'
    else coalesce(d.position, b.position) end as position, b.grade, b.representing_country
    from v_participants b full join (select case when ord % 2 = 0 then pid else 'N' || pid end pid,
    case when ord % 3 = 0 then null else 'New ' || name end as name, case when ord % 5 = 0 then null else 'Chief' end as position
    from v_participants) d using (pid) where coalesce(b.pid, d.pid) not like '%4'"""


def _changed(t: Tables, compact: bool) -> str:
    """A database whose participants were upserted, patched and deleted by key, each change a version."""
    root = database(t)
    stored.write_table(t.participants, root, "participants")
    people = t.participants.select("pid")
    stored.transact(t.spark, root, lambda change: change.upsert("participants", delta(t)))
    patches = people.unionByName(people.select(F.concat(F.lit("N"), "pid").alias("pid"))).filter("pid like '%1'")
    stored.transact(t.spark, root, lambda change: change.patch("participants", patches.withColumn("position", F.lit("Patched"))))
    gone = people.unionByName(people.select(F.concat(F.lit("N"), "pid").alias("pid"))).filter("pid like '%4'")
    stored.transact(t.spark, root, lambda change: change.delete("participants", gone))
    if compact:
        stored.transact(t.spark, root, lambda change: change.compact("participants"))
    return root


@query("stored_changes", "v_participants", _CHANGED)
def stored_changes(t: Tables) -> DataFrame:
    """Keyed changes of a stored table, read with the changes beside the old files."""
    rows = stored.read_table(t.spark, _changed(t, compact=False), "participants")
    return rows.select("pid", "name", "position", "grade", "representing_country")


@query("stored_changes_compacted", "v_participants", _CHANGED)
def stored_changes_compacted(t: Tables) -> DataFrame:
    """The same after the touched cells were rewritten."""
    rows = stored.read_table(t.spark, _changed(t, compact=True), "participants")
    return rows.select("pid", "name", "position", "grade", "representing_country")


@query("stored_people_of_one_country", "v_participants", f"select * from ({_CHANGED}) where representing_country = 'C003'")
def stored_people_of_one_country(t: Tables) -> DataFrame:
    rows = stored.lookup(t.spark, _changed(t, compact=False), "participants", representing_country="C003")
    return rows.select("pid", "name", "position", "grade", "representing_country")


_STORED_SNAPSHOTS = """select participant_id, event_id, case when event_id like '%3' then 'Split' else traveling_from end traveling_from,
    transportation from v_snapshots"""


@query("stored_snapshots_of_one_event", "v_snapshots", f"select * from ({_STORED_SNAPSHOTS}) where event_id = 'E00013'")
def stored_snapshots_of_one_event(t: Tables) -> DataFrame:
    """Snapshots are stored in two halves, one appended, and some are changed."""
    root = database(t)
    # Made once for the three changes: the join of all lines is what this shuffles most.
    rows = staged(t.snapshots)
    stored.write_table(rows.filter("participant_id like '%2'"), root, "participant_events")
    stored.append(t.spark, root, "participant_events", rows)
    moved = rows.filter("event_id like '%3'").select("participant_id", "event_id", F.lit("Split").alias("traveling_from"))
    stored.transact(t.spark, root, lambda change: change.upsert("participant_events", moved))
    found = stored.lookup(t.spark, root, "participant_events", event_id="E00013")
    return found.select("participant_id", "event_id", "traveling_from", "transportation")


def flat_files(t: Tables) -> str:
    """The three flat sheets as CSV files in order, without row numbers."""
    folder = database(t)
    for name, df in zip(("Participant", "Country", "Events"), sheets(t), strict=True):
        # The number of files grows with the rows, so that no task sorts more than its share.
        ordered = df.repartitionByRange("row_no").sortWithinPartitions("row_no").drop("row_no")
        ordered.write.option("header", "true").option("escape", '"').csv(f"{folder}/{name}")
    return folder


@query("flat_load_participants", "", ORACLES["bulk_load_participants"])
def flat_load_participants(t: Tables) -> DataFrame:
    """The load of the sheets from CSV files, whose rows are numbered in their order."""
    flat = stored.load_flat(t.spark, flat_files(t))
    result = bulk_load.load(flat["Participant"], flat["Country"], flat["Events"], now=F.lit("2025-01-01"))
    return result.participants.select(
        "pid", "name", "representing_country", "position", "grade", "gender",
        F.element_at("_audit", 1)["source"]["row"].alias("source_row"), "phone",
        F.array_join("citizenships", ",").alias("citizenships"),
    )
