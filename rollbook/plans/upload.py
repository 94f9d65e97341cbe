"""Upload of preview bundles into the stored tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollbook.functions import dates, enums, names
from rollbook.functions.phones import normalize_phone
from rollbook.functions.text import blank_to_null, citizenships, text
from rollbook.operators import match, merge, mutate, sequence, validate
from rollbook.schemas import SNAPSHOT_FIELDS
from rollbook.session import checkpointed, staged

_PROFILE = (
    "name representing_country gender grade dob pob birth_country citizenships email phone diet_restrictions "
    "organization unit position rank intl_authority bio_short"
).split()


@dataclass
class Upload:
    """New content of the stored tables, the rows that are new or changed in them, and the refused bundles.

    Uploaded events are new, so their rows and those of their snapshots can be appended; ``changed_people`` are what
    ``people_after`` makes the new participants of.
    """

    participants: DataFrame
    participant_events: DataFrame
    events: DataFrame
    added_snapshots: DataFrame
    added_events: DataFrame
    changed_people: DataFrame
    rejects: DataFrame


def _people(bundles: DataFrame) -> DataFrame:
    """Typed attendee rows of all bundles, numbered within their bundle."""
    rows = bundles.select("path", F.posexplode("participants").alias("_pos", "p"))
    row_no = F.col("_pos").cast("bigint").alias("row_no")
    kept = "representing_country pob birth_country diet_restrictions organization unit position rank bio_short".split()
    return rows.select(
        "path",
        row_no,
        blank_to_null("p.pid").alias("given_pid"),
        names.display_name("p.name").alias("name"),
        F.col("p.gender").alias("gender"),
        F.coalesce(F.col("p.grade").try_cast("double").cast("int"), F.lit(1)).alias("grade"),
        F.col("p.dob").alias("dob_text"),
        dates.normalize_dob("p.dob").alias("dob"),
        citizenships("p.citizenships", is_array=True).alias("citizenships"),
        blank_to_null("p.email").alias("email"),
        blank_to_null("p.phone").alias("phone"),
        enums.to_bool("p.intl_authority", "model").alias("intl_authority"),
        *[F.col(f"p.{n}").alias(n) for n in kept],
        _own_snapshot().alias("own"),
    )


def _checked_people(bundles: DataFrame) -> DataFrame:
    """Typed attendee rows of all bundles, each with its errors."""
    required = validate.errors_of(
        (F.col("pob").isNull(), "pob missing"), (F.col("birth_country").isNull(), "birth_country missing")
    )
    rows = _people(bundles).withColumn("pid", F.coalesce("given_pid", F.lit("TEMP")))
    return rows.withColumn("errors", F.concat(validate.participant_rules(dob_text="dob_text"), required)).drop("pid", "dob_text")


def _own_snapshot() -> Column:
    """Snapshot fields of an attendee row, null when it has none."""

    def value(name: str) -> Column:
        if name == "traveling_from":
            return F.coalesce(F.col(f"p.{name}"), F.col("p.travelling_from"))
        return F.col(f"p.{name}")

    present = F.coalesce(*[value(n) for n in SNAPSHOT_FIELDS]).isNotNull()
    return F.when(present, F.struct(*[value(n).alias(n) for n in SNAPSHOT_FIELDS]))


def _supplied(bundles: DataFrame) -> DataFrame:
    """Snapshots that a bundle supplies, by participant id."""
    rows = bundles.select("path", F.posexplode("participant_events").alias("_pos", "s"))
    leaving = F.coalesce("s.traveling_from", "s.travelling_from").alias("traveling_from")
    return rows.select(
        "path",
        F.col("_pos").cast("bigint").alias("row_no"),
        F.coalesce(blank_to_null("s.participant_id"), blank_to_null("s.pid")).alias("pid"),
        *[leaving if n == "traveling_from" else F.col(f"s.{n}").alias(n) for n in SNAPSHOT_FIELDS],
    ).filter("pid is not null")


def accepted_bundles(bundles: DataFrame, stored_events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bundles to upload, and path, eid and errors of the others."""
    checked = validate.bundle_rules(_with_path(bundles), stored_events)
    good = checked.filter(F.size("errors") == 0).drop("errors")
    return good, checked.filter(F.size("errors") > 0).select("path", F.col("event.eid").alias("eid"), "errors")


def _with_path(bundles: DataFrame) -> DataFrame:
    """Bundles that are told apart by their path, or by their eid where they have none."""
    path = F.coalesce("path", F.col("event.eid")) if "path" in bundles.columns else F.col("event.eid")
    return bundles.withColumn("path", path)


def repeated_events(events: DataFrame) -> DataFrame:
    """Bundles, by path and eid, whose event is also in a bundle with a smaller path, with their error."""
    spans = events.groupBy("eid").agg(F.min("path").alias("_first"), F.max("path").alias("_last"))
    later = events.join(spans.filter("_first <> _last"), "eid").filter("path <> _first").select("path", "eid").distinct()
    return later.select("path", "eid", F.array(F.lit("Event is also in an earlier bundle")).alias("errors"))


def identify(people: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct people of the upload with the pid they get, one row per name, country and date of birth.

    A stored person without a date of birth is taken by the first newcomer that fits; the
    next newcomers of the same name take the next such person, or become new ones.
    """
    who = ["name", "representing_country", "dob"]
    firsts = checkpointed(
        people.groupBy(*who).agg(
            F.min(F.struct("path", "row_no")).alias("_at"),
            F.min_by("given_pid", F.when(F.col("given_pid").isNotNull(), F.struct("path", "row_no"))).alias("given_pid"),
        )
    )
    undated = stored.filter(F.col("dob").isNull())
    dated = match.match_existing(firsts, stored.filter(F.col("dob").isNotNull()), "strict", "_dated_pid", few=True)
    same = ["name", "representing_country"]
    # The window is over different dates of birth of one name and country, a bounded group.
    turn = F.row_number().over(Window.partitionBy(*same).orderBy("_at"))
    waiting = undated.join(firsts.select(*same).distinct(), same, "left_semi")
    places = sequence.group_rank(waiting.select(*same, "ord", "pid"), same, ["ord", "pid"], "_turn")
    places = places.select(*same, F.col("pid").alias("_open_pid"), "_turn")
    needing = dated.filter(F.col("_dated_pid").isNull()).withColumn("_turn", turn.cast("bigint"))
    opened = needing.join(places, [*same, "_turn"], "left").drop("_turn")
    settled = dated.filter(F.col("_dated_pid").isNotNull()).withColumn("_open_pid", F.lit(None).cast("string"))
    found = checkpointed(opened.unionByName(settled)).withColumn("matched_pid", F.coalesce("_dated_pid", "_open_pid"))
    fresh = found.filter(F.col("matched_pid").isNull() & F.col("given_pid").isNull())
    ranked = sequence.global_rank(
        fresh.select(*who, F.col("_at.path").alias("_p"), F.col("_at.row_no").alias("_r")),
        [F.col("_p").asc(), F.col("_r").asc()],
        "_rank",
    )
    highest = merge.attendee_numbers(
        stored.select("pid").unionByName(
            people.filter(F.col("given_pid").isNotNull()).select(F.col("given_pid").alias("pid"))
        )
    )
    numbered = ranked.select(*who, F.format_string("P%04d", highest + F.col("_rank")).alias("_new_pid"))
    return (
        found.join(numbered, who, "left")
        .withColumn("pid", F.coalesce("matched_pid", "given_pid", "_new_pid"))
        .select(*who, "pid", "matched_pid")
    )


def _event_rows(bundles: DataFrame) -> DataFrame:
    """Typed event of every bundle, with an empty roster."""
    events = bundles.select("path", "event.*")
    typed = events.select(
        "path",
        text("eid").alias("eid"),
        F.coalesce("title", F.lit("")).alias("title"),
        dates.snapshot_ts("start_date").alias("start_date"),
        dates.snapshot_ts("end_date").alias("end_date"),
        F.coalesce("place", F.lit("")).alias("place"),
        "country",
        enums.event_type("type", unknown="Other").alias("type"),
        enums.cost("cost").alias("cost"),
    )
    return typed.withColumn("participants", F.array().cast("array<string>"))


def _with_rosters(events: DataFrame, identified: DataFrame) -> DataFrame:
    """Events with their rosters in the order of the bundle."""
    members = identified.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("row_no", "pid"))).alias("_members"))
    joined = events.join(members, "path", "left")
    return joined.withColumn("participants", F.coalesce("_members.pid", "participants")).drop("_members")


def _latest_snapshots(identified: DataFrame, supplied: DataFrame) -> DataFrame:
    """``path, pid, snapshot`` of the people of each bundle: the last one it supplies, else that of their last row that has one."""
    own = identified.select("path", "pid", F.struct(F.lit(0).alias("given"), "row_no", F.col("own").alias("snapshot")).alias("_s"))
    given = supplied.select("path", "pid", F.struct(F.lit(1).alias("given"), "row_no", F.struct(*SNAPSHOT_FIELDS).alias("snapshot")).alias("_s"))
    # Nearly every row is a person of its own, so the rows are dealt by key before they are reduced.
    rows = own.unionByName(given).repartition("path", "pid")
    best = rows.groupBy("path", "pid").agg(
        F.min("_s.given").alias("_least"), F.max(F.when(F.col("_s.snapshot").isNotNull(), F.col("_s"))).alias("_best")
    )
    return best.filter("_least = 0 and _best is not null").select("path", "pid", F.col("_best.snapshot").alias("snapshot"))


def _problems(checked: DataFrame) -> DataFrame:
    """Paths with errors, each with the different errors of its rows."""
    bad = checked.filter(F.size("errors") > 0).select("path", F.explode("errors").alias("error"))
    return bad.groupBy("path").agg(F.array_sort(F.collect_set("error")).alias("errors"))


def people_after(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Participants after an upload: known people patched, new ones after all stored ones in the order that matching uses."""
    patched = mutate.bulk_upsert(stored, changed, ["pid"], "_order")
    number = F.regexp_extract("pid", r"(\d+)$", 1).try_cast("bigint")
    return patched.withColumn("ord", F.coalesce("ord", F.lit(1 << 40) + number))


def upload(
    bundles: DataFrame, participants: DataFrame, participant_events: DataFrame, events: DataFrame, now: Column | None = None
) -> Upload:
    """Upload all bundles at once.

    Everything is checked before anything changes: a bundle with an unusable attendee or
    snapshot is refused as a whole.  Known people are patched with the values that are not
    null, new people are added, snapshots are upserted and the event is appended.
    """
    now = F.current_timestamp() if now is None else now
    accepted, refused = accepted_bundles(bundles, events)
    # Attendees and events are read from the bundles, typed and checked once; every later step takes the columns it needs.
    everyone = staged(_checked_people(accepted))
    heads = staged(_event_rows(accepted).withColumn("errors", validate.event_rules()))
    row_problems = checkpointed(_problems(everyone).unionByName(_problems(heads)))
    repeated = checkpointed(repeated_events(heads.join(row_problems, "path", "left_anti")))
    excluded = row_problems.select("path").unionByName(repeated.select("path"))
    good = heads.drop("errors").join(excluded, "path", "left_anti")
    people = everyone.drop("errors").join(excluded, "path", "left_anti")
    who = ["name", "representing_country", "dob"]
    pids = checkpointed(identify(people, participants))
    identified = staged(people.join(pids, who).select("path", "row_no", "pid", "matched_pid", "own"))

    supplied = _supplied(accepted).join(excluded, "path", "left_anti")
    latest = _latest_snapshots(identified, supplied)
    eids = good.select("path", F.col("eid").alias("event_id"))
    raw = latest.join(eids, "path").select("path", F.col("pid").alias("participant_id"), "event_id", "snapshot.*")
    snapshots = staged(
        raw.withColumns({n: dates.snapshot_ts(n) for n in SNAPSHOT_FIELDS if n.endswith("_date")})
    )
    event_rows = _with_rosters(good, identified)
    taken = identified.filter("matched_pid is null").join(participants.select("pid"), "pid", "left_semi")
    problems = [
        _problems(snapshots.withColumn("errors", validate.snapshot_rules())),
        _problems(taken.withColumn("errors", F.array(F.lit("pid is already in use")))),
        row_problems,
    ]
    broken = checkpointed(reduce(DataFrame.unionByName, problems))
    listed = broken.groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("errors")))).alias("errors"))
    eids_of_all = _with_path(bundles).groupBy("path").agg(F.max("event.eid").alias("eid"))
    rejects = refused.unionByName(repeated).unionByName(
        listed.join(eids_of_all, "path", "left").select("path", "eid", "errors")
    )

    bad_paths = broken.select("path")
    # The rest of a person's columns are read where the changed people are wanted.
    change = people.join(bad_paths, "path", "left_anti").withColumn("phone", normalize_phone("phone")).join(pids, who)
    delta = change.select("pid", F.struct("path", "row_no").alias("_order"), *_PROFILE)
    new_participants = people_after(participants, delta)
    kept_snapshots = snapshots.join(bad_paths, "path", "left_anti").drop("path")
    new_links = mutate.upsert(participant_events, kept_snapshots, ["participant_id", "event_id"])
    added = event_rows.join(bad_paths, "path", "left_anti").drop("path").withColumns(
        {"created_at": now.cast("timestamp"), "updated_at": now.cast("timestamp")}
    )
    new_events = events.unionByName(added, allowMissingColumns=True)
    return Upload(new_participants, new_links, new_events, kept_snapshots, added, delta, rejects)
