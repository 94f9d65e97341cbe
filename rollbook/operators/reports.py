"""The read side: country names, rosters, counts, averages and display projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rollbook.functions.enums import grade_label
from rollbook.functions.text import blank_to_null
from rollbook.schemas import DEFAULT_GRADE, SNAPSHOT_COUNTRY_FIELDS, SNAPSHOT_FIELDS, SNAPSHOT_LABELS


def with_country_name(
    df: DataFrame, code: str, countries: DataFrame, into: str = "country", blank: str | None = ""
) -> DataFrame:
    """Add the country name of a code; an unknown code stays as it is, an empty one gives ``blank``.

    No broadcast is forced: Spark broadcasts the countries while they are small and joins
    with a shuffle, split where a code is hot, when they are not.
    """
    key = f"_cid_{into}"
    names = countries.select(F.col("cid").alias(key), F.col("country").alias(f"_name_{into}"))
    found = F.coalesce(F.col(f"_name_{into}"), F.col(code))
    named = F.when(F.col(code).isNull() | (F.col(code) == ""), F.lit(blank)).otherwise(found)
    return df.join(names, F.col(code) == F.col(key), "left").withColumn(into, named).drop(key, f"_name_{into}")


def names_of(df: DataFrame, codes: str, keys: list[str], countries: DataFrame, into: str) -> DataFrame:
    """Add the array of country names of an array of codes, joined item by item for a country table of any size.

    Order, repeats, unknown codes and null items are kept; of a repeated cid the first name counts.
    ``keys`` are unique and not null.
    """
    items = df.select(*keys, F.posexplode(codes).alias("_pos", "_code"))
    names = countries.groupBy(F.col("cid").alias("_cid")).agg(F.min_by("country", F.struct("ord", "country")).alias("_known"))
    named = items.join(names, F.col("_code") == F.col("_cid"), "left").withColumn("_name", F.coalesce("_known", "_code"))
    grouped = named.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_name"))).alias("_items"))
    grouped = grouped.select(*keys, F.col("_items._name").alias(into))
    none = F.when(F.col(codes).isNotNull(), F.array().cast("array<string>"))
    return df.join(grouped, keys, "left").withColumn(into, F.coalesce(F.col(into), none))


def with_country_names(participants: DataFrame, countries: DataFrame) -> DataFrame:
    """Participants with the names of their represented, birth and citizenship countries."""
    named = with_country_name(participants, "representing_country", countries, "representing_country_name")
    named = with_country_name(named, "birth_country", countries, "birth_country_name")
    named = names_of(named, "citizenships", ["pid"], countries, "citizenship_names")
    return named.withColumn(
        "citizenship_names", F.coalesce(F.col("citizenship_names"), F.array().cast("array<string>"))
    )


def attendee_counts(links: DataFrame) -> DataFrame:
    """Attendees per event."""
    return links.filter(F.col("participant_id").isNotNull()).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("participant_count")
    )


def with_attendee_count(events: DataFrame, links: DataFrame) -> DataFrame:
    """Add the number of attendees; an event without links counts its embedded roster."""
    counts = attendee_counts(links).select(
        F.col("event_id").alias("_eid"), F.col("participant_count").alias("_linked")
    )
    embedded = F.when(F.col("participants").isNotNull(), F.size("participants"))
    count = F.coalesce(F.col("_linked"), embedded, F.lit(0)).cast("bigint")
    joined = events.join(counts, F.col("eid") == F.col("_eid"), "left")
    return joined.withColumn("participant_count", count).drop("_eid", "_linked")


SUMMARY = (
    "eid title place country start_date end_date type cost participant_count country_code"
).split()


def event_summaries(events: DataFrame, links: DataFrame, countries: DataFrame) -> DataFrame:
    """The event list: country name and code, dates, type, cost and attendee count."""
    counted = with_attendee_count(events, links).withColumnRenamed("country", "country_code")
    return with_country_name(counted, "country_code", countries).select(*SUMMARY)


def participant_display(participants: DataFrame, countries: DataFrame) -> DataFrame:
    """The participant list: country name and grade label."""
    named = with_country_name(participants, "representing_country", countries, "country", blank=None)
    return named.select("pid", "name", "position", grade_label("grade").alias("grade"), "country")


def events_of(links: DataFrame, events: DataFrame, participants: DataFrame | None = None) -> DataFrame:
    """Events each participant attended; links to missing events fall away."""
    keys = links.filter(F.col("event_id").isNotNull()).select("participant_id", F.col("event_id").alias("eid"))
    if participants is not None:
        keys = keys.join(participants.select(F.col("pid").alias("participant_id")), "participant_id", "left_semi")
    return keys.join(events, "eid")


def participant_events_display(links: DataFrame, events: DataFrame, countries: DataFrame) -> DataFrame:
    """Event list of a participant page, with country name and code."""
    attended = events_of(links, events).withColumnRenamed("country", "country_code")
    named = with_country_name(attended, "country_code", countries, blank=None)
    return named.select(
        "participant_id", "eid", "title", "place", "country", "start_date", "end_date", "country_code"
    )


def roster_of(links: DataFrame, participants: DataFrame, countries: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Attendees of each event with country name; links to missing people fall away.

    The join is keyed by participant, which spreads a hot event over all partitions.
    """
    keys = links.filter(F.col("participant_id").isNotNull()).select("event_id", F.col("participant_id").alias("pid"))
    if events is not None:
        keys = keys.join(events.select(F.col("eid").alias("event_id")), "event_id", "left_semi")
    named = with_country_name(participants, "representing_country", countries)
    return keys.join(named.select("pid", "name", "position", "grade", "country"), "pid").select(
        "event_id", "pid", "name", "position", "grade", "country"
    )


def event_scores(tests: DataFrame) -> DataFrame:
    """Mean pre and post score per event, 0.0 where there is none."""

    def mean(kind: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col("type") == kind, F.col("score"))), F.lit(0.0)).alias(f"avg_{kind}")

    return tests.groupBy("eid").agg(mean("pre"), mean("post"))


def event_scores_for(events: DataFrame, tests: DataFrame) -> DataFrame:
    """``event_scores`` for every event, also those without tests."""
    zero = {"avg_pre": 0.0, "avg_post": 0.0}
    return events.select("eid").join(event_scores(tests), "eid", "left").fillna(zero)


def table_counts(participants: DataFrame, events: DataFrame, countries: DataFrame) -> DataFrame:
    """One row with the size of the three tables."""

    def size(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    counted = participants.agg(F.count(F.lit(1)).alias("participants"))
    return counted.select("participants", size(events).alias("events"), size(countries).alias("countries"))


def grade_counts(participants: DataFrame) -> DataFrame:
    """Participants of each grade, in one pass."""
    names = {0: "black_list", 1: "normal", 2: "excellent"}
    return participants.agg(*[F.count_if(F.col("grade") == code).alias(name) for code, name in names.items()])


def top_countries(participants: DataFrame, k: int = 5) -> DataFrame:
    """Countries with the most participants; equal counts are ordered by code."""
    counts = participants.groupBy("representing_country").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_first("representing_country")).limit(k)


def latest_event(events: DataFrame) -> DataFrame:
    """Title (or eid) and date of the event that starts last; equal dates go by eid."""
    best = events.orderBy(F.desc_nulls_last("start_date"), F.asc("eid")).limit(1)
    older = [F.col("dateFrom")] if "dateFrom" in events.columns else []
    return best.select(
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("eid")).alias("latest_event"),
        F.coalesce(F.col("start_date"), *older).alias("latest_event_date"),
    )


def dashboard(participants: DataFrame, events: DataFrame, countries: DataFrame) -> DataFrame:
    """Landing page: the table sizes and the latest event, null without events."""
    latest = latest_event(events).agg(
        F.max("latest_event").alias("latest_event"), F.max("latest_event_date").alias("latest_event_date")
    )
    counts = table_counts(participants, events, countries)
    return counts.withColumns(
        {name: latest.select(name).scalar() for name in ("latest_event", "latest_event_date")}
    )


def detailed_stats(participants: DataFrame, countries: DataFrame) -> DataFrame:
    """Statistics page: sizes, grade counts and the five largest countries, as one row."""
    top = top_countries(participants).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "representing_country"))).alias("top")
    )
    top = top.select(F.transform("top", lambda c: F.struct((-c["less"]).alias("n"), c["representing_country"].alias("representing_country"))).alias("top"))
    sizes = countries.agg(F.count(F.lit(1)).alias("n"))
    graded = participants.agg(
        F.count(F.lit(1)).alias("participants_count"),
        *[F.count_if(F.col("grade") == code).alias(name) for code, name in {0: "black_list", 1: "normal", 2: "excellent"}.items()],
    )
    return graded.withColumns({"countries_count": sizes.scalar(), "top_countries": top.scalar()})


def distinct_events(rows: DataFrame, key: str = "eid") -> DataFrame:
    """Number of different events; a missing key does not count."""
    return rows.agg(F.countDistinct(key).alias("events"))


def rosters(events: DataFrame, links: DataFrame) -> DataFrame:
    """Sorted distinct participants of every event, as the array that an event row holds.

    Repeated links are dropped before the shuffle; an event that nobody attended has an empty array.
    """
    keyed = links.filter(F.col("participant_id").isNotNull()).select(F.col("event_id").alias("eid"), "participant_id")
    arrays = keyed.groupBy("eid").agg(F.array_sort(F.collect_set("participant_id")).alias("participants"))
    none = F.array().cast("array<string>")
    return events.select("eid").join(arrays, "eid", "left").select("eid", F.coalesce("participants", none).alias("participants"))


def snapshot_details(snapshots: DataFrame, countries: DataFrame) -> DataFrame:
    """Twelve labelled rows per snapshot; blank text is null and three fields show country names.

    The names are looked up before the rows are multiplied, on one twelfth of the rows.
    """
    named = snapshots
    for name in SNAPSHOT_COUNTRY_FIELDS:
        named = named.withColumn(f"_{name}", blank_to_null(name))
        named = with_country_name(named, f"_{name}", countries, f"_{name}_name", blank=None)

    def shown(name: str) -> Column:
        if name in SNAPSHOT_COUNTRY_FIELDS:
            return F.col(f"_{name}_name")
        if name.endswith("_date"):
            return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss")
        return blank_to_null(name)

    entries = [
        F.struct(
            F.lit(no).alias("no"), F.lit(name).alias("field"), F.lit(label).alias("label"), shown(name).alias("value")
        )
        for no, (name, label) in enumerate(SNAPSHOT_LABELS.items())
    ]
    return named.select("participant_id", "event_id", F.inline(F.array(*entries)))


def snapshot_available(details: DataFrame) -> DataFrame:
    """Whether a snapshot shows any value."""
    return details.groupBy("participant_id", "event_id").agg(
        F.bool_or(F.col("value").isNotNull()).alias("available")
    )


ATTENDEE_PROFILE = (
    "name representing_country gender grade dob pob birth_country citizenships email phone diet_restrictions "
    "organization unit position rank intl_authority bio_short"
).split()


def join_snapshots(participants: DataFrame, snapshots: DataFrame, order: str = "rec_no", scope: tuple[str, ...] = ()) -> DataFrame:
    """Participants with their snapshots; of equal pids the last row counts, orphans fall away."""
    keys = [*scope, "pid"]
    others = [c for c in participants.columns if c not in (*keys, order)]
    latest = (
        participants.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("_p")).select(*keys, "_p.*")
    )
    kept = [c for c in snapshots.columns if c not in latest.columns or c in scope]
    return latest.join(snapshots.select(*kept).withColumn("pid", F.col("participant_id")), keys)


def merge_attendee(participants: DataFrame, snapshots: DataFrame, order: str = "rec_no", scope: tuple[str, ...] = ()) -> DataFrame:
    """One row of 32 columns per attendee: profile, keys and snapshot."""
    joined = join_snapshots(participants, snapshots, order, scope)
    empty = F.array().cast("array<string>")
    return joined.withColumn("citizenships", F.coalesce("citizenships", empty)).select(
        *scope, "pid", *ATTENDEE_PROFILE, "event_id", "participant_id", *SNAPSHOT_FIELDS
    )


def to_preview(df: DataFrame, into: str = "preview") -> DataFrame:
    """Rows as JSON without null fields; the grade is a whole number."""
    if "grade" in df.columns:
        df = df.withColumn("grade", F.coalesce(F.col("grade").try_cast("int"), F.lit(DEFAULT_GRADE)))
    return df.select(F.to_json(F.struct(*df.columns)).alias(into))
