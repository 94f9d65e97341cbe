"""Lookups, filters and projections over the stored tables, and their guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rollbook.functions.text import col, norm_ws
from rollbook.schemas import SNAPSHOT_FIELDS


def by_key(df: DataFrame, **keys: object) -> DataFrame:
    """Rows whose columns equal the given values; the filters reach the parquet scan."""
    for name, value in keys.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def by_country(participants: DataFrame, cid: str) -> DataFrame:
    return by_key(participants, representing_country=cid)


def by_grade(participants: DataFrame, grade: int) -> DataFrame:
    return by_key(participants, grade=grade)


def event_ids(links: DataFrame, pid: str | None = None) -> DataFrame:
    """Events of one participant, or of all, without empty keys."""
    links = links if pid is None else by_key(links, participant_id=pid)
    return links.filter(F.col("event_id").isNotNull()).select("participant_id", "event_id")


def participant_ids(links: DataFrame, eid: str | None = None) -> DataFrame:
    """Participants of one event, or of all, without empty keys."""
    links = links if eid is None else by_key(links, event_id=eid)
    return links.filter(F.col("participant_id").isNotNull()).select("event_id", "participant_id")


def distinct_links(links: DataFrame) -> DataFrame:
    return links.select("participant_id", "event_id").distinct()


def search_participants(df: DataFrame, pattern: str | None) -> DataFrame:
    """Rows whose pid, name or position matches a regular expression, ignoring case."""
    if not pattern:
        return df
    hit = F.lit(False)
    for name in ("pid", "name", "position"):
        hit = hit | F.coalesce(F.col(name).rlike(f"(?iu){pattern}"), F.lit(False))
    return df.filter(hit)


def search_events(summaries: DataFrame, needle: str | None) -> DataFrame:
    """Rows whose eid, title, place or country name contains the text, ignoring case."""
    if not needle:
        return summaries
    hit = F.lit(False)
    for name in ("eid", "title", "place", "country"):
        hit = hit | F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), F.lower(F.lit(needle)))
    return summaries.filter(hit)


def attendee_rows(df: DataFrame, name: str = "name") -> DataFrame:
    """Rows that name a person: no blank cell and no ``TOTAL`` line."""
    cleaned = norm_ws(name)
    return df.filter((cleaned != "") & (F.upper(cleaned) != "TOTAL"))


def _missing(c: Column, kind: str) -> Column:
    if kind.startswith("array"):
        return F.coalesce(F.size(c) < 1, F.lit(True))
    return c.isNull() | (c.cast("string") == "")


def upgrade_events(df: DataFrame) -> DataFrame:
    """Fill the current event columns from the names older documents used."""
    legacy = {
        "start_date": "dateFrom",
        "end_date": "dateTo",
        "place": "location",
        "participants": "participant_ids",
    }
    kinds = dict(df.dtypes)
    empty = {"place": F.lit(""), "participants": F.array().cast("array<string>")}
    for new, old in legacy.items():
        present = [c for c in (new, old) if c in kinds]
        values = [F.when(~_missing(F.col(c), kinds[c]), F.col(c)) for c in present]
        if new in empty:
            values.append(empty[new])
        if values:
            df = df.withColumn(new, F.coalesce(*values))
    for name in ("eid", "title"):
        if name in kinds:
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit("")))
    return df.drop(*legacy.values())


def canonical_keys(df: DataFrame) -> DataFrame:
    """Rename the short and misspelt column names that payloads may use."""
    aliases = {"travelling_from": "traveling_from", "pid": "participant_id", "eid": "event_id"}
    for old, new in aliases.items():
        if old not in df.columns:
            continue
        value = F.coalesce(F.col(new), F.col(old)) if new in df.columns else F.col(old)
        df = df.withColumn(new, value).drop(old)
    return df


def extract_snapshot(cells: Column | str) -> Column:
    """Snapshot fields of a row map, null when the row has none of them.

    Presence of a key counts, not its value, so the input is the untyped map.
    """
    source = col(cells)
    names = [*SNAPSHOT_FIELDS, "travelling_from", "requires_visa_hr"]
    present = F.map_contains_key(source, F.lit(names[0]))
    for name in names[1:]:
        present = present | F.map_contains_key(source, F.lit(name))

    def value(name: str) -> Column:
        found = F.try_element_at(source, F.lit(name))
        if name != "traveling_from":
            return found.alias(name)
        older = F.try_element_at(source, F.lit("travelling_from"))
        return F.when(F.map_contains_key(source, F.lit(name)), found).otherwise(older).alias(name)

    return F.when(present, F.struct(*[value(name) for name in SNAPSHOT_FIELDS]))


def country_refs(representing: Column | str, birth: Column | str, citizenships: Column | str) -> Column:
    """Sorted set of the country codes a participant refers to."""
    listed = F.coalesce(col(citizenships), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(F.array(col(representing), col(birth)), listed)))


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count; empty when the keys are unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def new_events(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Events that are not stored yet; repeats of a stored eid are put together before the join."""
    return incoming.join(stored.select("eid").distinct(), "eid", "left_anti")


def known_events(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Events that are stored already; repeats of a stored eid are put together before the join."""
    return incoming.join(stored.select("eid").distinct(), "eid", "left_semi")


def should_load(events: DataFrame, participants: DataFrame, countries: DataFrame, source_events: DataFrame) -> DataFrame:
    """One row that says whether a bulk load should run, with the counts behind it."""

    def size(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    one = source_events.agg(F.countDistinct("eid").alias("source_events"))
    counted = one.select(
        "source_events",
        size(events).alias("events"),
        size(participants).alias("participants"),
        size(countries).alias("countries"),
    )
    filled = (F.col("events") > 5) & (F.col("participants") > 10) & (F.col("countries") > 5)
    return counted.withColumn("load", ~(filled | (F.col("events") >= F.col("source_events"))))
