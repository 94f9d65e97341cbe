"""The screens: event list and detail, participant list and detail, dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollbook.operators import paging, reports, tables


def event_list(
    events: DataFrame,
    links: DataFrame,
    countries: DataFrame,
    search: str = "",
    sort: str = "eid",
    direction: int = 1,
    page: int = 1,
    per_page: int = 25,
) -> DataFrame:
    """One page of the searched and sorted event list; only the links of its events are counted."""
    named = reports.with_country_name(events.withColumnRenamed("country", "country_code"), "country_code", countries)
    found = tables.search_events(named, search)
    cut = paging.event_page(found, sort, direction, max(page - 1, 0) * per_page, per_page)
    shown = cut.select(F.col("eid").alias("event_id"))
    counted = reports.with_attendee_count(cut, links.join(F.broadcast(shown) if per_page else shown, "event_id", "left_semi"))
    return counted.select(*reports.SUMMARY).orderBy(*paging.event_order(sort, direction))


def event_detail(
    eid: str,
    events: DataFrame,
    links: DataFrame,
    participants: DataFrame,
    countries: DataFrame,
    tests: DataFrame,
    sort: str = "name",
    direction: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Summary with mean scores, and the sorted roster, of one event."""
    chosen, attending = tables.by_key(events, eid=eid), tables.by_key(links, event_id=eid)
    scores = reports.event_scores_for(chosen, tables.by_key(tests, eid=eid))
    summary = reports.event_summaries(chosen, attending, countries).join(scores, "eid")
    return summary, paging.sort_roster(reports.roster_of(attending, participants, countries), sort, direction)


def participant_list(
    participants: DataFrame,
    countries: DataFrame,
    search: str | None = None,
    sort: str = "pid",
    direction: int = 1,
    page: int = 1,
    per_page: int = 25,
) -> DataFrame:
    """One page of the participant list; the total counts all matches.

    The page is cut before country names are added, so only its rows are joined.
    """
    found = tables.search_participants(participants, search)
    skip = max(page - 1, 0) * per_page
    cut = paging.participant_page(found, sort, direction, skip, per_page)
    shown = reports.participant_display(cut, countries)
    if sort == "country":
        name = F.coalesce(F.col("country"), F.lit(""))
        return shown.orderBy(name.asc() if direction >= 0 else name.desc(), "pid")
    # The join may reorder the page; the labels of grades sort differently from grades.
    rank = {"Black List": 0, "Normal": 1, "Excellent": 2}
    key = F.col(sort) if sort in ("pid", "name", "position") else F.col("pid")
    if sort == "grade":
        key = F.when(F.lit(False), 0)
        for label, value in rank.items():
            key = key.when(F.col("grade") == label, value)
    return shown.orderBy(key.asc_nulls_first() if direction >= 0 else key.desc_nulls_last(), "pid")


def participant_detail(
    pid: str, participants: DataFrame, links: DataFrame, events: DataFrame, countries: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Profile with country names, and the attended events, of one participant."""
    chosen = reports.with_country_names(tables.by_key(participants, pid=pid), countries)
    attended = reports.participant_events_display(tables.by_key(links, participant_id=pid), events, countries)
    return chosen, attended
