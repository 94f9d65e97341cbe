"""Sorted pages and top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rollbook.operators.sequence import global_rank

PARTICIPANT_SORTS = {
    "pid": "pid",
    "name": "name",
    "position": "position",
    "grade": "grade",
    "country": "representing_country",
}


def _direction(c: Column, direction: int) -> Column:
    return c.asc_nulls_first() if direction >= 0 else c.desc_nulls_last()


def page(df: DataFrame, order: list[Column], skip: int = 0, limit: int = 0) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` of an order that ends in a unique key; 0 is no limit.

    A page keeps the top rows of every partition, whatever its depth.  All rows but the first
    few are ranked over range partitions, because an offset alone would bring them to one task.
    """
    if limit:
        return df.orderBy(*order).offset(skip).limit(limit)
    if not skip:
        return df.orderBy(*order)
    return global_rank(df, order, "_rank").filter(F.col("_rank") > skip).orderBy("_rank").drop("_rank")


def total(df: DataFrame) -> Column:
    """Number of rows as a one-value subquery."""
    return df.agg(F.count(F.lit(1)).alias("total")).scalar()


def participant_order(sort: str, direction: int) -> list[Column]:
    chosen = PARTICIPANT_SORTS.get(sort, "pid")
    order = [_direction(F.col(chosen), direction)]
    return order if chosen == "pid" else [*order, F.col("pid").asc()]


def participant_page(
    df: DataFrame, sort: str = "pid", direction: int = 1, skip: int = 0, limit: int = 0
) -> DataFrame:
    """One page of participants; an unknown sort field falls back to pid."""
    return page(df, participant_order(sort, direction), skip, limit)


def participant_page_by_country(
    df: DataFrame, direction: int = 1, skip: int = 0, limit: int = 0, sort_key: str = "code"
) -> DataFrame:
    """A page cut by country code whose rows are then put in order of country name.

    ``df`` has the name in ``country``.  ``sort_key="name"`` cuts by name as well.
    """
    name = _direction(F.coalesce(F.col("country"), F.lit("")), direction)
    pid = F.col("pid").asc()
    if sort_key == "name":
        return page(df, [name, pid], skip, limit)
    code = _direction(F.coalesce(F.col("representing_country"), F.lit("")), direction)
    return page(df, [code, pid], skip, limit).orderBy(name, pid)


def event_order(sort: str = "eid", direction: int = 1) -> list[Column]:
    """Event order: text ignores case, a missing date comes first, unknown fields mean eid."""
    dates = {"start_date": "start_date", "dateFrom": "start_date"}
    texts = {"eid": "eid", "title": "title", "place": "place", "location": "place", "country": "country"}
    if sort in dates:
        value = F.col(dates[sort])
    else:
        value = F.lower(F.coalesce(F.col(texts.get(sort, "eid")), F.lit("")))
    return [_direction(value, direction), F.col("eid").asc()]


def event_page(df: DataFrame, sort: str = "eid", direction: int = 1, skip: int = 0, limit: int = 0) -> DataFrame:
    return page(df, event_order(sort, direction), skip, limit)


def sort_roster(df: DataFrame, sort: str = "name", direction: int = 1) -> DataFrame:
    """Roster order: name, position and country ignore case, grade is a number, unknown means name."""
    texts = {"name": "name", "position": "position", "country": "country", "pid": "pid"}
    if sort == "grade":
        value = F.col("grade")
    else:
        value = F.lower(F.coalesce(F.col(texts.get(sort, "name")), F.lit("")))
    return df.orderBy(_direction(value, direction), F.col("pid").asc())


def page_info(df: DataFrame, page_no: int, size: int) -> DataFrame:
    """One row with the total, the page and the number of pages, which is at least one."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(size))).cast("bigint") if size else F.lit(1).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("total")).select("total", F.lit(page_no).alias("page"), pages.alias("pages"))
