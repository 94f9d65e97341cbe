"""Ledger sheets: lines of people below the line of their event."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollbook.functions.text import split_entry, strip
from rollbook.operators.sequence import BLOCK, carry_forward

_EVENT = r"(?U)^(PFE\d{2}M\d)\s+([^\n]*)"
_ENTRY = r"(?U)^\d+\.\s+([^\n]*)"


def extract_ledger(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Events and participants of ledger lines ``(sheet, row_no, first, second)``.

    An event line holds for all numbered lines after it in the same sheet, until the next.
    """
    is_event_line = F.contains(F.col("first"), F.lit("PFE"))
    code = F.when(is_event_line & F.col("first").rlike(_EVENT), F.regexp_extract("first", _EVENT, 1))
    marked = rows.withColumn("event", code)
    events = marked.filter(F.col("event").isNotNull()).select(
        "sheet",
        "row_no",
        F.col("event").alias("Event"),
        F.regexp_extract("first", _EVENT, 2).alias("Title"),
        F.coalesce("second", F.lit("")).alias("LocationDate"),
    )
    filled = carry_forward(marked, ["sheet"], "row_no", "event", block=block)
    line = strip("first")
    people = filled.filter(~is_event_line & F.col("event").isNotNull() & line.rlike(_ENTRY)).withColumn(
        "_entry", split_entry(strip(F.regexp_extract(line, _ENTRY, 1)))
    )
    return events, people.select(
        "sheet",
        "row_no",
        F.col("event").alias("Event"),
        F.col("_entry.name").alias("Name"),
        F.col("_entry.position").alias("Position"),
        F.lit("").alias("ID"),
        F.lit("").alias("Grade"),
        F.col("sheet").alias("Country"),
    )


def write_ledger(events: DataFrame, people: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """Write the two ledger tables as parquet or CSV."""
    for name, df in {"Participants": people, "Events": events}.items():
        writer = df.drop("sheet", "row_no").write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", "true")
        writer.format(fmt).save(f"{folder}/{name}")
