"""Workbooks that arrive in a folder, imported and uploaded batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rollbook.plans.upload import people_after, upload
from rollbook.plans.workbook_import import import_workbooks
from rollbook.session import checkpointed, prepare
from rollbook.sources import stored
from rollbook.sources.preview import preview_bundles

#: Changes and additions of a table after which its touched cells are rewritten.
COMPACT_AFTER = 20

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New workbook files of a folder as a stream."""
    return (
        spark.readStream.format("binaryFile")
        .schema(FILES)
        .option("pathGlobFilter", "*.{xlsx,xls}")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select("path", "content")
    )


def process(files: DataFrame, root: str, batch: int | None = None, stream: str = "") -> DataFrame:
    """Import and upload one batch of files into the tables below ``root``; returns the table of rejects.

    Participants, snapshots, events, rejects and the number of the batch become one new version of the database.  A batch
    that this ``stream`` has stored already changes nothing, and one that broke off has left nothing behind.  Only changed
    people and new rows are written; now and then the cells they lie in are rewritten.
    """
    spark = prepare(files.sparkSession)

    def work(change: stored.Change) -> None:
        if batch is not None and change.batches.get(stream, -1) >= batch:
            return
        tables = {n: change.read(n) for n in ("countries", "participants", "participant_events", "events")}
        found = import_workbooks(files, tables["countries"], tables["participants"])
        bundles = checkpointed(preview_bundles(found.events, found.attendees, found.snapshots))
        result = upload(bundles, tables["participants"], tables["participant_events"], tables["events"])
        eid = F.lit(None).cast("string").alias("eid")
        change.append("rejects", found.rejects.select("path", eid, "errors").unionByName(result.rejects))
        change.change("participants", result.changed_people, people_after)
        change.append("participant_events", result.added_snapshots)
        change.append("events", result.added_events)
        for name in ("participants", "participant_events", "events", "rejects"):
            if change.pending(name) > COMPACT_AFTER:
                change.compact(name)
        if batch is not None:
            change.batches[stream] = batch

    stored.transact(spark, root, work)
    return stored.read_table(spark, root, "rejects")


def start(
    spark: SparkSession, folder: str, root: str, checkpoint: str, files_per_batch: int = 1000, available_now: bool = False
) -> StreamingQuery:
    """Run ``process`` for every batch of arriving files, each stored exactly once for this checkpoint folder."""

    def handle(batch: DataFrame, number: int) -> None:
        process(batch, root, number, checkpoint)

    writer = arriving_files(spark, folder, files_per_batch).writeStream.foreachBatch(handle)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
