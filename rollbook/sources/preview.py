"""Preview bundles: one event with its attendees and snapshots as a JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rollbook.schemas import SNAPSHOT_FIELDS

_S = T.StringType()
_EVENT_FIELDS = "eid title start_date end_date place country type cost".split()
_PERSON_FIELDS = (
    "pid name representing_country gender grade dob pob birth_country email phone diet_restrictions organization "
    "unit position rank intl_authority bio_short"
).split()

PERSON = T.StructType(
    [T.StructField(n, _S) for n in _PERSON_FIELDS]
    + [T.StructField("citizenships", T.ArrayType(_S))]
    + [T.StructField(n, _S) for n in [*SNAPSHOT_FIELDS, "travelling_from"]]
)
SNAPSHOT = T.StructType(
    [T.StructField(n, _S) for n in ["participant_id", "pid", "event_id", *SNAPSHOT_FIELDS, "travelling_from"]]
)
BUNDLE = T.StructType(
    [
        T.StructField("event", T.StructType([T.StructField(n, _S) for n in _EVENT_FIELDS])),
        T.StructField("participants", T.ArrayType(PERSON)),
        T.StructField("participant_events", T.ArrayType(SNAPSHOT)),
        T.StructField("participants_count", T.LongType()),
        T.StructField("participant_events_count", T.LongType()),
        T.StructField("generated_at", _S),
    ]
)

def _fitted(df: DataFrame, schema: T.StructType) -> list:
    """Columns of a bundle struct, in the text form that JSON keeps; missing ones are null."""
    columns = []
    for field in schema.fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return columns


def preview_bundles(
    events: DataFrame, attendees: DataFrame, snapshots: DataFrame | None = None, keys: tuple[str, ...] = ("path",)
) -> DataFrame:
    """One bundle per key, its attendees and snapshots in the order of ``row_no``.

    A bundle is the content of one workbook, which one task has read before, so its arrays are bounded.
    """

    def arrays(df: DataFrame, schema: T.StructType, name: str) -> DataFrame:
        item = F.struct("row_no", F.struct(*_fitted(df, schema)).alias("item"))
        grouped = df.select(*keys, item.alias("_i")).groupBy(*keys)
        return grouped.agg(F.sort_array(F.collect_list("_i")).alias("_l")).select(*keys, F.col("_l.item").alias(name))

    whole = events.select(*keys, F.struct(*_fitted(events, BUNDLE["event"].dataType)).alias("event"))
    whole = whole.join(arrays(attendees, PERSON, "participants"), list(keys), "left")
    none_p, none_s = (F.array().cast(T.ArrayType(s)) for s in (PERSON, SNAPSHOT))
    if snapshots is None:
        whole = whole.withColumn("participant_events", none_s)
    else:
        whole = whole.join(arrays(snapshots, SNAPSHOT, "participant_events"), list(keys), "left")
    people_or_none, snaps_or_none = F.coalesce("participants", none_p), F.coalesce("participant_events", none_s)
    return whole.select(
        *keys,
        "event",
        people_or_none.alias("participants"),
        snaps_or_none.alias("participant_events"),
        F.size(people_or_none).cast("bigint").alias("participants_count"),
        F.size(snaps_or_none).cast("bigint").alias("participant_events_count"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"),
    )


def write_preview(bundles: DataFrame, folder: str) -> None:
    """One JSON document per line; null fields are left out."""
    bundles.write.mode("overwrite").json(folder)


def read_preview(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Bundles of JSON files; ``multi_line`` reads files that hold one formatted document."""
    schema = T.StructType([*BUNDLE.fields, T.StructField("path", _S)])
    return spark.read.schema(schema).option("multiLine", str(multi_line).lower()).json(path)


def preview_counts(bundles: DataFrame) -> DataFrame:
    """Number of attendees and snapshots per event."""
    return bundles.groupBy(F.col("event.eid").alias("eid")).agg(
        F.sum(F.coalesce(F.size("participants"), F.lit(0))).alias("participants_count"),
        F.sum(F.coalesce(F.size("participant_events"), F.lit(0))).alias("participant_events_count"),
    )
