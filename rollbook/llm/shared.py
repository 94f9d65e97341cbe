"""Shared folders, written intermediate tables and blocks of text for the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.session import shared_folder

#: Bytes of text that are worked on at once inside a task; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table of its own in the shared folder and read it back: a reliable cut of the lineage."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about ``limit`` bytes: the rows, their bytes and their offsets."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    first, rows = 0, batch.num_rows
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, rows)
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def short_id(column: str = "text") -> F.Column:
    """64 bits of the SHA-256 of a text, as a number."""
    return F.conv(F.substring(F.sha2(F.coalesce(F.col(column), F.lit("")), 256), 1, 16), 16, -10).cast("long")


def text_key(column: str = "text") -> F.Column:
    """128 bits of the SHA-256 of a text, as bytes; a null is an empty text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(column), F.lit("")), 256), 1, 32))


def likely(rows: DataFrame, column: str, among: DataFrame, bits: int = 24) -> DataFrame:
    """``rows`` with ``likely``: true wherever ``column`` is in ``among``, and false for nearly all others.

    The values of ``among`` are marked by their hashes in ``2 ** bits`` bits, at most ``2 ** (bits - 6)`` rows of 64, so
    the table that is broadcast is bounded whatever the data.  It keeps rows that cannot match out of a shuffle.
    """
    place = F.shiftrightunsigned(F.xxhash64(column), 64 - bits)
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    filled = written(among.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    tested = rows.withColumn("_w", word).withColumn("_b", bit).join(F.broadcast(filled), F.col("_w") == F.col("_word"), "left")
    return tested.withColumn("likely", F.coalesce(F.col("_bits").bitwiseAND(F.col("_b")) != 0, F.lit(False))).drop("_w", "_b", "_word", "_bits")


def packed(docs: DataFrame, *more: F.Column) -> DataFrame:
    """``docs`` as one struct column ``row`` beside ``more``, so that no name of theirs can clash with another."""
    return docs.select(F.struct(*docs.columns).alias("row"), *more)


def unpacked(rows: DataFrame, like: DataFrame, **replaced: F.Column) -> DataFrame:
    """The columns of ``like`` out of ``row``, some replaced."""
    return rows.select(*[(replaced[c] if c in replaced else F.col("row").getField(c)).alias(c) for c in like.columns])
