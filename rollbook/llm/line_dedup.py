"""Substring dedup by hashing of lines and paragraphs; long passages inside them by windows of words.

Digests of the normalised units are grouped over all documents; the earliest occurrence stays, the others are
removed as runs of the original text (``repeated_spans``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.shared import likely, packed, text_blocks, text_key, written
from rollbook.llm.tokens import LOWER, mix, word_bounds, xxh64

_FACTOR = np.uint64(0x9E3779B97F4A7C15)

#: Told apart by this: a line is compared with lines and paragraphs, a window with windows.
_WHOLE = np.uint64(0xC2B2AE3D27D4EB4F)


def units(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, text_id, word, start, end, n_words, whole, high, low`` of every unit.

    Units are all lines and paragraphs (``whole``), of any length, and windows of ``width`` words anywhere in a text: of
    any ``width`` windows in a row the one of least hash (all of equal ones).  So equal passages of ``2 * width - 1``
    words choose equal windows, which meet or overlap and leave out fewer than ``width`` words at either end, whatever
    stands around them.  ``word`` counts the words before; ``start`` and ``end`` are code points of the original text, from
    the first to the last word.  The digest of 128 bits is over the words, A-Z lower-cased, whatever the white space
    between them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch):
                data = LOWER[data]
                starts, ends, first = word_bounds(data, offsets)
                if not len(starts):
                    continue
                hashes = xxh64(data, starts, ends)
                text = np.zeros(len(starts), bool)
                text[first[:-1][np.diff(first) > 0]] = True
                lines = np.concatenate([[0], np.cumsum(data == 0x0A)])
                passed = lines[starts[1:]] - lines[starts[:-1]]
                line, paragraph = text.copy(), text.copy()
                line[1:] |= passed > 0
                paragraph[1:] |= passed > 1
                begin, size, one, two = (np.concatenate(c) for c in zip(*[_cut(hashes, np.flatnonzero(new)) for new in (line, paragraph)], strict=True))
                # A line that is a whole paragraph is one unit.
                _, only = np.unique(begin * np.int64(len(starts) + 1) + size, return_index=True)
                lined = begin[only], size[only], mix(one[only] ^ _WHOLE), two[only]
                begin, size, one, two = (np.concatenate(c) for c in zip(lined, _windows(hashes, first, width), strict=True))
                whole = np.arange(len(begin)) < len(only)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                row = np.searchsorted(first, begin, "right") - 1
                base = points[offsets[row]]
                columns = [begin - first[row], points[starts[begin]] - base, points[ends[begin + size - 1]] - base, size]
                ids = pa.array(row)
                yield pa.record_batch(
                    [rows.column(0).take(ids), rows.column(1).take(ids), *[pa.array(c.astype(np.int32)) for c in columns], pa.array(whole), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    names=["doc_id", "text_id", "word", "start", "end", "n_words", "whole", "high", "low"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("text_id"), "text").mapInArrow(
        run, f"doc_id {kind}, text_id binary, word int, start int, end int, n_words int, whole boolean, high long, low long"
    )


def _cut(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, words and digest of the units that begin at ``begin`` and fill the words."""
    size = np.diff(np.append(begin, len(hashes)))
    place = (np.arange(len(hashes)) - np.repeat(begin, size)).astype(np.uint64)
    return begin, size, np.add.reduceat(mix(hashes + place * _FACTOR), begin), np.add.reduceat(mix(hashes ^ mix(place + np.uint64(1))), begin)


def _windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, words and digest of the chosen windows: each the least of some ``width`` windows in a row."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(hashes))
    one = np.zeros(len(hashes), np.uint64)
    for k in range(min(width, len(hashes))):
        one[: len(hashes) - k] += mix(hashes[k:] + np.uint64(k) * _FACTOR)
    order = np.where(left >= width, mix(one), np.uint64(2**64 - 1))
    least = order.copy()
    for k in range(1, width):
        least[:-k] = np.minimum(least[:-k], order[k:])
    chosen = np.zeros(len(hashes), bool)
    for k in range(min(width, len(hashes))):
        chosen[k:] |= order[k:] == least[: len(hashes) - k]
    at = np.flatnonzero(chosen & (left >= width))
    two = np.zeros(len(at), np.uint64)
    for k in range(width):
        two += mix(hashes[at + k] ^ mix(np.array([k + 1], np.uint64)))
    return at, np.full(len(at), width), one[at], two


def repeated_spans(docs: DataFrame, width: int = 8, long_words: int = 50) -> DataFrame:
    """One row for each run to remove: ``doc_id, text_id, start, end, n_words, first_doc_id, first_start``.

    Of equal lines and paragraphs the one in the smallest ``doc_id`` (null ids last), and in it the first, stays; the
    others go, at any length.  Elsewhere words go where later occurrences of windows cover a run of at least
    ``long_words - 2 * (width - 1)`` words, which every repeated passage of ``long_words`` words does; it loses at most
    ``width - 1`` words at either end.  A window that overlaps its own first occurrence stays.  Runs that meet are
    one row; ``first_doc_id`` and ``first_start`` are the kept occurrence of its first unit.

    Rows that are equal in id and text are one document.  Null, empty and blank texts have no units, and documents
    without a repeated unit are not listed; an empty table gives no rows.  Whole texts of any length are read, each in one
    task.  Other columns of ``docs`` are not read.  The units are made twice, which takes less disk than storing all.
    """
    found = units(docs, width)
    keys = written(found.groupBy("high").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("high"))
    again = written(likely(found, "high", keys).where("likely").drop("likely"))
    removed = _runs(_later(again)).withColumn("long", F.col("to") - F.col("from") >= long_words - 2 * (width - 1))
    joined = _runs(removed.where("whole or long").drop("isle", "from", "to"))
    first = F.min(F.struct("word", -F.col("n_words"), "first_doc_id", "first_start")).alias("first")
    runs = joined.groupBy("doc_id", "text_id", "isle").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("to") - F.min("from")).alias("n_words"), first
    )
    return runs.select("doc_id", "text_id", "start", "end", "n_words", "first.first_doc_id", "first.first_start")


def _later(found: DataFrame) -> DataFrame:
    """All but the first of equal units, each once."""
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_id").alias("t"), F.col("word").alias("w"), F.col("start").alias("s"))
    first = found.groupBy("high", "low").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    both = found.join(written(first), ["high", "low"]).where(~(rank == F.col("first")))
    same = F.col("doc_id").eqNullSafe(F.col("first.d")) & (F.col("text_id") == F.col("first.t"))
    both = both.where(~(same & (F.col("word") < F.col("first.w") + F.col("n_words"))))
    hits = both.select(
        "high", "low", "doc_id", "text_id", "word", "start", "end", "n_words", "whole", F.col("first.d").alias("first_doc_id"), F.col("first.s").alias("first_start")
    )
    # Rows lie by the digest after the join, so this needs no shuffle.
    return hits.distinct().drop("high", "low")


def _runs(hits: DataFrame) -> DataFrame:
    """``hits`` with the run of words without a gap that each stands in: ``isle``, its first word ``from`` and its end ``to``."""
    text = Window.partitionBy("doc_id", "text_id")
    order = text.orderBy("word", "n_words", "whole")
    until: Column = F.col("word") + F.col("n_words")
    reached = F.max(until).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.withColumn("gap", F.when(F.col("word") <= reached, 0).otherwise(1))
    isles = marked.withColumn("isle", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("gap")
    isle = Window.partitionBy("doc_id", "text_id", "isle")
    return isles.withColumn("from", F.min("word").over(isle)).withColumn("to", F.max(until).over(isle))


def without_repeats(docs: DataFrame, width: int = 8, long_words: int = 50) -> DataFrame:
    """``docs`` with the runs of ``repeated_spans`` cut out of ``text``, and ``removed``: their original ``start`` and ``end``.

    Every row stays, also of null and empty texts; ``removed`` is null where nothing went and replaces a column of that
    name.
    """
    found = repeated_spans(docs, width, long_words).groupBy("doc_id", "text_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed")
    )
    rows = packed(docs, F.col("doc_id").alias("d"), text_key().alias("t"), "text")
    both = rows.join(found, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("text_id")), "left").select("row", "text", "removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True):
                at, out = 0, []
                for span in removed or ():
                    out.append(text[at : span["start"]])
                    at = max(at, span["end"])
                texts.append(None if text is None else "".join([*out, text[at:]]))
            yield batch.set_column(1, batch.schema.field(1), pa.array(texts, batch.schema.field(1).type))

    out = both.mapInArrow(run, both.schema)
    names = [c for c in docs.columns if c != "removed"]
    return out.select(*[(F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in names], "removed")
