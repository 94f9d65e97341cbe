"""Suffix-array dedup: every string of a given length that also starts anywhere else is removed.

One suffix array of the whole corpus would not fit a task, so the text is cut into shards by content.  Every
string of ``length`` bytes has an anchor, the least of the hashes of its short substrings: equal strings have
equal anchors at equal places.  Strings with the same anchor, at about the same place, share a core of bytes,
and the hash of the core is the shard key.  Keys that occur once are done with.  The stretches of text behind
the others are gathered by key, equal stretches once, and each shard gets a suffix array by induced sorting and its
permuted common prefixes (``suffixes``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import text_blocks, utf8, written
from rollbook.llm.suffixes import repeated_starts
from rollbook.llm.tokens import mix

#: Bytes of the substrings whose hashes choose the anchor.
_GRAM = 48

#: Cells into which the places are dealt that an anchor can have in a string.
_CELLS = 2

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Different stretches of one key that go into one suffix array; keys with more are split by longer cores.
SHARD = 2000

#: Bytes of stretches that are sorted together, when keys are small.
_TOGETHER = 1 << 21

#: Bytes of text whose places are hashed at once; about 70 bytes of arrays stand for each of them.
_HASHED = 1 << 18

#: Bits of the filter of texts with repeats; its size does not depend on the corpus.
_FILTER_BITS = 22


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Prints:
    """Hashes of any substring of a block of bytes."""

    def __init__(self, data: np.ndarray) -> None:
        terms = _powers(_BASE, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * terms[:-1], out=self.sums[1:])
        self.back = _powers(_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.back[start])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` successive values, from the minima of blocks of that width up to and from each place."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    square = padded.reshape(blocks, width)
    upto = np.minimum.accumulate(square, axis=1).ravel()
    since = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(since[:count], upto[width - 1 : width - 1 + count])


def cells(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of string starts that share an anchor and half of the places it can be at.

    Returns key, row, first start in the row, number of starts, and the place of the first in its half.
    """
    width = length - _GRAM + 1
    half = -(-width // _CELLS)
    empty = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(data) < length:
        return empty
    prints = Prints(data)
    places = np.arange(len(data) - _GRAM + 1)
    hashes = prints.of(places, _GRAM) & np.uint64(0xFFFFFFFF00000000) | places.astype(np.uint64)
    anchor = (_least(hashes, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(np.arange(len(data)) + length <= np.repeat(offsets[1:], sizes))
    if not len(starts):
        return empty
    anchor, row = anchor[starts], row[starts]
    side = (anchor - starts >= half).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) > 1) | (anchor[1:] != anchor[:-1]) | (side[1:] != side[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(starts)))
    first, anchor, side, row = starts[head], anchor[head], side[head], row[head]
    low = np.where(side == 1, anchor - (width - 1), anchor - half + 1)  # first start of the half
    high = np.where(side == 1, anchor - half, anchor)  # last start of the half
    core = prints.of(high, low + length - high) ^ side.astype(np.uint64)
    return core.view(np.int64), row, first - offsets[row], count, first - low


def _unique_rows(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows of a batch with different keys, and how many rows each stands for."""
    place: dict[bytes, int] = {}
    keep: list[int] = []
    times: list[int] = []
    for k, key in enumerate(batch.column(0).to_pylist()):
        if key in place:
            times[place[key]] += 1
        else:
            place[key] = len(keep)
            keep.append(k)
            times.append(1)
    return batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int32())), np.array(times)


def _digest() -> F.Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def repeated_ranges(docs: DataFrame, length: int = 400, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """``(ranges, texts)``: for each different text with repeats its key and ``ranges`` of starts of repeated strings.

    ``ranges`` has ``key, begin, end``: all strings that start at bytes ``begin`` to ``end - 1`` of the text with that key start elsewhere too.
    ``texts`` has ``key, text`` of all texts that may have some.  A key is the first half of the SHA-256.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            unique, times = _unique_rows(whole)
            done = 0
            for rows, data, offsets in text_blocks(unique, limit=_HASHED):
                core, row, begin, count, place = cells(data, offsets, length)
                here = times[done : done + rows.num_rows]
                done += rows.num_rows
                columns = [pa.array(x.astype(np.int32)) for x in (begin, count, place, here[row])]
                yield pa.record_batch([pa.array(core), rows.column(0).take(pa.array(row)), *columns], names=["core", "key", "begin", "count", "place", "n"])

    keyed = docs.select(F.unhex(F.substring(_digest(), 1, 32)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    found = written(keyed.mapInArrow(cut, "core long, key binary, begin int, count int, place int, n int"))
    often = found.groupBy("core").agg(F.sum("n").alias("_n")).where("_n > 1").select("core")
    # A start is in one cell, so the first three tell the core; without it in the grouping the join may split a hot core over tasks.
    kept = written(found.join(written(often), "core").groupBy("key", "begin", "count", "place").agg(F.first("core").alias("core"), F.sum("n").alias("n")))

    bit = F.shiftrightunsigned(F.xxhash64("key"), 64 - _FILTER_BITS).alias("bit")
    present = np.zeros(1 << _FILTER_BITS, bool)
    present[kept.select(bit).distinct().toArrow().column("bit").to_numpy()] = True  # at most one row for each bit

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(present[batch.column("bit").to_numpy()]))
            yield _unique_rows(some.select(["key", "text"]))[0]

    texts = keyed.select("key", "text", bit).mapInArrow(likely, "key binary, text string")
    texts = written(texts.groupBy("key").agg(F.first("text").alias("text")))

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            lists = batch.column("cells")
            inner = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            begin, count = (inner.field(c).to_numpy() for c in ("begin", "count"))
            at = offsets[row] + begin
            pieces = pa.array([data[a : a + size].tobytes() for a, size in zip(at, count + (length - 1), strict=True)], pa.binary())
            yield pa.record_batch(
                [inner.field("core"), batch.column("key").take(pa.array(row)), inner.field("begin"), inner.field("place"), inner.field("n"), pieces],
                names=["core", "key", "begin", "place", "n", "piece"],
            )

    lists = kept.groupBy("key").agg(F.collect_list(F.struct("core", "begin", "count", "place", "n")).alias("cells"))
    pieces = texts.join(lists, "key").mapInArrow(stretch, "core long, key binary, begin int, place int, n long, piece binary")
    piece_id = F.unhex(F.substring(F.sha2(F.col("piece"), 256), 1, 32)).alias("piece_id")
    pieces = written(pieces.select("*", piece_id))
    # Equal stretches of a key go on as one, with the number of times they occur.
    level = pieces.groupBy("core", "piece_id").agg(F.sum("n").alias("n"), F.first("piece").alias("piece"), F.first("place").alias("place"))
    level = level.select("core", F.col("piece_id").alias("unit"), "place", "n", "piece")
    width = -(-(length - _GRAM + 1) // _CELLS)
    results = []
    names = None
    while True:
        level = written(level)
        sizes = level.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("_n")).where("_n > 1")
        sizes = written(sizes)
        level = level.join(sizes.select("core", "kinds"), "core")
        last = width <= 1
        fit = level if last else level.where(F.col("kinds") <= shard)
        results.append(_named(_sorted_shards(fit, length), names))
        if last or sizes.where(F.col("kinds") > shard).isEmpty():
            break
        halves = written(_split(level.where(F.col("kinds") > shard).drop("kinds"), width, length))
        names = written(_names(halves, names))
        # Halves that are equal go on as one: at width one all strings of a key are, and their number alone decides.
        level = halves.groupBy("core", "unit", "place").agg(F.sum("n").alias("n"), F.first("piece").alias("piece"))
        width = -(-width // 2)
    hits = results[0]
    for more in results[1:]:
        hits = hits.unionByName(more)
    hits = written(hits)
    placed = pieces.select("key", "begin", F.col("core").alias("c"), "piece_id").join(hits, "piece_id")
    same = placed.select("key", (F.col("begin") + F.col("first")).alias("begin"), (F.col("begin") + F.col("until")).alias("end")).distinct()
    return same, texts


_UNIT = ["core", "unit", "place"]


def _names(halves: DataFrame, names: DataFrame | None) -> DataFrame:
    """``core, unit, place`` of the halves, and the stretches that they are in: ``piece_id, at``."""
    own = halves.select(*_UNIT, *[f"of_{c}" for c in _UNIT], "at")
    if names is None:
        return own.select(*_UNIT, F.col("of_unit").alias("piece_id"), "at")
    upper = names.select(*[F.col(c).alias(f"of_{c}") for c in _UNIT], "piece_id", F.col("at").alias("before"))
    return own.join(upper, [f"of_{c}" for c in _UNIT]).select(*_UNIT, "piece_id", (F.col("at") + F.col("before")).alias("at"))


def _named(hits: DataFrame, names: DataFrame | None) -> DataFrame:
    """``piece_id, first, until``: the hits in units as such in the stretches that these were cut from."""
    if names is None:
        return hits.select(F.col("unit").alias("piece_id"), "first", "until")
    return hits.join(names, _UNIT).select("piece_id", (F.col("first") + F.col("at")).alias("first"), (F.col("until") + F.col("at")).alias("until"))


def _sorted_shards(level: DataFrame, length: int) -> DataFrame:
    """``core, unit, place, first, until``: starts in a unit whose strings are repeated among the units of its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        last = None
        for batch in batches:
            core = batch.column("core").to_numpy()
            cuts = np.flatnonzero(core[1:] != core[:-1]) + 1 if len(core) else []
            lengths = np.diff(utf8(batch.column("piece"))[1])
            begin = 0
            for cut in [*cuts, batch.num_rows]:
                if begin == cut:
                    continue
                if size >= _TOGETHER and core[begin] != last:
                    yield from done(held)
                    held, size = [], 0
                held.append(batch.slice(begin, cut - begin))
                size += int(lengths[begin:cut].sum())
                last = core[begin]
                begin = cut
        yield from done(held)

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        pieces, times = rows.column("piece").to_pylist(), rows.column("n").to_numpy()
        ids, first, until = [], [], []
        for k, flags in enumerate(repeated_starts(pieces, times, length)):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
            ids += [k] * (len(edges) // 2)
            first += edges[::2].tolist()
            until += edges[1::2].tolist()
        which = pa.array(ids, pa.int64())
        table = pa.table([*(rows.column(c).take(which) for c in _UNIT), pa.array(first, pa.int32()), pa.array(until, pa.int32())], names=[*_UNIT, "first", "until"])
        yield from table.combine_chunks().to_batches()

    rows = level.select("core", "unit", "place", "n", "piece").repartition("core").sortWithinPartitions("core")
    return rows.mapInArrow(run, "core long, unit binary, place int, first int, until int")


def _split(level: DataFrame, width: int, length: int) -> DataFrame:
    """Units of hot keys as their two halves, each keyed by the longer core that its starts share: what they hold and were cut from."""
    half = -(-width // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("piece"))
            core, place = (batch.column(c).to_numpy() for c in ("core", "place"))
            prints = Prints(data)
            starts = np.diff(offsets) - (length - 1)
            for low, high in ((0, half), (half, width)):  # places of the first start and past the last
                first = np.maximum(place, low)
                until = np.minimum(place + starts, high)
                some = np.flatnonzero(first < until)
                if not len(some):
                    continue
                first, until = first[some], until[some]
                begin = offsets[some] + (high - 1 - place[some])
                key = mix(prints.of(begin, low + length - (high - 1)) + core[some].view(np.uint64) * np.uint64(_BASE) + np.uint64(low))
                cut = offsets[some] + first - place[some]
                pieces = [data[a : a + n].tobytes() for a, n in zip(cut, until - first + length - 1, strict=True)]
                which = pa.array(some)
                yield pa.record_batch(
                    [
                        pa.array(key.view(np.int64)),
                        pa.array((first - low).astype(np.int32)),
                        *(batch.column(c).take(which) for c in _UNIT),
                        pa.array((first - place[some]).astype(np.int32)),
                        batch.column("n").take(which),
                        pa.array(pieces, pa.binary()),
                    ],
                    names=["core", "place", "of_core", "of_unit", "of_place", "at", "n", "piece"],
                )

    halves = level.select("core", "unit", "place", "n", "piece").mapInArrow(
        run, "core long, place int, of_core long, of_unit binary, of_place int, at int, n long, piece binary"
    )
    return halves.withColumn("unit", F.unhex(F.substring(F.sha2(F.col("piece"), 256), 1, 32)))


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``key, n_removed, n_spans, kept_sha256, spans`` of every different text that loses bytes.

    ``spans`` are the maximal removed runs of bytes.  Texts are compared as UTF-8, in themselves and with all others;
    what is repeated is judged on the input, not on what is left.
    """
    ranges, texts = repeated_ranges(docs, length)
    lists = ranges.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out = []
            for k, ranges in enumerate(batch.column("ranges")):
                inner = ranges.values
                begin, end = inner.field("begin").to_numpy(), inner.field("end").to_numpy() + (length - 1)
                order = np.argsort(begin)
                begin, end = begin[order], np.maximum.accumulate(end[order])
                apart = np.append(True, begin[1:] > end[:-1])
                begin, end = begin[apart], end[np.append(np.flatnonzero(apart)[1:] - 1, len(end) - 1)]
                text = data[offsets[k] : offsets[k + 1]]
                keep = np.ones(len(text), bool)
                for a, b in zip(begin, end, strict=True):
                    keep[a:b] = False
                spans = [{"begin": int(a), "end": int(b)} for a, b in zip(begin, end, strict=True)]
                out.append((int((end - begin).sum()), len(begin), hashlib.sha256(text[keep].tobytes()).hexdigest(), spans))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
            columns = [pa.array([row[c] for row in out], kind) for c, kind in enumerate(kinds)]
            yield pa.record_batch([batch.column("key"), *columns], names=["key", "n_removed", "n_spans", "kept_sha256", "spans"])

    return texts.join(lists, "key").mapInArrow(
        run, "key binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:int,end:int>>"
    )


def dedup_report(docs: DataFrame, length: int = 400) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs``.

    A null text is an empty one.  Texts shorter than ``length`` lose nothing.  Rows with equal texts (also under
    equal ids) are occurrences of their own, so both lose all strings.  Other columns are not read.
    """
    lost = written(remove_repeats(docs, length).select("key", "n_removed", "n_spans", "kept_sha256"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    rows = docs.select("doc_id", size.alias("n_bytes"), _digest().alias("sha")).withColumn("key", F.unhex(F.substring("sha", 1, 32)))
    zero = F.lit(0).cast("long")
    return rows.join(lost, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )
