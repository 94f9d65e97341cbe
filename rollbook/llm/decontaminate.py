"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over successive words of which some positions are ignored, so a replaced word at such
a position leaves the seed's hash as it is.  Items of different lengths have masks of their own, chosen so that
whatever words are replaced within the tolerance, some mask fits between them.  Hashes of the benchmark and of the
documents meet in an equality join; around each hit, benchmark and document are laid side by side and compared
word by word, substitutions tolerated.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import packed, text_blocks, text_key, unpacked, written
from rollbook.llm.tokens import ALPHANUMERIC, mix, word_bounds, xxh64

#: Masks by the number of words from which on an item uses them: a 1 is a word that counts, a 0 one that is ignored.
#: Any two replaced words of 13 or of 10, and any one of 8, leave at least one of their masks whole at some place.
MASKS = {
    13: ("100100110111", "111101011", "11001100111"),
    10: ("110000111", "111011", "11010101"),
    8: ("11000111", "11111"),
    **{size: ("1" * size,) for size in range(1, 8)},
}

#: Items with fewer words are matched word for word.
EXACT_BELOW = 8

#: Items with fewer words match only texts that consist of them; inside other texts they tell nothing.
WHOLE_TEXT_BELOW = 4

#: Words of a text that are stored together.
PIECE = 64

#: Bits of each of the two filters of benchmark hashes that every task holds; their size does not depend on the benchmark.
_FILTER_BITS = 22

_FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)


def seeds(words: np.ndarray, first: np.ndarray, sizes: Iterable[int] = MASKS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every mask of ``sizes``: its size, the words at which it fits into its text, and the hashes there."""
    counts = np.repeat(np.diff(first), np.diff(first))
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(words))
    for size in sizes:
        for k, mask in enumerate(MASKS[size]):
            at = np.flatnonzero(left >= len(mask) if size >= WHOLE_TEXT_BELOW else (counts == size) & (left == size))
            total = np.full(len(at), 4 * size + k, np.uint64)
            for place, used in enumerate(mask):
                if used == "1":
                    total = total * _FACTOR + words[at + place]
            yield size, at, mix(total)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters and digits only) of lower-cased texts, and the first word of every text."""
    data = ALPHANUMERIC[data]
    starts, ends, first = word_bounds(data, offsets)
    return xxh64(data, starts, ends), first


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``item_id``, ``words`` (their hashes), ``size`` (of their masks), ``hashes`` and ``places`` of their seeds; items without words are left out."""
    steps = np.array(sorted(MASKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "_low"):
                words, first = _words(data, offsets)
                size = np.concatenate([[0], steps])[np.searchsorted(steps, np.diff(first), "right")]
                row = np.repeat(np.arange(len(size)), np.diff(first))
                found = [(at[size[row[at]] == of], hashes[size[row[at]] == of]) for of, at, hashes in seeds(words, first)]
                at = np.concatenate([a for a, _ in found])
                hashes = np.concatenate([h for _, h in found])
                order = np.argsort(at, kind="stable")
                at, hashes = at[order], hashes[order]
                bounds = np.searchsorted(at, first)
                place = (at - first[np.searchsorted(first, at, "right") - 1]).astype(np.int32)
                yield pa.record_batch(
                    [rows.column(0), pa.array(size.astype(np.int32)), _lists(words.view(np.int64), first), _lists(hashes.view(np.int64), bounds), _lists(place, bounds)],
                    names=["item_id", "size", "words", "hashes", "places"],
                )

    low = F.lower(F.coalesce("text", F.lit(""))).alias("_low")
    kind = benchmark.schema["item_id"].dataType.simpleString()
    made = benchmark.select("item_id", low).distinct().mapInArrow(run, f"item_id {kind}, size int, words array<long>, hashes array<long>, places array<int>")
    return made.where("size > 0").withColumn("item_no", F.monotonically_increasing_id())


def _pieces(docs: DataFrame, sizes: list[int], present: np.ndarray, reach: int) -> DataFrame:
    """Pieces of texts within ``reach`` words of a hit of the filter: ``text_id``, ``piece`` (number), the words and the hits in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "_low"):
                words, first = _words(data, offsets)
                found = []
                for _, at, hashes in seeds(words, first, sizes):
                    high, low = (hashes >> np.uint64(64 - _FILTER_BITS)).view(np.int64), (hashes & np.uint64((1 << _FILTER_BITS) - 1)).view(np.int64)
                    hit = present[0][high] & present[1][low]
                    found.append((at[hit], hashes[hit]))
                at = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
                if not len(at):
                    continue
                hashes = np.concatenate([h for _, h in found])
                order = np.argsort(at, kind="stable")
                at, hashes = at[order], hashes[order]
                row = np.searchsorted(first, at, "right") - 1
                place = at - first[row]
                counts = np.diff(first)
                before = np.concatenate([[0], np.cumsum(-(-counts // PIECE))])
                change = np.zeros(before[-1] + 1, np.int64)
                np.add.at(change, before[row] + np.maximum(place - reach, 0) // PIECE, 1)
                np.add.at(change, before[row] + np.minimum(place + reach, counts[row] - 1) // PIECE + 1, -1)
                kept = np.flatnonzero(np.cumsum(change[:-1]) > 0)
                owner = np.searchsorted(before, kept, "right") - 1
                number = kept - before[owner]
                low = first[owner] + number * PIECE
                lengths = np.minimum(low + PIECE, first[owner + 1]) - low
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                inside = words[np.repeat(low - bounds[:-1], lengths) + np.arange(bounds[-1])]
                hits = np.append(np.searchsorted(before[row] + place // PIECE, kept), len(at))
                yield pa.record_batch(
                    [
                        rows.column(0).take(pa.array(owner)),
                        pa.array(number.astype(np.int32)),
                        _lists(inside.view(np.int64), bounds),
                        _lists(hashes.view(np.int64), hits),
                        _lists(place.astype(np.int32), hits),
                    ],
                    names=["text_id", "piece", "words", "hashes", "places"],
                )

    low = F.lower(F.coalesce("text", F.lit(""))).alias("_low")
    return docs.select(text_key().alias("text_id"), low).mapInArrow(
        run, "text_id binary, piece int, words array<long>, hashes array<long>, places array<int>"
    )


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, similarity: float = 0.8) -> DataFrame:
    """``text_id, item_id, word_start, word_end, matched, item_words`` of every overlap of a text with an item.

    Laid side by side at a hit, some ``window`` successive words (the whole item, if it is shorter) must be equal
    but for a share of ``1 - similarity``; the overlap goes from the first to the last equal word in such windows, in
    words of the document, and ``matched`` counts the equal words in it.  With the given window and similarity no overlap
    without inserted or left out words is missed.  Items of fewer than 8 words must be equal word for word, and those of
    fewer than 4 match only texts that consist of them.  Words are runs of letters and digits, lower-cased.  Null and
    empty items and texts match nothing; equal items (id and text) are one; texts may be of any length.  ``text_id`` is
    ``text_key`` of the text.
    """
    items = written(benchmark_items(benchmark))
    hashes = items.select(F.explode("hashes").alias("h"))
    present = np.zeros((2, 1 << _FILTER_BITS), bool)
    for filled, bit in zip(present, (F.shiftrightunsigned("h", 64 - _FILTER_BITS), F.col("h").bitwiseAND((1 << _FILTER_BITS) - 1)), strict=True):
        filled[hashes.select(bit.alias("bit")).distinct().toArrow().column("bit").to_numpy()] = True  # at most one row for each bit
    reach = items.agg(F.max(F.size("words"))).first()[0] or 0
    sizes = [row["size"] for row in items.select("size").distinct().collect()]  # at most one row for each entry of MASKS
    pieces = written(_pieces(docs, sizes, present, reach).dropDuplicates(["text_id", "piece"]))
    seed = F.explode(F.arrays_zip("hashes", "places")).alias("seed")
    asked = pieces.select("text_id", seed).select("text_id", F.col("seed.hashes").alias("h"), F.col("seed.places").alias("p"))
    known = items.select("item_no", F.size("words").alias("n"), seed).select("item_no", "n", F.col("seed.hashes").alias("h"), F.col("seed.places").alias("q"))
    sides = asked.join(known, "h").select("text_id", "item_no", "n", (F.col("p") - F.col("q")).alias("shift")).distinct()
    numbers = F.sequence(F.floor(F.greatest("shift", F.lit(0)) / PIECE).cast("int"), F.floor((F.col("shift") + F.col("n") - 1) / PIECE).cast("int"))
    cut = sides.select("text_id", "item_no", "shift", F.explode(numbers).alias("piece")).join(pieces.select("text_id", "piece", "words"), ["text_id", "piece"])
    # As many pieces as the item is long.
    met = cut.groupBy("text_id", "item_no", "shift").agg(F.sort_array(F.collect_list(F.struct("piece", "words"))).alias("met"))
    met = met.select("text_id", "item_no", "shift", (F.col("met")[0]["piece"] * PIECE).alias("start"), F.flatten("met.words").alias("words"))
    laid = met.join(items.select("item_no", "item_id", F.col("words").alias("item")), "item_no")
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                text = np.asarray(batch.column("words")[k].values)
                item = np.asarray(batch.column("item")[k].values)
                shift = batch.column("shift")[k].as_py() - batch.column("start")[k].as_py()
                low, high = max(0, -shift), min(len(item), len(text) - shift)
                span = min(window, len(item))
                if high - low < span:
                    continue
                same = item[low:high] == text[low + shift : high + shift]
                sums = np.concatenate([[0], np.cumsum(same)])
                good = np.flatnonzero(sums[span:] - sums[:-span] >= (span if len(item) < EXACT_BELOW else similarity * span))
                if len(good):
                    inside = np.flatnonzero(same[good[0] : good[-1] + span]) + good[0]
                    begin, end = int(inside[0]), int(inside[-1]) + 1
                    place = low + batch.column("shift")[k].as_py()
                    out.append((batch.column("text_id")[k].as_py(), batch.column("item_id")[k].as_py(), place + begin, place + end, int(sums[end] - sums[begin]), len(item)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out], schema=schema)

    probe = items.select("item_id").limit(0).toArrow().schema.field("item_id").type
    schema = pa.schema(
        [("text_id", pa.binary()), ("item_id", probe), ("word_start", pa.int32()), ("word_end", pa.int32()), ("matched", pa.int32()), ("item_words", pa.int32())]
    )
    return laid.mapInArrow(compare, f"text_id binary, item_id {kind}, word_start int, word_end int, matched int, item_words int").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each overlap of a document with an item; documents without any are not listed.

    ``doc_id, item_id, word_start, word_end, matched, item_words`` (see ``overlaps``).  Null and empty texts
    overlap with nothing; documents with equal or null ids are all listed, equal rows once.  Other columns do not matter.
    """
    found = written(overlaps(docs, benchmark))
    ids = docs.select("doc_id", text_key().alias("text_id")).distinct()
    return ids.join(found, "text_id").drop("text_id")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap with an item of the benchmark.

    Null and empty texts stay, equal rows stay or go together, and columns of any name are kept as they are.
    """
    found = written(overlaps(docs, benchmark).select("text_id").distinct())
    return unpacked(packed(docs, text_key().alias("text_id")).join(found, "text_id", "left_anti"), docs)
