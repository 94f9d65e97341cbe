"""SimHash near-dedup with deletion-variant signatures.

A fingerprint is cut into so few segments that two fingerprints within the allowed distance have one
segment that differs by at most one bit.  Every segment is indexed once for each of its bits, with that
bit masked: segments that differ in at most one bit share a variant.  An equality join on the variants
finds the candidates, which are then verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.groups import EDGES, block_pairs, blocks, by_block, components, edges_of
from rollbook.llm.shared import likely, packed, short_id, text_blocks, unpacked, written
from rollbook.llm.tokens import LOWER, bit_majority, mix, shingles, word_bounds, xxh64

#: Seeds that make independent fingerprints of the same features.
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id`` and ``fingerprint`` (a 64-bit number) of every row, over shingles of lower-cased words.

    A null text is an empty one; a text without words has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch):
                marks = bit_majority(*shingles(LOWER[data], offsets, words)).view(np.int64)
                yield pa.record_batch([rows.column(0), pa.array(marks)], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint long")


def variants(marks: DataFrame, columns: list[str], segments: int) -> DataFrame:
    """``marks`` once for each fingerprint column, segment and masked bit, with the ``key`` they share."""
    width = 64 // segments
    per = width * segments
    value = f"shiftrightunsigned(array({', '.join(columns)})[_i div {per}], cast((_i % {per}) div {width} * {width} as int))"
    masked = f"({value} & {(1 << width) - 1}L & ~shiftleft(1L, cast(_i % {width} as int)))"
    steps = F.explode(F.sequence(F.lit(0), F.lit(per * len(columns) - 1))).alias("_i")
    return marks.select("*", steps).withColumn("key", F.expr(f"shiftleft({masked}, 8) | _i")).drop("_i")


def links(marks: DataFrame, node: str, columns: list[str], segments: int, max_bits: int) -> DataFrame:
    """Links ``(a, b)`` that connect all nodes whose fingerprints differ in at most ``max_bits`` bits.

    ``marks`` has one row a node.  With one column all such nodes are found as long as no more than one
    bit falls to some segment; of several columns any segment can bring two nodes together.  A hot key is
    compared in blocks, and of each block only a forest of links leaves the task.
    """
    if len(columns) == 1 and max_bits // segments > 1:
        raise ValueError("with so many bits, two segments would have to differ in more than one")
    small = marks.select(F.col(node).alias("_node"), *[F.col(c) for c in columns if c != node])
    if node in columns:
        small = small.withColumn(node, F.col("_node"))
    spread = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = variants(small.repartition(spread, "_node"), columns, segments).select("key", "_node")
    sizes = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    shared = likely(keyed, "key", sizes).where("likely").drop("likely")
    dealt = blocks(shared, ["key"], "_node", sizes=sizes)
    if columns != [node]:
        dealt = dealt.join(small, "_node")

    def run(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch | None:
        ids = rows.column("_node").to_numpy()
        marks = [rows.column(c).to_numpy().view(np.uint64) for c in (columns if columns != [node] else ["_node"])]
        found = []
        for i, j in block_pairs(rows, cuts):
            near = sum(np.bitwise_count(m[i] ^ m[j]).astype(np.int16) for m in marks) <= max_bits
            found.append(np.stack([i[near], j[near]], axis=1))
        return edges_of(ids, found)

    return by_block(dealt, ["key"], run, EDGES)


def simhash_components(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row of ``docs``.

    Fingerprints with ``max_bits`` or fewer different bits are linked, also those of empty and null texts,
    which are zero; ``component_id`` is the smallest ``doc_id`` of all rows reached (null if all are null).
    Equal fingerprints are one node, so copies never multiply.  Other columns of ``docs`` are not read;
    an empty table gives an empty result.
    """
    rows = written(fingerprints(docs, words))
    marks = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("low"))
    linked = written(components(links(marks, "fingerprint", ["fingerprint"], max_bits // 2 + 1, max_bits)))
    lows = linked.join(marks, linked.node == marks.fingerprint).groupBy("component").agg(F.min("low").alias("lowest"))
    reached = linked.join(lows, "component").select(F.col("node").alias("fingerprint"), "lowest")
    names = written(marks.join(reached, "fingerprint", "left").select("fingerprint", F.coalesce("lowest", "low").alias("component_id")))
    return rows.join(names, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def band_keys(hashes: np.ndarray, bounds: np.ndarray, bands: int, per: int) -> np.ndarray:
    """For each row one key a band, of ``per`` minima of its hashes under independent orders; no row may be empty.

    Rows whose sets of hashes have a Jaccard similarity ``j`` share the key of a band with odds of ``j ** per``.
    """
    out = np.empty((len(bounds) - 1, bands), np.uint64)
    if not len(out):
        return out
    orders = mix(np.arange(1, bands * per // 2 + 1, dtype=np.uint64) * np.uint64(_SEEDS[0]))
    for band in range(bands):
        key = np.full(len(out), band, np.uint64)
        for order in orders[band * per // 2 : (band + 1) * per // 2]:
            mixed = mix(hashes ^ order).view(np.uint32)
            for half in (mixed[0::2], mixed[1::2]):
                key = mix(key * np.uint64(_SEEDS[1]) + np.minimum.reduceat(half, bounds[:-1]))
        out[:, band] = key
    return out


def band_links(keys: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of every row of ``keys(text_id, keys)`` to the smallest ``text_id`` of each key it shares."""
    keyed = keys.select("text_id", F.explode("keys").alias("key"))
    lows = written(keyed.groupBy("key").agg(F.min("text_id").alias("low"), F.max("text_id").alias("high")).where("low < high").drop("high"))
    shared = likely(keyed, "key", lows).where("likely").drop("likely")
    return shared.join(lows, "key").where("text_id <> low").select(F.col("text_id").alias("a"), F.col("low").alias("b")).distinct()


def near_copies(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, prints: int = 3, max_bits: int = 32, bands: int = 32, per: int = 8
) -> DataFrame:
    """``text_id`` and ``group`` of all texts that have a near copy, over whole texts.

    Two texts are linked if the sets of their lower-cased ``words``-word shingles have a Jaccard similarity of
    at least ``similarity``.  Candidates share one of ``bands`` keys of ``per`` minima over the shingles: a pair of
    similarity ``j`` is missed with odds of ``(1 - j ** per) ** bands``, 0.3 % at 0.8, whatever was edited, cut off or
    added.  More come from ``prints`` SimHashes of the set of words: pairs with a common variant and at most
    ``max_bits`` different bits.  All candidates are then compared exactly.  ``text_id`` is 64 bits of the text's
    SHA-256; equal texts are one node.  A text without words is linked with none.
    """
    columns = [f"f{k}" for k in range(prints)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch):
                low = LOWER[data]
                starts, ends, first = word_bounds(low, offsets)
                hashes = xxh64(low, starts, ends)
                row = np.repeat(np.arange(rows.num_rows), np.diff(first))
                order = np.lexsort((hashes, row))
                hashes, row = hashes[order], row[order]
                new = np.ones(len(row), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
                hashes, row = hashes[new], row[new]
                bounds = np.searchsorted(row, np.arange(rows.num_rows + 1))
                full = np.diff(bounds) > 0
                marks = [pa.array(bit_majority(mix(hashes ^ np.uint64(seed)), bounds).view(np.int64)[full]) for seed in _SEEDS[:prints]]
                parts, cuts = shingles(low, offsets, words)
                keys = band_keys(parts, np.append(cuts[:-1][full], cuts[-1]), bands, per)
                own = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.record_batch([rows.column(0).filter(pa.array(full)), *marks, own], names=["text_id", *columns, "keys"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch):
                hashes, bounds = shingles(LOWER[data], offsets, words)
                own = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.record_batch([rows.column(0), rows.column(2), own], names=["text_id", "coarse", "own"])

    texts = docs.select(short_id().alias("text_id"), "text")
    marked = texts.mapInArrow(mark, "text_id long, " + ", ".join(f"{c} long" for c in columns) + ", keys array<long>")
    marks = written(marked.dropDuplicates(["text_id"]))
    near = links(marks.drop("keys"), "text_id", columns, 2, max_bits)
    # Written first: the rounds of components repeat the plan of their links.
    candidates = written(near.unionByName(band_links(marks.select("text_id", "keys"))))
    coarse = written(components(candidates))
    coarse = coarse.select(F.col("node").alias("text_id"), F.col("component").alias("coarse"))
    members = likely(texts, "text_id", coarse).where("likely").drop("likely").join(coarse, "text_id")
    members = members.groupBy("text_id").agg(F.first("text").alias("text"), F.first("coarse").alias("coarse"))
    owned = written(members.mapInArrow(sets, "text_id long, coarse long, own array<long>"))

    def compare(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch | None:
        ids = rows.column("text_id").to_numpy()
        own = rows.column("own").combine_chunks()
        flat, bounds = own.flatten().to_numpy(), own.offsets.to_numpy() - own.offsets[0].as_py()
        found = []
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            overlap, sizes = _overlaps([np.unique(flat[bounds[k] : bounds[k + 1]]) for k in range(begin, end)])
            union = sizes[:, None] + sizes[None, :] - overlap
            i, j = np.nonzero(np.triu(overlap >= similarity * union, 1))
            found.append(np.stack([i + begin, j + begin], axis=1))
        return edges_of(ids, found)

    exact = written(by_block(blocks(owned, ["coarse"], "text_id", part=256), ["coarse"], compare, EDGES))
    return components(exact).select(F.col("node").alias("text_id"), F.col("component").alias("group"))


def _overlaps(sets: list[np.ndarray], columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all intersections and of the sets; shingles of one set only are left out of the product."""
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[place] > 1
    row, place = row[shared], np.unique(place[shared], return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        begin, end = np.searchsorted(place, [low, low + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[row[begin:end], place[begin:end] - low] = 1
        out += part @ part.T
    return out.astype(np.int64), sizes


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of copies and near copies (see ``near_copies``).

    The smallest ``doc_id`` stays, null ids last; of rows that are equal in it, the one whose other columns
    hash lowest, and one of rows that are equal in everything.  Rows without any word are one group.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.xxhash64(*rest, F.lit(0)).alias("h"), short_id().alias("t"))
    groups = near_copies(docs, words, similarity)
    placed = docs.select(order.alias("order")).groupBy(F.col("order.t").alias("text_id")).agg(F.min("order").alias("order"), F.count(F.lit(1)).alias("n"))
    placed = written(placed.join(groups, "text_id", "left").withColumn("group", F.coalesce("group", "text_id")))
    best = placed.groupBy("group").agg(F.min("order").alias("best"), F.sum("n").alias("n")).where("n > 1").drop("n")
    told = written(placed.join(best, "group").select("text_id", "best"))
    rows = likely(packed(docs, short_id().alias("text_id"), order.alias("order")), "text_id", told)
    grouped = rows.where("likely").join(told, "text_id", "left")
    # Rows that are equal in everything are the same choice.
    chosen = grouped.where("best is not null and order = best").dropDuplicates(["text_id"])
    parts = [rows.where("not likely"), grouped.where("best is null"), chosen]
    return reduce(DataFrame.unionByName, [unpacked(part, docs) for part in parts])
