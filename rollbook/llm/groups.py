"""Buckets of equal keys cut into bounded blocks, and connected components over tables of links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rollbook.llm.shared import written

#: Members of a bucket that meet in one block; a larger bucket is compared as pairs of such parts.
PART = 512


def blocks(members: DataFrame, keys: list[str], spread: str, part: int = PART, sizes: DataFrame | None = None) -> DataFrame:
    """Every bucket of two or more members as blocks: ``members`` with ``_x``, ``_y`` and ``_side``.

    A bucket of ``n`` members is dealt into ``ceil(n / part)`` parts by the hash of ``spread``.  Block
    (x, y) holds the parts x and y, so any two members meet, in a task of bounded size, and a hot key
    is many tasks.  ``_side`` says to which of the two parts a row belongs.  ``sizes`` are the buckets
    and their ``_n`` members, if they are known.
    """
    if sizes is None:
        sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    parts = F.ceil(F.col("_n") / part).cast("int")
    mine = F.pmod(F.xxhash64(spread, F.lit(7)), F.col("_parts")).cast("int")
    return (
        members.join(sizes, keys)
        .withColumn("_parts", parts)
        .withColumn("_mine", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn("_x", F.least("_mine", "_other"))
        .withColumn("_y", F.greatest("_mine", "_other"))
        .withColumn("_side", (F.col("_mine") == F.col("_y")).cast("int"))
        .drop("_n", "_parts", "_mine", "_other")
    )


def by_block(rows: DataFrame, keys: list[str], function: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: StructType | str) -> DataFrame:
    """Run ``function`` over whole blocks, many in one call: the rows sorted by block, and where blocks begin."""
    keys = [*keys, "_x", "_y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cuts = _starts(batch, keys)
            if held and (not batch.num_rows or _same(held[-1], batch, keys)):
                first = cuts[1] if len(cuts) > 1 else batch.num_rows
                held.append(batch.slice(0, first))
                batch, cuts = batch.slice(first), cuts[1:] - first
            if not batch.num_rows:
                continue
            yield from done(held)
            yield from done([batch.slice(0, cuts[-1])])
            held = [batch.slice(cuts[-1])]
        yield from done(held)

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks() if parts else None
        if table is not None and table.num_rows:
            out = function(table, np.append(_starts(table, keys), table.num_rows))
            if out is not None and out.num_rows:
                yield out

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _starts(rows: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Where the key changes; the keys are numbers."""
    if not rows.num_rows:
        return np.zeros(0, np.int64)
    change = np.zeros(rows.num_rows, bool)
    change[0] = True
    for key in keys:
        x = _numbers(rows.column(key))
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def _same(last: pa.RecordBatch, batch: pa.RecordBatch, keys: list[str]) -> bool:
    return all(last.column(k)[last.num_rows - 1] == batch.column(k)[0] for k in keys)


def forest(links: np.ndarray) -> np.ndarray:
    """Links (pairs of positions, as two columns) that connect as much as all of them do: at most one a member.

    Labels sink to the smallest position over the links; each member is then linked to its label.
    """
    if not len(links):
        return links
    nodes, flat = np.unique(links, return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return np.stack([nodes[label[moved]], nodes[moved]], axis=1)


EDGES = StructType([StructField("a", LongType()), StructField("b", LongType())])


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it is linked to, for every end of ``edges(a, b)``.

    Rounds of large and small stars: each round links all neighbours of a node to their smallest one,
    which takes a logarithmic number of rounds.  Every round is written to the shared folder.  Minima are
    pre-aggregated, so a node with very many links is no hot task.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        links = written(small.where("a <> b").distinct())
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def block_pairs(rows: pa.Table, cuts: np.ndarray, few: int = 64, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs that a block is to compare, in bounded portions.

    Small blocks are stepped through together, one distance at a time; a large block row by row.  In a
    block of two different parts only members of different parts are paired.
    """
    sizes = np.diff(cuts)
    x, y, side = (_numbers(rows.column(c)) for c in ("_x", "_y", "_side"))
    member = np.repeat(sizes, sizes)
    last = np.repeat(cuts[1:], sizes)
    at = np.flatnonzero(member <= few)
    step = 1
    while len(at):
        at = at[at + step < last[at]]
        other = at + step
        wanted = (x[at] == y[at]) | (side[at] != side[other])
        yield at[wanted], other[wanted]
        step += 1
    for k in np.flatnonzero(sizes > few):
        inside = np.arange(cuts[k], cuts[k + 1])
        if x[inside[0]] != y[inside[0]]:
            left, right = inside[side[inside] == 0], inside[side[inside] == 1]
        else:
            left = right = inside
        height = max(1, most // max(1, len(right)))
        for begin in range(0, len(left), height):
            i, j = (m.ravel() for m in np.meshgrid(left[begin : begin + height], right, indexing="ij"))
            if left is right:
                wanted = i < j
                i, j = i[wanted], j[wanted]
            yield i, j


def edges_of(ids: np.ndarray, links: list[np.ndarray]) -> pa.RecordBatch | None:
    """The forest of links between rows, as links between their ids."""
    if not links:
        return None
    nodes, flat = np.unique(ids, return_inverse=True)
    found = np.concatenate(links)
    tree = forest(flat[found])
    tree = tree[tree[:, 0] != tree[:, 1]] if len(tree) else tree
    if not len(tree):
        return None
    return pa.record_batch([pa.array(nodes[tree[:, 0]]), pa.array(nodes[tree[:, 1]])], names=["a", "b"])
