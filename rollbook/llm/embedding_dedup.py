"""Embedding near-dedup by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions; the quantised projections of a table are its bucket.
Vectors that share a bucket in some table are compared by their exact cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.groups import block_pairs, blocks, by_block, components, forest
from rollbook.llm.shared import written

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def directions(dim: int, tables: int, projections: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions and uniform offsets, the same in every task and run."""
    random = np.random.default_rng([seed, dim])
    return random.normal(size=(dim, tables * projections)), random.uniform(0, width, tables * projections)


def buckets(vectors: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """For each unit vector a bucket number in every table."""
    axes, shift = directions(vectors.shape[1], tables, projections, width, seed)
    cells = np.floor((vectors @ axes + shift) / width).astype(np.int64).astype(np.uint64).reshape(len(vectors), tables, projections)
    out = np.full((len(vectors), tables), np.uint64(vectors.shape[1]))
    for k in range(projections):
        out = (out ^ cells[:, :, k]) * _FACTOR
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def near_vectors(
    embeddings: DataFrame, cosine: float = 0.98, tables: int = 16, projections: int = 16, width: float = 3.0, seed: int = 11
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``embeddings``.

    Rows are linked if their labels are equal and not null, their vectors have the same length, and the cosine of the
    vectors is ``cosine`` or more.  Null and empty vectors, zero vectors and such with null or non-finite components are linked with
    none, and are components of their own.  At a cosine of 0.98 a pair is missed in two cases of ten thousand, closer
    pairs in fewer (the odds of sharing no bucket).  Equal vectors of a label are one node and counted, not
    compared.  ``component_id`` is the smallest ``vec_id`` reached; a row with a null id counts as a link but names no
    component (``kept`` is then false).  Repeated ids are rows of their own.  Other columns are not read.
    """
    vector = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = embeddings.select("vec_id", "label", vector.alias("v"))
    usable = (
        F.col("label").isNotNull()
        & F.coalesce(F.size("v") > 0, F.lit(False))
        & F.coalesce(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )
    rows = rows.withColumn("v", F.when(usable, F.col("v")))
    # The node of equal vectors is known by a digest; a row without a usable vector has none.
    node = F.when(F.col("v").isNotNull(), F.conv(F.substring(F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("v").cast("array<string>")), 256), 1, 16), 16, -10).cast("long"))
    named = written(rows.withColumn("node", node))
    nodes = named.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = written(nodes)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for some, vectors in _unit(batch.column("v")):
                    marks = buckets(vectors, tables, projections, width, seed)
                    ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * tables)
                    ids = batch.column("node").take(pa.array(some))
                    yield pa.record_batch([ids, pa.ListArray.from_arrays(ends, pa.array(marks.ravel()))], names=["node", "marks"])

    hashed = nodes.select("node", "v").mapInArrow(spread, "node long, marks array<long>")
    hashed = written(nodes.join(hashed, "node"))
    keyed = hashed.select("node", "label", F.posexplode("marks").alias("table", "mark"))
    keyed = keyed.select("node", F.xxhash64("label", "table", "mark").alias("key"), "table")
    dealt = blocks(keyed, ["key"], "node").join(hashed.select("node", "n", "label", "v", "marks"), "node")
    dealt = dealt.withColumn("label_no", F.xxhash64("label")).drop("label")

    def compare(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch | None:
        ids, many, table, label = (rows.column(c).to_numpy() for c in ("node", "n", "table", "label_no"))
        marks = rows.column("marks").combine_chunks().flatten().to_numpy().reshape(-1, tables)
        out, sets = [], []
        place, shape = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for k, (some, vectors) in enumerate(_unit(rows.column("v"))):
            place[some], shape[some] = np.arange(len(some)), k
            sets.append(vectors)
        for i, j in block_pairs(rows, cuts):
            # A pair counts in the first table in which it shares a bucket.
            first = np.argmax(marks[i] == marks[j], axis=1) == table[i]
            same = first & (label[i] == label[j]) & (shape[i] == shape[j]) & (ids[i] != ids[j])
            i, j = i[same], j[same]
            for k, vectors in enumerate(sets):
                own = shape[i] == k
                a, b = i[own], j[own]
                near = np.einsum("ij,ij->i", vectors[place[a]], vectors[place[b]]) >= cosine
                out.append(np.stack([a[near], b[near]], axis=1))
        if not out:
            return None
        found = np.concatenate(out)
        if not len(found):
            return None
        nodes, flat = np.unique(ids, return_inverse=True)
        a, b = flat[found].T
        links = np.bincount(a, many[found[:, 1]], minlength=len(nodes)) + np.bincount(b, many[found[:, 0]], minlength=len(nodes))
        tree = forest(flat[found])
        return pa.record_batch(
            [
                pa.array(np.concatenate([nodes, nodes[tree[:, 0]]])),
                pa.array(np.concatenate([links, np.zeros(len(tree))]).astype(np.int64)),
                pa.array(np.concatenate([nodes, nodes[tree[:, 1]]])),
            ],
            names=["a", "links", "b"],
        )

    found = written(by_block(dealt, ["key"], compare, "a long, links long, b long"))
    counts = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    linked = written(components(found.select("a", "b")))
    lows = linked.join(nodes.select("node", "low"), "node").groupBy("component").agg(F.min("low").alias("lowest"))
    reached = linked.join(lows, "component").select("node", "lowest")
    told = nodes.select("node", "n", "low").join(counts, "node", "left").join(reached, "node", "left")
    told = written(told.select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("lowest", "low").alias("component_id")))
    out = named.select("vec_id", "node").join(told, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _unit(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors of each length scaled to length one: their rows and a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    begin = np.concatenate([[0], np.cumsum(sizes)])
    for size in np.unique(sizes):
        some = np.flatnonzero(sizes == size)
        vectors = flat[begin[some][:, None] + np.arange(size)]
        vectors = vectors / np.abs(vectors).max(axis=1)[:, None]  # so that no square overflows or vanishes
        yield some, vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
