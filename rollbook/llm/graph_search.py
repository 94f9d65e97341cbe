"""Approximate nearest neighbours by largest inner product: a hierarchical navigable small-world graph for each shard.

Vectors are dealt to shards by hash.  A shard is one row of the index: its vectors, and for every layer its nodes and
their neighbours in one flat array of fixed width.  A query walks the graph of every shard and the results are merged.

Inner products are no distance, so a graph is built over vectors that got one more coordinate, which brings all of a shard
to one length; for a query, whose own is zero, the nearest of these are those of largest inner product.  Nodes enter a
layer in blocks: all nodes of a block, and likewise all queries of a batch, walk the graph in step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.shared import written

#: Different vectors in a shard, about.
SHARD_ROWS = 8192
#: Neighbours of a node in the upper layers; twice as many in the lowest.
LINKS = 16
#: Length of the list of best nodes while a graph is built and searched.
BUILD_WIDTH, SEARCH_WIDTH = 96, 128
#: Nodes that a query leaves at once, and rows that walk in step.
STRIDE, ROWS = 4, 512

_INDEX = "dim int, shard long, layers int, vectors binary, nodes array<binary>, links array<binary>, starts binary, members binary"


def _usable(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    """``id, v`` and ``d1, d2`` (128 bits that stand for the vector) of the rows that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")).where("id is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(F.exists("v", lambda x: x != 0))
    return rows.withColumn("d1", F.xxhash64(F.lit(1), "v")).withColumn("d2", F.xxhash64(F.lit(2), "v"))


def build_index(vectors: DataFrame, k: int = 20, vector: str = "embedding", key: str = "vec_id", shard_rows: int = SHARD_ROWS, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = 5) -> DataFrame:
    """The index of all rows of ``vectors``: a row for each shard, written to the shared folder.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a key, take no part.  Equal
    vectors are one node, however many rows have them; it names the ``k + 1`` smallest of their keys, more of which no
    list of ``k`` can hold.  Vectors of different lengths are in different shards.  Other columns are not read.
    """
    rows = _usable(vectors, vector, key)
    first = Window.partitionBy("d1", "d2").orderBy("id")
    least = rows.select("d1", "d2", "id").distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    members = least.groupBy("d1", "d2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = rows.groupBy("d1", "d2").agg(F.first("v").alias("v")).join(members, ["d1", "d2"])
    nodes = written(nodes.withColumn("dim", F.size("v")))
    sizes = nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))
    dealt = nodes.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("d1", "d2", F.lit(seed)), F.col("shards")))

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("d1", "ascending"), ("d2", "ascending")]).combine_chunks()
        raw = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        ids = table.column("ids").combine_chunks()
        layers = build(_lengthened(raw), links, width, seed)
        return pa.table(
            {
                "dim": [raw.shape[1]], "shard": table.column("shard")[:1], "layers": pa.array([len(layers)], pa.int32()), "vectors": [raw.tobytes()],
                "nodes": [[x.astype("<i4").tobytes() for x, _ in layers]], "links": [[x.astype("<i4").tobytes() for _, x in layers]],
                "starts": [ids.offsets.to_numpy().astype("<i8").tobytes()], "members": [ids.flatten().to_numpy().astype("<i8").tobytes()],
            }
        ).cast(pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("layers", pa.int32()), ("vectors", pa.binary()), ("nodes", pa.list_(pa.binary())), ("links", pa.list_(pa.binary())), ("starts", pa.binary()), ("members", pa.binary())]))

    placed = dealt.select("dim", "shard", "d1", "d2", "v", "ids").repartition(_tasks(sizes), "dim", "shard")
    return written(placed.groupBy("dim", "shard").applyInArrow(shard, _INDEX))


def _tasks(sizes: DataFrame) -> int:
    """Tasks that shards are dealt to: a few bytes of vectors are much work, so partitions are not merged by their size."""
    shards = int(sizes.agg(F.coalesce(F.sum("shards"), F.lit(1)).alias("n")).first()["n"])
    return max(1, min(2 * shards, 8 * int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def search(index: DataFrame, queries: DataFrame, k: int = 20, vector: str = "embedding", key: str = "vec_id", width: int = SEARCH_WIDTH) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every usable row of ``queries`` the ``k`` nearest found, but for its own key.

    ``score`` is the inner product in double precision; nearest first, ties to the smaller ``vec_id``.  Where there are
    fewer candidates all of them are returned.  Rows that repeat key and vector are one query; one key with two vectors
    is two queries.  Queries of another length than all vectors find none.  All queries are dealt to every shard of their length; a
    task holds one shard and reads them in portions.
    """
    asked = _usable(queries, vector, key).dropDuplicates(["id", "d1", "d2"])
    shards = index.groupBy("dim").agg(F.collect_set("shard").alias("all"), F.count(F.lit(1)).alias("shards"))
    placed = asked.withColumn("dim", F.size("v")).join(shards.drop("shards"), "dim").select("dim", F.explode("all").alias("shard"), "id", "d1", "d2", "v")
    graphs = index.withColumns({"id": F.lit(None).cast("long"), "d1": F.lit(None).cast("long"), "d2": F.lit(None).cast("long"), "v": F.lit(None).cast("array<double>")})
    # The row of the shard comes first, its queries follow.
    stream = graphs.unionByName(placed, allowMissingColumns=True).repartition(_tasks(shards), "dim", "shard").sortWithinPartitions("dim", "shard", F.col("layers").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for batch in batches:
            heads = np.flatnonzero(batch.column("layers").is_valid().to_numpy(zero_copy_only=False))
            for a, b in zip([0, *heads.tolist()], [*heads.tolist(), batch.num_rows], strict=True):
                rows = batch.slice(a, b - a)
                if rows.num_rows and rows.column("layers")[0].is_valid:
                    graph = _Graph(rows.slice(0, 1).to_pylist()[0])
                    rows = rows.slice(1)
                for begin in range(0, rows.num_rows, ROWS):
                    part = rows.slice(begin, ROWS)
                    own, d1, d2 = (part.column(c).to_numpy() for c in ("id", "d1", "d2"))
                    row, near, score = graph.nearest(part.column("v").flatten().to_numpy().reshape(part.num_rows, -1), own, k, width)
                    yield pa.record_batch([pa.array(x) for x in (own[row], d1[row], d2[row], near, score)], names=["query_id", "d1", "d2", "vec_id", "score"])

    found = stream.mapInArrow(run, "query_id long, d1 long, d2 long, vec_id long, score double")
    best = Window.partitionBy("query_id", "d1", "d2").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _lengthened(raw: np.ndarray) -> np.ndarray:
    """Rows with one more coordinate, so that all have length one; inner products with the old part keep their order."""
    scaled = raw / np.abs(raw).max()
    squares = np.einsum("ij,ij->i", scaled, scaled)
    rest = np.sqrt(np.maximum(squares.max() - squares, 0))
    return (np.column_stack([scaled, rest]) / np.sqrt(squares.max())).astype(np.float32)


class _Graph:
    """A shard ready for search."""

    def __init__(self, row: dict):
        self.raw = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
        self.points = _lengthened(self.raw)
        self.layers = []
        for nodes, links in zip(row["nodes"], row["links"], strict=True):
            nodes = np.frombuffer(nodes, "<i4")
            self.layers.append((nodes, np.frombuffer(links, "<i4").reshape(len(nodes), -1)))
        self.starts, self.members = (np.frombuffer(row[c], "<i8") for c in ("starts", "members"))

    def nearest(self, queries: np.ndarray, own: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query, by its row: keys and inner products of the ``k`` nearest, but for its own key."""
        largest = np.abs(queries).max(axis=1, keepdims=True)
        points = np.column_stack([queries / largest, np.zeros(len(queries))]).astype(np.float32)
        found, _ = descend(self.points, self.layers, points, max(width, k + 1))
        row, place = np.nonzero(found >= 0)
        node = found[row, place]
        score = np.einsum("ij,ij->i", self.raw[node], queries[row])
        many = self.starts[node + 1] - self.starts[node]
        row, score = np.repeat(row, many), np.repeat(score, many)
        before = np.cumsum(many) - many
        near = self.members[np.repeat(self.starts[node] - before, many) + np.arange(int(many.sum()))]
        other = near != own[row]
        row, near, score = row[other], near[other], score[other]
        order = np.lexsort((near, -score, row))
        row, near, score = row[order], near[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        return row[rank < k], near[rank < k], score[rank < k]


def descend(points: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``width`` nodes of the last of ``layers`` (top first) for every query, -1 for none, and their likeness."""
    entry = np.zeros((len(queries), 1), np.int32) + layers[0][0][0] if len(queries) else np.zeros((0, 1), np.int32)
    likeness = np.zeros(entry.shape, np.float32)
    for depth, (nodes, links) in enumerate(layers):
        place = np.full(len(points), -1, np.int32)
        place[nodes] = np.arange(len(nodes))
        last = depth == len(layers) - 1
        found, likeness = walk(points[nodes], links, queries, place[entry], width if last else 4)
        entry = np.where(found >= 0, nodes[found], -1)
        if not last:
            entry = entry[:, :1]
    return entry, likeness


def walk(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first walk of all queries in step: each keeps its best ``width`` nodes and leaves the best not yet left."""
    count = len(queries)
    ids, like = np.full((count, width), -1, np.int32), np.full((count, width), -np.inf, np.float32)
    seen = np.zeros((count, len(points)), bool)
    rows = np.arange(count)
    ids[:, 0] = entry[:, 0]
    like[:, 0] = np.einsum("ij,ij->i", points[entry[:, 0]], queries)
    seen[rows, entry[:, 0]] = True
    left = np.zeros((count, width), bool)
    active = rows
    stride = min(STRIDE, width)
    while len(active):
        open_like = np.where(left[active], -np.inf, like[active])
        best = np.argpartition(-open_like, stride - 1, axis=1)[:, :stride]
        worth = np.take_along_axis(open_like, best, 1) > -np.inf
        some = worth.any(axis=1)
        active, best, worth = active[some], best[some], worth[some]
        if not len(active):
            break
        new_row, new_id = [], []
        for s in range(stride):
            use = np.flatnonzero(worth[:, s])
            who = active[use]
            left[who, best[use, s]] = True
            near = links[ids[who, best[use, s]]]
            fresh = (near >= 0) & ~seen[who[:, None], near]
            r, c = np.nonzero(fresh)
            seen[who[r], near[r, c]] = True
            new_row.append(use[r])
            new_id.append(near[r, c])
        row, node = np.concatenate(new_row), np.concatenate(new_id)
        if not len(row):
            continue
        value = np.einsum("ij,ij->i", points[node], queries[active[row]])
        better = value > like[active].min(axis=1)[row]
        row, node, value = row[better], node[better], value[better]
        if not len(row):
            continue
        order = np.argsort(row, kind="stable")
        row, node, value = row[order], node[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        longer = int(place.max()) + 1
        all_ids = np.concatenate([ids[active], np.full((len(active), longer), -1, np.int32)], axis=1)
        all_like = np.concatenate([like[active], np.full((len(active), longer), -np.inf, np.float32)], axis=1)
        all_left = np.concatenate([left[active], np.zeros((len(active), longer), bool)], axis=1)
        all_ids[row, width + place], all_like[row, width + place] = node, value
        keep = np.argpartition(-all_like, width - 1, axis=1)[:, :width]
        ids[active], like[active], left[active] = (np.take_along_axis(x, keep, 1) for x in (all_ids, all_like, all_left))
    order = np.argsort(-like, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(like, order, 1)


def build(points: np.ndarray, links: int, width: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The layers of the graph over ``points``, top first: the nodes of each, and for each node its neighbours, -1 for none.

    The layer of a node is drawn with odds that fall by ``links`` from one to the next.  Layers are filled from the top;
    nodes that are in the layer above come first, so that a walk enters where it came down.
    """
    draw = np.random.default_rng([seed, len(points)]).random(len(points))
    level = np.minimum(np.floor(-np.log(1 - draw) / np.log(links)), 30).astype(int)
    order = np.argsort(-level, kind="stable").astype(np.int32)
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    for depth in range(int(level.max()), -1, -1):
        nodes = order[: int((level >= depth).sum())]
        layers.append((nodes, _layer(points, nodes, layers, 2 * links if depth == 0 else links, links, width)))
    return layers


def _layer(points: np.ndarray, nodes: np.ndarray, above: list[tuple[np.ndarray, np.ndarray]], most: int, links: int, width: int) -> np.ndarray:
    """Neighbours, as places in ``nodes``, after all of them were put in, in growing blocks."""
    local = points[nodes]
    out = np.full((len(nodes), most), -1, np.int32)
    done = 0
    while done < len(nodes):
        size = min(len(nodes) - done, max(64, min(done, ROWS)))
        block = np.arange(done, done + size, dtype=np.int32)
        own = local[block] @ local[block].T
        np.fill_diagonal(own, -np.inf)
        near = np.argsort(-own, axis=1, kind="stable")[:, : min(size, width)]
        ids, like = block[near], np.take_along_axis(own, near, 1)
        ids = np.where(np.isfinite(like), ids, -1)
        if done:
            if above:
                entry, _ = descend(points, above, local[block], 4)
                place = np.full(len(points), 0, np.int32)
                place[nodes] = np.arange(len(nodes))
                entry = place[entry[:, :1]]
                # The entry of a node is itself where the layer above has it; it then enters at the first node.
                entry = np.where(entry < done, entry, 0)
            else:
                entry = np.zeros((size, 1), np.int32)
            far, far_like = walk(local[:done], out[:done], local[block], entry, width)
            ids, like = np.concatenate([ids, far], axis=1), np.concatenate([like, far_like], axis=1)
        best = np.argsort(-like, axis=1, kind="stable")[:, :width]
        ids, like = np.take_along_axis(ids, best, 1), np.take_along_axis(like, best, 1)
        chosen = diverse(local, ids, like, links)
        out[block, : chosen.shape[1]] = chosen
        r, c = np.nonzero(chosen >= 0)
        _link_back(local, out, block[r], chosen[r, c], most)
        done += size
    return out


def _link_back(points: np.ndarray, out: np.ndarray, source: np.ndarray, target: np.ndarray, most: int) -> None:
    """Give every target its sources as neighbours; a node that then has too many keeps a diverse choice of them."""
    if not len(target):
        return
    touched = np.unique(target)
    r, c = np.nonzero(out[touched] >= 0)
    node = np.concatenate([target, touched[r]])
    other = np.concatenate([source, out[touched[r], c]])
    node, other = np.unique(np.stack([node, other], axis=1), axis=0).T
    like = np.einsum("ij,ij->i", points[node], points[other])
    order = np.lexsort((other, -like, node))
    node, other, like = node[order], other[order], like[order]
    rank = np.arange(len(node)) - np.searchsorted(node, node)
    kept = rank < most + most // 2
    row = np.searchsorted(touched, node[kept])
    wide = int(rank[kept].max()) + 1
    ids, likes = np.full((len(touched), wide), -1, np.int32), np.full((len(touched), wide), -np.inf, np.float32)
    ids[row, rank[kept]], likes[row, rank[kept]] = other[kept], like[kept]
    for begin in range(0, len(touched), 2 * ROWS):
        part = slice(begin, begin + 2 * ROWS)
        chosen = diverse(points, ids[part], likes[part], most)
        out[touched[part]] = -1
        out[touched[part], : chosen.shape[1]] = chosen


def diverse(points: np.ndarray, ids: np.ndarray, like: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the candidates of each row, which come nearest first: those nearer to the row than to any chosen
    before them, then the nearest of the others.
    """
    vectors = points[ids]
    between = vectors @ vectors.transpose(0, 2, 1)
    chosen, nearest = np.zeros(ids.shape, bool), np.full(ids.shape, -np.inf, np.float32)
    many = np.zeros(len(ids), int)
    for c in range(ids.shape[1]):
        take = (ids[:, c] >= 0) & (like[:, c] > nearest[:, c]) & (many < most)
        chosen[take, c] = True
        many += take
        nearest[take] = np.maximum(nearest[take], between[take, c])
    order = np.argsort(np.where(ids < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1)
