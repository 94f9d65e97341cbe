"""Prefix trie of conversations: a ROLLUP over columns of turn ids gives all prefixes together.

A conversation is cut into blocks of turns; a row of a block holds the ids of its turns in columns, and the node that
the block before it ended in.  One ROLLUP over the columns, within that node, aggregates every prefix of every block, so
neither long conversations nor frequent first turns need rounds of their own: a hot prefix is reduced on every task first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.shared import written

#: Turns of a block, the columns of the rollup.
BLOCK = 8
#: Ids are listed in runs of the same number but for so many low bits, which bounds a list.
RUN_BITS = 12


def _turn_id(role: str, text: str) -> Column:
    """128 bits of the SHA-256 of a turn and the bytes of its text, in 24 bytes; null is empty text."""
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256)
    return F.unhex(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.octet_length(said).cast("long")), 16, "0")))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, id`` of every turn: its place in the conversation from 1, and the id of its role and text.

    Turns are taken by ``turn``, null first; turns of one number by their ids.  Repeated rows are turns of their own, rows
    without a ``conv_id`` belong to no conversation and are left out.  Other columns are not read.  Texts do not leave the
    task that reads them; only ids are sorted, on disk if need be.
    """
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", _turn_id("role", "text").alias("id"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "id")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "id")


def shared_heads(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Conversations that share their first turns with the first one of their group.

    Conversation ``c`` gets the first ``h`` turns of ``c - c % group`` (all if fewer, none if that is absent) and then its
    own turns after its first ``h``; ``h`` is the CRC-32 of the decimal ``c``, modulo ``most``.  Every conversation has a
    row with ``pos`` 0 besides its turns, for such as are left without any.
    """
    first = F.when(F.col("pos") < most, F.struct("pos", "id"))
    heads = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(first)).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    convs = heads.select("conv_id", taken, (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    bases = heads.select(F.col("conv_id").alias("base"), "head")
    part = F.filter(F.coalesce("head", F.array().cast("array<struct<pos:long,id:binary>>")), lambda e: e["pos"] <= F.col("h"))
    joined = convs.join(bases, "base", "left").select("conv_id", "h", part.alias("head"))
    lent = joined.select("conv_id", F.explode(F.concat(F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("id"))), "head")).alias("e"))
    moved = joined.select("conv_id", "h", F.size("head").cast("long").alias("m"))
    own = turns.join(moved, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "id")
    return lent.select("conv_id", "e.pos", "e.id").unionAll(own)


def _mark(ids: Column | str, seed: int) -> Column:
    """64 bits for turns with their places, to be joined by exclusive or; two seeds make the 128 bits that name a node."""
    return F.aggregate(ids, F.lit(0).cast("long"), lambda bits, e: bits.bitwiseXOR(F.xxhash64(e["pos"], e["id"], F.lit(seed))))


def _blocks(turns: DataFrame, width: int) -> DataFrame:
    """A row for each conversation and block: ``k1, k2`` (the node before the block), ``x1, x2`` (what its turns add), ``t1`` to ``t<width>``."""
    no = F.floor((F.greatest(F.col("pos"), F.lit(1)) - 1) / width).cast("long")
    turn = F.when(F.col("pos") > 0, F.struct("pos", "id"))
    rows = turns.repartition("conv_id").groupBy("conv_id", no.alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("ids"))
    rows = rows.select("conv_id", "block", "ids", _mark("ids", 1).alias("x1"), _mark("ids", 2).alias("x2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0)).alias(f"k{k}") for k in (1, 2)]
    return rows.select("conv_id", "block", *keys, "x1", "x2", *[F.get("ids", F.lit(i)).getField("id").alias(f"t{i + 1}") for i in range(width)])


def _rolled(blocks: DataFrame, width: int, *sums: str) -> DataFrame:
    """All prefixes of all blocks: ``depth``, the node (``n1, n2``) and its parent (``p1, p2``), ``bytes`` of its last text, the sums."""
    names = ", ".join(f"t{i + 1}" for i in range(width))
    rolled = blocks.sparkSession.sql(
        f"SELECT block, k1, k2, {names}, {', '.join(sums)}, {width} - bit_count(grouping_id()) AS level FROM {{blocks}} GROUP BY block, k1, k2, ROLLUP({names})",
        blocks=blocks,
    )
    listed = rolled.withColumn("path", F.slice(F.array(*[f"t{i + 1}" for i in range(width)]), F.lit(1), F.col("level")))
    # A prefix that is longer than its conversation ends in null; the empty prefix of a later block is a node of the block before.
    real = listed.where((F.col("level") == 0) & (F.col("block") == 0) | (F.col("level") > 0) & F.get("path", F.col("level") - 1).isNotNull())
    start = F.col("block") * width
    ids = F.transform("path", lambda id, i: F.struct((start + i + 1).cast("long").alias("pos"), id.alias("id")))
    real = real.withColumn("ids", ids)
    upper = F.slice("ids", F.lit(1), F.greatest(F.col("level") - 1, F.lit(0)))
    node = [F.col(f"k{k}").bitwiseXOR(_mark("ids", k)).alias(f"n{k}") for k in (1, 2)]
    parent = [F.when(F.col("level") > 0, F.col(f"k{k}").bitwiseXOR(_mark(upper, k))).alias(f"p{k}") for k in (1, 2)]
    size = F.conv(F.hex(F.substring(F.get("path", F.col("level") - 1), 17, 8)), 16, 10).cast("long")
    kept = [s.rsplit(" ", 1)[1] for s in sums]
    return real.select(*node, *parent, (start + F.col("level")).alias("depth"), F.coalesce(size, F.lit(0)).alias("bytes"), *kept)


def prefix_trie(turns: DataFrame, width: int = BLOCK) -> DataFrame:
    """The nodes of the trie of all conversations in ``turns(conv_id, pos, id)``, one row each.

    ``n1, n2`` and ``p1, p2`` name the node and its parent (null at the root), ``depth`` counts its turns, ``bytes`` those
    of its last text; ``conv_id`` and ``parent_conv_id`` are the smallest members, ``n_convs`` the members, ``n_children``
    the children, ``n_leaves`` the childless nodes in the subtree, itself included, and ``saved`` the bytes that a cache of
    prefixes saves there: for every node of the subtree its last text, once for each member but the first.
    ``ends_sha256`` is the SHA-256 of the decimal ids of the conversations that end in the node, ascending, joined by
    commas.  A row with ``pos`` 0 stands for a conversation that may have no turns.  Without rows there is no node.

    Sums over subtrees need no walk: a node is charged to its smallest member, and that one is a member of every node
    above, so the same rollup adds the charges up; what it adds too much lies above the node on its own member's path.
    """
    blocks = written(_blocks(turns, width))
    nodes = written(_rolled(blocks, width, "min(conv_id) AS conv_id", "count(1) AS n_convs"))
    children = nodes.where("p1 is not null").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = nodes.join(children, ["n1", "n2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    weight = (F.col("n_convs") - 1) * F.col("bytes")
    path = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    counted = written(counted.withColumn("w", weight).withColumn("above", F.coalesce(F.sum("w").over(path), F.lit(0))))
    charges = counted.groupBy("conv_id").agg(F.sum("w").alias("w"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"))
    sums = _rolled(blocks.join(charges, "conv_id"), width, "sum(w) AS below", "sum(leaf) AS n_leaves").select("n1", "n2", "below", "n_leaves")
    parents = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    whole = counted.join(sums, ["n1", "n2"]).join(_ends(blocks), ["n1", "n2"], "left").join(parents, ["p1", "p2"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select(
        "n1", "n2", "p1", "p2", "depth", "bytes", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("below") - F.col("above")).alias("saved"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def _ends(blocks: DataFrame) -> DataFrame:
    """``ends_sha256`` of the nodes ``n1, n2`` that conversations end in.

    Ids are first listed in runs, on many tasks; the digest of a node then reads its runs in order, one at a time.
    """
    last = blocks.groupBy("conv_id").agg(F.bit_xor("x1").alias("n1"), F.bit_xor("x2").alias("n2"))
    runs = last.groupBy("n1", "n2", F.shiftright("conv_id", RUN_BITS).alias("run")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    listed = runs.select("n1", "n2", "run", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            found = []
            for n1, n2, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (n1, n2) != node:
                    if node is not None:
                        found.append((*node, digest.hexdigest()))
                    node, digest = (n1, n2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _rows(found)
        if node is not None:
            yield _rows([(*node, digest.hexdigest())])

    return listed.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "run").mapInArrow(digests, "n1 long, n2 long, ends_sha256 string")


def _rows(found: list[tuple[int, int, str]]) -> pa.RecordBatch:
    n1, n2, digests = zip(*found, strict=True) if found else ((), (), ())
    return pa.record_batch([pa.array(n1, pa.int64()), pa.array(n2, pa.int64()), pa.array(digests, pa.string())], names=["n1", "n2", "ends_sha256"])


def node_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` of the trie of ``conversations`` with the ``role`` and ``text`` of their last turn; null at the root."""
    ids = numbered_turns(conversations).select("conv_id", F.col("pos").alias("depth"), "id")
    said = conversations.select(_turn_id("role", "text").alias("id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    first = ids.join(nodes.select("conv_id", "depth"), ["conv_id", "depth"])
    texts = said.join(first.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    named = first.join(texts, "id").drop("id")
    return nodes.join(named, ["conv_id", "depth"], "left")
