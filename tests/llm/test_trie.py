"""The prefix trie against a plain one, over odd and long conversations."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rollbook.llm import conversation_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, pos string, id int"


def _plain(rows):
    said = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in said.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = set()
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(node))
        digest = hashlib.sha256(ends.encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.add((min(who), len(node), parent, len(who), children[node], leaves[node], saved[node], digest))
    return out


def _conversations():
    chance, rows = random.Random(4), []
    for c in [*range(40), 5000, 5001, 5004, 9999]:
        for turn in range(chance.choice([1, 1, 2, 3, 5, 9, 8, 16, 17, 30]) if c != 15 else 70):
            role = chance.choice(["user", "assistant", None])
            text = chance.choice(["", "hi", "é", "hi there", None]) if turn > 9 or chance.random() < 0.3 else f"turn {turn}"
            rows.append((c, turn if turn else chance.choice([0, None]), role, text, "x", 1))
    rows += [(50, 1, "user", "y" * 100_000, "", 0), (50, 1, "user", "y" * 100_000, "", 0), (51, 1, "user", "y" * 100_000, None, None)]
    rows += [(c, t, "user", "copy", None, None) for c in range(100, 5000, 9) for t in range(3)]
    rows += [(None, 1, "user", "nobody", None, None)]
    return rows


def test_nodes_equal_a_plain_trie(spark, tmp_path):
    rows = _conversations()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.QUERIES["op13_conversation_prefix_trie"](spark, str(tmp_path)).collect()
    assert len(found) == len({tuple(r) for r in found})
    assert {tuple(r) for r in found} == _plain(rows)


@pytest.mark.parametrize("width", [1, 3])
def test_width_of_blocks_changes_nothing(spark, width):
    turns = conversation_trie.numbered_turns(spark.createDataFrame(_conversations()[:300], SCHEMA))
    kept = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    narrow, wide = (conversation_trie.prefix_trie(turns, w).select(kept) for w in (width, 8))
    assert sorted(map(str, narrow.collect())) == sorted(map(str, wide.collect()))


def test_no_conversation_has_no_node_and_texts_are_found_again(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_trie.prefix_trie(conversation_trie.numbered_turns(empty)).count() == 0
    talk = spark.createDataFrame([(1, 1, "user", "a", "", 0), (1, 2, None, None, "", 0), (2, 1, "user", "a", "", 0)], SCHEMA)
    nodes = conversation_trie.prefix_trie(conversation_trie.numbered_turns(talk))
    told = conversation_trie.node_texts(nodes, talk).orderBy("depth").select("depth", "role", "text", "n_convs", F.size(F.array("n1")))
    assert [tuple(r)[:4] for r in told.collect()] == [(0, None, None, 2), (1, "user", "a", 2), (2, "", "", 1)]
