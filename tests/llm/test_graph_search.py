"""Neighbours found in graphs against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from rollbook.llm import graph_search, queries

SCHEMA = "vec_id long, embedding array<float>, label int, shard string, v int"


def _exact(rows, k=20, every=20):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in usable:
        if i % every == 0:
            scored = [(-float(np.dot(np.float64(v), np.float64(w))), j) for j, w in usable if j != i and len(w) == len(v)]
            out[i, v] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def _rows(df):
    found = {}
    for row in df.orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    return found


def _check(found, exact, least):
    hits = wanted = 0
    assert set(found) == {i for (i, _), near in exact.items() if near}
    for (i, _), near in exact.items():
        got = found.get(i, [])
        assert [r for r, _, _ in got] == list(range(1, len(near) + 1))
        assert [(-s, j) for _, j, s in got] == sorted((-s, j) for _, j, s in got)
        scores = dict(near)
        for _, j, s in got:
            assert j != i
            if j in scores:
                assert s == pytest.approx(scores[j], rel=1e-12)
        hits += len({j for _, j, _ in got} & set(scores))
        wanted += len(near)
    assert hits >= least * wanted


def test_recall_over_several_shards(spark):
    chance = np.random.default_rng(1)
    centres = chance.normal(size=(10, 32))
    points = (centres[chance.integers(0, 10, 3000)] + chance.normal(size=(3000, 32)) * 0.5) * chance.uniform(0.5, 3, (3000, 1))
    rows = [(k, [float(x) for x in np.float32(p)]) for k, p in enumerate(points)]
    frame = spark.createDataFrame([(*r, 0, "s", 1) for r in rows], SCHEMA)
    index = graph_search.build_index(frame, shard_rows=700)
    assert index.count() > 3
    found = _rows(graph_search.search(index, frame.where("vec_id % 20 = 0")))
    _check(found, _exact(rows), 0.97)


def test_odd_rows_and_many_copies(spark, tmp_path):
    chance = np.random.default_rng(2)
    rows = [(k, [float(x) for x in np.float32(chance.normal(size=8))]) for k in range(60)]
    same = rows[3][1]
    rows += [(k, same) for k in range(1000, 1100)] + [(1000, same), (1000, same)]
    rows += [(200, None), (220, []), (240, [0.0] * 8), (260, [1.0, None] * 4), (280, [float("nan")] * 8), (300, [float("inf")] * 8), (None, same)]
    rows += [(320, [1.0, 2.0]), (321, [2.0, 2.0]), (340, [5.0])]
    spark.createDataFrame([(*r, None, "s", 1) for r in rows], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    exact = _exact(rows)
    found = _rows(queries.QUERIES["op11_graph_search"](spark, str(tmp_path)))
    _check(found, exact, 1.0)
    assert [j for _, j, _ in found[1000]][:2] == [3, 1001] and [j for _, j, _ in found[320]] == [321] and 340 not in found


def test_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    index = graph_search.build_index(empty)
    some = spark.createDataFrame([(20, [1.0], 1, "", 1)], SCHEMA)
    assert index.count() == 0 and graph_search.search(index, some).count() == 0
    assert graph_search.search(graph_search.build_index(some), empty).count() == 0


def test_query_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    _check(_rows(queries.QUERIES["op11_graph_search"](spark, folder)), _exact(rows), 0.99)


def test_graph_of_few_points_and_of_a_dense_group():
    for points in (np.ones((1, 3)), np.eye(3), np.arange(1.0, 11).reshape(5, 2)):
        near = graph_search._lengthened(points)
        ids, like = graph_search.descend(near, graph_search.build(near, 4, 16, 0), near[:1], 8)
        assert sorted(ids[0][ids[0] >= 0].tolist()) == list(range(len(points))) and like[0, 0] == pytest.approx(1)
    chance = np.random.default_rng(3)
    points = np.concatenate([chance.normal(size=(1000, 16)), chance.normal(size=16) * 2 + chance.normal(size=(1000, 16)) * 0.02])
    near = graph_search._lengthened(points)
    asked = np.column_stack([points[::50], np.zeros(40)]).astype(np.float32)
    ids, _ = graph_search.descend(near, graph_search.build(near, 16, 96, 0), asked, 128)
    exact = np.argsort(-(points[::50] @ points.T), axis=1)[:, :20]
    assert np.mean([len(set(a[:20]) & set(b)) for a, b in zip(ids, exact, strict=True)]) >= 19
