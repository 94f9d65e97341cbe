"""Suffix-array, embedding, SimHash and line dedup on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rollbook.llm import embedding_dedup, line_dedup, simhash, suffix_dedup
from rollbook.llm.groups import components
from rollbook.llm.shared import text_blocks

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()


def prose(seed, words=120):
    chance = random.Random(seed)
    return " ".join("".join(chance.choices(WORDS, k=2)) for _ in range(words))


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long, key string, spans int, size int, score double"):
    return spark.createDataFrame([(*row, *[None] * (9 - len(row))) for row in rows], schema).repartition(3)


ODD = [(1, None), (2, ""), (3, " \n "), (None, "lost words"), (4, "short"), (4, "short"), (5, "x" * 3000), (None, None)]


def removed_by_brute_force(texts, size):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for piece in data:
        for i in range(len(piece) - size + 1):
            seen[piece[i : i + size]] = seen.get(piece[i : i + size], 0) + 1
    out = []
    for piece in data:
        keep = np.ones(len(piece), bool)
        for i in range(len(piece) - size + 1):
            if seen[piece[i : i + size]] > 1:
                keep[i : i + size] = False
        runs = int((np.diff(np.concatenate([[1], keep.astype(int)])) == -1).sum())
        out.append((len(piece), int((~keep).sum()), runs, hashlib.sha256(np.frombuffer(piece, np.uint8)[keep].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [2000, 1])
def test_suffix_dedup(spark, shard):
    shared = prose(0, 60)
    rows = [*ODD, (10, prose(1) + shared + prose(2)), (11, prose(3) + shared), (12, shared[3:] + "é" * 300), (13, prose(1) + shared + prose(2))]
    rows += [(20 + k, prose(50 + k, 20) + shared + prose(90 + k, 20)) for k in range(6)]
    docs = frame(spark, rows)
    held = suffix_dedup.SHARD
    suffix_dedup.repeated_ranges.__defaults__ = (400, shard)
    try:
        got = [tuple(r) for r in suffix_dedup.dedup_report(docs).collect()]
    finally:
        suffix_dedup.repeated_ranges.__defaults__ = (400, held)
    wanted = [(row[0], *numbers) for row, numbers in zip(rows, removed_by_brute_force([r[1] for r in rows], 400), strict=True)]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_a_passage_in_many_unlike_texts_is_no_hot_group(spark, monkeypatch):
    """A key with many contexts is split until equal halves have merged; no task gets the rows of a whole key."""
    chance = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def noise(n):
        return "".join(chance.choices(letters, k=n))

    passage = noise(700)
    texts = [noise(chance.randint(0, 300)) + passage[chance.randint(0, 200) :] + noise(chance.randint(0, 300)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    largest, sort = [], suffix_dedup._sorted_shards

    def watched(level, length):
        largest.append(level.groupBy("core").count().agg({"count": "max"}).first()[0] or 0)
        return sort(level, length)

    monkeypatch.setattr(suffix_dedup, "_sorted_shards", watched)
    ranges, found = suffix_dedup.repeated_ranges(docs, 400, 20)
    times = Counter(text[i : i + 400] for text in texts for i in range(len(text) - 399))
    keys = {bytes(r.key): r.text for r in found.collect()}
    got = {(bytes(r.key), i) for r in ranges.collect() for i in range(r.begin, r.end)}
    wanted = {(k, i) for k, text in keys.items() for i in range(len(text) - 399) if times[text[i : i + 400]] > 1}
    assert got == wanted and len(wanted) > 10_000
    assert len(largest) > 2 and max(largest) <= 20


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.dedup_report(frame(spark, ODD).limit(0)).count() == 0


def test_embeddings(spark):
    chance = np.random.default_rng(1)
    base = chance.normal(size=(3, 16))
    vectors = [(k, (base[k % 3] + chance.normal(size=16) * (0.02 if k % 2 else 0.3)).tolist(), k % 2) for k in range(120)]
    rows = vectors + [(200, vectors[1][1], 1), (201, vectors[1][1], 1), (201, vectors[1][1], 1), (202, vectors[1][1], None), (203, None, 1), (204, [0.0] * 16, 1)]
    rows += [(205, [float("nan")] * 16, 1), (206, [1.0, None] * 8, 1), (207, [], 1), (208, [1.0, 2.0], 1), (209, [2.0, 4.0], 1), (None, vectors[1][1], 1), (210, [float("inf")] * 16, 1)]
    table = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, label int, node int, key int").repartition(4)
    got = sorted(map(tuple, embedding_dedup.near_vectors(table).collect()), key=str)

    def fine(r):
        v = r[1]
        return r[2] is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    group = list(range(len(rows)))
    count = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i], rows[j]
            if fine(a) and fine(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    count[i] += 1
                    count[j] += 1
                    group = [group[j] if g == group[i] else g for g in group]
    lows = [min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group]
    wanted = [(r[0], n, low, r[0] is not None and r[0] == low) for r, n, low in zip(rows, count, lows, strict=True)]
    assert got == sorted(wanted, key=str)
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0


def test_hot_bucket_of_different_vectors_is_cut_into_blocks(spark):
    chance = np.random.default_rng(2)
    rows = [(k, (np.ones(8) + chance.normal(size=8) * 1e-3).tolist(), 1) for k in range(1300)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas()
    assert (got.n_links == 1299).all() and (got.component_id == 0).all() and got.kept.sum() == 1


def test_simhash_components(spark):
    rows = [*ODD, (10, prose(1, 400)), (11, prose(1, 400) + " extra"), (12, prose(1, 400).upper()), (13, prose(2)), (9, prose(2))]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(frame(spark, rows)).collect()}
    prints = simhash.fingerprints(frame(spark, rows)).collect()
    marks = [(r.doc_id, r.fingerprint & (2**64 - 1)) for r in prints]
    group = {m: m for _, m in marks}
    for a in list(group):
        for b in list(group):
            if (a ^ b).bit_count() <= 3:
                old, new = group[a], group[b]
                group = {k: new if v == old else v for k, v in group.items()}
    low = {}
    for i, m in marks:
        if i is not None:
            low[group[m]] = min(low.get(group[m], i), i)
    assert got == {(i, f"{m:016x}", low.get(group[m])) for i, m in marks}
    assert simhash.simhash_components(frame(spark, ODD).limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    words = prose(7, 200).split()
    near = " ".join([*words[:100], "other", *words[101:]])
    far = " ".join(w if k % 4 else "x" + w for k, w in enumerate(words))
    rows = [(5, " ".join(words), "en"), (6, near, "en"), (7, far, "en"), (5, " ".join(words), "en"), (5, " ".join(words), "de"), (None, near, "en"), *ODD]
    docs = frame(spark, rows)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    # Texts without words are three different texts: null and empty are equal, blank ones have no words in common with any.
    assert ids == [1, 3, 4, 5, 5, 7, None]
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_near_copies_keep_to_the_similarity(spark):
    rows, texts = [], []
    for k in range(60):
        words = prose(100 + k, 150).split()
        chance = random.Random(k)
        other = [("new" + w if chance.random() < k / 2000 else w) for w in words]
        texts += [words, other]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    kept = {r.doc_id for r in simhash.drop_near_copies(frame(spark, rows)).collect()}

    def jaccard(a, b):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        return len(x & y) / len(x | y)

    wanted = {2 * k + s for k in range(60) for s in (0, 1) if s == 0 or jaccard(texts[2 * k], texts[2 * k + 1]) < 0.8}
    assert len(kept ^ wanted) <= 1  # candidates are found with odds of about 0.99
    assert kept >= wanted


def jaccard_of_words(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_of_every_kind_of_edit_are_found(spark):
    rows, wanted = [], {}
    for k in range(240):
        kind, size = ("cut", "extended", "block")[k % 3], (60, 100, 200, 500, 1000)[k % 5]
        words = [f"w{k}x{i}" for i in range(size)]
        part = {"cut": (size - 4) // 5, "extended": (size - 4) // 4, "block": (size - 4) // 9 - 4}[kind]
        new = [f"n{k}x{i}" for i in range(part)]
        other = {"cut": words[: size - part], "extended": words + new, "block": words[: size // 3] + new + words[size // 3 + part :]}[kind]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        wanted[2 * k + 1] = (kind, jaccard_of_words(words, other) >= 0.8)
    kept = {r.doc_id for r in simhash.drop_near_copies(frame(spark, rows)).collect()}
    assert kept >= {2 * k for k in range(240)} | {i for i, (_, near) in wanted.items() if not near}
    for kind in ("cut", "extended", "block"):
        near = [i for i, (own, like) in wanted.items() if own == kind and like]
        assert len(near) == 80 and len(set(near) & kept) <= 2  # each is missed with odds of 0.003 at most


def test_lines(spark):
    line = "One line of words that is the same in many places."
    rows = [*ODD, (8, f"Start.\n{line}\nEnd."), (9, f"  {line.upper()}  \nMore of it. é {line}"), (None, line), (7, f"é {line}"), (12, "a b.\na b.\n"), (12, "a b.\na b.\n")]
    docs = frame(spark, rows)
    got = {(r.doc_id, r.start, r.end, r.n_words, r.first_doc_id, r.first_start) for r in line_dedup.repeated_spans(docs).collect()}
    # In texts 7 and 9 the words also stand inside other lines, where a run of so few words stays.
    unit = len(line)
    assert got == {(9, 2, 2 + unit, 11, 8, 7), (None, 0, unit, 11, 8, 7), (12, 5, 9, 2, 12, 0)}
    left = [(r.doc_id, r.text) for r in line_dedup.without_repeats(docs).collect()]
    assert dict(left)[9].split() == f"More of it. é {line}".split() and dict(left)[8] == f"Start.\n{line}\nEnd." and dict(left)[1] is None
    assert left.count((12, "a b.\n\n")) == 2 and len(left) == len(rows)
    assert line_dedup.repeated_spans(docs.limit(0)).count() == 0 and line_dedup.without_repeats(docs.limit(0)).count() == 0


def test_long_passages_inside_other_texts_are_one_run(spark):
    passage = ". ".join(prose(k, 12) for k in range(6))
    rows = [(k, f"{prose(300 + k, 9)} {passage} {prose(400 + k, 9)}") for k in range(3)]
    got = line_dedup.repeated_spans(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == [1, 2] and all(72 - 14 <= r.n_words <= 72 and r.first_doc_id == 0 for r in got)


def test_short_passages_inside_other_texts_stay(spark):
    rows = [(k, f"{prose(500 + k, 40)} {prose(1, 35)} {prose(600 + k, 40)}") for k in range(4)]
    assert line_dedup.repeated_spans(frame(spark, rows)).count() == 0
    got = line_dedup.repeated_spans(frame(spark, rows), long_words=35).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3] and all(21 <= r.n_words <= 35 for r in got)


def removed_words(texts, width=8, long_words=50):
    """Words of (id, text) that must go, and words that may go, by comparing every line, paragraph and window."""
    first, words = {}, {}
    for doc, text in sorted(texts):
        found, at, line = [], 0, 0
        for m in re.finditer(r"[^ \t-\r]+", text):
            line += text.count("\n", at, m.start())
            at = m.start()
            found.append((re.sub("[A-Z]", lambda c: c[0].lower(), m[0]), line))
        words[doc] = found
    must, may = {doc: set() for doc in words}, {doc: set() for doc in words}

    def later(key, doc, at):
        seen = first.setdefault(key, (doc, at))
        return seen != (doc, at) and not (seen[0] == doc and at < seen[1] + len(key[1]))

    for doc, found in words.items():
        hits, plain = set(), [w for w, _ in found]
        for gap in (1, 2):
            cuts = [0, *[k for k in range(1, len(found)) if found[k][1] - found[k - 1][1] >= gap], len(found)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a and later(("line", tuple(plain[a:b])), doc, a):
                    must[doc] |= set(range(a, b))
        for a in range(len(plain) - width + 1):
            if later(("window", tuple(plain[a : a + width])), doc, a):
                hits |= set(range(a, a + width))
        for a in range(len(plain) - long_words + 1):
            if later(("long", tuple(plain[a : a + long_words])), doc, a) and first["long", tuple(plain[a : a + long_words])][0] != doc:
                must[doc] |= set(range(a + width - 1, a + long_words - width + 1))
        hits |= must[doc]
        run = []
        for k in range(len(plain) + 1):
            if k in hits:
                run.append(k)
            elif run:
                may[doc] |= set(run) if len(run) >= long_words - 2 * (width - 1) else set(run) & must[doc]
                run = []
    return must, may


def test_removed_runs_lie_between_bounds_of_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    texts += [(10**6 + k, f"{prose(k, 30)} {texts[k][1]} {prose(900 + k, 20)}") for k in range(0, 60, 3)]
    texts += [(2 * 10**6, "\n".join(prose(k % 1500, 90) for k in range(1600)))]
    assert len(texts[-1][1]) > 1 << 20
    must, may = removed_words(texts)
    got = line_dedup.repeated_spans(frame(spark, texts)).collect()
    assert any(must.values()) and len({(r.doc_id, r.start) for r in got}) == len(got)
    for doc, text in texts:
        mine = covered(got, doc)
        gone = {k for k, m in enumerate(re.finditer(r"[^ \t-\r]+", text)) if m.start() in mine}
        assert must[doc] <= gone <= may[doc], doc


def covered(rows, doc):
    return {c for r in rows if r.doc_id == doc for c in range(r.start, r.end)}


def test_short_lines_repeat_whole(spark):
    two = "Read all of the terms here today. Then go back to the first page."
    texts = ["All rights reserved.\nOne more.", f"all  rights RESERVED.\n{two}", f"{two}\nA new one.\n\nall rights\nreserved.", "a b.\na b.\n"]
    docs = frame(spark, list(enumerate(texts)))
    got = line_dedup.repeated_spans(docs).collect()
    assert [covered(got, k) for k in range(4)] == [set(), set(range(21)), set(range(len(two))) | set(range(len(two) + 13, len(texts[2]))), set(range(5, 9))]
    left = {r.doc_id: r.text.split() for r in line_dedup.without_repeats(docs).collect()}
    assert left == {0: texts[0].split(), 1: two.split(), 2: "A new one.".split(), 3: "a b.".split()}


def test_unpunctuated_passages_repeat_in_unlike_texts(spark):
    rows, spots = [], {}
    for k in range(120):
        passage = [f"p{k}x{i}" for i in range((50, 60, 80, 300)[k % 4])]
        for side in (0, 1):
            words = [f"l{k}{side}x{i}" for i in range(40 * side)] + passage + [f"r{k}{side}x{i}" for i in range(30 * side)]
            rows.append((2 * k + side, " ".join(words)))
        begin = rows[-1][1].index(passage[0])
        spots[2 * k + 1] = (begin, begin + len(" ".join(passage)), len(passage))
    got = line_dedup.repeated_spans(frame(spark, rows)).collect()
    text = dict(rows)
    for doc in text:
        mine = covered(got, doc)
        if doc not in spots:
            assert not mine
            continue
        begin, end, words = spots[doc]
        assert mine and begin <= min(mine) and max(mine) < end
        left = set(range(min(mine), max(mine) + 1)) - mine
        assert all(text[doc][c] == " " for c in left) and len(text[doc][min(mine) : max(mine) + 1].split()) >= words - 14


def test_words_that_repeat_themselves_keep_their_first_occurrence(spark):
    got = line_dedup.repeated_spans(frame(spark, [(1, "word " * 40)]), long_words=40).collect()
    assert got and min(r.start for r in got) == 40


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (130, 100), (130, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 131), 100)}


def test_hashing_the_places_of_a_text_takes_bounded_memory():
    batch = pa.record_batch([pa.array([prose(k, 300) for k in range(900)])], names=["text"])
    found, peaks = [], []
    for limit in (1 << 20, suffix_dedup._HASHED):
        tracemalloc.start()
        found.append(np.concatenate([suffix_dedup.cells(data, offsets, 400)[0] for _, data, offsets in text_blocks(batch, limit=limit)]))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert np.array_equal(*found) and peaks[1] < 30_000_000 < peaks[0]
