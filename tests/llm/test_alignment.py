"""Alignment of two tokenizers against a plain merge of whole texts, one document at a time."""

from __future__ import annotations

import hashlib
import os
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from rollbook.llm import queries, token_alignment
from rollbook.llm.token_alignment import A_FILE, B_FILE

pytestmark = pytest.mark.skipif(not os.path.exists(A_FILE), reason="no tokenizer files here")

ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "a\t \t b  ", " x  y", "x   y", "é é", "你好 世界",
    "▁x", "x▁ y", "<|endoftext|> <s> </s> <unk> <0x41>", "\U0001f600\U0001f600 \U0001f468‍\U0001f469", "don't we'll I'm", "x\x00y \x1c z\x85 q",
    "1234567 89", "   lead", "tail   ", "\n\n\n", "word " * 300, "y" * 5000, " " * 3000, "long tail über " * 9000,
]


def _merge(text, a, b):
    """Tokens, links and groups of one whole text by the plain rule, or None."""
    if not text:
        return None
    whole = (" " + text).encode()
    left, right = a.encode([" " + text])[0], b.encode([" " + text])[0]
    spans = []
    for ids, vocabulary in ((left, a), (right, b)):
        at, out, joined = 0, [], b""
        for i in ids:
            piece = vocabulary.bytes_of(_one(i)).tobytes()
            joined += piece
            out.append((at, at + len(piece)))
            at += len(piece)
        if joined != whole:
            return None
        spans.append(out)
    links, j = [], 0
    for i, (s, e) in enumerate(spans[0]):
        while spans[1][j][1] <= s:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < e:
            links.append((i, k))
            k += 1
    ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, i, j = [], 0, 0
    for end in ends:
        one, two = [], []
        while i < len(left) and spans[0][i][1] <= end:
            one.append(str(left[i]))
            i += 1
        while j < len(right) and spans[1][j][1] <= end:
            two.append(str(right[j]))
            j += 1
        groups.append(",".join(one) + "|" + ",".join(two))
    return left, right, links, groups


def _one(number):
    import numpy as np

    return np.array([number])


def _expected(rows):
    a, b = token_alignment.ByteLevel(A_FILE), token_alignment.Pieces(B_FILE)
    found = [_merge(text, a, b) for _, text in rows]
    counts = Counter()
    for f in found:
        if f:
            counts.update({(f[0][i], f[1][k]) for i, k in f[2]})
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for (number, _), f in zip(rows, found, strict=True):
        if not f:
            out.append((number, 0, 0, 0, 0, 0, 0, ""))
            continue
        held = [counts[f[0][i], f[1][k]] for i, k in f[2]]
        best = sum(n == most[f[0][i]] for n, (i, _) in zip(held, f[2], strict=True))
        out.append((number, len(f[0]), len(f[1]), len(f[3]), len(f[2]), best, sum(held), hashlib.sha256(";".join(f[3]).encode()).hexdigest()))
    return out


def _sorted(rows):
    return sorted(map(str, rows))


def test_odd_texts_equal_the_plain_merge(spark, tmp_path, monkeypatch):
    rows = [(k, text) for k, text in enumerate(ODD)] + [(None, "no id"), (3, "same id"), (3, "same id")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, pairs string, chunk int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op12_cross_tokenizer_alignment"](spark, str(tmp_path)).collect()
    assert _sorted(map(tuple, found)) == _sorted(_expected(rows))


def test_documents_equal_the_plain_merge(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert _sorted(map(tuple, token_alignment.alignment_report(docs).collect())) == _sorted(_expected(rows))


def test_alignments_are_links_and_cuts(spark):
    docs = spark.createDataFrame([(k, text) for k, text in enumerate(ODD)], "doc_id long, text string")
    a, b = token_alignment.ByteLevel(A_FILE), token_alignment.Pieces(B_FILE)
    for row in token_alignment.alignments(docs).collect():
        found = _merge(ODD[row.doc_id], a, b)
        assert (row.a_ids, row.b_ids) == (found[:2] if found else ([], []))
        assert [tuple(x) for x in row.links] == (found[2] if found else [])
        assert len(row.cuts) == (len(found[3]) if found else 0)
        if found:
            assert row.a_ends[-1] == row.b_ends[-1] == len(ODD[row.doc_id].encode()) + 1
            assert all(row.a_ends[c.a] == row.b_ends[c.b] for c in row.cuts)


def test_no_documents_and_packed_numbers(spark):
    assert token_alignment.alignment_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    for values in ([], [0], [5, 2**32 - 1, 7]):
        assert token_alignment._unpacked(token_alignment._packed(_one(0)[:0] if not values else pa.array(values, pa.int64()).to_numpy())).tolist() == values
