"""Word hashes, suffix arrays and subset sums against plain Python."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from rollbook.llm.groups import forest
from rollbook.llm.mixing import fill
from rollbook.llm.shared import text_blocks, utf8
from rollbook.llm.suffixes import repeated_starts, suffix_array
from rollbook.llm.tokens import bit_majority, shingles, word_bounds

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts(seed, count=40):
    chance = random.Random(seed)
    parts = ["a", "bb", "é", " ", " ", "  ", "\n", "\t", "\x0b", "long" * 12, "ß", "x\x00y", ""]
    return ["".join(chance.choices(parts, k=chance.randint(0, 30))) for _ in range(count)] + ["", " "]


@pytest.mark.parametrize("width", [1, 3, 5])
def test_shingles_are_xxh64_of_joined_words(width):
    texts = _texts(width)
    hashes, bounds = shingles(*utf8(pa.array(texts)), width)
    for k, text in enumerate(texts):
        words = WORD.findall(text)
        grams = [" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, 1 if words else 0))]
        assert hashes[bounds[k] : bounds[k + 1]].tolist() == [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]


def test_bit_majority_needs_over_half():
    hashes = np.array([1, 1, 2, 3, 1, 2], np.uint64)
    assert bit_majority(hashes, np.array([0, 3, 4, 4, 6])).tolist() == [1, 3, 0, 0]


def test_blocks_keep_every_row_and_nulls_are_empty():
    batch = pa.record_batch([pa.array([1, 2, 3, 4]), pa.array(["abc", None, "d" * 50, ""])], names=["id", "text"])
    rows = [(part.column(0).to_pylist(), np.diff(offsets).tolist()) for part, _, offsets in text_blocks(batch, "text", 10)]
    assert [i for ids, _ in rows for i in ids] == [1, 2, 3, 4]
    assert [n for _, sizes in rows for n in sizes] == [3, 0, 50, 0]
    assert word_bounds(*utf8(pa.array([], pa.string())))[2].tolist() == [0]


def test_suffix_arrays_and_repeats():
    chance = random.Random(2)
    for _ in range(300):
        letters = chance.choice([b"a", b"ab", b"abcdef"])
        pieces = [bytes(chance.choices(letters, k=chance.randint(0, 25))) for _ in range(chance.randint(1, 5))]
        pieces.append(pieces[0][1:] + b"x" + pieces[-1])
        whole = np.frombuffer(b"".join(pieces), np.uint8)
        assert suffix_array(whole, 10**6).tolist() == sorted(range(len(whole)), key=lambda i: whole[i:].tobytes())
        times = np.array([chance.choice([1, 1, 3]) for _ in pieces])
        size = chance.randint(1, 6)
        seen = {}
        for piece, n in zip(pieces, times, strict=True):
            for i in range(len(piece) - size + 1):
                seen[piece[i : i + size]] = seen.get(piece[i : i + size], 0) + n
        for piece, flags in zip(pieces, repeated_starts(pieces, times, size), strict=True):
            assert flags.tolist() == [seen[piece[i : i + size]] > 1 for i in range(len(piece) - size + 1)]


def test_fill_is_exact_where_a_sum_exists():
    chance = random.Random(4)
    for _ in range(200):
        lengths = sorted(chance.sample(range(1, 12), chance.randint(1, 4)))
        counts = [chance.randint(1, 3) for _ in lengths]
        budget = chance.randint(0, sum(n * c for n, c in zip(lengths, counts, strict=True)))
        taken = fill(lengths, counts, budget)
        sums = {sum(n * k for n, k in zip(lengths, some, strict=True)) for some in itertools.product(*[range(c + 1) for c in counts])}
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        assert sum(n * t for n, t in zip(lengths, taken, strict=True)) == max(s for s in sums if s <= budget)
    assert fill([0, 5], [3, 2], 5) in ([0, 1], [3, 1])
    large = fill([7, 11, 1000], [10**6, 10**6, 10**4], 12_345_678)
    assert 7 * large[0] + 11 * large[1] + 1000 * large[2] == 12_345_678


def test_forest_connects_the_same():
    links = np.array([[0, 1], [1, 2], [0, 2], [5, 6]])
    assert sorted(map(tuple, forest(links).tolist())) == [(0, 1), (0, 2), (5, 6)]
    assert len(forest(links[:0])) == 0
