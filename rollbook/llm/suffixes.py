"""Suffix arrays of byte strings by induced sorting, and permuted longest common prefixes, in numpy.

Both inductions run over the alphabet of bytes, one bucket at a time, with all suffixes of a bucket in step.
"""

from __future__ import annotations

import numpy as np

#: Ends every piece of text; no byte of UTF-8 has this value.
SEPARATOR = 0xFF


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as a number (zeros beyond the end), without copying."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))


def suffix_types(data: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than the next one; runs of a byte take the type of their end."""
    ends = np.append(np.flatnonzero(data[1:] != data[:-1]), len(data) - 1)
    rising = np.zeros(len(ends), bool)
    rising[:-1] = data[ends[:-1]] < data[ends[:-1] + 1]
    return np.repeat(rising, np.diff(ends, prepend=-1))


class _Buckets:
    """Where the suffixes of each first byte stand: the larger-type ones first, then the smaller-type ones."""

    def __init__(self, data: np.ndarray, smaller: np.ndarray) -> None:
        self.data, self.smaller = data, smaller
        counts = np.bincount(data, minlength=256)
        self.end = np.cumsum(counts)
        self.start = self.end - counts
        self.middle = self.start + np.bincount(data[~smaller], minlength=256)
        self.present = np.flatnonzero(counts)

    def before(self, suffixes: np.ndarray, smaller: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The suffixes one byte longer that have the wanted type, by first byte and else in the given order."""
        longer = suffixes[suffixes > 0] - 1
        longer = longer[self.smaller[longer] == smaller]
        first = self.data[longer]
        order = np.argsort(first, kind="stable")
        counts = np.bincount(first, minlength=256)
        first = first[order]
        return longer[order], first, np.arange(len(order)) - (np.cumsum(counts) - counts)[first], counts


def induce(buckets: _Buckets, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost smaller ones in order (at least by their first byte)."""
    data = buckets.data
    out = np.empty(len(data), np.int32)
    head = buckets.start.copy()
    last = len(data) - 1
    out[head[data[last]]] = last
    head[data[last]] += 1
    seed_at = np.searchsorted(data[seeds], np.arange(257))

    def put_larger(suffixes: np.ndarray) -> None:
        longer, first, nth, counts = buckets.before(suffixes, False)
        out[head[first] + nth] = longer
        np.add(head, counts, out=head)

    for c in buckets.present:
        at = buckets.start[c]
        while at < head[c]:
            fresh, at = out[at : head[c]], head[c]
            put_larger(fresh)
        if seed_at[c] < seed_at[c + 1]:
            put_larger(seeds[seed_at[c] : seed_at[c + 1]])
    tail = buckets.end.copy()

    def put_smaller(suffixes: np.ndarray) -> None:
        longer, first, nth, counts = buckets.before(suffixes, True)
        out[tail[first] - 1 - nth] = longer
        np.subtract(tail, counts, out=tail)

    for c in buckets.present[::-1]:
        at = buckets.end[c]
        while tail[c] < at:
            fresh, at = out[tail[c] : at][::-1], tail[c]
            put_smaller(fresh)
        if buckets.start[c] < buckets.middle[c]:
            put_smaller(out[buckets.start[c] : buckets.middle[c]][::-1])
    return out


def _equal(words: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the ``sizes`` bytes at ``a`` and at ``b`` are the same."""
    same = np.ones(len(a), bool)
    live, done = np.arange(len(a)), 0
    while len(live):
        left = np.minimum(sizes[live] - done, 8).astype(np.uint64)
        cut = np.uint64(64) - np.uint64(8) * left
        differ = ((words[a[live] + done] ^ words[b[live] + done]) << cut) != 0
        same[live[differ]] = False
        done += 8
        live = live[~differ & (sizes[live] > done)]
    return same


def suffix_array(data: np.ndarray, depth: int, room: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``data`` in the order of their first ``depth`` bytes; those equal so far come in any order.

    With ``room``, the bytes left of the piece at every position (the separator after it not counted), suffixes count
    as equal if they are so up to the ends of their pieces.

    Leftmost smaller substrings are sorted by a first induction and named.  While names repeat, the string of
    names is sorted in turn, by ranks of twice as many names in each round, until ``depth`` bytes are covered or
    no round tells more names apart.  A second induction places all suffixes.
    """
    if not len(data):
        return np.zeros(0, np.int32)
    smaller = suffix_types(data)
    buckets = _Buckets(data, smaller)
    left = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    if not len(left):
        return induce(buckets, left)
    leftmost = np.zeros(len(data), bool)
    leftmost[left] = True
    order = induce(buckets, left[np.argsort(data[left], kind="stable")])
    order = order[leftmost[order]]
    size = np.zeros(len(data), np.int32)
    size[left[:-1]] = np.diff(left) + 1
    size[left[-1]] = len(data) - left[-1]
    inside = None
    if room is not None:
        np.minimum(size, room + 1, out=size)
        inside = np.cumsum(room == 0)[left]
    a, b = order[:-1], order[1:]
    same = (size[a] == size[b]) & (a != left[-1]) & (b != left[-1])
    among = np.flatnonzero(same)
    same[among] = _equal(words_at(data), a[among], b[among], size[a[among]])
    names = np.concatenate([[1], 1 + np.cumsum(~same)])
    rank = np.empty(len(data), np.int64)
    rank[order] = names
    rank = rank[left]
    kinds, covered = int(names[-1]), 1
    while kinds < len(left) and covered < depth:
        after = np.zeros(len(left), np.int64)
        if covered < len(left):
            after[:-covered] = rank[covered:] if inside is None else np.where(inside[covered:] == inside[:-covered], rank[covered:], 0)
        key = rank * (len(left) + 1) + after
        order = np.argsort(key)
        step = np.empty(len(left), np.int64)
        step[0] = 1
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(left), np.int64)
        rank[order] = np.cumsum(step)
        more = int(step.sum())
        if more == kinds:
            break
        kinds, covered = more, covered * 2
    return induce(buckets, left[np.argsort(rank)])


def common_prefixes(data: np.ndarray, order: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every suffix its predecessor in ``order`` (-1: none) and their common prefix, by position in ``data``.

    No prefix is longer than ``room`` at either suffix.  If a suffix and its predecessor both follow, by one equal byte, a suffix and its
    predecessor, they have one byte less in common than those; only the others are compared.
    """
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    follows = np.zeros(len(data), bool)
    follows[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (room[1:] < room[:-1])
    follows[1:] &= (room[before[1:]] < room[before[:-1]]) & (data[:-1] == data[before[:-1]])
    start = np.flatnonzero(~follows)
    length = np.zeros(len(start), np.int64)
    words = words_at(data)
    most = np.where(before[start] >= 0, np.minimum(room[start], room[before[start]]), 0)
    live, done = np.flatnonzero(most > 0), 0
    while len(live):
        i, j = start[live] + done, before[start[live]] + done
        differ = words[i] ^ words[j]
        lowest = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 8)
        length[live] += equal
        done += 8
        live = live[(equal == 8) & (most[live] > done)]
    length = np.minimum(length, most)
    nearest = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(data))))
    return before, np.maximum(length[nearest] - (np.arange(len(data)) - start[nearest]), 0)


def repeated_starts(pieces: list[bytes], times: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece, whether the ``length`` bytes from each position on occur anywhere else in the pieces.

    A piece that stands for several equal ones (``times``) is repeated as a whole.
    """
    end = bytes([SEPARATOR])
    data = np.frombuffer(end.join(pieces) + end, np.uint8)
    sizes = np.array([len(p) for p in pieces]) + 1
    ends = np.cumsum(sizes)
    room = (np.repeat(ends, sizes) - 1 - np.arange(len(data))).astype(np.int32)
    order = suffix_array(data, length, room)
    before, common = common_prefixes(data, order, room)
    hit = common >= length
    repeated = hit.copy()
    repeated[before[hit]] = True
    repeated |= np.repeat(np.asarray(times) > 1, sizes)
    return [repeated[e - s : e - s + max(0, s - length)] for s, e in zip(sizes, ends, strict=True)]
