"""Words of whole blocks of UTF-8 text as numpy arrays: boundaries, hashes and shingles."""

from __future__ import annotations

import numpy as np
import xxhash

#: The white space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: ASCII letters A-Z to lower case, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ASCII letters and digits and all bytes of longer characters as they are, every other byte a space.
ALPHANUMERIC = np.arange(256, dtype=np.uint8)
ALPHANUMERIC[[c for c in range(128) if not chr(c).isalnum()]] = 0x20

#: Fixed values of the XXH64 hash.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the index of its first word (one more entry than rows)."""
    space = SPACES[data]
    inner = ~space
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    before |= edge[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    after |= edge[1:]
    starts = np.flatnonzero(inner & before)
    ends = np.flatnonzero(inner & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each, and their new starts and ends."""
    lengths = ends - starts
    new_ends = np.cumsum(lengths + 1) - 1
    new_starts = new_ends - lengths
    out = np.full(int(new_ends[-1]) + 1 if len(starts) else 0, 0x20, np.uint8)
    if len(starts):
        keep = np.ones(len(out), bool)
        keep[new_ends] = False
        marks = np.zeros(len(data) + 1, np.int8)
        marks[starts] += 1
        marks[ends] -= 1
        out[keep] = data[np.cumsum(marks[:-1], dtype=np.int8).astype(bool)]
    return out, new_starts, new_ends


def _rotl(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of ``data``: short slices in step, those of 32 bytes or more one by one."""
    lengths = (ends - starts).astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded.data, 0, (1,))
    halves = np.ndarray((len(padded) - 3,), "<u4", padded.data, 0, (1,))
    out = np.uint64(seed) + _P5 + lengths.astype(np.uint64)
    short = lengths < 32
    for step in range(3):
        at = np.flatnonzero(short & (lengths >= 8 * step + 8))
        if len(at):
            k = _rotl(words[starts[at] + 8 * step] * _P2, 31) * _P1
            out[at] = _rotl(out[at] ^ k, 27) * _P1 + _P4
    at = np.flatnonzero(short & (lengths & 4 > 0))
    if len(at):
        k = halves[starts[at] + (lengths[at] & ~7)].astype(np.uint64)
        out[at] = _rotl(out[at] ^ (k * _P1), 23) * _P2 + _P3
    for step in range(3):
        at = np.flatnonzero(short & (lengths & 3 > step))
        if len(at):
            k = data[starts[at] + (lengths[at] & ~3) + step].astype(np.uint64)
            out[at] = _rotl(out[at] ^ (k * _P5), 11) * _P1
    out ^= out >> np.uint64(33)
    out *= _P2
    out ^= out >> np.uint64(29)
    out *= _P3
    out ^= out >> np.uint64(32)
    raw = data.tobytes() if not short.all() else b""
    for i in np.flatnonzero(~short):
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]], seed)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finaliser of two multiplications)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingles(data: np.ndarray, offsets: np.ndarray, width: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of ``width`` words, row by row, and the bounds of the rows in it.

    A row with fewer words has one shingle, its whole sequence; a row without words has none.
    """
    starts, ends, first = word_bounds(data, offsets)
    flat, starts, ends = joined(data, starts, ends)
    counts = np.diff(first)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(len(counts)), made)
    begin = first[:-1][row] + np.arange(bounds[-1]) - bounds[:-1][row]
    final = np.minimum(begin + width, first[1:][row]) - 1
    return xxh64(flat, starts[begin], ends[final], seed), bounds


def bit_majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row the 64-bit number whose bits are set in over half of the row's hashes; zero for a row without any."""
    counts = np.diff(bounds)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, bounds[:-1][full], axis=0, dtype=np.int32)
        packed = np.packbits(sums * 2 > counts[full][:, None], axis=1)
        out[full] = packed.reshape(-1).view(">u8").astype(np.uint64)
    return out
