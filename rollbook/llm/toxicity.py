"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

A word is the bag of its hashed grams of 3 to 8 bytes (with marks for its ends) and of itself, so an unseen
misspelling shares most vectors with the word it stands for.  The vectors of a window of words are averaged
and go into a linear softmax; embeddings and softmax are trained together in numpy on a bounded sample.  A
document is as toxic as its worst window, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import packed, text_blocks, unpacked, utf8
from rollbook.llm.tokens import ALPHANUMERIC, joined, word_bounds, xxh64

#: Words whose vectors are averaged together.
WINDOW = 6

_BITS = 17
_GRAMS = (3, 4, 5, 6, 8)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

@dataclass(frozen=True)
class Model:
    """What a window needs of a trained model: a number for each hashed gram, and the calibration of a document.

    The average of vectors followed by a linear layer is the average of one number for each gram.
    """

    grams: np.ndarray
    bias: float
    slope: float
    offset: float


class Bag:
    """Hashed grams of the words of a block of texts (lower-cased UTF-8)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        data = ALPHANUMERIC[data]
        starts, ends, self.first = word_bounds(data, offsets)
        flat, starts, ends = joined(data, starts, ends)
        self.words = len(starts)
        self.whole = (xxh64(flat, starts, ends) >> np.uint64(64 - _BITS)).astype(np.int32)
        # One mark before every word: the space after the word before it, or one put in front.
        flat = np.concatenate([[np.uint8(0x20)], flat, np.zeros(8, np.uint8)])
        self.begins = starts
        self.positions = len(flat) - 9
        self.eight = np.ndarray((self.positions,), "<u8", flat.data, 0, (1,)).copy()
        marked = ends - starts + 2
        self.room = np.repeat(ends + 2, marked - 1) - np.arange(self.positions)  # bytes up to the mark after the word
        self.many = 1 + sum(np.maximum(marked - n + 1, 0) for n in _GRAMS)

    def hashed(self, n: int) -> np.ndarray:
        """Bucket of the gram of ``n`` bytes at every position."""
        mixed = self.eight & np.uint64((1 << 8 * n) - 1)
        mixed += np.uint64(n)
        mixed *= _MULTIPLIER
        mixed >>= np.uint64(64 - _BITS)
        return mixed.view(np.int64)

    def sums(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word, the sum of the values of its grams, and how many there are."""
        if not self.words:
            return np.zeros(0), np.zeros(0)
        total = np.zeros(self.positions, np.float32)
        for n in _GRAMS:
            found = values[self.hashed(n)]
            found *= self.room >= n
            total += found
        return np.add.reduceat(total, self.begins) + values[self.whole], self.many

    def windows(self, values: np.ndarray, bias: float) -> np.ndarray:
        """The highest logit of any window of each text; the bias where there is no word."""
        total, many = (np.concatenate([[0], np.cumsum(x, dtype=np.float64)]) for x in self.sums(values))
        out = np.full(len(self.first) - 1, bias)
        full = np.flatnonzero(np.diff(self.first) > 0)
        if len(full):
            row_end = np.repeat(self.first[1:], np.diff(self.first))
            begin = np.arange(self.words)
            begin = np.minimum(begin, np.maximum(row_end - WINDOW, np.repeat(self.first[:-1], np.diff(self.first))))
            end = np.minimum(begin + WINDOW, row_end)
            logits = (total[end] - total[begin]) / (many[end] - many[begin]) + bias
            out[full] = np.maximum.reduceat(logits, self.first[:-1][full])
        return out

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of every word's grams, word by word, and where each word's begin (one more entry than words)."""
        spread = np.repeat(np.arange(self.words), np.diff(np.append(self.begins, self.positions)))
        parts = [(self.hashed(n), self.room >= n) for n in _GRAMS]
        word = np.concatenate([*[spread[valid] for _, valid in parts], np.arange(self.words)])
        value = np.concatenate([*[hashed[valid] for hashed, valid in parts], self.whole]).astype(np.int32)
        order = np.argsort(word, kind="stable")
        return value[order], np.searchsorted(word[order], np.arange(self.words + 1))


class Sample:
    """Labelled texts as numbers of words, with the grams of each different word once."""

    RUN = 32768

    def __init__(self, texts: pa.Array) -> None:
        hashes, firsts, seen = [], [np.zeros(1, np.int64)], [np.zeros(0, np.uint8)]
        for low in range(0, len(texts), 256):
            data, offsets = utf8(texts.slice(low, 256))
            data = ALPHANUMERIC[data]
            starts, ends, first = word_bounds(data, offsets)
            mine = xxh64(data, starts, ends)
            fresh = np.sort(np.unique(mine, return_index=True)[1])
            hashes.append(mine)
            firsts.append(first[1:] + firsts[-1][-1])
            seen.append(joined(data, starts[fresh], ends[fresh])[0])
        data = np.concatenate(seen)
        starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
        fresh = np.sort(np.unique(xxh64(data, starts, ends), return_index=True)[1])
        data, starts, ends = joined(data, starts[fresh], ends[fresh])
        # The grams are kept in runs of words, so that no step needs more than a run at once.
        self.runs, self.many = [], np.zeros(len(starts), np.int64)
        for low in range(0, len(starts), self.RUN):
            high = min(low + self.RUN, len(starts))
            piece = data[starts[low] : ends[high - 1]]
            bag = Bag(piece, np.array([0, len(piece)]))
            self.runs.append((low, high, *bag.grams()))
            self.many[low:high] = bag.many
        names = xxh64(data, starts, ends)
        order = np.argsort(names)
        self.tokens = order[np.searchsorted(names[order], np.concatenate([np.zeros(0, np.uint64), *hashes]))] if len(names) else np.zeros(0, np.int64)
        self.first = np.concatenate(firsts)

    def word_sums(self, grams: np.ndarray) -> np.ndarray:
        """For each different word the sum of its grams' values."""
        out = np.zeros(len(self.many))
        for low, high, values, at in self.runs:
            out[low:high] = np.add.reduceat(grams[values], at[:-1])
        return out

    def gram_sums(self, words: np.ndarray) -> np.ndarray:
        """For each gram the sum of the values of the words that it is in."""
        out = np.zeros(1 << _BITS)
        for low, high, values, at in self.runs:
            out += np.bincount(values, np.repeat(words[low:high], np.diff(at)), minlength=1 << _BITS)
        return out

    def windows(self, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end (in words) and text of windows that begin at every ``step``-th word of a text."""
        counts = np.diff(self.first)
        row = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(self.tokens)) - self.first[:-1][row]
        begin = np.flatnonzero((place % step == 0) & ((place == 0) | (place + WINDOW - step < counts[row])))
        return begin, np.minimum(begin + WINDOW, self.first[1:][row[begin]]), row[begin]


def train(texts: pa.Array, labels: np.ndarray, prior: float, seed: int = 5, dim: int = 8, steps: int = 160) -> Model:
    """Fit a model on lower-cased texts with labels 0 and 1; ``prior`` is the share of label 1 at large.

    Only documents are labelled.  A document's logit is the average of its windows' logits, weighted by a softmax
    that sharpens from plain averaging to the worst window while training goes on; the loss weighs both classes
    alike.  Vectors and softmax are moved together in every step.  A fifth of the documents is kept back: they
    choose the best step, and the calibration from worst window to document is fitted on them.
    """
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(1 << _BITS, np.float32), 0.0, 0.0, -30.0 if not len(labels) or labels.max() == 0 else 30.0)
    random = np.random.default_rng(seed)
    sample = Sample(texts)
    begin, end, row = sample.windows(WINDOW // 2)
    counts = np.concatenate([[0], np.cumsum(sample.many[sample.tokens])])
    sizes = (counts[end] - counts[begin]).astype(np.float64)
    bounds = np.flatnonzero(np.diff(row, prepend=-1))
    known = row[bounds]  # the texts that have a window
    nth = np.repeat(np.arange(len(known)), np.diff(np.append(bounds, len(row))))
    truth = labels[known].astype(np.float64)
    apart = random.random(len(known)) < 0.2
    weight = np.where(truth > 0, 0.5 / max(1, (truth[~apart] > 0).sum()), 0.5 / max(1, (truth[~apart] == 0).sum())) * ~apart
    vectors = random.normal(0, 0.3, (1 << _BITS, dim))
    weights = random.normal(0, 0.3, dim)
    bias, best, kept = 0.0, -1.0, None
    moved, scale = np.zeros(1 << _BITS), np.full(1 << _BITS, 1e-12)
    for step in range(steps):
        grams = vectors @ weights
        total = np.concatenate([[0], np.cumsum(sample.word_sums(grams)[sample.tokens])])
        logit = (total[end] - total[begin]) / sizes + bias
        worst = np.maximum.reduceat(logit, bounds)
        if step % 8 == 7:
            rank = _auc(worst[apart], truth[apart])
            if rank > best:
                best, kept = rank, (grams.astype(np.float32), bias, worst)
        sharp = 4.0 * min(1.0, step / (0.5 * steps))
        share = np.exp(sharp * (logit - worst[nth]))
        share /= np.add.reduceat(share, bounds)[nth]
        mean = np.add.reduceat(share * logit, bounds)
        slip = (1 / (1 + np.exp(-np.clip(mean, -30, 30))) - truth) * weight
        push = slip[nth] * share / sizes
        edge = np.bincount(begin, push, minlength=len(sample.tokens) + 1) - np.bincount(end, push, minlength=len(sample.tokens) + 1)
        each = np.bincount(sample.tokens, np.cumsum(edge)[:-1], minlength=len(sample.many))
        change = sample.gram_sums(each)
        moved = 0.8 * moved + 0.2 * change
        scale = np.maximum(0.95 * scale, change * change)
        pull = change @ vectors
        vectors -= 0.15 * (moved / (np.sqrt(scale) + 1e-7))[:, None] * (weights / (np.abs(weights).max() + 1e-9))[None, :]
        vectors *= 0.995
        weights -= 0.3 * pull
        bias -= 0.5 * slip.sum()
    grams, bias, worst = kept
    balance = truth[apart].mean() if apart.any() else 0.5
    at_large = np.where(truth[apart] > 0, prior / max(balance, 1e-9), (1 - prior) / max(1 - balance, 1e-9))
    slope, offset = _calibrated(worst[apart], truth[apart], at_large)
    return Model(grams, bias, slope, offset)


def _auc(x: np.ndarray, truth: np.ndarray) -> float:
    """Share of pairs of the two classes that are in order; a half where a class is missing."""
    ones = truth.sum()
    if not 0 < ones < len(truth):
        return 0.5
    rank = np.empty(len(x))
    rank[np.argsort(x, kind="stable")] = np.arange(len(x))
    return float((rank[truth > 0].sum() - ones * (ones - 1) / 2) / (ones * (len(x) - ones)))


def _calibrated(x: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one number, by Newton steps with a little shrinkage."""
    if not len(x):
        return 1.0, 0.0
    centre, scale = x.mean(), x.std() + 1e-9
    z = np.stack([(x - centre) / scale, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (weight * (truth - chance)) - 0.01 * beta
        bend = (z * (weight * chance * (1 - chance))[:, None]).T @ z + 0.01 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return float(max(beta[0], 0.0) / scale), float(beta[1] - max(beta[0], 0.0) * centre / scale)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Documents whose labels are never learned from: CRC-32 of the id as text is a multiple of 5 (a null id is empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = 1500) -> Model:
    """Train on at most ``rows`` labelled documents of each class, the first in order of a hash of their ids.

    Only labels of documents that are not held out are used.  Labels that are null, other than 0 or 1, or without a
    document are left out; of contradicting labels of a document the larger counts.  Without both classes the
    scores are all 0 (or all 1).
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    first = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    chosen = F.broadcast(first[0].unionAll(first[1]))  # at most 2 * rows narrow rows
    sample = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")).join(chosen, "doc_id")
    table = sample.select("doc_id", "text", "toxic").toArrow().combine_chunks()
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
    return train(texts, table.column("toxic").to_numpy(), float(share))


def _chances(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    worst = Bag(data, offsets).windows(model.grams, model.bias)
    return 1 / (1 + np.exp(-np.clip(model.slope * worst + model.offset, -500, 500)))


def _lowered() -> F.Column:
    return F.lower(F.coalesce("text", F.lit(""))).alias("low")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of every row; an empty or null text has the score of no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "low"):
                chance = _chances(data, offsets, model)
                marks = pa.array((chance >= 0.5).astype(np.int32))
                yield pa.record_batch([rows.column(0), pa.array(chance), marks], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _lowered()).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    return score(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that a model trained on their labels predicts to be toxic."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "low"):
                clean = pa.array(_chances(data, offsets, model) < 0.5)
                yield pa.record_batch([rows.column("row").filter(clean)], names=["row"])

    rows = packed(docs, _lowered())
    return unpacked(rows.mapInArrow(run, rows.select("row").schema), docs)
