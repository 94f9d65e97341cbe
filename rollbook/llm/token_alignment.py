"""Alignment of two tokenizers by lockstep merging.

The token ends of a text under tokenizer A and under tokenizer B are two ascending lists of byte offsets.  Merging them
visits every pair of tokens whose bytes overlap once, and finds the offsets at which both end.  All documents of a batch
are merged at once: one state vector holds a pointer into A and one into B for each, every step emits the links and cuts of
all of them and advances the pointers whose token ends first, and finished documents are compacted away.

A chunk of documents is the unit of work between tasks: its id pairs are counted once for the chunk, so that the counts of
the whole corpus travel as one row a chunk and pair and not as one a document and pair.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import shared_folder, text_blocks

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Tokens of A after which a document goes on in another place of the state vector, so that a long one takes no more steps.
LANE = 64
#: Bytes of different words that are encoded in one call.
RUN_BYTES = 4096


class Vocabulary:
    """Encoder of texts that begin with a space, and the bytes of every token."""

    def __init__(self, table: list[bytes]):
        self.sizes = np.array([len(t) for t in table], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.flat = np.frombuffer(b"".join(table) or b"\0", np.uint8)
        self.size = len(table)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[_ragged(self.starts[ids], self.sizes[ids])]


class ByteLevel(Vocabulary):
    """A byte-level tokenizer file; the names of special tokens are ordinary text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in seen} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in seen)}
        vocabulary = self.model.get_vocab()
        table = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            table[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        super().__init__(table)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces(Vocabulary):
    """A sentencepiece model, which puts the space in front itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.space = [self.model.piece_to_id("▁")]
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        raw = [self.model.is_byte(i) for i in range(len(names))]
        super().__init__([bytes([int(n[3:5], 16)]) if is_byte else n.replace("▁", " ").encode() for n, is_byte in zip(names, raw, strict=True)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        # The model puts nothing in front of an empty text.
        return [ids if t != " " else self.space for t, ids in zip(texts, self.model.encode([t[1:] for t in texts], num_threads=1), strict=True)]


@lru_cache(maxsize=4)
def _loaded(kind: type, path: str) -> Vocabulary:
    return kind(path)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of runs of ``sizes`` that begin at ``starts``, one run after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words of the texts with the space before each, the words of every text, and their counts.

    Both tokenizers end a token wherever a space follows a character that is no white space, so the tokens of a text are
    those of its words.  After white space a word goes on.
    """
    parts = pc.split_pattern(texts, " ")
    counts = np.diff(parts.offsets.to_numpy())
    coded = parts.flatten().dictionary_encode()
    words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = [" " + w for w in words]
    open_ended = np.array([w[-1].isspace() for w in words], bool)
    if open_ended.any():
        text = np.repeat(np.arange(len(counts)), counts)
        glued = np.zeros(len(which), bool)
        glued[1:] = open_ended[which[:-1]] & (text[1:] == text[:-1])
        begin = np.flatnonzero(~glued)
        sizes = np.diff(np.append(begin, len(which)))
        whole, place = which[begin], {w: i for i, w in enumerate(words)}
        for k in np.flatnonzero(sizes > 1):
            word = "".join(words[i] for i in which[begin[k] : begin[k] + sizes[k]])
            whole[k] = place.setdefault(word, len(place))
        words, which, counts = list(place), whole, np.bincount(text[begin], minlength=len(counts))
    return words, which, counts


def _encoded(vocabulary: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all words, one word after the other, how many each has, and whether their bytes are the word's."""
    raw = [w.encode() for w in words]
    sizes = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(sizes)
    open_ended = np.flatnonzero([w[-1].isspace() for w in words]) + 1  # nothing may follow such a word
    cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(ends // RUN_BYTES, prepend=0)), open_ended, [len(words)]]).astype(np.int64))
    runs = ["".join(words[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    counts, good, tokens = np.zeros(len(words), np.int64), np.ones(len(words), bool), []
    for a, b, ids in zip(cuts[:-1], cuts[1:], vocabulary.encode(runs), strict=True):
        ids = np.array(ids, np.int64)
        token_ends, word_ends = np.cumsum(vocabulary.sizes[ids]), np.cumsum(sizes[a:b])
        last = np.searchsorted(token_ends, word_ends, "right")
        if (last > 0).all() and (token_ends[last - 1] == word_ends).all() and vocabulary.bytes_of(ids).tobytes() == b"".join(raw[a:b]):
            counts[a:b] = np.diff(last, prepend=0)
            tokens.append(ids)
            continue
        for k, ids in zip(range(a, b), vocabulary.encode(words[a:b]), strict=True):  # a word that is not given back byte by byte is in the run
            good[k] = vocabulary.bytes_of(np.array(ids, np.int64)).tobytes() == raw[k]
            counts[k] = len(ids)
            tokens.append(np.array(ids, np.int64))
    return np.concatenate(tokens) if tokens else np.zeros(0, np.int64), counts, good


@dataclass
class Alignment:
    """Tokens, links and cuts of a batch of texts; ``a_text``, ``b_text`` say whose tokens they are, ascending."""

    a: np.ndarray
    b: np.ndarray
    a_text: np.ndarray
    b_text: np.ndarray
    a_end: np.ndarray  # byte offsets in the texts laid end to end, each after a space
    b_end: np.ndarray
    links: tuple[np.ndarray, np.ndarray]  # positions in a and in b
    cuts: tuple[np.ndarray, np.ndarray]  # positions of the tokens that end together


def align_texts(texts: pa.Array, a: Vocabulary, b: Vocabulary) -> Alignment:
    """Align a batch of texts; a text that is null, empty or not given back byte by byte by both has no tokens."""
    asked = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(asked)
    words, which, counts = _words(texts.take(pa.array(rows)))
    sides, owner = [], np.repeat(rows, counts)
    encoded = [_encoded(v, words) for v in (a, b)]
    bad = ~(encoded[0][2] & encoded[1][2])
    spoilt = np.zeros(len(texts), bool)
    spoilt[owner[bad[which]]] = True
    kept = ~spoilt[owner]
    which, owner = which[kept], owner[kept]
    for vocabulary, (tokens, many, _) in zip((a, b), encoded, strict=True):
        start = np.cumsum(many) - many
        ids = tokens[_ragged(start[which], many[which])]
        sides.append((ids, np.repeat(owner, many[which]), np.cumsum(vocabulary.sizes[ids])))
    (a_ids, a_text, a_end), (b_ids, b_text, b_end) = sides
    return Alignment(a_ids, b_ids, a_text, b_text, a_end, b_end, *_lockstep(a_text, a_end, b_end))


def _lockstep(a_text: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Merge the token ends of all texts at once: links and cuts as positions in A and B, in order of A.

    A text enters the state vector once for every ``LANE`` tokens of A.  Wherever a token of A ends, the merge has the
    first later token of A and the first token of B that ends later, so it can be entered there.
    """
    if not len(a_text):
        none = np.zeros(0, np.int64)
        return (none, none), (none, none)
    begin = np.flatnonzero(np.diff(a_text, prepend=-1))
    nth = np.arange(len(a_text)) - np.repeat(begin, np.diff(np.append(begin, len(a_text))))
    i = np.flatnonzero(nth % LANE == 0)
    stop = np.append(i[1:], len(a_text))
    j = np.searchsorted(b_end, np.where(i > 0, a_end[i - 1], 0), "right")
    links, cuts = [], []
    while len(i):
        links.append((i, j))
        x, y = a_end[i], b_end[j]
        both = x == y
        cuts.append((i[both], j[both]))
        i, j = i + (x <= y), j + (y <= x)
        going = i < stop
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    out = []
    for found in (links, cuts):
        left, right = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        order = np.argsort(left * np.int64(len(b_end) + 1) + right)
        out.append((left[order], right[order]))
    return out[0], out[1]


def _decimals(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of all numbers below ``count``, left-aligned with one place free, and how many they are."""
    digits = [str(n).encode() for n in range(count)]
    width = max(map(len, digits)) + 1
    return np.frombuffer(b"".join(d.ljust(width) for d in digits), np.uint8).reshape(count, width), np.array([len(d) for d in digits])


def group_texts(found: Alignment, rows: int, digits: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """For each text its groups as ``a1,a2|b1;a3|b2,b3``."""
    figures, lengths = digits
    group_a = np.searchsorted(found.cuts[0], np.arange(len(found.a)), "left")
    group_b = np.searchsorted(found.cuts[1], np.arange(len(found.b)), "left")
    ids, text = np.concatenate([found.a, found.b]), np.concatenate([found.a_text, found.b_text])
    group, side = np.concatenate([group_a, group_b]), np.repeat([0, 1], [len(found.a), len(found.b)])
    order = np.argsort(group * 2 + side, kind="stable")
    ids, text, group, side = ids[order], text[order], group[order], side[order]
    mark = np.full(len(ids), ord(","), np.uint8)
    last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True) if len(ids) else np.zeros(0, bool)
    mark[last & (side == 0)] = ord("|")
    mark[last & (side == 1)] = ord(";")
    cells, sizes = figures[ids], lengths[ids]
    cells[np.arange(len(ids)), sizes] = mark
    flat = cells[np.arange(cells.shape[1]) <= sizes[:, None]].tobytes()
    ends = np.cumsum(np.bincount(text, sizes + 1, rows).astype(np.int64))
    return [flat[a : max(a, b - 1)] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def alignments(documents: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """``doc_id`` with ``a_ids, a_ends, b_ids, b_ends`` (byte ends in the text with a space before it), ``links`` (pairs of
    positions of tokens whose bytes overlap) and ``cuts`` (positions of the tokens that end together) of every document.

    Null and empty texts, and such that a tokenizer does not give back byte by byte, have empty lists.  Repeated rows are
    rows of their own; a null ``doc_id`` stays null; other columns are not read.  A text is worked on whole, in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _loaded(ByteLevel, a_file), _loaded(Pieces, b_file)
        for batch in batches:
            for rows, _, _ in text_blocks(batch, "text"):
                found = align_texts(rows.column("text"), a, b)
                n = rows.num_rows
                firsts = []
                for text in (found.a_text, found.b_text):
                    firsts.append(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]))
                size = np.bincount(found.a_text, a.sizes[found.a], n).astype(np.int64)
                before = np.cumsum(size) - size
                pairs = []
                for left, right in (found.links, found.cuts):
                    owner = found.a_text[left]
                    cells = pa.StructArray.from_arrays([pa.array((left - firsts[0][owner]).astype(np.int32)), pa.array((right - firsts[1][owner]).astype(np.int32))], names=["a", "b"])
                    pairs.append(_lists(owner, cells, n))
                yield pa.record_batch(
                    [
                        rows.column("doc_id"),
                        _lists(found.a_text, pa.array(found.a.astype(np.int32)), n), _lists(found.a_text, pa.array(found.a_end - before[found.a_text]), n),
                        _lists(found.b_text, pa.array(found.b.astype(np.int32)), n), _lists(found.b_text, pa.array(found.b_end - before[found.b_text]), n),
                        *pairs,
                    ],
                    names=["doc_id", "a_ids", "a_ends", "b_ids", "b_ends", "links", "cuts"],
                )

    kinds = "doc_id long, a_ids array<int>, a_ends array<long>, b_ids array<int>, b_ends array<long>, links array<struct<a:int,b:int>>, cuts array<struct<a:int,b:int>>"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kinds)


def _lists(owner: np.ndarray, values: pa.Array, rows: int) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


_REPORT = "n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string"


def alignment_report(documents: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``documents``.

    A pair of ids counts once for every row in which a token of the one overlaps a token of the other.  ``count_sum`` adds
    the counts of all links, ``n_best`` are the links whose count is the highest that their id of A has with any id of B.
    Rows without tokens (see ``alignments``) have zeros and no digest; repeated rows count each.
    """
    aligned = _chunks(documents, a_file, b_file)
    pairs = aligned.select("chunk", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "p")).select("chunk", "at", "p.pairs", "p.held")
    counts = pairs.groupBy("pairs").agg(F.sum("held").alias("count"))
    best = counts.groupBy(F.shiftright("pairs", 32).alias("a")).agg(F.max("count").alias("most"))
    counts = _kept(counts.withColumn("a", F.shiftright("pairs", 32)).join(best, "a").select("pairs", "count", (F.col("count") == F.col("most")).alias("best")))
    told = pairs.select(F.col("chunk").alias("of"), "at", "pairs").join(counts, "pairs").select("of", "at", "count", "best")

    def summed(documents: pa.Table, told: pa.Table) -> pa.Table:
        order = np.argsort(told.column("at").to_numpy())
        count, best = (told.column(c).to_numpy()[order].astype(np.int64) for c in ("count", "best"))
        row = documents.to_pylist()[0]
        docs, ends = row["docs"], np.cumsum(row["sizes"], dtype=np.int64)
        times = _unpacked(row["times"]).astype(np.int64)
        place = np.cumsum(_unpacked(row["places"]).astype(np.int64)) % max(1, len(count))
        sums = []
        for figure in (best, count):
            total = np.concatenate([[0], np.cumsum(times * figure[place] if len(place) else times)])
            sums.append(np.diff(total[np.concatenate([[0], ends])]))
        names = [f.split(":")[0] for f in _REPORT.split(",")]
        columns = {"doc_id": pa.array(row["ids"], pa.int64())} | {n: pa.array([d[n] for d in docs], pa.string() if n.endswith("256") else pa.int64()) for n in names}
        return pa.table(columns | {"n_best": pa.array(sums[0], pa.int64()), "count_sum": pa.array(sums[1], pa.int64())})

    schema = f"doc_id long, {_REPORT.replace(':', ' ').replace(',', ', ')}, n_best long, count_sum long"
    out = aligned.select("chunk", "ids", "docs", "sizes", "places", "times").groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(summed, schema)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _packed(values: np.ndarray) -> bytes:
    """Numbers of four bytes, the first bytes of all of them first, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, compressed more than usual."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _chunks(documents: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Align all documents, a row for each chunk: its documents, their id pairs as places in the chunk's ``pairs`` and how
    often each has them, and how many documents of the chunk have a pair (``held``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _loaded(ByteLevel, a_file), _loaded(Pieces, b_file)
        digits = _decimals(max(a.size, b.size))
        nth = 0
        for batch in batches:
            for rows, _, _ in text_blocks(batch, "text", CHUNK_BYTES):
                number = (TaskContext.get().partitionId() << 32) + nth
                nth += 1
                yield _chunk(number, rows, align_texts(rows.column("text"), a, b), digits)

    kinds = f"chunk long, ids array<long>, docs array<struct<{_REPORT}>>, sizes array<long>, pairs array<long>, held array<int>, places binary, times binary"
    return _kept(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kinds))


def _chunk(number: int, rows: pa.RecordBatch, found: Alignment, digits: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    n = rows.num_rows
    left, right = found.links
    text, pair = found.a_text[left], (found.a[left] << 32) + found.b[right]
    pairs, place = np.unique(pair, return_inverse=True)
    cells, times = np.unique(text * max(1, len(pairs)) + place, return_counts=True)
    owner, place = np.divmod(cells, max(1, len(pairs)))
    counted = [np.bincount(t, minlength=n) for t in (found.a_text, found.b_text, found.a_text[found.cuts[0]], text)]
    digests = [hashlib.sha256(g).hexdigest() if g else "" for g in group_texts(found, n, digits)]
    # Steps from one place to the next, around the list of pairs: mostly small.
    steps = np.diff(cells, prepend=0) % max(1, len(pairs))
    docs = [dict(zip([f.split(":")[0] for f in _REPORT.split(",")], (*(int(c[k]) for c in counted), digests[k]), strict=True)) for k in range(n)]
    kind = pa.struct([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
    return pa.record_batch(
        [
            pa.array([number], pa.int64()),
            pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
            pa.array([docs], pa.list_(kind)),
            pa.array([np.bincount(owner, minlength=n)], pa.list_(pa.int64())),
            pa.array([pairs], pa.list_(pa.int64())),
            pa.array([np.bincount(place, minlength=len(pairs)).astype(np.int32)], pa.list_(pa.int32())),
            pa.array([_packed(steps)], pa.binary()),
            pa.array([_packed(times)], pa.binary()),
        ],
        names=["chunk", "ids", "docs", "sizes", "pairs", "held", "places", "times"],
    )
