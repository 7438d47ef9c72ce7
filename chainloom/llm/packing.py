"""Packing: token streams cut into sequences by an order-preserving dynamic program.

Documents follow each other as they are read (or by ``order_by``); each task packs the
documents of its own partition. Windows of at most ``size`` tokens end at cut points: ends of
documents (free), ends of sentences (``SENTENCE``), and, where there is no such end for ``GAP``
tokens and near the end of the stream, plain token borders (``TOKEN``). With ``p`` a cut
point and ``f(p)`` the least padding plus penalties of all tokens before it,

    f(p) = penalty(p) + min( min over q in [p - size, p) of f(q) + size - (p - q),
                             min over powers of two b, p - b a cut point, of f(p - b) ).

The first inner minimum is one of f(q) + q over a sliding window, kept in a monotone queue, so
each cut point costs constant time; the second holds since a sequence whose length is a power of two
isn't padded. Every sequence costs ``SEQUENCE`` besides.

A task works on a stream of unbounded length: after each ``BLOCK`` tokens the cuts that all
paths to the last ``size`` tokens share are final and are given out, and the rest stays for the
next block. Where no cut is shared in ``MOST`` blocks, the best path is taken. Tokens of one
document don't leave its task, and nothing is shuffled unless an order is asked for.

Defined results: a null text is an empty one, whose only token is the end id; a null id comes back
null; repeated rows are documents of their own; an empty table gives an empty one; other columns are
ignored and may have any names. Sequence ids are unique: the task's number in the bits from
33 up, a count below; they depend on how the input is split.
"""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import text_or_empty
from chainloom.llm.token_store import encoder

SENTENCE, TOKEN, SEQUENCE = 8.0, 64.0, 1.0  # penalties, in tokens of padding
GAP, TAIL_STEP, LEAST_POWER = 256, 64, 256
BLOCK, MOST = 1 << 19, 8
SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


class SentenceEnds:
    """Which ids end a sentence: those that end in a stop (with closing signs in the same token) if white space
    follows; those that end in an ideographic stop or a line end always do."""

    STOPS, WIDE, CLOSING = ".!?", "。！？", "\"')]’”"

    def __init__(self, tokenizer_file: str):
        from tokenizers import decoders

        library = encoder(tokenizer_file).library
        plain = decoders.ByteLevel()
        vocabulary = library.get_vocab()
        n = max(vocabulary.values()) + 1
        self.stops, self.always, self.opens = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        for token, i in vocabulary.items():
            text = plain.decode([token])
            bare = text.rstrip(self.CLOSING) or text
            self.stops[i] = bare[-1:] in self.STOPS and bare != ""
            self.always[i] = bare[-1:] != "" and (bare[-1:] in self.WIDE or bare[-1:] == "\n")
            self.opens[i] = text[:1].isspace()

    def after(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of tokens before each sentence end within a stream; its own end isn't one."""
        ends = self.always[ids[:-1]] | (self.stops[ids[:-1]] & self.opens[ids[1:]])
        return np.flatnonzero(ends) + 1


_ends: dict[str, SentenceEnds] = {}


def sentence_ends(tokenizer_file: str) -> SentenceEnds:
    if tokenizer_file not in _ends:
        _ends[tokenizer_file] = SentenceEnds(tokenizer_file)
    return _ends[tokenizer_file]


def padding(length: int, size: int) -> int:
    return 0 if length & (length - 1) == 0 else size - length


def cut_points(doc_ends: np.ndarray, sentences: np.ndarray, size: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties) of a stream from 0 to ``doc_ends[-1]``, in ascending order, with 0 as the first."""
    total = int(doc_ends[-1])
    penalty = np.full(total + 1, np.inf)  # of no cut point
    penalty[sentences] = SENTENCE
    penalty[doc_ends] = penalty[0] = 0.0
    soft, gap = np.flatnonzero(penalty < np.inf), min(GAP, size)
    more = [np.arange(soft[k] + gap, soft[k + 1], gap) for k in np.flatnonzero(np.diff(soft) > gap).tolist()]
    if last:
        more.append(np.arange(total - min(TAIL_STEP, size), max(total - size, 0), -min(TAIL_STEP, size)))
    for hard in more:
        penalty[hard] = np.minimum(penalty[hard], TOKEN)
    places = np.flatnonzero(penalty < np.inf)
    return places, penalty[places]


def power_jumps(places: np.ndarray, size: int) -> list[list[int] | None]:
    """For each cut point those that lie a power of two of at least ``LEAST_POWER`` before it; the
    size itself has no padding anyway."""
    number = np.full(int(places[-1]) + 1, -1)
    number[places] = np.arange(len(places))
    jumps: list[list[int] | None] = [None] * len(places)
    b = LEAST_POWER
    while b < size:
        first = int(np.searchsorted(places, b))
        at = number[places[first:] - b]
        for i in np.flatnonzero(at >= 0).tolist():
            jumps[first + i] = [*(jumps[first + i] or ()), int(at[i])]
        b *= 2
    return jumps


def shortest_paths(places: np.ndarray, penalties: np.ndarray, size: int) -> tuple[list[float], list[int]]:
    """(f, parent) of every cut point; the first has no parent (0)."""
    n, place, penalty, jumps = len(places), places.tolist(), (penalties + SEQUENCE).tolist(), power_jumps(places, size)
    f, parent = [0.0] * n, [0] * n
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # f(q) + q, q, number; ascending in the first
    for i in range(1, n):
        p = place[i]
        while queue[0][1] < p - size:
            queue.popleft()
        best, _, at = queue[0]
        best += size - p
        if jumps[i]:
            for j in jumps[i]:
                if f[j] < best:
                    best, at = f[j], j
        f[i] = best = best + penalty[i]
        parent[i] = at
        best += p
        while queue and queue[-1][0] >= best:
            queue.pop()
        queue.append((best, p, i))
    return f, parent


def shared_cut(places: np.ndarray, parent: list[int], size: int) -> int:
    """The last cut point that the paths to all of the last ``size`` tokens have in common."""
    live = set(range(int(np.searchsorted(places, places[-1] - size)), len(places)))
    while len(live) > 1:
        i = max(live)
        live.remove(i)
        live.add(parent[i])
    return live.pop()


def path_to(i: int, parent: list[int]) -> list[int]:
    path = [i]
    while path[-1]:
        path.append(parent[path[-1]])
    return path[::-1]


class Packer:
    """The stream of one task. ``documents``: (id, tokens in all, tokens given out), of which the first may be under way."""

    def __init__(self, size: int, ends: SentenceEnds, first_sequence: int):
        self.size, self.ends, self.sequence = size, ends, first_sequence
        self.documents: list[tuple[int | None, int, int]] = []
        self.held: list[bytes] = []
        self.n, self.due = 0, BLOCK

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.documents.append((doc_id, len(ids) // 4, 0))
        self.held.append(ids)
        self.n += len(ids) // 4

    def given(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """The pieces that are final, if there is enough to decide on."""
        if not self.n or not (last or self.n >= self.due):
            return
        data = b"".join(self.held)
        doc_ends = np.cumsum([total - done for _, total, done in self.documents])
        places, penalties = cut_points(doc_ends, self.ends.after(np.frombuffer(data, "<u4")), self.size, last)
        f, parent = shortest_paths(places, penalties, self.size)
        until = len(places) - 1 if last else shared_cut(places, parent, self.size)
        if not until and self.n >= MOST * BLOCK:
            until = parent[int(np.argmin(f[1:])) + 1] if len(f) == 2 else parent[-1]
        if not until:
            self.held, self.due = [data], self.n + BLOCK
            return
        windows = places[path_to(until, parent)]
        yield self._pieces(windows, doc_ends, data)
        self._drop(int(windows[-1]), doc_ends, data)

    def _pieces(self, windows: np.ndarray, doc_ends: np.ndarray, data: bytes) -> pa.RecordBatch:
        cut = int(windows[-1])
        held = np.zeros(cut + 1, bool)
        held[windows] = held[doc_ends[doc_ends < cut]] = True
        borders = np.flatnonzero(held)
        a, b = borders[:-1], borders[1:]
        doc, window = np.searchsorted(doc_ends, a, "right"), np.searchsorted(windows, a, "right") - 1
        begins = np.r_[0, doc_ends[:-1]][doc]
        totals, done = (np.array([d[k] for d in self.documents], np.int64)[doc] for k in (1, 2))
        found = {
            "doc_id": pa.array([self.documents[k][0] for k in doc.tolist()], pa.int64()),
            "start": pa.array(a - begins + done),
            "ids": pa.array([data[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist())], pa.binary()),
            "doc_tokens": pa.array(totals),
            "sequence_id": pa.array(self.sequence + window),
            "offset": pa.array(a - windows[window]),
        }
        self.sequence += len(windows) - 1
        return pa.RecordBatch.from_pydict(found)

    def _drop(self, cut: int, doc_ends: np.ndarray, data: bytes) -> None:
        k = int(np.searchsorted(doc_ends, cut, "right"))  # documents that are given out whole
        rest = self.documents[k:]
        if rest:
            doc_id, total, done = rest[0]
            begins = int(doc_ends[k - 1]) if k else 0
            rest[0] = (doc_id, total, done + cut - begins)
        self.documents, self.held, self.n = rest, [data[4 * cut :]], self.n - cut
        self.due = self.n + BLOCK


def packed(docs: DataFrame, tokenizer_file: str, size: int = 2048, end_id: int = 1, order_by: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, ids, doc_tokens, sequence_id, offset) of every piece; ``ids`` are little-endian uint32.

    ``order_by``: columns to deal and sort the documents by first; a hot value is split by the texts.
    """
    rows = docs
    if order_by:
        deal = [*order_by, F.xxhash64(text_col)]
        rows = docs.repartitionByRange(*deal).sortWithinPartitions(*deal)
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, sentence_ends(tokenizer_file), TaskContext.get().partitionId() << 33)
        encode = encoder(tokenizer_file).encoded
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1), end)):
                packer.add(doc_id, ids)
                yield from packer.given()
        yield from packer.given(last=True)

    return rows.mapInArrow(run, SCHEMA)


def op11_packing(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    length = (F.octet_length("ids") / 4).cast("long")
    return packed(docs, tokenizer_file).select("doc_id", "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
