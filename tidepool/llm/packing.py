"""Packing documents into windows by non-negative least squares over length combinations.

Each document's ids are cut into whole windows and one remainder. A plan for a histogram of lengths

1. enumerates shallow combinations, one to three lengths that fill a window exactly;
2. solves min |A x - h| with x >= 0: how often each combination is repeated;
3. rounds x to what the histogram still holds;
4. packs what remains greedily, longest first into the tightest open window.

Each task plans the pieces that it has encoded, a block of BLOCK_IDS ids at a time, by steps 1 to 3: so most windows are filled where their documents are read, and
written at once. What is left of all tasks is planned once more, by all four steps, on counts and not on pieces; only this is shuffled. A plan's size depends on the window alone. The
sequences' table is that of sequences.py: one row a training sequence, its ids followed by padding up to the window (unless its length is a power of two), and beside them which document
each segment comes from and where it begins there, so that attention and loss can be kept to a segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tidepool.llm import sequences
from tidepool.llm.sequences import Piece, Plan

#: Ids of the pieces that a task plans together, and rounds of the solver then.
BLOCK_IDS, BLOCK_ROUNDS = 1 << 22, 60


def combinations_of(lengths: np.ndarray, window: int, triples: int = 12) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to the window: every single and pair, and for each length up to so many triples,
    spread evenly over the possible second lengths."""
    has = np.zeros(window + 1, bool)
    has[lengths] = True
    out = [[window, 0, 0]] if has[window] else []
    out += [[window - a, a, 0] for a in lengths if a <= window - a and has[window - a]]
    for a in lengths:
        b = np.arange(a, (window - a) // 2 + 1)
        b = b[has[b] & has[window - a - b]] if len(b) else b
        if len(b) > triples:
            b = b[np.linspace(0, len(b) - 1, triples).astype(int)]
        out += [[window - a - k, k, a] for k in b]
    return np.array(out, np.int64).reshape(-1, 3)


def nnls(columns: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that brings A x near the histogram, by multiplicative updates; a column of A counts its row's lengths. Missing the count of
    a long piece costs more than missing that of a short one, which the greedy pass places easily."""
    size = len(histogram)
    weight = np.sqrt(np.arange(size) / max(1, size - 1)) + 0.05
    weight[0] = 0

    def forward(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(columns[:, k], x, size) for k in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        r = r * weight
        return sum(r[columns[:, k]] for k in range(3))

    target = back(histogram.astype(float))
    x = np.full(len(columns), histogram.sum() / max(1, len(columns)))
    for _ in range(rounds):
        x *= target / np.maximum(back(forward(x)), 1e-12)
    return x


def filled(left: np.ndarray, window: int, rounds: int = 300, least: int = 0) -> Plan:
    """(lengths that fill a window, how many such windows), by least squares, for as much of the histogram as they take up; left keeps the rest. A combination is taken
    as often as its rounded share says, and at least so often (least) as long as there are pieces for it."""
    left[0] = 0
    out = []
    columns = combinations_of(np.flatnonzero(left), window)
    if len(columns):
        x = nnls(columns, left, rounds)
        for k in np.argsort(-x, kind="stable"):
            lengths = [int(v) for v in columns[k] if v]
            n = max(int(round(x[k])), least)
            for v in set(lengths):
                n = min(n, int(left[v]) // lengths.count(v))
            if n > 0:
                for v in lengths:
                    left[v] -= n
                out.append((lengths, n))
    return out


def plan(histogram: np.ndarray, window: int) -> Plan:
    """(lengths in a window, how many such windows), for all pieces of the histogram."""
    left = histogram.astype(np.int64).copy()
    return filled(left, window) + greedy(left, window)


def greedy(left: np.ndarray, window: int) -> list[tuple[list[int], int]]:
    """Longest first, each into the window with the least room that still takes it; kinds of windows, with counts."""
    out: list[tuple[list[int], int]] = []
    room: dict[int, list[tuple[list[int], int]]] = {}
    open_rooms = np.zeros(window + 1, bool)

    def put(lengths: list[int], n: int) -> None:
        free = window - sum(lengths)
        if free == 0:
            out.append((lengths, n))
        else:
            room.setdefault(free, []).append((lengths, n))
            open_rooms[free] = True

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fits = open_rooms[length:]
            at = int(np.argmax(fits))
            if fits[at]:
                free = length + at
                lengths, m = room[free].pop()
                open_rooms[free] = bool(room[free])
                each = min(free // length, -(-n // m))  # pieces of this length for each such window
                took = min(m, n // each)
                put(lengths + [length] * each, took)
                if took < m:
                    put(lengths, m - took)
                n -= took * each
            else:
                each = min(window // length, n)
                put([length] * each, n // each)
                n -= n // each * each
    return out + [x for kinds in room.values() for x in kinds]


class Blocks:
    """A task's pieces by length, planned a block at a time."""

    def __init__(self, window: int, block_ids: int = BLOCK_IDS):
        self.window, self.block_ids, self.held, self.new, self.ended = window, block_ids, 0, 0, False
        self.by_length: list[list[Piece]] = [[] for _ in range(window)]

    def put(self, piece: Piece) -> Iterator[list[Piece]]:
        self.by_length[piece.length].append(piece)
        self.held += piece.length
        self.new += piece.length
        if self.new >= self.block_ids:
            yield from self.full()

    def full(self) -> Iterator[list[Piece]]:
        self.new = 0
        left = np.array([len(x) for x in self.by_length] + [0], np.int64)
        for lengths, n in filled(left, self.window, BLOCK_ROUNDS, 1):
            for _ in range(n):
                self.held -= self.window
                yield [self.by_length[v].pop() for v in lengths]

    def loose(self) -> Iterator[Piece]:
        """All that is left at the end; before, what blocks have left over, if it comes to more than a block."""
        if self.ended or self.held - self.new > self.block_ids:
            for own in self.by_length:
                yield from own
                own.clear()
            self.held = self.new = 0

    def end(self) -> Iterator[list[Piece]]:
        yield from self.full()
        self.ended = True


def write_sequences(df: DataFrame, vocab: str = "word_bpe_49k.json", end_id: int = 1, window: int = 2048, pad_id: int = 0, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Packs every document and writes the sequences to the shared folder; returns them as a DataFrame that reads them.

    Null text: only the end id. Repeated rows are documents of their own. An empty table gives no rows. Null doc_ids stay null. Texts of any length are packed
    whole. Other columns are ignored, whatever their names.
    """
    return sequences.write(df, vocab, end_id, window, lambda: Blocks(window, block_ids), plan, short_first=False, pad_id=pad_id)


def pack(df: DataFrame, vocab: str = "word_bpe_49k.json", end_id: int = 1, window: int = 2048) -> DataFrame:
    """Packs every document into written sequences and reads them back: one row a piece."""
    return sequences.read(write_sequences(df, vocab, end_id, window)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
