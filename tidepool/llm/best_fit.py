"""Sum-of-squares packing: documents into as few sequences as it can, cutting none that fits.

N(h) is the number of open sequences (bins) with room for h more ids. A document of length s goes where the sum of all N(h)^2 becomes smallest: into a
bin with room h >= s, or into a new one. So no kind of gap grows frequent, and there is nearly always a bin that the next document fills exactly.

Each task encodes its documents and packs them as they come. A bin that is full is written at once, with its ids: it wastes nothing and is never moved again.
What is still open at the end of a task, or beyond MOST_IDS held ids (then the bins with the most frequent gap), is set free: as no next document can be
served there by a balance of gaps, its documents are written on their own and packed once more, those of all tasks together, longest first into the tightest gap. That
is done on counts: the histogram of their lengths (a number for each length) goes to the driver, whose work depends on the window alone. Only these documents are
shuffled. A task of 10,000 documents sets about 1,500 of them free, one of 1,000 about 600.

A document longer than a window is cut into whole windows, each a sequence, and one shorter piece, the first, that is packed like a document.

The sequences' table is that of sequences.py.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tidepool.llm import sequences
from tidepool.llm.packing import greedy
from tidepool.llm.sequences import Piece

#: Ids that a task's open bins hold at most: 64 MB where they are four bytes wide.
MOST_IDS = 1 << 24


class Gaps:
    """Doubled counts of open bins by gap, and where a document makes the sum of squares least.

    Moving one bin from gap h to h - s changes the sum by 2 (N(h - s) - N(h) + 1); a full bin (gap 0) and a new one (gap window) count on one side only,
    which -1 and 1 at the two ends of the doubled counts amount to."""

    def __init__(self, window: int):
        self.window = window
        self.to = np.zeros(window + 1, np.int64)
        self.to[0] = -1
        self.out = np.full(window + 1, -(1 << 60), np.int64)
        self.out[window] = 1

    def best(self, size: int) -> int:
        """The gap to put a document into; window: a new bin. Ties: the tightest."""
        return size + int(np.argmin(self.to[: self.window + 1 - size] - self.out[size:]))

    def add(self, gap: int, n: int) -> None:
        if 0 < gap < self.window:
            self.to[gap] += 2 * n
            self.out[gap] = self.to[gap] or -(1 << 60)


class Bins:
    """A task's open bins: for each gap a stack of lists of pieces."""

    def __init__(self, window: int, most_ids: int = MOST_IDS):
        self.window, self.most_ids, self.gaps, self.held, self.ended = window, most_ids, Gaps(window), 0, False
        self.bins: list[list[list[Piece]]] = [[] for _ in range(window)]

    def put(self, piece: Piece) -> Iterator[list[Piece]]:
        """Places a piece; a bin that it fills comes out."""
        size = piece.length
        gap = self.gaps.best(size)
        if gap == self.window:
            own = [piece]
        else:
            own = self.bins[gap].pop()
            own.append(piece)
            self.gaps.add(gap, -1)
        if gap == size:
            self.held -= self.window - size
            yield own
        else:
            self.bins[gap - size].append(own)
            self.gaps.add(gap - size, 1)
            self.held += size

    def free(self, gap: int) -> list[Piece]:
        """The pieces of all bins of a gap, which are open no longer."""
        out = [p for own in self.bins[gap] for p in own]
        self.gaps.add(gap, -len(self.bins[gap]))
        self.bins[gap] = []
        self.held -= sum(p.length for p in out)
        return out

    def loose(self) -> Iterator[Piece]:
        if self.ended:
            for gap in range(1, self.window):
                yield from self.free(gap)
        while self.held > self.most_ids:
            yield from self.free(max(range(1, self.window), key=lambda h: len(self.bins[h])))

    def end(self) -> Iterator[list[Piece]]:
        self.ended = True
        return iter(())


def write_sequences(df: DataFrame, vocab: str = "byte_bpe_50k.json", end_id: int = 2, window: int = 1024, most_ids: int = MOST_IDS) -> DataFrame:
    """Packs every document and writes the sequences to the shared folder; returns them as a DataFrame that reads them.

    Null text: only the end id. Repeated rows are documents of their own. An empty table gives no rows. Null doc_ids stay null. Texts of any
    length are packed whole. Other columns are ignored, whatever their names.
    """
    return sequences.write(df, vocab, end_id, window, lambda: Bins(window, most_ids), greedy, short_first=True)


def pack(df: DataFrame, vocab: str = "byte_bpe_50k.json", end_id: int = 2, window: int = 1024) -> DataFrame:
    """Packs every document into written sequences and reads them back: one row a piece."""
    return sequences.read(write_sequences(df, vocab, end_id, window)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
