"""Token counts of sections, from one encoding of the whole document.

A document's ids are mapped to spans of its bytes (each id of a byte-level vocabulary stands for known bytes, and together they are
the text), and the spans are joined with the sections by binary search on the sections' starts. A token that lies across a
boundary is allocated by rule:

* first: to the section that holds its first byte (the default);
* last: to the section that holds its last byte;
* most: to the section that holds most of its bytes, the earlier one of two equals;
* share: to each section the share of its bytes there.

Sections are the lines of a text, each with the line end after it, so every character is in one section and the counts of a
document's sections sum to its tokens. A text that ends in a line end has no section after it; an empty or null text has one empty section.
Repeated rows give repeated rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepool.llm.common import documents_of
from tidepool.llm.tokenizing import encoder

RULES = ("first", "last", "most", "share")


def section_starts(raw: np.ndarray) -> np.ndarray:
    """First bytes of the lines."""
    after = np.flatnonzero(raw == 10) + 1
    return np.concatenate([[0], after[after < len(raw)]])


def allocate(begins: np.ndarray, ends: np.ndarray, starts: np.ndarray, size: int, rule: str) -> np.ndarray:
    """Tokens of each section. begins, ends: the tokens' spans of bytes; starts: the sections'."""
    n = len(starts)
    first = np.searchsorted(starts, begins, "right") - 1
    if rule == "first":
        return np.bincount(first, minlength=n)
    last = np.searchsorted(starts, np.maximum(ends - 1, begins), "right") - 1
    if rule == "last":
        return np.bincount(last, minlength=n)
    one = first == last
    out = np.bincount(first[one], minlength=n).astype(float)
    stops = np.append(starts[1:], size)
    for k in np.flatnonzero(~one):
        own = np.arange(first[k], last[k] + 1)
        part = np.minimum(stops[own], ends[k]) - np.maximum(starts[own], begins[k])
        if rule == "share":
            out[own] += part / part.sum()
        else:
            out[own[int(np.argmax(part))]] += 1
    return out


def count_tokens(df: DataFrame, vocab: str = "byte_bpe_50k.json", rule: str = "first") -> DataFrame:
    """doc_id, section, start and length in characters, n_tokens, doc_tokens: one row a section of every document."""
    if rule not in RULES:
        raise ValueError(f"rule: one of {RULES}")
    kind, arrow = ("double", pa.float64()) if rule == "share" else ("long", pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        sizes = enc.byte_lengths()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                docs, columns = part.column(0).to_pylist(), ([], [], [], [], [], [])
                for doc, text in zip(docs, part.column(1).to_pylist(), strict=True):
                    raw = np.frombuffer(text.encode(), np.uint8)
                    ids = enc.encode(text)
                    ends = np.cumsum(sizes[ids])
                    starts = section_starts(raw)
                    n = len(starts)
                    counts = allocate(ends - sizes[ids], ends, starts, len(raw), rule) if len(ids) else np.zeros(n)
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    places = chars[np.append(starts, len(raw))]
                    for c, v in zip(columns, ([doc] * n, range(n), places[:-1].tolist(), np.diff(places).tolist(), counts.tolist(), [len(ids)] * n), strict=True):
                        c.extend(v)
                kinds = [pa.int64()] * 4 + [arrow, pa.int64()]
                values = [[int(x) for x in columns[4]] if kind == "long" else columns[4]]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip([*columns[:4], *values, columns[5]], kinds, strict=True)], ["doc_id", "section", "start", "length", "n_tokens", "doc_tokens"])

    return documents_of(df).mapInArrow(run, f"doc_id long, section long, start long, length long, n_tokens {kind}, doc_tokens long")
