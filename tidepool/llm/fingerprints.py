"""Document fingerprints by locally consistent parsing.

A level turns a string of names into a shorter one. Runs of one name become one name (with the run's length). Then deterministic
coin tossing: each place takes the lowest bit in which its name differs from the one before it, twice that bit's number plus its value;
neighbours stay different, and after three rounds only a handful of labels is left. A phrase begins at each local maximum of
the labels, so where phrases begin depends on a few names around the place and not on its offset. A phrase's name is a hash of
its names in order: equal substrings get equal phrases but for a few at their borders.

Level 1 reads code points. Phrases of level 2 hold about ten characters and those of level 3 about thirty; the fingerprint of a text is
the least hashes of its distinct phrases of both levels, WIDTH at most, in hexadecimal. Likeness is the share of common phrases among the
least of both fingerprints: the bottom sketch's estimate of the Jaccard index, exact for short texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import documents_of
from tidepool.llm.ranges import ranges_of

LEVELS = (2, 3)
WIDTH = 96
#: Characters that are parsed at once; each takes some fifty bytes meanwhile.
GROUP_CHARS = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def _runs(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one name become one name. first: whether a text begins at the place."""
    start = first.copy()
    start[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(start)
    if len(at) == len(names):
        return names, first
    length = np.diff(np.append(at, len(names))).astype(np.uint64)
    out = names[at]
    long = length > 1
    out[long] = _mix(out[long] * _A + length[long])
    # a run's new name may by chance be its neighbour's; coin tossing treats equal neighbours as differing in the last bit
    return out, first[at]


def _toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing. The first place of a text compares with the complement of its own lowest bit."""
    before = np.empty_like(labels)
    before[1:] = labels[:-1]
    before[first] = labels[first] ^ np.uint64(1)
    differ = labels ^ before
    low = differ & (~differ + np.uint64(1))
    bit = np.where(differ == 0, 63, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64)).astype(np.uint64)
    return bit * np.uint64(2) + ((labels >> bit) & np.uint64(1))


def level(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and text beginnings of the next level."""
    names, first = _runs(names, first)
    labels = names
    for _ in range(3):
        labels = _toss(labels, first)
    labels = labels.astype(np.int64)
    before, after = np.empty_like(labels), np.empty_like(labels)
    before[1:], before[0] = labels[:-1], -1
    after[:-1], after[-1] = labels[1:], -1
    last = np.append(first[1:], True)
    start = (labels > before) & (labels >= after) & ~last
    start[np.append(False, first[:-1])] = False  # no phrase of one name at a text's head
    start |= first
    at = np.flatnonzero(start)
    length = np.diff(np.append(at, len(names)))
    place = np.arange(len(names)) - np.repeat(at, length)
    parts = _mix(names + (place.astype(np.uint64) + np.uint64(1)) * _A)
    return _mix(np.add.reduceat(parts, at) + length.astype(np.uint64) * _B), first[at]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """For each text the least distinct 32-bit phrase hashes, in order; many texts are parsed at once."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
    full = [k for k, t in enumerate(texts) if t]
    if not full:
        return out
    points = np.frombuffer("".join(texts[k] for k in full).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(texts[k]) for k in full])
    first = np.zeros(len(points), bool)
    first[np.cumsum(sizes) - sizes] = True
    with np.errstate(over="ignore"):
        names, found, owners = _mix(points + np.uint64(1)), [], []
        for depth in range(1, max(LEVELS) + 1):
            names, first = level(names, first)
            if depth in LEVELS:
                found.append((_mix(names + np.uint64(depth)) >> np.uint64(32)).astype(np.uint64))
                owners.append(np.cumsum(first) - 1)
    both = (np.concatenate(owners).astype(np.uint64) << np.uint64(32)) | np.concatenate(found)
    both = np.unique(both)
    owner = (both >> np.uint64(32)).astype(np.int64)
    values = both.astype(np.uint32)
    ends = np.searchsorted(owner, np.arange(len(full)), "right")
    begin = 0
    for k, end in zip(full, ends.tolist(), strict=True):
        out[k] = values[begin : min(end, begin + WIDTH)]
        begin = end
    return out


def fingerprint(text: str) -> str:
    return as_text(sketches([text])[0])


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for two empty texts, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:WIDTH]
    return float(np.isin(union, a, assume_unique=True)[np.isin(union, b, assume_unique=True)].sum() / len(union))


def likeness_of(a: str, b: str) -> float:
    """Likeness of two fingerprints as text."""
    return likeness(*[np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32) for x in (a, b)])


def in_groups(texts: list[str], most: int) -> Iterator[int]:
    """Sizes of consecutive groups of at most so many texts and GROUP_CHARS characters; a longer text is a group of its own."""
    n = chars = 0
    for t in texts:
        if n and (n == most or chars + len(t) > GROUP_CHARS):
            yield n
            n = chars = 0
        n, chars = n + 1, chars + len(t)
    if n:
        yield n


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every document. Null text: empty, with an empty fingerprint. Repeated rows give repeated rows; an empty table gives
    none; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at = b.column(1).to_pylist(), 0
            for n in in_groups(texts, 128):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array([as_text(s) for s in sketches(texts[at : at + n])], pa.string())], ["doc_id", "fingerprint"])
                at += n

    return documents_of(df).mapInArrow(run, "doc_id long, fingerprint string")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_study(df: DataFrame, group: int = 128) -> DataFrame:
    """Each document beside its edited text (its last third replaced by the head of the next document, in descending doc_id, the first after the
    last), and beside that next document.

    Documents are dealt out by ranges of doc_id and sorted there; the head of the range below is read as a guest at a range's end, so the
    texts move once. Equal doc_ids follow in order of a hash of their texts, then of the texts; a null doc_id comes last. A table of one row is its own next.
    """
    docs = documents_of(df).withColumn("mark", F.xxhash64("text"))
    ranges = ranges_of(docs.select("doc_id"), "doc_id")
    dealt = docs.withColumn("range_id", ranges.id_of("doc_id", F.col("mark"), descending=True))
    # a range's first document in descending order: a row a range
    heads = {r.range_id: r.m for r in dealt.groupBy("range_id").agg(F.max(F.struct("doc_id", F.bitwise_not("mark").alias("inverse"))).alias("m")).collect()}
    if not heads:
        return df.sparkSession.createDataFrame([], EDITED)
    order = sorted(heads, reverse=True)
    guests = [(r, n, heads[n].doc_id, ~heads[n].inverse) for r, n in zip(order, order[1:] + order[:1], strict=True)]
    wanted = F.broadcast(df.sparkSession.createDataFrame(guests, "range_id int, own int, guest long, guest_mark long"))  # a row a range
    met = dealt.withColumnRenamed("range_id", "own").join(wanted, "own").where(F.col("doc_id").eqNullSafe(F.col("guest")) & (F.col("mark") == F.col("guest_mark")))
    read = met.groupBy("range_id").agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"), F.first("mark").alias("mark"))
    both = dealt.withColumn("is_guest", F.lit(False)).unionByName(read.withColumn("is_guest", F.lit(True)))
    both = both.repartitionById(ranges.n, "range_id").sortWithinPartitions("is_guest", F.col("doc_id").desc_nulls_last(), "mark", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        chars = 0

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            # rows: documents in order, the last one only as the next of the one before it
            texts = [r[1] for r in rows]
            edits = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, texts[1:], strict=False)]
            found = sketches(texts + edits)
            own, changed = found[: len(texts)], found[len(texts) :]
            n = len(edits)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows[:n]], pa.int64()),
                    pa.array([len(t) for t in texts[:n]], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits], pa.string()),
                    pa.array([as_text(s) for s in own[:n]], pa.string()),
                    pa.array([as_text(s) for s in changed], pa.string()),
                    pa.array([likeness(own[k], changed[k]) for k in range(n)], pa.float64()),
                    pa.array([likeness(own[k], own[k + 1]) for k in range(n)], pa.float64()),
                ],
                [x.split()[0] for x in EDITED.split(", ")],
            )

        for b in batches:
            for row in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("is_guest").to_pylist(), strict=True):
                held.append(row)
                chars += len(row[1])
                if row[2]:
                    if len(held) > 1:
                        yield emit(held)
                    held, chars = [], 0
                elif len(held) > group or chars > GROUP_CHARS and len(held) > 1:
                    yield emit(held)
                    held, chars = held[-1:], len(row[1])

    return both.mapInArrow(run, EDITED)
