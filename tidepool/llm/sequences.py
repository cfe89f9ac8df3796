"""Packed training sequences: how tasks write them, how pieces that no task could place are placed together, and how they are read back.

A task encodes its documents, cuts their ids into pieces and gives these to a packer. What the packer fills a window with is written at once, with its ids, and
never moved again. Pieces that it sets free are written on their own; they are placed on counts: the histogram of their lengths, a number for each length,
goes to the driver, and its plan comes back as a table of rank intervals by length. A piece's rank among those of its length is its partition's base plus its ordinal
there, so no window function sorts a frequent length. Only these pieces are shuffled, to their sequences, and written again.

A row of the sequences' table is one sequence: sequence_id, n_ids (without padding), width (bytes an id), ids (with padding up to the window, unless n_ids is a power of two or no
padding is asked for), segments (where each part comes from, in order). A task that is run again writes the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import documents_of, materialize, scratch
from tidepool.llm.tokenizing import ChunkEncoder, encoder

SEGMENT = ["doc_id", "piece", "start", "length", "doc_tokens"]
SEGMENTS = "array<struct<" + ",".join(f"{c}:bigint" for c in SEGMENT) + ">>"
SEQUENCES = f"sequence_id long, n_ids long, width int, ids binary, segments {SEGMENTS}"
FIRST = f"free boolean, part int, ordinal long, length int, {SEQUENCES}"
READ = "doc_id long, piece int, start long, length long, doc_tokens long, ids_crc32 long, sequence_id long, offset long"
#: Ids of rows that are gathered before a batch is handed on.
BATCH_IDS = 1 << 20
#: Texts that are Python objects at once.
AT_ONCE = 256
Plan = list[tuple[list[int], int]]


class Piece(NamedTuple):
    doc_id: int | None
    piece: int
    start: int
    length: int
    doc_tokens: int
    ids: bytes


class Packer(Protocol):
    """Pieces are shorter than a window."""

    def put(self, piece: Piece) -> Iterator[list[Piece]]:
        """The windows that are full now."""

    def loose(self) -> Iterator[Piece]:
        """Pieces that the packer sets free now; all that are left, if nothing comes any more (ended)."""

    def end(self) -> Iterator[list[Piece]]: ...


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(f" {SEGMENTS}")[0].split(", ")]


def id_type(enc: ChunkEncoder, end_id: int) -> str:
    return "<u2" if enc.plain.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"


def padded_size(n: int, window: int) -> int:
    return n if n & (n - 1) == 0 else window


def segments_of(pieces: list, ends: list[int]) -> pa.ListArray:
    """Lists of segments; ends: where each list ends, after 0."""
    columns = list(zip(*pieces, strict=True))[: len(SEGMENT)] if pieces else [[]] * len(SEGMENT)
    structs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], names=SEGMENT)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)


def first_pass(docs: DataFrame, vocab: str, end_id: int, window: int, packer: Callable[[], Packer], short_first: bool, pad_id: int | None) -> DataFrame:
    """Full sequences, and (free) the pieces that are to be placed together, with their partition and ordinal among its pieces of their length."""
    kinds = [pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, own = encoder(vocab), TaskContext.get().partitionId(), packer()
        wide, end = np.dtype(id_type(enc, end_id)), np.array([end_id], "<u4").tobytes()
        seen, full, rows, pieces, ends, held = np.zeros(window + 1, np.int64), 0, [], [], [0], 0

        def emit(found: list[Piece], free: bool) -> None:
            nonlocal full, held
            size = sum(p.length for p in found)
            held += size
            ids = b"".join([p.ids for p in found])
            if free:
                rows.append((True, part, int(seen[size]), size, None, size, wide.itemsize, ids))
                seen[size] += 1
            else:
                rows.append((False, part, None, size, (part << 40) + full, size, wide.itemsize, ids))
                full += 1
            pieces.extend(found)
            ends.append(len(pieces))

        def batch() -> pa.RecordBatch:
            nonlocal held
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], kind) for kind in kinds]
            out = pa.RecordBatch.from_arrays([*columns, segments_of(pieces, ends)], [*names_of(FIRST)[:-1], "segments"])
            rows.clear()
            pieces.clear()
            ends[1:] = []
            held = 0
            return out

        for b in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, whole.num_rows, AT_ONCE)):
            for doc, coded in zip(b.column(0).to_pylist(), enc.encode_each(b.column(1)), strict=True):
                ids = np.frombuffer(coded + end, "<u4").astype(wide).tobytes()
                n = len(ids) // wide.itemsize
                first = (n - 1) % window + 1 if short_first else min(n, window)
                for k, start in enumerate([0, *range(first, n, window)]):
                    size = first if k == 0 else min(window, n - start)
                    piece = Piece(doc, k, start, size, n, ids[wide.itemsize * start : wide.itemsize * (start + size)])
                    for found in [[piece]] if size == window else own.put(piece):
                        emit(found, False)
                for p in own.loose():
                    emit([p], True)
                if held > BATCH_IDS:
                    yield batch()
        for found in own.end():
            emit(found, False)
        for p in own.loose():
            emit([p], True)
            if held > BATCH_IDS:
                yield batch()
        yield batch()

    return docs.mapInArrow(run, FIRST)


def slots_of(planned: Plan, window: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), in order of length and rank."""
    rank, rows, sequence = np.zeros(window + 1, np.int64), [], 0
    for lengths, n in planned:
        offset = 0
        for v in lengths:
            rows.append((v, rank[v], sequence, offset))
            rank[v] += n
            offset += v
        sequence += n
    out = np.array(rows, np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def seated(loose: DataFrame, window: int, plan: Callable[[np.ndarray, int], Plan]) -> DataFrame:
    """The loose pieces with their sequence (negative: -1, -2 ...) and offset."""
    counts = loose.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # a number for each length, at most
        histogram[length] = n
    table = slots_of(plan(histogram, window), window)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that Spark knows its size and sends it to the pieces if it is small
    base = materialize(counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    ranked = loose.join(base, ["part", "length"]).select("width", "ids", "segments", F.col("length").cast("long").alias("length"), (F.col("base") + F.col("ordinal")).alias("rank"))
    high = np.int64(1) << np.int64(50)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] * high + table[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            row = table[np.searchsorted(keys, length * high + rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([pa.array(-1 - row[:, 2] - rank + row[:, 1]), pa.array(row[:, 3]), *b.columns[:3]], ["sequence_id", "offset", "width", "ids", "segments"])

    return ranked.mapInArrow(run, f"sequence_id long, offset long, width int, ids binary, segments {SEGMENTS}")


def merged(pieces: DataFrame, window: int, pad_id: int | None) -> DataFrame:
    """Sequences of pieces that lie in order of sequence_id and offset."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, own, rows, segments, ends = None, [], [], [], [0]

        def close() -> None:
            if own:
                width, ids = own[0][0], b"".join([x for _, x in own])
                n = len(ids) // width
                pad = b"" if pad_id is None else np.full(padded_size(n, window) - n, pad_id, f"<u{width}").tobytes()
                rows.append((sequence, n, width, ids + pad))
                ends.append(len(segments))
                own.clear()

        def batch() -> pa.RecordBatch:
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], kind) for kind in kinds]
            closed = ends[-1]
            out = pa.RecordBatch.from_arrays([*columns, segments_of(segments[:closed], ends)], [*names_of(SEQUENCES)[:-1], "segments"])
            rows.clear()
            segments[:closed] = []
            ends[1:] = []
            return out

        for b in batches:
            flat = [x.to_numpy(zero_copy_only=False).tolist() if not x.null_count else x.to_pylist() for x in b.column(4).flatten().flatten()]
            for s, width, ids, segment in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), zip(*flat, strict=True), strict=True):
                if s != sequence:
                    close()
                    sequence = s
                own.append((width, ids))
                segments.append(segment)
            yield batch()
        close()
        yield batch()

    return pieces.mapInArrow(run, SEQUENCES)


def write(df: DataFrame, vocab: str, end_id: int, window: int, packer: Callable[[], Packer], plan: Callable[[np.ndarray, int], Plan], short_first: bool, pad_id: int | None = None) -> DataFrame:
    """Packs every document and writes the sequences to the shared folder; returns them as a DataFrame that reads them. short_first: of a document longer than a window
    the first piece is the shorter one, else the last."""
    packed = materialize(first_pass(documents_of(df), vocab, end_id, window, packer, short_first, pad_id), "packed", keep=True, partition_by="free", compression="zstd")
    columns = [*names_of(SEQUENCES)[:-1], "segments"]
    partitions = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    with scratch(df.sparkSession):
        dealt = seated(packed.where("free"), window, plan).repartition(partitions, "sequence_id").sortWithinPartitions("sequence_id", "offset")
        others = materialize(merged(dealt, window, pad_id), "sequences", keep=True, compression="zstd")
    return packed.where("NOT free").select(columns).unionByName(others.select(columns))


def read(sequences: DataFrame) -> DataFrame:
    """One row a piece, read back from the written sequences: where it lies, and its ids' crc32 as unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segments = b.column(4)
            doc, piece, start, length, tokens = segments.flatten().flatten()
            sizes, ends = length.to_numpy(zero_copy_only=False), segments.offsets.to_numpy() - segments.offsets[0].as_py()
            after = np.cumsum(sizes)
            offsets = after - sizes
            offsets = offsets - np.repeat(offsets[ends[:-1]], np.diff(ends)) if len(sizes) else offsets
            crcs, spans = [], list(zip((4 * offsets).tolist(), (4 * (offsets + sizes)).tolist(), strict=True))
            for width, data, low, high in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own = memoryview(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes())
                crcs += [zlib.crc32(own[x:y]) for x, y in spans[low:high]]
            sequence = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(ends))))
            yield pa.RecordBatch.from_arrays([doc, piece.cast(pa.int32()), start, length, tokens, pa.array(crcs, pa.int64()), sequence, pa.array(offsets, pa.int64())], [x.split()[0] for x in READ.split(", ")])

    return sequences.mapInArrow(run, READ)
