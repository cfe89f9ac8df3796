"""Chat formatting at token level, and its reader.

A turn becomes  TURN role SEP text END  and a conversation  BEGIN turns CLOSE, where the capitals are reserved ids above the
vocabulary. Role and text are encoded apart, so that no text can merge with a marker or make one. Lengths of the segments are
summed up to places, and the loss mask covers the segments that hold an assistant's text and nothing else.

Where the ids are rendered as a string, a reserved id shows as its control string. A control string that occurs in a text,
ours or another template's, is escaped: backslashes after its first character, one more than it had. Reading takes one away.

The output is a table of frames: whole turns of one conversation, up to so many ids a frame. A conversation of any length is
streamed through its task a frame at a time; its turns are encoded before they are brought together.

Turns with equal numbers are put in order of role and ids; repeated rows are turns of their own. Null text or role: empty. Null turns
come first; a null conv_id is a conversation. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import materialize
from tidepool.llm.tokenizing import ChunkEncoder, encoder

#: Reserved ids, counted from the vocabulary's size, and their control strings.
MARKERS = ["<|begin|>", "<|turn|>", "<|sep|>", "<|end|>", "<|close|>"]
BEGIN, TURN, SEP, END, CLOSE = range(5)
#: Control strings of templates in wide use.
FOREIGN = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>"]
_CONTROLS = "|".join(f"{re.escape(c[0])}(?:\\\\*){re.escape(c[1:])}" for c in MARKERS + FOREIGN)
_ESCAPE = re.compile(_CONTROLS)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + m[0][2:] if m[0][1:2] == "\\" else m[0], text)


def byte_table(enc: ChunkEncoder) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary. Printable bytes stand for themselves, the others are moved above 255 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
    size = enc.plain.get_vocab_size(with_added_tokens=True)
    out = []
    for i in range(size):
        token = enc.plain.id_to_token(i) or ""
        out.append(bytes(back[c] for c in token) if all(c in back for c in token) else token.encode())
    return out


_tables: dict[str, list[bytes]] = {}


def decode(ids: np.ndarray, vocab: str) -> str:
    if vocab not in _tables:
        _tables[vocab] = byte_table(encoder(vocab, literal=True))
    return b"".join(map(_tables[vocab].__getitem__, ids.tolist())).decode("utf-8", "replace")


TURNS = "conv_id long, turn long, role string, assistant boolean, ids binary"
FRAMES = "conv_id long, frame int, ids binary, mask binary"


def encoded_turns(df: DataFrame, vocab: str) -> DataFrame:
    """Each turn's segments, joined by reserved ids, before any row moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab, literal=True)
        size = len(enc.sizes)
        mark = [np.array([size + k], "<u4").tobytes() for k in range(len(MARKERS))]
        for b in batches:
            roles = b.column(2).to_pylist()
            ids = [mark[TURN] + enc.encode_bytes(escape(r)) + mark[SEP] + enc.encode_bytes(escape(t)) + mark[END] for r, t in zip(roles, b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([r == "assistant" for r in roles], pa.bool_()), pa.array(ids, pa.binary())], ["conv_id", "turn", "role", "assistant", "ids"])

    empty = F.lit("")
    own = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    return own.mapInArrow(run, TURNS)


def format_conversations(df: DataFrame, vocab: str = "byte_bpe_50k.json", frame_ids: int = 1 << 16) -> DataFrame:
    """Writes the frames: conv_id, frame, ids (uint32) and mask (a byte an id, 1 where the loss counts)."""
    partitions = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    turns = encoded_turns(df, vocab).repartition(partitions, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(encoder(vocab, literal=True).sizes)
        mark = [np.array([size + k], "<u4").tobytes() for k in range(len(MARKERS))]
        conv, frame, held, loss, total = None, -1, [], [], 0

        def flush(last: bool):
            nonlocal frame, held, loss, total
            if frame < 0 or not held and not last:
                return
            ids = np.frombuffer(b"".join([mark[BEGIN]] * (frame == 0) + held + [mark[CLOSE]] * last), "<u4")
            lengths = np.array([1] * (frame == 0) + [len(x) // 4 for x in held] + [1] * last, np.int64)
            ends = np.cumsum(lengths)
            begins = ends - lengths
            mask = np.zeros(len(ids) + 1, np.int8)
            for k in np.flatnonzero(np.array([False] * (frame == 0) + loss + [False] * last, bool)):
                sep = begins[k] + int(np.argmax(ids[begins[k] : ends[k]] == size + SEP))
                mask[sep + 1] += 1
                mask[ends[k] - 1] -= 1
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([frame], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([np.cumsum(mask[:-1]).astype(np.uint8).tobytes()], pa.binary())], ["conv_id", "frame", "ids", "mask"])
            frame, held, loss, total = frame + 1, [], [], 0

        for b in batches:
            for c, a, ids in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if frame < 0 or c != conv:
                    yield from flush(True)
                    conv, frame = c, 0
                elif total >= frame_ids:
                    yield from flush(False)
                held.append(ids)
                loss.append(a)
                total += len(ids) // 4
        yield from flush(True)

    return materialize(turns.mapInArrow(run, FRAMES), "frames")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_conversations(frames: DataFrame, vocab: str = "byte_bpe_50k.json") -> DataFrame:
    """What the frames hold, from their ids and masks alone: one row a conversation."""
    partitions = max(1, int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = frames.repartition(partitions, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(encoder(vocab, literal=True).sizes)
        names, kinds = [x.split()[0] for x in DIGESTS.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for b in batches:
            done: list[list] = []
            for conv, frame, ids, mask in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if frame == 0:
                    n = loss_chars = chars = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                ids, mask = np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8)
                places = np.flatnonzero(ids >= size)
                kinds_at = ids[places] - size
                chars += sum(len(MARKERS[k]) for k in kinds_at)
                for k in np.flatnonzero(kinds_at == TURN):
                    begin, sep, end = places[k : k + 3]
                    role, text = decode(ids[begin + 1 : sep], vocab), decode(ids[sep + 1 : end], vocab)
                    chars += len(role) + len(text)
                    turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    own = np.flatnonzero(mask[begin : end + 1])
                    if len(own):
                        said = unescape(decode(ids[begin + own[0] : begin + own[-1] + 1], vocab))
                        loss.update(said.encode())
                        loss_chars += len(said)
                    n += 1
                if len(ids) and ids[-1] == size + CLOSE:
                    done.append([conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars])
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kinds[k]) for k in range(6)], names)

    return dealt.mapInArrow(run, DIGESTS)
