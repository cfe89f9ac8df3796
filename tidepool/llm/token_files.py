"""Token-id files: raw id payloads in shards, each with a minimal perfect hash index over document keys.

A file is one row of a Parquet table in the shared folder, so that any store Spark can write will do:

    shard, block                place of the block in the order of doc_id
    n_docs, n_tokens, before    its size, and the ids of the shard's blocks before it
    n_null                      how many of its documents, the first ones, have no doc_id
    first_key, first_ordinal    its first document that has a doc_id; null if none has
    keys                        int64 doc_ids, in order (those without one first, as 0)
    ordinals                    uint32: 0 for the first row of a doc_id, 1 for its second ...
    seeds                       int32: the minimal perfect hash (hash, displace): a seed for each bucket
    prints                      uint32: stored fingerprint of the key in each slot
    offsets, lengths            uint32: where the slot's ids lie in the payload
    payload                     the ids, uint16 where the vocabulary fits, else uint32

A lookup in a block hashes the key twice, reads one slot, compares the fingerprint, and slices the payload: constant time. find() takes a table
of keys to their blocks by the blocks' first keys and looks each up there.

Rows with one doc_id are in order of a hash of their ids, then of the ids' bytes, and a doc_id with a great share of all rows is dealt out over several ranges. Null text: only the end id. Empty table: no rows. Columns
beside doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import documents_of, materialize
from tidepool.llm.ranges import by_range
from tidepool.llm.tokenizing import encoder

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + (np.asarray(seed).astype(np.uint64) + np.uint64(1)) * _M1
        z = (z ^ (z >> np.uint64(30))) * _M2
        z = (z ^ (z >> np.uint64(27))) * _M3
        return z ^ (z >> np.uint64(31))


def hashed_keys(keys: np.ndarray, ordinals: np.ndarray, n_null: int = 0) -> np.ndarray:
    """n_null: how many of the keys, the first ones, stand for no doc_id."""
    salt = ordinals.astype(np.uint64) + np.uint64(77)
    salt[:n_null] += np.uint64(1 << 40)
    return mix(keys.view(np.uint64), salt)


class PerfectHash:
    """Hash and displace: n keys to n slots without a gap. Buckets of about four keys, largest first, each with the first seed
    that sends its keys to free slots; buckets of one key store their slot as a negative number."""

    def __init__(self, seeds: np.ndarray, n: int):
        self.seeds, self.n = seeds, n

    @classmethod
    def build(cls, hashes: np.ndarray) -> "PerfectHash":
        n = len(hashes)
        m = max(1, n // 4)
        bucket = (mix(hashes, 1) % np.uint64(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=m)
        starts = np.concatenate([[0], np.cumsum(counts)])
        seeds, used = np.zeros(m, np.int32), np.zeros(n, bool)
        for b in np.argsort(-counts, kind="stable"):
            size = counts[b]
            if size <= 1:
                break
            own = hashes[order[starts[b] : starts[b + 1]]]
            for low in range(2, 1 << 30, 64):
                tries = np.arange(low, low + 64)
                slots = (mix(own[None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
                good = ~used[slots].any(1)
                if size > 1 and good.any():
                    s = np.sort(slots, 1)
                    good &= (s[:, 1:] != s[:, :-1]).all(1)
                if good.any():
                    k = int(np.argmax(good))
                    seeds[b] = tries[k]
                    used[slots[k]] = True
                    break
        single = np.flatnonzero(counts == 1)
        seeds[single] = -1 - np.flatnonzero(~used)[: len(single)]
        return cls(seeds, n)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        seed = self.seeds[(mix(hashes, 1) % np.uint64(len(self.seeds))).astype(np.int64)]
        return np.where(seed < 0, -1 - seed, (mix(hashes, np.maximum(seed, 0)) % np.uint64(max(1, self.n))).astype(np.int64))


def prints_of(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes, 5) >> np.uint64(32)).astype("<u4")


ENCODED = "doc_id long, n_tokens long, ids binary"
BLOCKS = "shard int, block int, n_docs long, n_tokens long, before long, n_null long, first_key long, first_ordinal long, keys binary, ordinals binary, seeds binary, prints binary, offsets binary, lengths binary, width int, payload binary"


def encoded(docs: DataFrame, vocab: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, ids: the whole text's ids and the end id. Narrow ids are two bytes wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        wide = "<u2" if enc.plain.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids = [np.frombuffer(coded + end, "<u4") for coded in enc.encode_each(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(wide).tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.mapInArrow(run, ENCODED)


def block_row(shard: int, block: int, before: int, keys: list[int | None], ordinals: list[int], ids: list[bytes], lengths: list[int]) -> list:
    n_null = keys.count(None)
    known = [k for k in keys if k is not None]
    keys_, ords = np.array([0] * n_null + known, "<i8"), np.array(ordinals, "<u4")
    h = hashed_keys(keys_, ords, n_null)
    ph = PerfectHash.build(h)
    slot = ph.slots(h)
    n = np.array(lengths, np.int64)
    width = sum(map(len, ids)) // max(1, int(n.sum()))
    at = np.zeros((3, len(n)), "<u4")
    at[0, slot], at[1, slot], at[2, slot] = prints_of(h), np.cumsum(n) - n, n
    first = (known[0], ordinals[n_null]) if known else (None, None)
    return [shard, block, len(n), int(n.sum()), before, n_null, *first, keys_.tobytes(), ords.tobytes(), ph.seeds.astype("<i4").tobytes(), at[0].tobytes(), at[1].tobytes(), at[2].tobytes(), width, b"".join(ids)]


def write_token_files(df: DataFrame, vocab: str = "byte_bpe_50k.json", end_id: int = 2, block_tokens: int = 1 << 20, block_docs: int = 4096) -> DataFrame:
    """Encodes documents and writes the files; returns them as a DataFrame that reads them."""
    docs = documents_of(df)
    spread = by_range(encoded(docs, vocab, end_id), "doc_id", F.xxhash64("ids"), ["ids"], docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, held, last, ordinal, tokens, before = None, 0, ([], [], [], []), None, 0, 0, 0
        names = [x.split()[0] for x in BLOCKS.split(", ")]

        def flush():
            nonlocal block, held, tokens, before
            if held[0]:
                row = block_row(shard, block, before, *held)
                block, held, tokens, before = block + 1, ([], [], [], []), 0, before + tokens
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32()] * 2 + [pa.int64()] * 6 + [pa.binary()] * 6 + [pa.int32(), pa.binary()], strict=True)], names)

        for b in batches:
            for pid, key, n, ids in zip(*[b.column(b.schema.names.index(c)).to_pylist() for c in ("range_id", "doc_id", "n_tokens", "ids")], strict=True):
                if pid != shard:
                    yield from flush()
                    shard, block, before = pid, 0, 0
                    ordinal, last = -1, key
                ordinal = ordinal + 1 if key == last else 0
                last = key
                for k, v in enumerate((key, ordinal, ids, n)):
                    held[k].append(v)
                tokens += n
                if len(held[0]) >= block_docs or tokens >= block_tokens:
                    yield from flush()
        yield from flush()

    return materialize(spread.mapInArrow(run, BLOCKS), "token-files", compression="uncompressed")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def lookup(row: dict, keys: np.ndarray, ordinals: np.ndarray, n_null: int = 0) -> list[np.ndarray | None]:
    """The ids of keys in one file; None for a key that it does not hold."""
    n = row["n_docs"]
    h = hashed_keys(np.asarray(keys, "<i8"), np.asarray(ordinals, "<u4"), n_null)
    slot = PerfectHash(np.frombuffer(row["seeds"], "<i4"), n).slots(h)
    prints, at, size = (np.frombuffer(row[c], "<u4") for c in ("prints", "offsets", "lengths"))
    ids = np.frombuffer(row["payload"], f"<u{row['width']}")
    known = prints[slot] == prints_of(h)
    return [ids[at[s] : at[s] + size[s]] if ok else None for s, ok in zip(slot, known, strict=True)]


def with_first_token(files: DataFrame) -> DataFrame:
    """first_token: ids before the block. Only the shards' sums are joined, a row a shard; the payload stays where it is read."""
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("_t"))
    earlier = F.coalesce(F.sum("_t").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sums.select("shard", earlier.alias("_earlier")))
    return files.join(starts, "shard").withColumn("first_token", F.col("_earlier") + F.col("before")).drop("_earlier")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, each looked up by its key through the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                keys, ords = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["ordinals"], "<u4")
                ids = lookup(row, keys, ords, row["n_null"])
                n = np.array([len(x) for x in ids], np.int64)
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=np.arange(len(keys)) < row["n_null"]), pa.array(row["first_token"] + np.cumsum(n) - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return with_first_token(files).mapInArrow(run, READ)


FOUND = "doc_id long, ordinal long, n_tokens long, ids array<long>"


def find(files: DataFrame, keys: DataFrame) -> DataFrame:
    """The ids of the documents in keys (doc_id, and ordinal if it has that column: 0 for the first row of a doc_id). One row a row of keys whose
    document is there; null doc_ids are not looked for.

    Keys and the blocks' first keys are put in one order within a shard, where each key follows its block; the key's shard is told from
    the shards' first keys, a row a shard. Payloads stay in place if few blocks are asked for, and meet their keys by a join otherwise."""
    ordinal = F.col("ordinal").cast("long") if "ordinal" in keys.columns else F.lit(0).cast("long")
    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id"), ordinal.alias("ordinal")).where("doc_id IS NOT NULL")
    starts = files.where("first_key IS NOT NULL").select("shard", "block", F.col("first_key").alias("k"), F.col("first_ordinal").alias("o"), (F.col("n_docs") - F.col("n_null")).alias("docs"))
    shards = starts.groupBy("shard").agg(F.min("k").alias("k"), F.sum("docs").alias("docs")).orderBy("shard").collect()  # a row a shard
    if not shards:
        return keys.sparkSession.createDataFrame([], FOUND)
    # only a doc_id with shards of its own is in several; ordinals go on from shard to shard
    before, bases = {}, []
    for r in shards:
        bases.append(before.get(r.k, 0))
        before[r.k] = bases[-1] + r.docs

    def shard_of(low: int, high: int) -> F.Column:
        """The last shard that does not begin after the key, and the ordinal it begins with."""
        if low == high:
            return F.struct(F.lit(shards[low].shard).alias("shard"), F.lit(bases[low]).cast("long").alias("base"))
        mid = (low + high + 1) // 2
        k = F.lit(shards[mid].k)
        after = (F.col("doc_id") > k) | (F.col("doc_id") == k) & (F.col("ordinal") >= F.lit(bases[mid]))
        return F.when(after, shard_of(mid, high)).otherwise(shard_of(low, mid - 1))

    both = asked.withColumn("s", shard_of(0, len(shards) - 1)).select("s.shard", F.col("doc_id").alias("k"), (F.col("ordinal") - F.col("s.base")).alias("o"), "s.base", F.lit(None).cast("int").alias("block"))
    order = Window.partitionBy("shard").orderBy("k", "o", F.col("block").asc_nulls_last())
    all_ = starts.select("shard", "k", "o", F.lit(0).cast("long").alias("base"), "block").unionByName(both)
    placed = all_.select("*", F.last("block", ignorenulls=True).over(order).alias("own")).where("block IS NULL AND own IS NOT NULL")
    wanted = placed.groupBy("shard", F.col("own").alias("block")).agg(F.collect_list(F.struct("k", "o", "base")).alias("wanted"))
    columns = ["n_docs", "seeds", "prints", "offsets", "lengths", "width", "payload", "wanted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                at = row["wanted"]
                ids = lookup(row, np.array([x["k"] for x in at], "<i8"), np.array([x["o"] for x in at], "<u4"))
                rows = [(x["k"], x["o"] + x["base"], len(i), i.astype(np.int64)) for x, i in zip(at, ids, strict=True) if i is not None]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64()] * 3 + [pa.list_(pa.int64())])], ["doc_id", "ordinal", "n_tokens", "ids"])

    return files.join(wanted, ["shard", "block"]).select(columns).mapInArrow(run, FOUND)
