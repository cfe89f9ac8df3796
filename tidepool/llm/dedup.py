"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

A permutation of the shingle hashes gives two signature values, the minimum and the maximum, so PERMUTATIONS hash evaluations a shingle
give twice as many values. Each matches with the probability of the Jaccard index. Bands of values (minima and maxima of the same
permutations) are bucket keys. There are so many bands that a pair just at the threshold misses all of them with a chance of MISSES at most (0.85: 40
bands of 8 values; 0.80: 70 of 8), and one well above it never in practice. Sets of a few shingles miss more often, as the minimum and the maximum of so
few depend on each other: at 0.80 up to 6 in 100,000, for 4 shingles against 5.

1. Documents with equal sets are one class, represented by the least doc_id; copies go no further.
2. In each bucket of two or more classes each class is compared with the bucket's least one: a star, not all pairs.
3. Components of the confirmed links. Buckets that lie in one component are done, however large. In the others (open ones) the component with most
   members is the major one. As long as an open bucket has more than a block of other members, there is another round of stars: the least of
   these members of which no star was made yet is compared with all of the bucket, up to STARS rounds.
4. In buckets that are still open, pairs of different components that a sketch of the signature cannot rule out are compared in the bucket
   itself, so no link between different texts is lost and no pair is written. Only members of such pairs bring their sets. A bucket is dealt out in blocks of bounded rows and bytes, the
   major component's apart from the others; pairs of blocks of the major component need no look. So a bucket of m members of which few are
   not in its major component costs in proportion to m.
5. Components of all links.

A link is confirmed on the full sets of 64-bit shingle hashes, computed again from the whole texts of the classes that share a bucket.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import documents_of, materialize
from tidepool.llm.components import components

SHINGLE = 5
#: Bands have up to ROWS values, and fewer where more than MOST_BANDS would be needed; LEAST_BANDS also fill the sketch.
ROWS, LEAST_BANDS, MOST_BANDS = 8, 40, 80
MISSES = 3e-6
SKETCH = 160
#: A pair is compared if its sketches differ from what a link at the threshold would show by no more deviations than this.
DEVIATIONS = 6.7
#: Members, and shingles, of a bucket's block.
BLOCK, BLOCK_SHINGLES = 500, 1 << 19
#: Rounds of further stars in open buckets.
STARS = 6
_C = np.random.default_rng(20240607)
_MULT = _C.integers(0, 2**32, 160, dtype=np.uint32) | np.uint32(1)
_ADD = _C.integers(0, 2**32, 160, dtype=np.uint32)
_POS = _C.integers(0, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_BAND = _C.integers(0, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@cache
def layout(percent: int) -> tuple[int, int]:
    """Bands, and values in each, for links of percent."""
    for rows in range(ROWS, 0, -2):
        hit = (percent / 100) ** rows
        bands = max(LEAST_BANDS * ROWS // rows, math.ceil(math.log(MISSES) / math.log1p(-hit)) if hit < 1 else 0)
        if bands * rows <= MOST_BANDS * ROWS:
            break
    return bands, rows


@cache
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of n permutations; the first ones are the same for all n."""
    more = np.random.default_rng(20240608).integers(0, 2**32, (max(0, n - len(_MULT)), 2), dtype=np.uint32)
    return np.concatenate([_MULT, more[:, 0] | np.uint32(1)])[:n, None], np.concatenate([_ADD, more[:, 1]])[:n, None]


def sketch_bound(percent: int) -> int:
    """The least number of equal bytes in the sketches of a pair that is compared."""
    p = percent / 100
    return math.ceil(SKETCH * math.floor(100 * (p - DEVIATIONS * math.sqrt(p * (1 - p) / SKETCH))) / 100)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K1
    x = (x ^ (x >> np.uint64(27))) * _K2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; one for fewer words; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))[ids]
    n = len(words) - SHINGLE + 1
    with np.errstate(over="ignore"):
        if n < 1:
            short = np.uint64(len(words)) + sum((_mix(h + _POS[k]) * _POS[k] for k, h in enumerate(hashes)), np.uint64(0))
            return _mix(np.array([short], np.uint64) + np.uint64(1))
        total = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            total += _mix(hashes[k : k + n] + _POS[k]) * _POS[k]
        return np.unique(_mix(total))


def set_key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """Minima, then maxima, of n permutations."""
    mult, add = permutations(n)
    low = np.full(n, 0xFFFFFFFF, np.uint32)
    high = np.zeros(n, np.uint32)
    # only minima and maxima matter, so many shingles are taken in steps
    base = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(base), 1024):
        v = base[None, at : at + 1024] * mult
        v += add
        np.minimum(low, v.min(1), out=low)
        np.maximum(high, v.max(1), out=high)
    return np.concatenate([low, high])


def bands_of(values: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band, from half as many minima and as many maxima."""
    v = np.concatenate([x.reshape(bands, -1) for x in np.split(values, 2)], 1).astype(np.uint64)
    place = _BAND[: v.shape[1]]
    with np.errstate(over="ignore"):
        return _mix((_mix(v + place) * place).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _K2).view(np.int64)


SIGNED = "doc_id long, mark long, n_shingles long, set_key binary, bands array<long>, sketch binary"


def signed(docs: DataFrame, least: int, percent: int) -> DataFrame:
    """Set size, set key, band keys and sketch. mark: a hash of the text, which with the doc_id finds it again. Sets below least shingles link with
    equal sets alone: no bands."""
    count, rows = layout(percent)
    n_permutations = count * rows // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n, keys, bands, sketches = [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set(text)
                    n.append(len(s))
                    keys.append(set_key(s))
                    if len(s) < least:
                        bands.append([])
                        sketches.append(None)
                        continue
                    values = signature(s, n_permutations)
                    bands.append(bands_of(values, count))
                    sketches.append((values[:: len(values) // SKETCH][:SKETCH] >> np.uint32(11)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "mark", "n_shingles", "set_key", "bands", "sketch"])

    return docs.select("doc_id", "text", "mark").mapInArrow(run, SIGNED)


def sets_of(docs: DataFrame) -> DataFrame:
    """node, shingles: the hashes as signed numbers, in the order of the unsigned ones. docs: node, text, set_key; rows whose set is another than that go, if there is a set_key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [(node, shingle_set(t), key) for node, t, key in zip(*[part.column(k).to_pylist() for k in range(3)], strict=True)]
                found = [(node, own) for node, own, key in found if key is None or set_key(own) == key]
                ends = pa.array(np.cumsum([0, *[len(own) for _, own in found]]), pa.int32())
                flat = np.concatenate([np.zeros(0, np.uint64), *[own for _, own in found]]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([node for node, _ in found], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat))], ["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= percent * union, a pair at a time: sets of long texts are never held by the thousand."""
    joined = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v")
    common = F.size(F.array_intersect("su", "sv"))
    return joined.where(100 * common >= percent * (F.size("su") + F.size("sv") - common)).select("u", "v")


def n_common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets that are not empty."""
    if len(a) < len(b):
        a, b = b, a
    at = a.searchsorted(b)
    at[at == len(a)] = 0
    return int(np.count_nonzero(a[at] == b))


@dataclass
class Bucket:
    """The members of a bucket, or of a pair of its blocks (across), in order of node, as columns; sets: places of their shingles, if they brought them."""

    node: np.ndarray
    component: np.ndarray
    n: np.ndarray
    block: np.ndarray
    earlier: np.ndarray
    sketch: np.ndarray
    sets: list[np.ndarray]
    across: bool
    percent: int

    def partners(self, k: int, bound: int) -> np.ndarray:
        """Later members of other components that sizes and sketches do not rule out as links of member k. A pair that shares several bands is looked at in the first of
        them alone."""
        n, m = self.n, np.arange(k + 1, len(self.node))
        m = m[(self.component[m] != self.component[k]) & (100 * np.minimum(n[m], n[k]) >= self.percent * np.maximum(n[m], n[k]))]
        if self.across and len(m):
            m = m[self.block[m] != self.block[k]]
        if len(m):
            m = m[(self.sketch[m] == self.sketch[k]).sum(1) >= bound]
        return m[~(self.earlier[m] == self.earlier[k]).any(1)] if len(m) else m


def members_in_doubt(bucket: Bucket, bound: int) -> np.ndarray:
    """The members that have a partner: only their sets need to be compared."""
    found = np.zeros(len(bucket.node), bool)
    for k in range(len(found) - 1):
        m = bucket.partners(k, bound)
        found[m] = True
        found[k] |= len(m) > 0
    return found


def links_in_bucket(bucket: Bucket, bound: int) -> list[tuple[int, int]]:
    """Links between different components, confirmed on the full sets."""
    node, component, n, out = bucket.node, bucket.component.copy(), bucket.n, []
    for k in range(len(node) - 1):
        for v in bucket.partners(k, bound).tolist():
            if component[v] != component[k]:
                common = n_common(bucket.sets[k], bucket.sets[v])
                if 100 * common >= bucket.percent * (n[k] + n[v] - common):
                    out.append((node[k], node[v]))
                    component[component == component[v]] = component[k]
    return out


MEMBERS = ["key", "low", "high", "node", "n", "component", "own", "band", "bands", "sketch"]


def buckets_of(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[tuple[int, int, int], Bucket]]:
    """The buckets of rows (MEMBERS, and shingles or not) that lie in order of key, low, high and node. A bucket may begin in one batch and end in another."""

    def of_table(t: pa.Table, starts: list[int]) -> Iterator[tuple[tuple[int, int, int], Bucket]]:
        t = t.combine_chunks()
        key, low, high, node, n, component, own, band = (t.column(c).to_numpy() for c in MEMBERS[:8])
        one = lambda c: t.column(c).chunk(0)
        bands = one("bands").flatten().to_numpy().reshape(t.num_rows, -1)
        sketch = np.frombuffer(b"".join(one("sketch").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        sets = None
        if "shingles" in t.column_names:
            ends = one("shingles").offsets.to_numpy() - one("shingles").offsets[0].as_py()
            flat = one("shingles").flatten().to_numpy().view(np.uint64)
            sets = [flat[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for a, b in zip(starts, [*starts[1:], t.num_rows], strict=True):
            if b - a > 1:
                at = slice(a, b)
                yield (int(key[a]), int(low[a]), int(high[a])), Bucket(node[at], component[at], n[at], own[at], bands[at, : band[a]], sketch[at], sets[at] if sets else [], bool(low[a] != high[a]), percent)

    rest: list[pa.RecordBatch] = []  # of the last bucket, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([*rest, batch])
        places = np.stack([t.column(c).to_numpy() for c in MEMBERS[:3]])
        starts = [0, *(np.flatnonzero((places[:, 1:] != places[:, :-1]).any(0)) + 1).tolist()]
        if starts[-1]:
            yield from of_table(t.slice(0, starts[-1]), starts[:-1])
        rest = t.slice(starts[-1]).to_batches()
    if rest:
        yield from of_table(pa.Table.from_batches(rest), [0])


def open_buckets(labelled: DataFrame) -> DataFrame:
    """key, major (the component with most members), others (members not in it), and the blocks that both need, of buckets that lie in several
    components. Counts are by component first, so a large bucket is no task's alone."""
    parts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    best = F.max(F.struct("m", F.col("component").alias("major"), "s"))
    found = parts.groupBy("key").agg(best.alias("best"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("parts")).where("parts > 1")

    def blocks(members: F.Column, shingles: F.Column) -> F.Column:
        return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")

    return found.select("key", "best.major", (F.col("m") - F.col("best.m")).alias("others"), blocks(F.col("best.m"), F.col("best.s")).alias("majors"), blocks(F.col("m") - F.col("best.m"), F.col("s") - F.col("best.s")).alias("minors"))


def in_blocks(members: DataFrame) -> DataFrame:
    """Each member of an open bucket with its own block, once for each pair of blocks (low, high) that needs a look. The major component's blocks come first."""
    is_major = F.col("component") == F.col("major")
    hashed = F.xxhash64("node")
    own = F.when(is_major, F.pmod(hashed, F.col("majors").cast("long"))).otherwise(F.col("majors") + F.pmod(hashed, F.col("minors").cast("long"))).cast("int")
    last = F.col("majors") + F.col("minors") - 1
    others = F.sequence(F.when(is_major, F.col("majors")).otherwise(F.lit(0)), last)
    dealt = members.withColumn("own", own).withColumn("other", F.explode(others))
    return dealt.select("key", "band", "node", "n", "component", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def doubtful(members: DataFrame, percent: int) -> DataFrame:
    """key, low, high, node of the members that sketches leave in doubt."""
    bound = sketch_bound(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int32(), pa.int32(), pa.int64()])], MEMBERS[:4])
            rows.clear()
            return out

        for place, bucket in buckets_of(batches, percent):
            rows += [(*place, v) for v in bucket.node[members_in_doubt(bucket, bound)].tolist()]
            if len(rows) > 10_000:
                yield batch()
        yield batch()

    return in_order(members).mapInArrow(run, "key long, low int, high int, node long")


def linked(members: DataFrame, percent: int) -> DataFrame:
    """u, v: the links within each bucket. members: with shingles."""
    bound = sketch_bound(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, bucket in buckets_of(batches, percent):
            if found := links_in_bucket(bucket, bound):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])

    return in_order(members).mapInArrow(run, "u long, v long")


def in_order(members: DataFrame) -> DataFrame:
    """Each bucket, or pair of its blocks, in one partition and in order of node."""
    more = [c for c in ("shingles",) if c in members.columns]
    own = members.select(*MEMBERS, *more)
    partitions = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return own.repartition(partitions, "key", "low", "high").sortWithinPartitions("key", "low", "high", "node")


def near_duplicates(df: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a row of df.

    Null or empty texts, and texts of white space, have no shingles and are linked with nothing. Other rows with one doc_id count as one document, whose
    texts are all linked with each other. A null doc_id is linked with nothing, has no component and is kept. An empty table gives no rows; other columns are ignored.
    """
    docs = documents_of(df).withColumn("mark", F.xxhash64("text"))
    # below this size two different sets cannot share enough
    least = next(n for n in range(1, 1000) if 100 * n >= percent * (n + 1))
    rows = materialize(signed(docs, least, percent), "signed")
    known = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    repeated = materialize(known.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    repeats = repeated.limit(1).count() > 0
    # a class is known by its least doc_id; where one doc_id has several texts, by a number that its row gets when it is written
    found = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "mark")).alias("r")).select("set_key", "r.doc_id", "r.mark")
    classes = materialize(found.withColumn("node", F.monotonically_increasing_id() if repeats else F.col("doc_id")), "classes")
    # a representative's own row has its bands, so they don't move with the aggregate
    reps = known.join(classes, ["set_key", "doc_id", "mark"]).where(F.col("n_shingles") >= least).select("node", "set_key", "doc_id", "mark", F.col("n_shingles").alias("n"), "bands", "sketch")
    reps = materialize(reps.dropDuplicates(["node"]) if repeats else reps, "representatives")
    keys = reps.select("node", "n", F.posexplode("bands").alias("band", "key"))
    heads = keys.groupBy("key").agg(F.min(F.struct("node", "n")).alias("head"), F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    buckets = materialize(keys.join(heads, "key"), "buckets")
    fits = 100 * F.least(F.col("n"), F.col("head.n")) >= percent * F.greatest(F.col("n"), F.col("head.n"))
    stars = buckets.where((F.col("node") != F.col("head.node")) & fits).select(F.col("head.node").alias("u"), F.col("node").alias("v")).distinct()

    # written, so that Spark knows its size and sends it to the texts if it is small
    if repeats:
        members = materialize(reps.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "mark", "set_key"), "members")
        sets = sets_of(docs.join(members, ["doc_id", "mark"]).select("node", "text", "set_key")).dropDuplicates(["node"])
    else:
        members = materialize(buckets.select("node").distinct(), "members")
        sets = sets_of(docs.join(members, F.col("doc_id") == F.col("node"), "left_semi").select("doc_id", "text", F.lit(None).cast("binary")))
    sets = materialize(sets, "shingles")
    links = materialize(confirmed(stars, sets, percent), "links-0")
    label = F.coalesce(F.col("component"), F.col("node"))
    used = heads.select("key", F.col("head.node").alias("node"))
    for k in range(1, STARS + 1):
        labelled = buckets.select("key", "band", "node", "n").join(components(links), "node", "left").select("key", "band", "node", "n", label.alias("component"))
        open_ = materialize(open_buckets(labelled), "open")
        if k == STARS or not open_.where(F.col("others") > BLOCK).limit(1).count():
            break
        wide = labelled.join(open_.where(F.col("others") > BLOCK).select("key", "major"), "key")
        fresh = wide.where(F.col("component") != F.col("major")).join(used, ["key", "node"], "left_anti").groupBy("key").agg(F.min(F.struct("node", "n", "component")).alias("head"))
        used = materialize(used.unionByName(fresh.select("key", F.col("head.node").alias("node"))), "stars")
        stars = wide.join(fresh, "key").where(fits & (F.col("component") != F.col("head.component"))).select(F.col("head.node").alias("u"), F.col("node").alias("v")).distinct()
        links = materialize(links.unionByName(confirmed(stars, sets, percent)), f"links-{k}")

    blocks = materialize(in_blocks(labelled.join(open_, "key")), "blocks")
    place = ["key", "low", "high", "node"]
    # sets are long and few of them are in doubt: first who has a partner at all, by sketches, then sets of these alone
    doubt = materialize(doubtful(blocks.join(reps.select("node", "sketch", "bands"), "node"), percent), "doubt")
    full = reps.select("node", "sketch", "bands").join(sets, "node")
    dealt = blocks.join(doubt, place, "left_semi").join(full, "node")
    links = links.unionByName(materialize(linked(dealt, percent), "links"))
    if repeats:
        own = known.join(repeated, "doc_id", "left_semi").select("doc_id", "set_key").distinct().join(classes.select("set_key", "node"), "set_key")
        first = own.groupBy("doc_id").agg(F.min("node").alias("u"))
        links = links.unionByName(own.join(first, "doc_id").where("u <> node").select("u", F.col("node").alias("v")))
    labels = classes.join(components(links), "node", "left").select("set_key", "doc_id", label.alias("component_id"))
    if repeats:
        labels = labels.join(labels.groupBy("component_id").agg(F.min("doc_id").alias("least")), "component_id").select("set_key", F.col("least").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(labels.select("set_key", "component_id"), "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
