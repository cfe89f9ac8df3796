"""Facts that a model has found in texts, stored as memories, with edges from the memories that they supersede.

A fact supersedes an older memory whose text holds its subject and its relation. Which texts hold them is a substring join, done without comparing every
subject with every text: facts are short and go to the tasks, in blocks, and each text is read once a block, where it lies. Each needle is looked up by the rarest of its grams
(runs of GRAM bytes; a shorter needle is its own gram): a text's grams are numbers, found by one look into a table, and only needles whose gram is there are looked for themselves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import text as tx
from tidepool.operators.search import in_blocks, spread
from tidepool.sources.folder import written

#: Bytes of a gram: at most eight, a number of 64 bits. Facts that are looked for at once. Bits of the table in which a gram is looked up first.
GRAM, MOST_ASKED, TABLE_BITS = 8, 200_000, 18


def codes(text: bytes, n: int) -> np.ndarray:
    """The runs of n bytes of a text (eight at most) as numbers, one for each place; none if it is shorter."""
    wide = np.ndarray((max(0, len(text) - n + 1),), "<u8", text + bytes(8), 0, (1,))
    return wide & np.uint64((1 << 8 * n) - 1)


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


class Needles:
    """Short byte strings, all of which are looked for in a text at once. Each is known by the gram that the fewest others have."""

    def __init__(self, needles: list[bytes], gram: int):
        self.needles = needles
        own = [np.unique(codes(x, min(len(x), gram))).tolist() for x in needles]
        often = Counter((min(len(x), gram), g) for x, grams in zip(needles, own, strict=True) for g in grams)
        best = [min(grams, key=lambda g, n=min(len(x), gram): often[n, g]) for x, grams in zip(needles, own, strict=True)]
        self.tables = []
        for n in sorted({min(len(x), gram) for x in needles}):
            of = np.array([k for k, x in enumerate(needles) if min(len(x), gram) == n])
            of = of[np.argsort(np.array([best[k] for k in of], np.uint64), kind="stable")]
            grams, starts = np.unique(np.array([best[k] for k in of], np.uint64), return_index=True)
            known = np.zeros(1 << TABLE_BITS, bool)
            known[_slots(grams)] = True
            self.tables.append((n, grams, np.append(starts, len(of)), of, known))

    def within(self, text: bytes) -> np.ndarray:
        """The numbers of the needles that the text holds, each once."""
        found = []
        for n, grams, starts, of, known in self.tables:
            here = codes(text, n)
            here = here[known[_slots(here)]]
            at = np.minimum(np.searchsorted(grams, here), len(grams) - 1)
            for g in np.unique(at[grams[at] == here]).tolist():
                found += [k for k in of[starts[g] : starts[g + 1]].tolist() if len(self.needles[k]) == n or self.needles[k] in text]
        return np.array(found, np.int64)


def _in_texts(texts: DataFrame, asked: list[tuple[str, str, object]], kind: str, gram: int, only: Callable[[np.ndarray, int], np.ndarray] | None = None) -> DataFrame:
    """name, id of each text that holds both parts of what is asked (part, part, name); an empty second part is in every text. only(names, id): which names count for an id."""
    numbers = {x: k for k, x in enumerate(sorted({x for a, b, _ in asked for x in (a, b)} - {""}))}
    needles, often = [x.encode() for x in numbers], Counter(numbers[x] for a, b, _ in asked for x in {a, b} if x)
    # a row is looked up by the part that fewer rows have, and its other part then asked for; the last number stands for no part
    pairs = [(numbers[a], numbers[b] if b else len(numbers)) for a, b, _ in asked]
    pairs = [(b, a) if b < len(numbers) and often[b] < often[a] else (a, b) for a, b in pairs]
    order = sorted(range(len(asked)), key=lambda k: pairs[k][0])
    key, other = np.array([pairs[k][0] for k in order], np.int64), np.array([pairs[k][1] for k in order], np.int64)
    starts = np.searchsorted(key, np.arange(len(numbers) + 1))
    names = np.array([asked[k][2] for k in order], object if kind == "string" else np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = Needles(needles, gram), np.zeros(len(needles) + 1, bool)
        held[-1] = True
        for b in batches:
            out, ids, sizes = [], b.column(0).to_numpy(zero_copy_only=False), []
            for i, text in zip(ids.tolist(), b.column(1), strict=True):
                own = known.within(text.as_py())
                held[own] = True
                many = starts[own + 1] - starts[own]
                rows = np.arange(many.sum()) + np.repeat(starts[own] + many - np.cumsum(many), many)
                hits = names[rows[held[other[rows]]]]
                out.append(hits if only is None else hits[only(hits, i)])
                held[own] = False
                sizes.append(len(out[-1]))
                if sum(sizes) > 1 << 16:
                    yield made(out, ids[: len(sizes)], sizes)
                    ids, out, sizes = ids[len(sizes) :], [], []
            yield made(out, ids, sizes)

    def made(out: list[np.ndarray], ids: np.ndarray, sizes: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([names[:0], *out]), pa.string() if kind == "string" else pa.int64()), pa.array(np.repeat(ids, sizes))], ["name", "id"])

    read = texts.where("low IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("low").cast("binary").alias("low"))
    return spread(read).mapInArrow(run, f"name {kind}, id long")


def containing(texts: DataFrame, needles: DataFrame, gram: int = GRAM) -> DataFrame:
    """needle, id of all texts that hold the needle. texts: id, low (null: holds nothing); needles: needle, distinct; null and empty ones are in nothing."""
    known = needles.where(F.length("needle") > 0).select("needle", F.xxhash64("needle").alias("query_id"))
    answer = lambda part: _in_texts(texts, [(r.needle, "", r.needle) for r in part.select("needle").collect()], "string", gram)  # noqa: E731  MOST_ASKED or so at most
    return in_blocks(known, F.lit(1), MOST_ASKED, answer, "holding").select(F.col("name").alias("needle"), "id")


def older_holding(texts: DataFrame, asked: DataFrame, gram: int = GRAM) -> DataFrame:
    """source_id, target_id: the texts with a smaller id that hold both the needle and the relation of target_id. asked: target_id, needle, relation; null ones and an empty needle are in
    nothing, an empty relation is in every text."""
    known = asked.where((F.length("needle") > 0) & F.col("relation").isNotNull()).withColumn("query_id", F.col("target_id"))
    answer = lambda part: _in_texts(texts, [(r.needle, r.relation, r.target_id) for r in part.collect()], "long", gram, lambda names, i: names > i)
    return in_blocks(known, F.lit(1), MOST_ASKED, answer, "holding").select(F.col("id").alias("source_id"), F.col("name").alias("target_id"))


def numbered(rows: DataFrame, order: list[str], first: int) -> DataFrame:
    """rows with id: numbers from first on in the order given. Ranges of the order are counted, and only their counts, a row a range, are summed in one task."""
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    dealt = dealt.select("*", F.shiftright("_at", 33).alias("_range"), F.expr("_at & 8589934591").alias("_place"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return dealt.join(starts, "_range").withColumn("id", F.lit(first) + F.col("_start") + F.col("_place")).drop("_at", "_range", "_place", "_start")


def store_facts(memories: DataFrame, facts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new memories, the edges (source_id superseded_by target_id), and one row of counts.

    Facts are taken in order of id and line. One whose text is that of a memory, or of an earlier fact, is a duplicate and not stored. Ids go on from the greatest one. An edge
    leads from each older memory, an earlier fact of the same call among them, whose text holds a fact's subject and its relation, case and underscores aside. facts:
    as ingest.parse_facts() gives them; those without text are left out. memories: id, searchable_text."""
    hashed = facts.where(F.length("text") > 0).withColumn("content_hash", tx.content_hash(F.col("text")))
    known = memories.select(tx.content_hash(F.col("searchable_text")).alias("content_hash")).where("content_hash IS NOT NULL").distinct()
    first = hashed.join(known, "content_hash", "left_anti").groupBy("content_hash").agg(F.min(F.struct("id", "line")).alias("_f")).select("content_hash", "_f.id", "_f.line")
    last = memories.agg(F.max("id")).first()[0]
    fresh = hashed.join(first, ["content_hash", "id", "line"]).dropDuplicates(["content_hash"]).withColumnRenamed("id", "source_id")
    stored = written(numbered(fresh, ["source_id", "line"], 1 if last is None else last + 1), "facts")
    details = F.when((F.size("entities") > 0) | (F.size("relationships") > 0), F.to_json(F.struct("entities", "relationships")))
    rows = stored.select("id", F.col("text").alias("searchable_text"), F.lit("semantic").alias("memory_type"), F.col("importance").cast("int").alias("importance"), "category", details.alias("metadata_json"), "content_hash", now.alias("created_at"))

    texts = memories.select("id", F.lower("searchable_text").alias("low")).unionByName(stored.select("id", F.lower("text").alias("low")))
    asked = written(stored.select(F.col("id").alias("target_id"), F.explode("relationships").alias("r")).select("target_id", F.lower("r.subject").alias("needle"), F.lower(F.replace("r.relation", F.lit("_"), F.lit(" "))).alias("relation")).distinct(), "asked")
    edges = written(older_holding(texts, asked).distinct().select("source_id", "target_id", F.lit("superseded_by").alias("relation")), "edges")
    kinds = {"facts_extracted": hashed, "memories_stored": stored, "edges_created": edges}
    tagged = reduce(DataFrame.unionByName, [x.select(F.lit(name).alias("kind")) for name, x in kinds.items()])
    counts = tagged.agg(*[F.count_if(F.col("kind") == name).alias(name) for name in kinds])
    return rows, edges, counts.withColumn("duplicates_skipped", F.col("facts_extracted") - F.col("memories_stored"))
