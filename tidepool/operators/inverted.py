"""An inverted index that lasts: written once, appended by batch, deleted from by a list of ids; searched without reading a text.

Tables in the index's folder, each a folder of Parquet files that append() adds to:

    docs       batch, block, memory_id, size         a row a memory; a block is BLOCK memories of one partition that were added together
    postings   batch, block, term, memory_id, count, size   each file in order of term and block, so that a filter on terms reads few of its row groups; files
               are by memory, so that nothing is shuffled and a frequent word is in all of them (compact() makes ranges of terms)
    blocks     batch, block, term, n, most, least     memories with the term, its greatest count and their least size: no memory of the block scores
               more for the term than these two would; a block that two tasks read has a row of each (of_blocks() adds them up)
    forward    batch, block, memory_id, size, words, line   what docs says, each word with its count, and the text's words in order, by their numbers in words, from 0
    gone       memory_id, before                      rows of batches below before are deleted

top_k() first scores, for each query, the PROBES blocks that could score most; the k-th best score found is a bound, and of the other blocks only those are
read that could reach it. Deleted rows count for nothing: neither as documents nor in a term's frequency.

Many queries together would join the same postings again and again: the rows of that join grow with queries times memories. Where they are more than SCANNED of all postings,
the queries go to the tasks (in blocks) and the forward rows are scored where they are read (scan()); nothing but each task's k best rows of a query is written, and
tasks are TASKS a core at most, whatever the number of files, so that those rows grow with the queries alone. The sums are those of dense.py.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.operators.dense import Asked, Scorer, holds  # noqa: F401
from tidepool.operators.dense import blocks_of as blocks
from tidepool.operators.search import B, K1, LEAST_IDF, TASKS, in_blocks, query_terms, spread, steps_of, top
from tidepool.sources.folder import written

BLOCK, PROBES = 256, 2
SCANNED = 0.25
#: Characters of texts that are cut into words at once.
AT_ONCE = 1 << 21
#: Leaves of the queries that are answered at once.
MOST_TERMS = 200_000
#: Deletions that are sent to the rows at most: 12 MB of numbers.
SENT_ROWS = 1 << 20
_BLANK = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
WORDS = "block long, memory_id long, size int, words array<struct<term:string,count:int>>, line array<int>"
SCHEMAS = {
    "docs": "batch int, block long, memory_id long, size int",
    "postings": "batch int, block long, term string, memory_id long, count int, size int",
    "blocks": "batch int, block long, term string, n long, most int, least int",
    "forward": "batch int, block long, memory_id long, size int, words array<struct<term:string,count:int>>, line array<int>",
    "gone": "memory_id long, before int",
}


def words_of(memories: DataFrame, batch: int) -> DataFrame:
    """A row a memory: its block, its size, its words in alphabetical order, and the text as their numbers. Words are lower-case runs of ASCII letters and digits."""

    entry = pa.struct([("term", pa.string()), ("count", pa.int32())])

    def made(block: int, rows: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        for low, high in steps_of(np.array([len(text) for _, text in rows]), AT_ONCE):
            texts = pa.array([text.lower().encode("ascii", "replace").translate(_BLANK).strip().decode() for _, text in rows[low:high]], pa.string())
            words = pc.ascii_split_whitespace(texts)
            size = np.where(pc.binary_length(texts).to_numpy() > 0, pc.list_value_length(words).to_numpy(), 0)
            flat = words.flatten()
            coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            place = np.zeros(len(order), np.int64)
            place[order] = np.arange(len(order))
            doc = np.repeat(np.arange(high - low), size)
            own, line, counts = np.unique(doc * len(order) + place[coded.indices.to_numpy()], return_inverse=True, return_counts=True)
            ends = np.searchsorted(own, np.arange(high - low + 1) * len(order))
            terms = coded.dictionary.take(pa.array(order[own % max(1, len(order))]))
            entries = pa.StructArray.from_arrays([terms, pa.array(counts.astype(np.int32))], fields=list(entry))
            lines = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array((line - ends[doc]).astype(np.int32)))
            columns = [pa.array([block] * (high - low), pa.int64()), pa.array([i for i, _ in rows[low:high]], pa.int64()), pa.array(size, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries), lines]
            yield pa.RecordBatch.from_arrays(columns, ["block", "memory_id", "size", "words", "line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = (batch << 44) + (TaskContext.get().partitionId() << 24), []
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                rows += zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                while len(rows) >= BLOCK:
                    yield from made(block, rows[:BLOCK])
                    block, rows = block + 1, rows[BLOCK:]
        if rows:
            yield from made(block, rows)

    texts = memories.select(F.col("id").cast("long").alias("memory_id"), F.coalesce(F.col("searchable_text"), F.lit("")).alias("text"))
    # a shuffle of the texts would take as much disk as they do: only if less than half of the cores had any
    return spread(texts, 0.5).mapInArrow(run, WORDS)


def blocks_of(forward: DataFrame) -> DataFrame:
    """What blocks says of forward rows: they lie by block, so nothing is shuffled."""

    def summed(block: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        many = pc.list_value_length(rows["terms"]).to_numpy()
        flat = pa.table({"term": pc.list_flatten(rows["terms"]), "count": pc.list_flatten(rows["counts"]), "size": np.repeat(rows["size"].to_numpy(), many)})
        of_term = flat.group_by("term").aggregate([("count", "count"), ("count", "max"), ("size", "min")])
        columns = [of_term.column(c).combine_chunks() for c in ("term", "count_count", "count_max", "size_min")]
        return pa.RecordBatch.from_arrays([pa.array([block] * len(of_term), pa.int64()), *columns], ["block", "term", "n", "most", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []
        for b in batches:
            own = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for low, high in zip(cuts, cuts[1:]):
                if high > low and own[low] != block:
                    if parts:
                        yield summed(block, parts)
                    block, parts = int(own[low]), []
                if high > low:
                    parts.append(b.slice(low, high - low))
        if parts:
            yield summed(block, parts)

    rows = forward.select("block", "size", F.col("words.term").alias("terms"), F.col("words.count").alias("counts"))
    return rows.mapInArrow(run, "block long, term string, n long, most int, least int")


def of_blocks(blocks: DataFrame) -> DataFrame:
    """One row a block and term."""
    return blocks.groupBy("block", "term").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("least").alias("least"))


@dataclass
class Index:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        """One of the five tables; empty before anything was written."""
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMAS[name])

    def add(self, df: DataFrame, name: str) -> None:
        df.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in SCHEMAS[name].split(", ")]).write.mode("append").option("compression", "zstd").parquet(f"{self.path}/{name}")

    def next_batch(self) -> int:
        last = self.table("docs").agg(F.max("batch")).first()[0]
        return 0 if last is None else last + 1

    def append(self, memories: DataFrame) -> None:
        """Adds memories (id, searchable_text). A null text has no words. An id that is there already is a second row of it: use replace()."""
        batch = self.next_batch()
        self.add(words_of(memories, batch).withColumn("batch", F.lit(batch)), "forward")
        found = self.table("forward").where(F.col("batch") == batch)
        self.add(found.select("batch", "block", "memory_id", "size", F.inline("words")).sortWithinPartitions("term", "block", "memory_id"), "postings")
        self.add(blocks_of(found).withColumn("batch", F.lit(batch)).sortWithinPartitions("term", "block"), "blocks")
        self.add(found, "docs")  # last: what is not in docs is of no search

    def delete(self, ids: DataFrame) -> None:
        """Deletes the rows of ids (id) that are there now; ids that are added later count again."""
        self.add(ids.select(F.col("id").cast("long").alias("memory_id"), F.lit(self.next_batch()).alias("before")).distinct(), "gone")

    def replace(self, memories: DataFrame) -> None:
        self.delete(memories.select("id"))
        self.append(memories)

    def live(self, rows: DataFrame) -> DataFrame:
        """rows without deleted ones; where few are, their ids go to the rows, so that these are not shuffled."""
        n = self.table("gone").limit(SENT_ROWS + 1).count()
        if not n:
            return rows
        gone = self.table("gone").groupBy(F.col("memory_id").alias("_id")).agg(F.max("before").alias("_before"))
        gone = F.broadcast(gone) if n <= SENT_ROWS else gone
        return rows.join(gone, (F.col("memory_id") == F.col("_id")) & (F.col("batch") < F.col("_before")), "left_anti")

    def compact(self, path: str) -> "Index":
        """A new index in path, of the live rows alone and in one range of terms; no text is read."""
        new = Index(self.spark, path)
        partitions = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        rows = self.live(self.table("postings")).repartitionByRange(partitions, "term", "block")
        new.add(rows.sortWithinPartitions("term", "block", "memory_id"), "postings")
        new.add(new.table("postings").groupBy("batch", "block", "term").agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most"), F.min("size").alias("least")), "blocks")
        new.add(self.live(self.table("forward")), "forward")
        new.add(self.live(self.table("docs")), "docs")
        return new

    def stats(self) -> tuple[int, float]:
        """Live memories, and their words on average."""
        n, words = self.live(self.table("docs")).agg(F.count(F.lit(1)), F.sum("size")).first()
        return n, words / n if words else 1.0


def gain(count: Column, size: Column, average: float) -> Column:
    return count * (K1 + 1) / (count + K1 * (1 - B + B * size / average))


def weights(frequency: Column, n_docs: int) -> Column:
    return F.greatest(F.log((F.lit(n_docs) - frequency + 0.5) / (frequency + 0.5)), F.lit(LEAST_IDF))


def hits_of(index: Index, asked: DataFrame) -> float:
    """Rows that a join of asked (with term) and the postings has, to all postings."""
    of_term = index.table("blocks").groupBy("term").agg(F.sum("n").alias("df"))
    counts = asked.groupBy("term").count()
    hits, all_ = of_term.join(counts, "term", "left").agg(F.sum(F.col("df") * F.col("count")), F.sum("df")).first()
    return (hits or 0) / all_ if all_ else 0.0


class Leaves:
    """Words, prefixes and phrases (numbered), found in batches of forward rows."""

    def __init__(self, leaves: list[tuple[str, tuple[str, ...]]]):
        of = lambda kind: {words: k for k, (name, words) in enumerate(leaves) if name == kind}
        word, prefix, phrase = of("word"), of("prefix"), of("phrase")
        self.words = (pa.array([w for (w,) in word], pa.string()), np.array(list(word.values()), np.int64))
        self.prefixes = []
        for n in sorted({len(w) for (w,) in prefix}):
            own = {w: k for (w,), k in prefix.items() if len(w) == n}
            self.prefixes.append((n, pa.array(list(own), pa.string()), np.array(list(own.values()), np.int64)))
        # phrases as a tree of their beginnings: at each level the codes of a beginning and its next word, and the phrase that ends there
        vocabulary = sorted({w for words in phrase for w in words})
        self.vocabulary, number = pa.array(vocabulary, pa.string()), {w: k for k, w in enumerate(vocabulary)}
        state, self.levels = {words: number[words[0]] for words in phrase}, []
        for j in range(1, max(map(len, phrase), default=1)):
            longer = [words for words in phrase if len(words) > j]
            codes = {words: state[words] * len(vocabulary) + number[words[j]] for words in longer}
            known = np.unique(np.array(list(codes.values()), np.int64))
            state, ends = {words: int(np.searchsorted(known, code)) for words, code in codes.items()}, np.full(len(known), -1)
            for words in longer:
                if len(words) == j + 1:
                    ends[state[words]] = phrase[words]
            self.levels.append((known, ends))
        self.n = len(leaves)

    def found(self, size: np.ndarray, terms: pa.ListArray, counts: np.ndarray, lines: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, leaf, how often: in order of row and leaf."""
        flat = terms.flatten()
        doc = np.repeat(np.arange(len(size)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        parts = []
        for text, values, numbers in [(flat, *self.words)] + [(pc.utf8_slice_codeunits(flat, 0, n), values, numbers) for n, values, numbers in self.prefixes]:
            at = pc.fill_null(pc.index_in(text, value_set=values), -1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(at >= 0)
            parts.append((doc[hit] * self.n + numbers[at[hit]], counts[hit]))
        if self.levels:
            at = pc.fill_null(pc.index_in(flat, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
            # each row's words in their order, -1 for any that no phrase has, and behind them
            base = np.concatenate([[0], np.cumsum(size + 1)])
            line = np.full(base[-1] + len(self.levels), -1, np.int64)
            row = np.repeat(np.arange(len(size)), size)
            first = np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False)) - pc.list_value_length(terms).to_numpy(zero_copy_only=False)
            line[np.arange(len(row)) + row] = at[first[row] + lines]
            begin = np.flatnonzero(line >= 0)
            state = line[begin]
            for j, (known, ends) in enumerate(self.levels, 1):
                code = state * len(self.vocabulary) + line[begin + j]
                place = np.minimum(np.searchsorted(known, code), len(known) - 1)
                good = (line[begin + j] >= 0) & (known[place] == code)
                begin, state = begin[good], place[good]
                ended = ends[state] >= 0
                row = np.searchsorted(base, begin[ended], "right") - 1
                parts.append((row * self.n + ends[state[ended]], np.ones(len(row), np.int64)))
        key, inverse = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        return key // self.n, key % self.n, np.bincount(inverse, np.concatenate([x for _, x in parts]), len(key)).astype(np.int64)


def scan(index: Index, leaves: DataFrame, k: int, n_docs: int, average: float) -> DataFrame:
    """query_id, memory_id, score: the k best rows of each task. leaves: query_id, leaf (0 to 62 with a tree), kind (word, prefix or phrase), words, tree: null: all leaves have to
    be there, any: one of them, else a tree of holds(), as JSON."""
    return in_blocks(leaves, F.lit(1), MOST_TERMS, lambda part: _scan(index, part, k, n_docs, average), "scanned", k)


def _scan(index: Index, leaves: DataFrame, k: int, n_docs: int, average: float) -> DataFrame:
    asked = leaves.collect()  # MOST_TERMS or so at most
    specs = sorted({(r.kind, tuple(r.words)) for r in asked})
    number, ids = {x: n for n, x in enumerate(specs)}, np.array(sorted({r.query_id for r in asked}), np.int64)
    schema = "query_id long, memory_id long, score double"
    if not asked:
        return index.spark.createDataFrame([], schema)
    trees = sorted({r.tree for r in asked if r.tree is not None})
    leaf, query = np.array([number[r.kind, tuple(r.words)] for r in asked], np.int64), np.searchsorted(ids, np.array([r.query_id for r in asked], np.int64))
    tree, place_of = np.full(len(ids), -1), {None: -1} | {x: n for n, x in enumerate(trees)}
    tree[query] = [place_of[r.tree] for r in asked]
    with_lines = any(kind == "phrase" for kind, _ in specs)
    rows = index.live(index.table("forward")).select("memory_id", "size", F.col("words.term").alias("terms"), F.col("words.count").alias("counts"), *["line"] * with_lines)
    rows = rows.coalesce(TASKS * index.spark.sparkContext.defaultParallelism)

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own = Leaves(specs)
        for whole in batches:
            for low, high in blocks(whole.column(1).to_numpy(zero_copy_only=False)):
                b = whole.slice(low, high - low)
                size = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                yield b, size, *own.found(size, b.column(2), b.column(3).flatten().to_numpy(zero_copy_only=False), b.column(4).flatten().to_numpy(zero_copy_only=False) if with_lines else None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(specs), np.int64)
        for *_, found, _ in parts_of(batches):
            df += np.bincount(found, minlength=len(specs))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df)), pa.array(df[df > 0])], ["leaf", "n"])

    df = np.zeros(len(specs))
    for r in rows.mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # a number for each leaf
        df[r.leaf] = r.n
    idf = np.maximum(np.log((n_docs - df + 0.5) / (df + 0.5)), LEAST_IDF)
    queries = Asked(len(ids), query, leaf, np.array([r.leaf for r in asked], np.int64), tree, [x if x == "any" else json.loads(x) for x in trees], df)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(queries, k)
        for b, size, doc, found, n in parts_of(batches):
            weight = idf[found] * n * (K1 + 1) / (n + K1 * (1 - B + B * size[doc] / average))
            scorer.add(b.column(0).to_numpy(zero_copy_only=False), doc, found, weight)
        held = scorer.rows()
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])], ["query_id", "memory_id", "score"])

    return rows.mapInArrow(score, schema)


def top_k(index: Index, queries: DataFrame, k: int, match_all: bool = False, probes: int = PROBES) -> DataFrame:
    """query_id, memory_id, score, rank: the same rows as search.bm25 gives of the texts. queries: query_id, query."""
    n_docs, average = index.stats()
    asked = written(query_terms(queries, stop_words=not match_all), "asked")
    words = asked.select("term").distinct()
    if hits_of(index, asked) > SCANNED:
        leaves = asked.select("query_id", F.dense_rank().over(Window.partitionBy("query_id").orderBy("term")).alias("leaf"), F.lit("word").alias("kind"), F.array("term").alias("words"), F.lit(None if match_all else "any").cast("string").alias("tree"))
        return top(scan(index, leaves, k, n_docs, average), k)
    rows = index.live(index.table("postings").join(words, "term", "left_semi"))
    # frequencies from the blocks, less what is deleted of these terms
    all_ = index.table("blocks").join(words, "term", "left_semi")
    has_gone = index.table("gone").limit(1).count() > 0
    frequency = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")) if has_gone else all_.groupBy("term").agg(F.sum("n").alias("df"))
    terms = written(asked.join(frequency, "term").select("query_id", "term", "n_terms", weights(F.col("df"), n_docs).alias("idf")), "terms")
    most = F.sum(F.col("idf") * gain(F.col("most"), F.col("least"), average))
    bounds = of_blocks(all_).join(terms, "term").groupBy("query_id", "block").agg(most.alias("bound"), F.count(F.lit(1)).alias("n"), F.first("n_terms").alias("n_terms"))
    bounds = written((bounds.where("n = n_terms") if match_all else bounds).select("query_id", "block", "bound"), "bounds")

    def scored(pairs: DataFrame) -> DataFrame:
        hits = rows.join(terms, "term").join(pairs.select("query_id", "block"), ["query_id", "block"])
        sums = hits.groupBy("query_id", "memory_id").agg(F.round(F.sum(F.col("idf") * gain(F.col("count"), F.col("size"), average)), 6).alias("score"), F.count(F.lit(1)).alias("n"), F.first("n_terms").alias("n_terms"))
        return written(top(sums.where("n = n_terms") if match_all else sums, k).select("query_id", "memory_id", "score"), "scored")

    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
    first = written(bounds.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= probes).select("query_id", "block", "bound"), "probed")
    best = scored(first)
    least = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_least")).where(F.col("_n") == k).select("query_id", "_least")
    others = bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(least, "query_id", "left")
    # rounding may lift a score by half of the last place
    others = written(others.where(F.col("_least").isNull() | (F.col("bound") + 1e-6 >= F.col("_least"))).select("query_id", "block", "bound"), "others")
    return top(best.unionByName(scored(others)), k)


def blocks_read(index: Index, queries: DataFrame, k: int, probes: int = PROBES) -> tuple[int, int]:
    """Blocks that hold a word of a query, and those that top_k() would score, summed over the queries."""
    n_docs, average = index.stats()
    asked = query_terms(queries)
    all_ = index.table("blocks")
    terms = asked.join(all_.groupBy("term").agg(F.sum("n").alias("df")), "term").select("query_id", "term", weights(F.col("df"), n_docs).alias("idf"))
    bounds = of_blocks(all_).join(terms, "term").groupBy("query_id", "block").agg(F.sum(F.col("idf") * gain(F.col("most"), F.col("least"), average)).alias("bound"))
    best = top_k(index, queries, k, probes=probes).groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_least"))
    out = bounds.join(best, "query_id").agg(F.count(F.lit(1)), F.count_if((F.col("_n") < k) | (F.col("bound") + 1e-6 >= F.col("_least")))).first()
    return out[0], out[1]
