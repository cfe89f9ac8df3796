"""Keyword search (BM25), exact vector search, rank fusion: many queries in one job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import text as tx
from tidepool.functions.stem import porter, stem
from tidepool.sources.folder import written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Terms, vector numbers, and best rows of the queries that are answered at once.
MOST_TERMS, MOST_NUMBERS, MOST_HELD = 2_000_000, 8_000_000, 1 << 22
#: Tasks a core that score texts: each writes its k best rows of a query.
TASKS = 2
#: Pairs of a query and a document that a task scores at once, queries of a tile, and stems that a task remembers.
CELLS, TILE, MOST_STEMS = 1 << 21, 1000, 1_000_000
#: Texts that are Python objects at once.
AT_ONCE = 256


def top(candidates: DataFrame, k: int, score: str = "score", by: str = "query_id", key: str = "memory_id") -> DataFrame:
    """The k best of each query, ties by id; with their rank from 1. Spark limits each partition before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(key).asc())
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, stop_words: bool = True) -> DataFrame:
    """query_id, term, n_terms."""
    words = F.array_distinct(tx.tokens(tx.strip_stop_words(tx.sanitize(F.col("query"))) if stop_words else tx.sanitize(F.col("query"))))
    return queries.select("query_id", words.alias("w")).select("query_id", F.explode("w").alias("term"), F.size("w").alias("n_terms"))


def in_blocks(queries: DataFrame, size: Column, most: int, answer: Callable[[DataFrame], DataFrame], name: str, k: int | None = None) -> DataFrame:
    """answer(queries), at once if their sizes add up to no more than most and their k best rows to MOST_HELD, else in so many blocks (by a hash of
    query_id), one after the other, each written to the shared folder: the driver and the tasks hold one block at a time, whatever the number of queries."""
    total, asked = queries.agg(F.coalesce(F.sum(size), F.lit(0)), F.count_distinct("query_id")).first()
    n = max(-(-total // most), -(-asked * (k or 0) // MOST_HELD))
    if n <= 1:
        return answer(queries)
    parts = [written(answer(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b)), f"{name}-{b}") for b in range(n)]
    return reduce(DataFrame.unionByName, parts)


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, ties by id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.searchsorted(query, query)  # of the row's query
    kept = np.arange(len(query)) - first < k
    return query[kept], ids[kept], score[kept]


class Best:
    """The k best rows of each of n queries, as they are found. What is below a query's k-th best is not held."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.n_held, self.parts = k, np.full(n, -np.inf), 0, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.least[query]
        self.parts.append((query[good], ids[good], score[good]))
        self.n_held += int(good.sum())
        if self.n_held > 4 * len(self.parts[0][0]) + CELLS // 8:
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, ids, score = best_of(*[np.concatenate(x) for x in zip(*self.parts, strict=True)], self.k)
        self.parts, self.n_held = [(query, ids, score)], len(query)
        last = np.flatnonzero(np.diff(query, append=-1)) if len(query) else np.zeros(0, np.int64)
        full = last[np.bincount(query, minlength=len(self.least))[query[last]] == self.k]
        self.least[query[full]] = score[full]
        return query, ids, score


def spread(df: DataFrame, share: float = 1.0) -> DataFrame:
    """A table of fewer partitions than there are cores (a file or two), or than a share of them, is dealt out to all of them; any other stays where it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < share * cores else df


#: Bytes that are no letter or digit become blanks; the same words as tokens() makes.
_BLANK = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
POSTINGS = "memory_id long, ok array<boolean>, size int, terms array<int>, counts array<int>"


def postings(memories: DataFrame, terms: list[str], stemmed: bool, where: list[Column]) -> DataFrame:
    """Each memory's words (size), and which of the terms occur in it how often, by number; and which of the conditions it meets (ok). A memory is one
    row, so no word is shuffled. stemmed: terms are stems; each task remembers the stems of the words it has met."""
    number = {t.encode(): n for n, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {} if stemmed else number

        def number_of(word: bytes) -> int:
            if stemmed and word not in known:
                if len(known) > MOST_STEMS:
                    known.clear()
                known[word] = number.get(porter(word.decode()).encode(), -1)
            return known.get(word, -1)

        for b in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, whole.num_rows, AT_ONCE)):
            sizes, found, counts = [], [], []
            for text in b.column(1).to_pylist():
                words = text.lower().encode("ascii", "replace").translate(_BLANK).split()
                sizes.append(len(words))
                code = np.fromiter(map(number_of, words) if stemmed else map(number.get, words, repeat(-1)), np.int32, len(words))
                own, n = np.unique(code[code >= 0], return_counts=True)
                found.append(own)
                counts.append(n)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int32)) if x else pa.array([], pa.int32())) for x in (found, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes, pa.int32()), *lists], ["memory_id", "ok", "size", "terms", "counts"])

    ok = F.array(*[F.coalesce(x, F.lit(False)) for x in where])
    texts = memories.select(F.col("id").cast("long").alias("memory_id"), F.coalesce(F.col("searchable_text"), F.lit("")).alias("text"), ok.alias("ok"))
    return spread(texts).mapInArrow(run, POSTINGS)


def bm25(memories: DataFrame, queries: DataFrame, match_all: bool = False, where: Column | list[Column] | None = None, stemmed: bool = False, k: int | None = None) -> DataFrame:
    """query_id, memory_id, score of all matches, or of the k best of each task (of which top() then takes the best). stemmed: words of one stem are one term.
    where: which memories may match; a list of conditions if each query has its own one's number in a column group.

    The texts are read once, into postings of the queries' terms, which are written. Documents and words in all, and documents with each
    term, are counted there; then each document is scored where its row is read (dense.py, where k is given). Queries with more than MOST_TERMS terms together are answered
    in blocks, those with more than MOST_HELD best rows in rounds over the same postings."""
    terms = query_terms(queries, stop_words=not match_all)
    if stemmed:
        terms = terms.select("query_id", stem(F.col("term")).alias("term")).distinct()
    conditions = where if isinstance(where, list) else [F.lit(True) if where is None else where]
    terms = terms.join(queries.select("query_id", "group"), "query_id") if isinstance(where, list) else terms.withColumn("group", F.lit(0))
    return in_blocks(terms, F.lit(1), MOST_TERMS, lambda part: _bm25(memories, part, match_all, conditions, stemmed, k), "keyword")


def steps_of(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows whose sizes add up to no more than most, or of one row."""
    ends = np.cumsum(sizes)
    out, at = [], 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        out.append((at, end))
        at = end
    return out


def _bm25(memories: DataFrame, asked: DataFrame, match_all: bool, where: list[Column], stemmed: bool, k: int | None) -> DataFrame:
    from tidepool.operators import dense  # which reads this module

    rows = asked.select(F.col("query_id").cast("long").alias("query_id"), "term", F.col("group").cast("int").alias("group")).toArrow()  # MOST_TERMS or so at most
    if not rows.num_rows:
        return memories.select(F.lit(0).cast("long").alias("query_id"), F.col("id").cast("long").alias("memory_id"), F.lit(0.0).alias("score")).limit(0)
    known = pc.unique(rows["term"]).sort()
    terms, term = known.to_pylist(), pc.index_in(rows["term"], value_set=known).to_numpy()
    query, group = rows["query_id"].to_numpy(), rows["group"].to_numpy()
    table = written(postings(memories, terms, stemmed, where), "postings")
    n_docs, n_words = table.agg(F.count(F.lit(1)), F.sum("size")).first()
    average = n_words / n_docs if n_words else 1.0
    df = np.zeros(len(terms))
    for t, n in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a number for each term
        df[t] = n
    idf = np.maximum(np.log((n_docs - df + 0.5) / (df + 0.5)), LEAST_IDF)
    if match_all:  # what no document has leads to none
        may = ~np.isin(query, query[df[term] == 0])
        query, term, group = query[may], term[may], group[may]

    def weights(t: np.ndarray, n: np.ndarray, size: np.ndarray) -> np.ndarray:
        return idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * size / average))

    def scorer(own: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """All matches of the queries of some of the rows."""
        ids = np.unique(query[own])
        order = np.argsort(term[own], kind="stable")
        asking, starts = np.searchsorted(ids, query[own])[order], np.searchsorted(term[own][order], np.arange(len(terms) + 1))  # the queries of each term
        needed = np.bincount(asking, minlength=len(ids))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                size, t, n = (c.to_numpy(zero_copy_only=False) for c in (b.column(1), b.column(2).flatten(), b.column(3).flatten()))
                lengths = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
                many, at = starts[t + 1] - starts[t], np.concatenate([[0], np.cumsum(lengths)])
                before = np.concatenate([[0], np.cumsum(many)])
                for low, high in steps_of(np.diff(before[at]), CELLS):
                    part, doc = slice(at[low], at[high]), np.repeat(np.arange(high - low), lengths[low:high])
                    weight, m = weights(t[part], n[part], size[low + doc]), many[part]
                    which = asking[np.arange(m.sum()) + np.repeat(starts[t[part]] + m - np.cumsum(m), m)]
                    cell = np.repeat(doc, m) * len(ids) + which
                    # only cells that occur, unless most do
                    if (high - low) * len(ids) > 4 * len(cell):
                        cell, place = np.unique(cell, return_inverse=True)
                    else:
                        place, cell = cell, np.arange((high - low) * len(ids))
                    matched, sums = np.bincount(place, minlength=len(cell)), np.bincount(place, np.repeat(weight, m), len(cell))
                    hit = np.flatnonzero(matched == needed[cell % len(ids)] if match_all else matched > 0)
                    found = (cell[hit] % len(ids), b.column(0).to_numpy(zero_copy_only=False)[low + cell[hit] // len(ids)], np.floor(sums[hit] * 1e6 + 0.5) / 1e6)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[found[0]]), pa.array(found[1]), pa.array(found[2])], ["query_id", "memory_id", "score"])

        return score

    def best_scorer(own: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """The k best of each task."""
        ids, leaves = np.unique(query[own]), np.unique(term[own])
        leaf_of = np.full(len(terms), -1)
        leaf_of[leaves] = np.arange(len(leaves))
        queries = dense.Asked(len(ids), np.searchsorted(ids, query[own]), leaf_of[term[own]], term[own], np.full(len(ids), -1 if match_all else 0), ["any"], df[leaves])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = dense.Scorer(queries, k)
            for whole in batches:
                lengths = pc.list_value_length(whole.column(2)).to_numpy(zero_copy_only=False)
                for low, high in dense.blocks_of(lengths):
                    b = whole.slice(low, high - low)
                    members, size, t, n = (c.to_numpy(zero_copy_only=False) for c in (b.column(0), b.column(1), b.column(2).flatten(), b.column(3).flatten()))
                    doc, wanted = np.repeat(np.arange(high - low), lengths[low:high]), leaf_of[t] >= 0
                    doc, t, n = doc[wanted], t[wanted], n[wanted]
                    best.add(members, doc, leaf_of[t], weights(t, n, size[doc]))
            found = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[found[0]]), pa.array(found[1]), pa.array(found[2])], ["query_id", "memory_id", "score"])

        return score

    out = []
    for g in np.unique(rows["group"].to_numpy()).tolist():
        texts = table.where(F.col("ok")[g]).select("memory_id", "size", "terms", "counts")
        own = np.flatnonzero(group == g)
        if k is None:
            out.append(texts.mapInArrow(scorer(own), "query_id long, memory_id long, score double"))
            continue
        asking = np.unique(query[own])
        texts = texts.coalesce(TASKS * memories.sparkSession.sparkContext.defaultParallelism)
        for part in np.array_split(asking, max(1, -(-len(asking) * k // MOST_HELD))):
            out.append(texts.mapInArrow(best_scorer(own[np.isin(query[own], part)]), "query_id long, memory_id long, score double"))
    return reduce(DataFrame.unionByName, out)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, models: list[str] | None = None) -> DataFrame:
    """query_id, memory_id, score, rank: exact dot products. queries: query_id, embedding. Each task keeps its k best a query. Query vectors of more than
    MOST_NUMBERS numbers together are answered in blocks."""
    if models:
        vectors = vectors.where(F.col("model_name").isin(models))
    known = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    return in_blocks(known, F.size("embedding"), MOST_NUMBERS, lambda part: _vector_topk(vectors, part, k), "vectors", k)


def _vector_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rows = queries.orderBy("query_id").collect()
    ids = np.array([r.query_id for r in rows], np.int64)
    matrix = np.array([r.embedding for r in rows], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, step = Best(len(ids), k), CELLS // TILE
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            for at in range(0, b.num_rows if len(ids) else 0, step):
                part = b.slice(at, step)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                own = part.column(0).to_numpy(zero_copy_only=False)
                for first in range(0, len(ids), TILE):
                    score = np.round(matrix[first : first + TILE] @ values.T, 6)
                    least = best.least[first : first + TILE]
                    if score.shape[1] > k and np.isinf(least).any():  # what is below the k-th best of these is not among the best
                        least = np.maximum(least, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k])
                    query, column = np.nonzero(score >= least[:, None])
                    best.add(first + query, own[column], score[query, column])
        held = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]] if len(ids) else held[0]), pa.array(held[1]), pa.array(held[2])], ["query_id", "memory_id", "score"])

    return top(vectors.select(F.col("memory_id").cast("long").alias("memory_id"), "embedding").mapInArrow(run, "query_id long, memory_id long, score double"), k)


def rrf_parameters(query: Column) -> tuple[Column, Column]:
    """k of the keyword and of the vector list: quoted queries lean on keywords, questions on vectors."""
    first = F.lower(F.element_at(F.split(F.trim(query), r"\s+"), 1))
    asks = first.isin("what", "how", "why", "when", "where", "who", "which")
    quoted = F.contains(query, F.lit('"'))
    return F.when(quoted, 40).when(asks, 100).otherwise(60), F.when(quoted, 60).when(asks, 20).otherwise(60)


def rrf(keyword: DataFrame, vector: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Reciprocal ranks of both lists summed; each list has query_id, memory_id, rank (from 1)."""
    kk, kv = rrf_parameters(F.col("query"))
    ks = queries.select("query_id", kk.alias("kk"), kv.alias("kv"))
    both = keyword.select("query_id", "memory_id", "rank", F.lit(True).alias("is_kw")).unionByName(vector.select("query_id", "memory_id", "rank", F.lit(False).alias("is_kw")))
    share = F.lit(1.0) / (F.when(F.col("is_kw"), F.col("kk")).otherwise(F.col("kv")) + F.col("rank"))
    return top(both.join(ks, "query_id").groupBy("query_id", "memory_id").agg(F.round(F.sum(share), 9).alias("score")), k)
