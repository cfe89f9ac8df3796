"""Approximate vector search: vectors are put in the list of their nearest centre, and a query reads the lists of its nearest centres. Queries of any number are
answered in blocks.

The centres are fitted on a bounded sample (SAMPLE rows, by a hash of the id); every vector is in the index. Scores of what is read are
exact. Written with partitionBy("list"), the index lets a search read only the lists it asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators.search import CELLS, MOST_NUMBERS, TILE, Best, in_blocks, top

SAMPLE, ROUNDS = 20_000, 8


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def train(vectors: DataFrame, lists: int) -> np.ndarray:
    """Unit centres by spherical k-means on the sample; fewer than lists where there are fewer vectors."""
    rows = vectors.where(F.col("embedding").isNotNull()).select("memory_id", "embedding").orderBy(F.xxhash64("memory_id"), "memory_id").limit(SAMPLE).collect()
    if not rows:
        return np.zeros((0, 0))
    data = np.array([r.embedding for r in rows], np.float64)
    centres = data[: max(1, min(lists, len(data)))].copy()
    for _ in range(ROUNDS):
        own = (data @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, data)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def build(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """memory_id, embedding, list: every vector, in the list of the centre with the greatest product. Rows without a vector are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = (_matrix(b.column(1)) @ centres.T).argmax(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32())], ["memory_id", "embedding", "list"])

    return vectors.where(F.col("embedding").isNotNull()).select("memory_id", F.col("embedding").cast("array<double>")).mapInArrow(run, "memory_id long, embedding array<double>, list int")


def search(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """query_id, memory_id, score, rank: the k best in the probes nearest lists of each query; all lists: exact."""
    known = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    return in_blocks(known, F.size("embedding"), MOST_NUMBERS, lambda part: _search(index, centres, part, k, probes), "lists", k)


def _search(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int) -> DataFrame:
    rows = queries.orderBy("query_id").collect()
    ids = np.array([r.query_id for r in rows], np.int64)
    matrix = np.array([r.embedding for r in rows], np.float64).reshape(len(rows), len(rows[0].embedding) if rows else 0)
    near = np.argsort(-(matrix @ centres.T), axis=1, kind="stable")[:, :probes] if len(rows) and len(centres) else np.zeros((0, 0), np.int64)
    asking = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # tiles of TILE queries and CELLS products, whatever the number of queries; the task holds its k best a query
        best, step = Best(len(ids), k), max(1, CELLS // TILE)
        for b in batches:
            own = b.column(2).to_numpy(zero_copy_only=False)
            data, members = _matrix(b.column(1)) if b.num_rows else None, b.column(0).to_numpy(zero_copy_only=False)
            for c in np.unique(own):
                rows = np.flatnonzero(own == c)
                for first in range(0, len(asking[int(c)]), TILE):
                    who = asking[int(c)][first : first + TILE]
                    for low in range(0, len(rows), step):
                        at = rows[low : low + step]
                        score, least = np.round(matrix[who] @ data[at].T, 6), best.least[who]
                        if len(at) > k and np.isinf(least).any():  # what is below the k-th best of these is not among the best
                            least = np.maximum(least, np.partition(score, len(at) - k, axis=1)[:, len(at) - k])
                        query, column = np.nonzero(score >= least[:, None])
                        best.add(who[query], members[at[column]], score[query, column])
        held = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])], ["query_id", "memory_id", "score"])

    read = index.where(F.col("list").isin(sorted(asking))) if asking else index.limit(0)
    return top(read.select("memory_id", "embedding", "list").mapInArrow(run, "query_id long, memory_id long, score double"), k)
