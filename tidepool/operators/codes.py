"""Approximate vector search over codes, with a life: an index knows of which model and of how many vectors it is.

A vector is its nearest centre plus a residual; the residual is cut into parts, and each part is a byte, the number of its nearest codeword. A search reads the codes alone (a byte a part), adds up
table look-ups (one table a query and part), keeps the SHORT best rows of each query, and only these rows' vectors are read for the exact product.

The centres and codewords are fitted on a bounded sample (ann.SAMPLE rows by a hash of the id); every vector has its code. The index's folder holds codes
(memory_id, list, code), model (the fitted numbers) and manifest (model_name, count, mark: a sum over the rows' ids and numbers). search() compares the manifest with the
vectors that are there: if they are others, it answers exactly, or builds the index again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import ann
from tidepool.operators.search import CELLS, MOST_NUMBERS, Best, in_blocks, top, vector_topk

PARTS, WORDS, LISTS, SHORT = 16, 256, 16, 100
MANIFEST = "model_name string, count long, mark decimal(38,0)"
MODEL = "centres binary, books binary, lists int, parts int"


@dataclass
class Codebook:
    """centres: a row a list. books: for each part its codewords, a row each."""

    centres: np.ndarray
    books: np.ndarray

    @classmethod
    def fit(cls, data: np.ndarray, lists: int = LISTS, parts: int = PARTS, rounds: int = 8) -> "Codebook":
        """Plain k-means, first for the centres, then for each part of the residuals. parts is lowered to a divisor of the dimension."""
        d = data.shape[1]
        parts = next(p for p in range(min(parts, d), 0, -1) if d % p == 0)
        centres = means(data, lists, rounds)
        rest = (data - centres[nearest(data, centres)]).reshape(len(data), parts, d // parts)
        books = [means(rest[:, p], WORDS, rounds) for p in range(parts)]
        most = max(map(len, books))
        return cls(centres, np.stack([np.vstack([b, np.repeat(b[-1:], most - len(b), 0)]) for b in books]))

    def encode(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(data, self.centres)
        parts = len(self.books)
        rest = (data - self.centres[own]).reshape(len(data), parts, -1)
        return own, np.stack([nearest(rest[:, p], self.books[p]) for p in range(parts)], 1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of each query with each centre, and of its parts with each codeword."""
        return queries @ self.centres.T, np.einsum("qpk,pwk->qpw", queries.reshape(len(queries), len(self.books), -1), self.books)


def nearest(data: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The nearest row of to, for each row."""
    return ((to**2).sum(1) - 2 * data @ to.T).argmin(1)


def means(data: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k centres at most, from rows spread over the data; empty ones stay where they are."""
    out = data[np.linspace(0, len(data) - 1, min(k, len(data))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(data, out)
        counts, sums = np.bincount(own, minlength=len(out)), np.zeros_like(out)
        np.add.at(sums, own, data)
        out[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return out


def manifest_of(vectors: DataFrame, model_name: str) -> DataFrame:
    """One row: how many vectors there are, and a sum that other ones would not have."""
    known = vectors.where(F.col("embedding").isNotNull())
    mark = F.coalesce(F.sum(F.xxhash64("memory_id", F.col("embedding").cast("array<double>")).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")
    return known.agg(F.lit(model_name).alias("model_name"), F.count(F.lit(1)).alias("count"), mark.alias("mark"))


def build(vectors: DataFrame, path: str, model_name: str, lists: int = LISTS, parts: int = PARTS) -> None:
    """Writes the index of vectors (memory_id, embedding); rows without a vector are left out. The manifest is written last, so that an index that was not finished is stale."""
    spark = vectors.sparkSession
    known = vectors.where(F.col("embedding").isNotNull()).select(F.col("memory_id").cast("long").alias("memory_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sample = known.orderBy(F.xxhash64("memory_id"), "memory_id").limit(ann.SAMPLE).collect()
    spark.createDataFrame([], MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")
    if not sample:
        return
    book = Codebook.fit(np.array([r.embedding for r in sample], np.float64), lists, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, code = book.encode(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int32()), pa.array([x.tobytes() for x in code], pa.binary())], ["memory_id", "list", "code"])

    known.mapInArrow(run, "memory_id long, list int, code binary").write.mode("overwrite").parquet(f"{path}/codes")
    row = (bytearray(book.centres.tobytes()), bytearray(book.books.tobytes()), len(book.centres), len(book.books))
    spark.createDataFrame([row], MODEL).write.mode("overwrite").parquet(f"{path}/model")
    manifest_of(vectors, model_name).write.mode("overwrite").parquet(f"{path}/manifest")


def is_stale(path: str, vectors: DataFrame, model_name: str) -> bool:
    """Whether there is no finished index, or one of another model or of other vectors."""
    spark = vectors.sparkSession
    try:
        found = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").first()
    except AnalysisException:
        return True
    return found is None or tuple(found) != tuple(manifest_of(vectors, model_name).first())


def short_list(spark: SparkSession, path: str, queries: DataFrame, short: int = SHORT) -> DataFrame:
    """query_id, memory_id, score of the rows that look best by their codes. Reads no vector."""
    row = spark.read.schema(MODEL).parquet(f"{path}/model").first()
    centres = np.frombuffer(row.centres).reshape(row.lists, -1)
    book = Codebook(centres, np.frombuffer(row.books).reshape(row.parts, -1, centres.shape[1] // row.parts))
    codes = spark.read.schema("memory_id long, list int, code binary").parquet(f"{path}/codes")

    def answer(part: DataFrame) -> DataFrame:
        rows = part.orderBy("query_id").collect()  # MOST_NUMBERS numbers or so at most
        ids, asked = np.array([r.query_id for r in rows], np.int64), np.array([r.embedding for r in rows], np.float64).reshape(len(rows), -1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(ids), short)
            tile = 64
            for b in batches:
                for at in range(0, b.num_rows if len(ids) else 0, CELLS // tile):
                    own = b.slice(at, CELLS // tile)
                    code = np.frombuffer(b"".join(own.column(2).to_pylist()), np.uint8).reshape(own.num_rows, -1)
                    lists, members = own.column(1).to_numpy(), own.column(0).to_numpy()
                    for first in range(0, len(ids), tile):
                        near, tables = book.tables(asked[first : first + tile])
                        score = near[:, lists]
                        for p in range(code.shape[1]):
                            score += tables[:, p][:, code[:, p]]
                        least = best.least[first : first + tile]
                        if score.shape[1] > short:
                            least = np.maximum(least, np.partition(score, score.shape[1] - short, axis=1)[:, score.shape[1] - short])
                        query, column = np.nonzero(score >= least[:, None])
                        best.add(first + query, members[column], score[query, column])
            held = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]] if len(ids) else held[0]), pa.array(held[1]), pa.array(held[2])], ["query_id", "memory_id", "score"])

        return top(codes.mapInArrow(run, "query_id long, memory_id long, score double"), short)

    known = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    return in_blocks(known, F.size("embedding"), MOST_NUMBERS, answer, "codes", short).select("query_id", "memory_id", "score")


def search(path: str, vectors: DataFrame, queries: DataFrame, k: int, model_name: str, short: int = SHORT, rebuild: bool = False) -> DataFrame:
    """query_id, memory_id, score, rank: the k best of the short list by exact products; from a stale index exact search, or, with rebuild, a new index."""
    if is_stale(path, vectors, model_name):
        if not rebuild or not vectors.where(F.col("embedding").isNotNull()).limit(1).count():
            return vector_topk(vectors, queries, k)
        build(vectors, path, model_name)
    pairs = short_list(vectors.sparkSession, path, queries, max(short, k)).select("query_id", "memory_id")
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("_q"))
    own = vectors.select("memory_id", F.col("embedding").cast("array<double>").alias("_v")).where(F.col("_v").isNotNull())
    product = F.aggregate(F.zip_with("_q", "_v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return top(pairs.join(own, "memory_id").join(asked, "query_id").select("query_id", "memory_id", F.round(product, 6).alias("score")), k)
