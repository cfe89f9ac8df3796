"""Whitening of embeddings by matrix-free block subspace iteration.

Vectors become long x = floor(64 c) + 1000000. The fit list holds each distinct x once; it is written to the shared folder, and each pass of
the iteration is one Spark job over it that computes V Q = 1/n sum of y (y' Q) on the centred rows y = (n x - S) / n, for a block Q of d rows
and a few columns. The covariance V, d by d, is never formed. On the driver, which holds matrices of the block's size only,

1. Rayleigh-Ritz on the block gives values and vectors, and V Q their residuals;
2. if the residuals of all k components are within tolerance, the iteration ends;
3. else V Q is made orthonormal (QR) and is the next block.

The iteration gains a factor of e(b+1) / e(k) a pass with b columns. Where the values fall so slowly that more than PASSES_AIM passes are to be expected,
the block is widened by random columns, up to MOST_COLUMNS or d; a block of d columns is exact after one pass.

A task adds up its rows' products; the tasks' sums are added up by FAN tasks in the order of the partitions, so that reruns agree.

Cases. Rows whose vector is null, or holds a null, NaN or infinite entry, are dropped, and so are rows whose vector has another length than most
(ties: the greater length counts) or none. Repeated rows count once in the fit list and are all returned. Null vec_ids stay null. Components
without variance are left out: a fit list of one vector, or an empty table, gives no rows. Other columns are ignored, whatever their names.
A deviation that a long cannot hold (about 5e7 distinct vectors like those of the tests) is an error, never rounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import materialize, scratch

SCALE, SHIFT = 64, 1_000_000
#: Tasks that add up the other tasks' sums.
FAN = 16
PASSES_AIM = 8
MOST_COLUMNS = 1024
#: A component's residual, relative to the greatest value.
TOLERANCE = 1e-13
#: Values below so much of the greatest one are no components.
NO_VALUE = 1e-12

WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """vectors: d rows, a column a component; values fall; n vectors with sums over the fit list."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    passes: int

    def numerators(self, x: np.ndarray) -> np.ndarray:
        return self.n * x - self.sums

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x) / self.n @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Exact; in Python's integers where 64 bits might not do."""
        y = self.numerators(x)
        if y.size and int(np.abs(y).max()) ** 2 * y.shape[1] >= 1 << 63:
            y = y.astype(object)
            found = (y * y).sum(1)
            if max(found) >= 1 << 63:
                raise OverflowError("a deviation does not fit in a long")
            return found.astype(np.int64)
        return (y * y).sum(1)


def usable(df: DataFrame, column: str) -> DataFrame:
    """vec_id and x of the rows that stay."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    v = F.col(column).cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", entry))
    rows = rows.select("vec_id", F.transform("v", lambda c: F.floor(F.lit(SCALE) * c) + F.lit(SHIFT)).alias("x"))
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == F.lit(most.d if most else 0))


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def summed(fit: DataFrame, of_rows: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: type = np.float64) -> np.ndarray:
    """The sum of of_rows(matrix of x) over all batches. The driver gets FAN matrices of that shape."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for b in batches:
            if b.num_rows:
                total += of_rows(matrix(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least = np.zeros(shape, kind), None
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total += np.frombuffer(data, kind).reshape(shape)
                least = part if least is None else least
        if least is not None:
            yield pa.RecordBatch.from_arrays([pa.array([least], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    kinds = "part int, total binary"
    parts = fit.select("x").mapInArrow(partial, kinds).repartition(FAN, "part").sortWithinPartitions("part").mapInArrow(add, kinds)
    return sum((np.frombuffer(bytes(r.total), kind).reshape(shape) for r in sorted(parts.collect(), key=lambda r: r.part)), np.zeros(shape, kind))


def orthonormal(columns: np.ndarray, width: int, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal block whose first columns span the given ones; random ones fill it up."""
    d, have = columns.shape
    return np.linalg.qr(np.hstack([columns, rng.standard_normal((d, width - have))]))[0]


def fit_whitening(fit: DataFrame, k: int = 16, width: int | None = None, tolerance: float = TOLERANCE, most_passes: int = 500) -> Whitening | None:
    """fit: the distinct x. width: columns of the first block, twice k if not given. None if nothing varies."""
    first = fit.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first.d
    # the last place counts the vectors
    found = summed(fit, lambda x: np.append(x.sum(0), len(x)), (d + 1,), np.int64)
    sums, n = found[:-1], int(found[-1])
    centred = lambda x: (n * x - sums) / n
    rng = np.random.default_rng(7)
    b = min(d, width or 2 * k)
    q, passes = orthonormal(np.zeros((d, 0)), b, rng), 0
    while True:

        def product(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            y = centred(x)
            return np.hstack([y.T @ (y @ q), (y * y).sum(0)[:, None]])

        out = summed(fit, product, (d, q.shape[1] + 1)) / n
        vq, trace, passes = out[:, :-1], float(out[:, -1].sum()), passes + 1
        if trace == 0:
            return None
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, image = q @ turn, vq @ turn
        m = int((values[:k] > NO_VALUE * values[0]).sum())
        residuals = np.linalg.norm(image[:, :m] - vectors[:, :m] * values[:m], axis=0)
        if (residuals <= tolerance * values[0] * np.sqrt(d)).all() and (m == k or len(values) > m or len(values) == d):
            break
        if passes == most_passes:
            raise ValueError(f"not converged after {passes} passes; residuals {residuals.max() / values[0]:.1e}")
        ratio = max(values[-1], 0.0) / values[m - 1]
        to_go = np.log(max(residuals.max() / values[0], tolerance) / tolerance) / max(-np.log(max(ratio, 1e-300)), 1e-9)
        if to_go > PASSES_AIM:
            b = min(d, 2 * b, max(b, MOST_COLUMNS))
        q = orthonormal(image, b, rng)
    vectors, values = vectors[:, :m], values[:m]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0) < 0, -1.0, 1.0)
    model = Whitening(n, sums, values, vectors, trace, 0.0, passes)

    def gram(x: np.ndarray) -> np.ndarray:
        w = model.project(x)
        return w.T @ w

    model.identity_error = float(np.abs(summed(fit, gram, (m, m)) / n - np.eye(m)).max())
    return model


def whiten(df: DataFrame, column: str = "embedding", k: int = 16, width: int | None = None) -> DataFrame:
    """One row a remaining row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows = usable(df, column)
    with scratch(df.sparkSession):
        model = fit_whitening(materialize(rows.select("x").distinct(), "fit", compression="zstd"), k, width)
    if model is None:
        return df.sparkSession.createDataFrame([], WHITENED)
    m, names = len(model.values), [x.split()[0] for x in WHITENED.split(", ")]
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1))
            ids, size = b.column(0), len(x) * m
            each = lambda v: np.repeat(v, m)
            out = [ids.take(pa.array(each(np.arange(len(x))))), np.tile(np.arange(1, m + 1, dtype=np.int32), len(x)), np.full(size, model.n), each(model.deviations(x)), model.project(x).ravel(), np.tile(explained, len(x)), np.full(size, model.identity_error)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], names)

    return rows.mapInArrow(run, WHITENED)
