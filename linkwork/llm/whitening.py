"""Embedding whitening by a bidiagonal qd solver (operator 13).

Entries become whole numbers ``x = floor(64 c) + 1000000``; the fit list is each distinct x vector once.  Its rows,
centred exactly as ``n x - S``, are reduced block by block to triangular factors, which meet in a tree of QR
factorisations of ``FAN`` factors each; only the last one, d x d for dimension d, reaches the driver, beside n and
the d sums.  It is bidiagonalised there, dqds gives the singular values, twisted factorisations the directions.

Defined cases: rows whose vector is null, or holds null, NaN or infinite entries, are dropped, and so are rows of
another length than the most frequent one (of ties the longest); null and repeated ids stay, a row each.  Directions
without variance (beyond rounding) are not returned, so equal vectors, one vector or an empty table give no rows.  A
deviation that does not fit a long is null.  Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwork.llm.bidiagonal import EPS, bidiagonalise, directions, singular_squares
from linkwork.llm.common import saved

#: Fixed values of the whole-number form.
STEPS, OFFSET = 64, 1_000_000
#: Triangular factors that one QR of the tree takes.
FAN = 16
#: Rows of one block of a factorisation.
BLOCK = 4096


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: ``n`` and ``sums`` of the fit list, unit ``components`` (columns), their variances."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float


def whole(vector: Column) -> Column:
    """The vector in whole numbers."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS) + F.lit(OFFSET).cast("long"))


def finite(vector: Column) -> Column:
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def whole_rows(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``id, x`` of the rows that count, and their dimension."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(finite(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("rows"))
    first = sizes.orderBy(F.desc("rows"), F.desc("size")).first()
    size = first["size"] if first else 0
    return rows.where(F.size("v") == size).select("id", whole(F.col("v")).alias("x")), size


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _sums(fit: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """Number of rows and sum of each dimension, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            total[0] += batch.num_rows
            total[1:] += _matrix(batch.column(0), size).sum(axis=0)
        yield pa.record_batch([pa.array(range(size + 1), pa.int32()), pa.array(total)], names=["pos", "part"])

    parts = fit.select("x").mapInArrow(run, "pos int, part long").groupBy("pos").agg(F.sum("part").alias("part"))
    total = {r["pos"]: r["part"] for r in parts.collect()}  # d + 1 rows
    return total.get(0, 0), np.array([total.get(i + 1, 0) for i in range(size)], dtype=np.int64)


def _factor(rows: np.ndarray) -> np.ndarray:
    """The triangular factor, with zero rows where there are fewer rows than columns."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - r.shape[0], rows.shape[1]))])


def _factors(fit: DataFrame, n: int, sums: np.ndarray) -> DataFrame:
    """``node, r``: the factor of each partition's centred rows."""
    size = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = (n * _matrix(batch.column(0).slice(at, BLOCK), size) - sums).astype(float)
                r = _factor(rows if r is None else np.vstack([r, rows]))
        if r is not None:
            node = pa.array([TaskContext.get().partitionId()], pa.int64())
            yield pa.record_batch([node, pa.array([r.tobytes()], pa.binary())], names=["node", "r"])

    return fit.select("x").mapInArrow(run, "node long, r binary")


def _joined(factors: DataFrame, size: int) -> DataFrame:
    """One step up the tree: the factor of ``FAN`` neighbouring factors."""

    def run(pdf):
        rows = [np.frombuffer(x).reshape(size, size) for x in pdf.sort_values("child")["r"]]
        r = _factor(np.vstack(rows))
        return pdf.head(1)[["node"]].assign(r=[r.tobytes()])

    up = factors.select(F.expr(f"node div {FAN}").alias("node"), F.col("node").alias("child"), "r")
    return up.groupBy("node").applyInPandas(run, "node long, r binary")


def fit(vectors: DataFrame, size: int, components: int = 16) -> Whitening | None:
    """The transform of the distinct vectors ``x``; None where there is no variance."""
    n, sums = _sums(vectors, size)
    if n < 2 or size == 0:
        return None
    factors = _factors(vectors, n, sums)
    leaves = vectors.rdd.getNumPartitions()
    while leaves > 1:
        factors = _joined(factors, size)
        leaves = -(-leaves // FAN)
    r = np.frombuffer(factors.first()["r"]).reshape(size, size)
    a, b, right = bidiagonalise(r)
    squares = singular_squares(a, b)
    rank = int(np.sum(squares > (size * EPS) ** 2 * squares[0])) if squares[0] > 0 else 0
    if rank == 0:
        return None
    top = squares[: min(rank, components)]
    vectors_of = right @ directions(a, b, top)
    cube = float(n) ** 3  # the factor is of n x - S, n times as long as x - S / n
    return Whitening(n, sums, vectors_of, top / cube, float(np.sum(squares)) / cube)


def _deviations(centred: np.ndarray) -> list[int | None]:
    """Sums of squares, exactly; None beyond a long."""
    rough = np.square(centred.astype(float)).sum(axis=1)
    if not len(rough) or rough.max() < 9e18:
        return np.square(centred).sum(axis=1).tolist()
    exact = (sum(int(c) * int(c) for c in row) for row in centred)
    return [d if d < 2**63 else None for d in exact]


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """``id, deviation, w``: exact deviation and whitened coordinates of each row of ``id, x``."""
    n, sums = model.n, model.sums
    scaled = model.components / np.sqrt(model.variances) / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred = n * _matrix(batch.column(1), len(sums)) - sums
            w = centred.astype(float) @ scaled
            at = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            lists = pa.ListArray.from_arrays(at, pa.array(w.ravel()))
            yield pa.record_batch([batch.column(0), pa.array(_deviations(centred), pa.int64()), lists], names=["id", "deviation", "w"])

    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "x").mapInArrow(run, f"id {kind}, deviation long, w array<double>")


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = model.components.shape[1]
    n, sums = model.n, model.sums
    scaled = model.components / np.sqrt(model.variances) / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = (n * _matrix(batch.column(0), len(sums)) - sums).astype(float) @ scaled
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.record_batch([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["pos", "part"])

    parts = vectors.select("x").mapInArrow(run, "pos int, part double").groupBy("pos").agg(F.sum("part").alias("part"))
    total = np.zeros((k + 1) * k)
    for r in parts.collect():  # k (k + 1) rows
        total[r["pos"]] = r["part"]
    total = total.reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """``<id>, component, n, deviation, whitened, explained, identity_error`` for each row and component."""
    rows, size = whole_rows(df, id_col, vector_col)
    vectors = saved(rows.select("x").distinct(), "whitening-fit")
    model = fit(vectors, size, components)
    if model is None:
        kind = dict(rows.dtypes)["id"]
        schema = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.variances])
    out = whitened(rows, model).select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(id_col),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
