"""Whitening of embeddings by singular values of their centred rows, to double precision.

Entries are put on a fixed grid, so sums over all rows are whole numbers and exact.  The distinct vectors
are the fit list.  Each task reduces its centred rows to a triangular factor, block after block, by QR;
factors are merged sixteen at a time until one is left, a matrix as wide as the vectors.  Its squared
singular values and right vectors (:mod:`flowloom.llm.bidiagonal`) are the covariance's eigenvalues, times
the number of rows, and its eigenvectors; the covariance itself is never formed, which would halve the
digits of small eigenvalues.  Only the column sums and that one factor reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.bidiagonal import right_singular
from flowloom.llm.common import c, fresh
from flowloom.session import materialize

_FAN_IN = 16
_CELLS = 1 << 21  # entries of one block of rows
_MOST = 2.0 ** 52  # grid values stop here on both sides


@dataclass
class Whitening:
    n: int
    base: np.ndarray  # whole part of the means
    rest: np.ndarray  # n * mean - n * base, in 0 .. n - 1
    weights: np.ndarray  # columns that whiten a centred vector
    explained: list[float]
    error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(float) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum of (n * x - S) ** 2 per row, exact; null where it does not fit into 64 bits."""
        y = x - self.base
        about = ((y.astype(float) * self.n - self.rest) ** 2).sum(1)
        small = about < 9e18
        z = np.where(small[:, None], y, 0) * np.int64(self.n) - self.rest
        out = [int(v) for v in (z * z).sum(1)]
        for i in np.flatnonzero(~small):
            exact = sum((int(v) * self.n - int(r)) ** 2 for v, r in zip(y[i], self.rest)) if about[i] < 1e19 else 1 << 63
            out[i] = exact if exact < 1 << 63 else None
        return pa.array(out, pa.int64())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _pieces(x: np.ndarray) -> Iterator[np.ndarray]:
    step = max(1, _CELLS // x.shape[1])
    for lo in range(0, len(x), step):
        yield x[lo:lo + step]


def _triangle(upper: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if upper is None else np.vstack([upper, rows]), mode="r")


def _packed(block: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([r.tobytes()], pa.binary())],
                                      names=["block", "r"])


def _unpacked(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.vstack([np.frombuffer(v, float).reshape(-1, width) for v in column.to_pylist()])


def _factor(fit: DataFrame, model: Whitening, width: int) -> np.ndarray:
    """The triangular factor of all centred rows."""
    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = None
        for b in batches:
            for x in _pieces(_matrix(b.column(0), width)):
                upper = _triangle(upper, model.centred(x))
        if upper is not None:
            yield _packed(TaskContext.get().partitionId(), upper)

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_packed(key[0].as_py(), _triangle(None, _unpacked(t.column("r"), width)))])

    schema = "block bigint, r binary"
    blocks = materialize(fit.mapInArrow(part, schema), "factors")
    last = blocks.agg(F.max("block")).first()[0]
    while last:
        blocks = (blocks.withColumn("block", F.floor(F.col("block") / _FAN_IN))
                  .groupBy("block").applyInArrow(merge, schema))
        last //= _FAN_IN
    r = _triangle(None, _unpacked(pa.array([bytes(x["r"]) for x in blocks.collect()]), width))
    return np.vstack([r, np.zeros((width - len(r), width))])


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact column sums; high and low halves are summed apart."""
    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for b in batches:
            x = _matrix(b.column(0), width)
            n, high, low = n + len(x), high + (x >> 26).sum(0), low + (x & ((1 << 26) - 1)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(high),
                                          pa.array(low)], names=["i", "n", "high", "low"])

    rows = (fit.mapInArrow(part, "i bigint, n bigint, high bigint, low bigint").groupBy("i")
            .agg(*[F.sum(F.col(x).cast("decimal(38,0)")).alias(x) for x in ("n", "high", "low")])
            .orderBy("i").collect())
    if not rows:
        return 0, []
    return int(rows[0]["n"]), [(int(r["high"]) << 26) + int(r["low"]) for r in rows]


def _identity_error(fit: DataFrame, model: Whitening, width: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    use = np.flatnonzero(np.array(model.explained) > 0)
    if not len(use):
        return 0.0
    weights = model.weights[:, use]
    k = len(use)

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            for x in _pieces(_matrix(b.column(0), width)):
                z = model.centred(x) @ weights
                total += np.vstack([z.T @ z, z.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    rows = fit.mapInArrow(part, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    total = np.array([r["v"] for r in rows]).reshape(k + 1, k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def grid(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * entry) + shift per entry, stopped at 2 ** 52 on both sides."""
    def cell(v: Column) -> Column:
        at = F.greatest(F.least(v.cast("double") * scale, F.lit(_MOST)), F.lit(-_MOST))
        return F.floor(at).cast("bigint") + F.lit(shift).cast("bigint")

    return F.transform(vector, cell)


def whiten(df: DataFrame, *, vector_col: str = "embedding", components: int = 16, scale: int = 64,
           shift: int = 1_000_000) -> DataFrame:
    """The rows of ``df`` with n, deviation, whitened, explained and identity_error.

    Vectors are put on the grid floor(``scale`` * entry) + ``shift``; the distinct grid vectors are the fit
    list, n their number.  ``whitened`` and ``explained`` are arrays over the components, by falling
    eigenvalue, at most ``components`` and at most as many as the vectors are wide.  ``deviation`` is the
    exact sum over dimensions of (n * x - column sum) ** 2, null beyond 64 bits.  ``identity_error``
    measures the whitened fit list over all rows.

    Rows whose vector is null or holds null, NaN or infinite entries go; so do vectors narrower than the
    widest of the others, whose last entries are missing.  Repeated rows stay.  Components without
    variance (one distinct vector, constant or dependent dimensions) have null in ``whitened``, 0 in
    ``explained`` and no part in the error.  Equal eigenvalues have some orthogonal directions, the same
    for all rows.  Without usable rows the result is empty.  The result's five columns replace input
    columns of the same names, except that a vector column so named is read first.
    """
    (x,) = fresh(df, "_grid")
    facts = ("n", "deviation", "whitened", "explained", "identity_error")
    vec = c(vector_col)
    whole = vec.isNotNull() & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = df.where(whole)
    width = good.agg(F.max(F.size(vec))).first()[0] or 0
    rows = good.where(F.size(vec) == width).withColumn(x, grid(vec, scale, shift)).drop(*facts)
    empty = "bigint", "bigint", "array<double>", "array<double>", "double"
    if not width:
        return rows.where(F.lit(False)).drop(x).withColumns({f: F.lit(None).cast(t) for f, t in zip(facts, empty)})

    fit = materialize(rows.select(c(x).alias("x")).distinct(), "fit-list")
    n, sums = _sums(fit, width)
    model = Whitening(n, np.array([s // n for s in sums]), np.array([s % n for s in sums]), np.zeros((width, 0)), [])
    r = _factor(fit, model, width)
    squares, vectors = right_singular(r, components)
    total = float((r * r).sum())
    model.weights = vectors * np.sqrt(np.divide(n, squares, out=np.zeros_like(squares), where=squares > 0))
    model.explained = [float(s / total) if total else 0.0 for s in squares]
    model.error = _identity_error(fit, model, width)
    none = np.array(model.explained) == 0

    @F.arrow_udf("deviation bigint, whitened array<double>")
    def score(column: pa.Array) -> pa.Array:
        rows = _matrix(column, width)
        z = model.centred(rows) @ model.weights
        flat = pa.array(z.ravel(), mask=np.tile(none, len(rows)))
        ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(none))
        return pa.StructArray.from_arrays([model.deviation(rows), pa.ListArray.from_arrays(ends, flat)],
                                          names=["deviation", "whitened"])

    (got,) = fresh(rows, "_got")
    out = rows.withColumn(got, score(c(x)))
    return out.withColumns({"n": F.lit(n).cast("bigint"), "deviation": c(got)["deviation"],
                            "whitened": c(got)["whitened"],
                            "explained": F.array(*[F.lit(v) for v in model.explained]),
                            "identity_error": F.lit(model.error)}).drop(x, got)
