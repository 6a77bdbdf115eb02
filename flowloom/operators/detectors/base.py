"""Shared pieces of the anomaly detectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.session import MAX_BROADCAST, materialize  # noqa: F401

_BINS = 4096  # histogram bins of one narrowing pass, and values read at its end


class SingularData(ValueError):
    """The training rows do not span the feature space."""


def numeric(df: DataFrame, features: list[str]) -> list[Column]:
    return [F.col(f"`{c}`").cast("double") for c in features]


def stacked(columns) -> np.ndarray:
    return np.column_stack([c.to_numpy(dtype=float) for c in columns])


def quantile(df: DataFrame, value: Column, p: float, weight: Column | None = None) -> float:
    """Exact interpolated quantile of the values that are neither null nor NaN.

    ``weight`` says how many rows a row stands for.  Histograms narrow the range around the wanted ranks
    until few values, or equal ones, are left; no task and no driver holds more than the bins.  The values
    are written once.
    """
    weight = F.lit(1) if weight is None else weight
    rows = df.select(value.cast("double").alias("v"), weight.cast("bigint").alias("w"))
    rows = materialize(rows.where("v is not null and not isnan(v) and w > 0"), "quantile")
    n, lo, hi = rows.agg(F.sum("w"), F.min("v"), F.max("v")).first()
    if not n:
        raise SingularData("no values")
    at = p * (n - 1)
    first, second = int(at), min(int(at) + 1, n - 1)
    low, high = _order_values(rows, lo, hi, first, second)
    return low + (at - first) * (high - low)


def ranked(rows: DataFrame, rank: Callable[[int], int]) -> float | None:
    """The exact value of a 0-based rank among ``rows`` (v, w), w rows of value v; None without any.

    ``rank`` is told the number of rows.
    """
    rows = materialize(rows, "ranked")
    n, lo, hi = rows.agg(F.sum("w"), F.min("v"), F.max("v")).first()
    return _order_values(rows, lo, hi, rank(n), rank(n))[0] if n else None


def _order_values(rows: DataFrame, lo: float, hi: float, first: int, second: int):
    """The values of 0-based ranks ``first`` and ``second`` (the same or the next) among ``rows``."""
    before, count = 0, rows.count()
    while lo < hi:
        inside = rows.where(F.col("v").between(F.lit(lo), F.lit(hi)))
        if count <= _BINS:
            found, upto = [], before
            for v, w in sorted(tuple(r) for r in inside.collect()):
                found += [v for rank in (first, second) if upto <= rank < upto + w]
                upto += w
            return found[0], found[-1]
        place = (F.col("v") - F.lit(lo)) / F.lit(hi - lo) * _BINS
        bins = (inside.groupBy(F.least(F.floor(place), F.lit(_BINS - 1)).alias("b"))
                .agg(F.sum("w").alias("n"), F.count("v").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                .orderBy("b").collect())
        for i, b in enumerate(bins):
            if first < before + b.n:
                break
            before += b.n
        if second >= before + b.n:  # the pair lies on both sides of an edge
            return b.hi, bins[i + 1].lo
        count, lo, hi = b.rows, b.lo, b.hi
    return lo, lo


def flagged(df: DataFrame, normality: Column, offset: float) -> DataFrame:
    """``guess`` is 1 below the offset; ``score`` grows with abnormality."""
    out = df.withColumn("score", -normality)
    return out.withColumn("guess", F.when(F.col("score") > -offset, 1).otherwise(0))


def summed(df: DataFrame, features: list[str], batch_sums) -> np.ndarray:
    """Sum over all rows of a fixed-length vector that ``batch_sums(matrix)`` gives per batch.

    Each task adds its batches up; entries are then summed by position on the cluster, so the
    driver sees one value per position.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                s = np.asarray(batch_sums(pdf.to_numpy(dtype=float)), dtype=float)
                total = s if total is None else total + s
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    cols = [c.alias(f"f{i}") for i, c in enumerate(numeric(df, features))]
    rows = (df.select(*cols).mapInPandas(part, "i long, v double")
            .groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect())
    if not rows:
        raise SingularData("no training rows")
    return np.array([r.v for r in rows])
