"""Statistics of the four-value signal vector of one flow, as JVM expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _add(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def signal(*cols: Column) -> list[Column]:
    return [c.cast("double") for c in cols]


def pad4(values: Column) -> Column:
    """Zero-pad an array column at the end up to four values."""
    fill = F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(4) - F.size(values)))
    return F.concat(values.cast("array<double>"), fill)


def items(values: Column, n: int = 4) -> list[Column]:
    return [F.element_at(values, i + 1) for i in range(n)]


def stats(v: list[Column]) -> dict[str, Column]:
    mean = _add(v) / F.lit(float(len(v)))
    # two-pass form: no cancellation between large squares
    spread = F.sqrt(_add([(x - mean) * (x - mean) for x in v]) / F.lit(float(len(v))))
    # greatest/least skip nulls; a missing value must make the whole statistic missing
    known = _add(v).isNotNull()
    return {"sum": _add(v), "max": F.when(known, F.greatest(*v)), "mean": mean,
            "min": F.when(known, F.least(*v)), "stddev": spread}


def value_information(v: list[Column]) -> Column:
    """Entropy in nats of the multiset of the (half-to-even rounded) values.

    Every position is distinct, so this is also the mutual information of position and value.
    """
    r = [F.bround(x, 0) for x in v]
    same = [_add([F.when(a == b, 1).otherwise(0) for b in r]) for a in r]
    n = len(v)
    # sum over positions of ln(multiplicity) equals sum over values of m ln m
    info = F.lit(math.log(n)) - _add([F.log(m.cast("double")) for m in same]) / n
    return F.when(_add(v).isNotNull(), F.greatest(F.lit(0.0), info))


def entropy(v: list[Column]) -> Column:
    shifted = [x + F.lit(1e-6) for x in v]
    total = _add(shifted)
    return -_add([(x / total) * F.log(x / total) for x in shifted])


def power_sum(v: list[Column]) -> Column:
    total = _add([x + F.lit(1e-6) for x in v])
    return _add([F.when(x == 0, F.lit(0.0)).otherwise(F.pow(x / total, F.lit(0.01))) for x in v])


def energy(v: list[Column]) -> Column:
    return _add([x * x for x in v])


def haar(v: list[Column]) -> dict[str, Column]:
    """Level-2 Haar approximation of four values: one coefficient, half their sum."""
    c = _add(v) / F.lit(2.0)
    return {"mean": c, "std": F.lit(0.0), "magnitude": F.abs(c)}


def wavelet_features(v: list[Column]) -> dict[str, Column]:
    h = haar(v)
    return {"MI-dir-L5-weight": value_information(v), "HH-L3-weight": entropy(v),
            "HH-L0.01-weight": power_sum(v), "HpHp-L0.01-weight": energy(v),
            "HpHp-L0.01-mean": h["mean"], "HpHp-L0.01-std": h["std"],
            "HpHp-L0.01-magnitude": h["magnitude"]}
