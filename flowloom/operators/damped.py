"""Exponentially damped counts, means and deviations per key.

For rows in time order the online recurrence has the closed form
``w_i = sum_{j<=i} exp(-lam (t_i - t_j))`` (and likewise with ``x_j``, ``x_j**2``).  Times are cut
into bins short enough for ``exp(lam * offset)`` to stay finite; inside (slice, key, bin) the sum is
a running window, and what earlier bins still weigh is carried over through a table with one row
per (slice, key, bin).  No key is ever gathered in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.prefix import SLICE, order_slices, running_sums

_SPAN = 40.0  # largest exponent; exp(40) is 2e17, far from overflow
_BIN = "_bin"


@dataclass(frozen=True)
class Stat:
    """One output column: ``kind`` is ``weight``, ``mean`` or ``std``."""

    name: str
    lam: float
    kind: str


def _exp(x: Column) -> Column:
    return F.exp(x)


def _layout(keys: list[str], value: Column | None, stats: list[Stat], time: str, row_id: str, name: str):
    """Decay rates, sums per rate, bin width, a function that adds the terms' inputs, and the terms."""
    lams = sorted({s.lam for s in stats})
    need = {lam: {"weight": "w", "mean": "ws", "std": "wsq"} for lam in lams}
    parts = {lam: "".join(sorted({p for s in stats if s.lam == lam for p in need[lam][s.kind]}))
             for lam in lams}
    width = max(1, math.floor(_SPAN * 1000 / max(lams)))  # ms per bin

    def prepared(df: DataFrame) -> DataFrame:
        if value is None:
            by_time = Window.partitionBy(name, *keys).orderBy(time, row_id)
            gap = F.col(time) - F.lag(time).over(by_time)
            df = df.withColumn("_x", F.coalesce(gap, F.lit(0)).cast("double"))
        else:
            df = df.withColumn("_x", value.cast("double"))
        df = df.withColumn(_BIN, F.floor(F.col(time) / F.lit(width)))
        return df.withColumn("_tau", (F.col(time) - F.col(_BIN) * width) / F.lit(1000.0))

    def term(part: str, lam: float) -> Column:
        up = _exp(F.col("_tau") * lam)
        return {"w": up, "s": F.col("_x") * up, "q": F.col("_x") * F.col("_x") * up}[part]

    measures = {f"_{p}{i}": term(p, lam) for i, lam in enumerate(lams) for p in parts[lam]}
    return lams, parts, width, prepared, measures


def _totals(rows: DataFrame, keys: list[str], measures: dict[str, Column], time: str, name: str) -> DataFrame:
    return rows.groupBy(name, *keys, _BIN).agg(
        *[F.sum(m).alias(c) for c, m in measures.items()],
        F.min(time).alias("_t0"), F.max(time).alias("_t1"))


def bin_carry(rows: DataFrame, keys: list[str], value: Column, stats: list[Stat], time: str = "stime",
              row_id: str = "row_id", source: DataFrame | None = None, name: str = SLICE) -> DataFrame:
    """What earlier rows of a key still weigh at the start of each of its bins, per slice of the bin.

    One row per (slice, key, ``bin``), with ``_c_w0`` for the weight at the lowest decay rate, ``_c_s0``
    for the sum, and so on; this is the table that :func:`damped` joins to the rows.
    """
    lams, parts, width, prepared, measures = _layout(keys, value, stats, time, row_id, name)
    totals = _totals(prepared(rows if source is None else source), keys, measures, time, name)
    return _carry(totals, keys, lams, parts, width, False, name).withColumnRenamed(_BIN, "bin")


def damped(rows: DataFrame, keys: list[str], value: Column | None, stats: list[Stat],
           time: str = "stime", row_id: str = "row_id", source: DataFrame | None = None,
           name: str = SLICE) -> DataFrame:
    """Add damped statistics of ``value`` per key; ``value=None`` means the inter-arrival time (ms).

    ``rows`` carries the slice column of :func:`prefix.time_slices`; ``source`` may give the same
    rows before the exchange, so that carry totals are combined on the map side.
    """
    lams, parts, width, prepared, measures = _layout(keys, value, stats, time, row_id, name)
    jitter = value is None
    base = rows if (jitter or source is None) else source
    carry = _carry(_totals(prepared(base), keys, measures, time, name), keys, lams, parts, width, jitter, name)

    local = Window.partitionBy(name, *keys, _BIN).orderBy(time, row_id).rowsBetween(
        Window.unboundedPreceding, 0)
    out = prepared(rows).withColumns({c: F.sum(m).over(local) for c, m in measures.items()})
    out = out.join(carry, [name, *keys, _BIN], "left")
    total = {c: F.col(c) + F.col(f"_c{c}") for c in measures}
    result = {}
    for s in stats:
        i = lams.index(s.lam)
        w = total[f"_w{i}"]
        if s.kind == "weight":
            result[s.name] = w * _exp(F.col("_tau") * -s.lam)
        else:
            mean = total[f"_s{i}"] / w
            result[s.name] = mean if s.kind == "mean" else F.sqrt(
                F.greatest(F.lit(0.0), total[f"_q{i}"] / w - mean * mean))
    out = out.withColumns(result)
    return out.drop("_x", "_tau", _BIN, *measures, *[f"_c{c}" for c in measures])


def _carry(totals: DataFrame, keys: list[str], lams: list[float], parts: dict, width: int,
           jitter: bool, name: str) -> DataFrame:
    """What all earlier (bin, slice) cells of a key still weigh at the start of each cell."""
    cells = totals
    if jitter:
        # the first row of a slice has its predecessor in an earlier slice
        seq = Window.partitionBy(*keys).orderBy(_BIN, name)
        last, last_slice = F.lag("_t1").over(seq), F.lag(name).over(seq)
        cells = cells.withColumn(
            "_gap", F.when(last_slice != F.col(name), (F.col("_t0") - last).cast("double"))
            .otherwise(F.lit(0.0)))
        cells = cells.withColumn("_gap", F.coalesce("_gap", F.lit(0.0)))
        tau = (F.col("_t0") - F.col(_BIN) * width) / F.lit(1000.0)
        for i, lam in enumerate(lams):
            for p in set(parts[lam]) - {"w"}:
                g = F.col("_gap") if p == "s" else F.col("_gap") * F.col("_gap")
                cells = cells.withColumn(f"_fix_{p}{i}", g * _exp(tau * lam))
                cells = cells.withColumn(f"_{p}{i}", F.col(f"_{p}{i}") + F.col(f"_fix_{p}{i}"))
    for i, lam in enumerate(lams):
        step = lam * width / 1000.0
        group = max(1, math.floor(_SPAN / step))  # bins per super-bin
        cells = cells.withColumn("_sup", F.floor(F.col(_BIN) / F.lit(group)))
        rel = (F.col(_BIN) - F.col("_sup") * group).cast("double")
        cells = cells.withColumn("_rel", rel)
        inside = Window.partitionBy(*keys, "_sup").orderBy(_BIN, name).rowsBetween(
            Window.unboundedPreceding, -1)
        by_sup = Window.partitionBy(*keys).orderBy("_sup")
        for p in parts[lam]:
            lifted = F.col(f"_{p}{i}") * _exp(F.col("_rel") * step)
            cells = cells.withColumn("_lift", lifted)
            here = F.coalesce(F.sum("_lift").over(inside), F.lit(0.0))
            prev = F.coalesce(F.sum("_lift").over(by_sup.rangeBetween(-1, -1)), F.lit(0.0))
            prev2 = F.coalesce(F.sum("_lift").over(by_sup.rangeBetween(-2, -2)), F.lit(0.0))
            old = (here + prev * math.exp(-step * group) + prev2 * math.exp(-2 * step * group))
            c = old * _exp(F.col("_rel") * -step)
            if jitter and p != "w":
                c = c + F.col(f"_fix_{p}{i}")
            cells = cells.withColumn(f"_c_{p}{i}", c)
    wanted = [f"_c_{p}{i}" for i, lam in enumerate(lams) for p in parts[lam]]
    return cells.select(name, *keys, _BIN, *wanted)


def in_sequence(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows dealt into slices that never decrease in ``order``, an order in which times may go back.

    ``order`` must tell rows apart; the usual one is (file number, time, row id).
    """
    return order_slices(df, order)


def damped_in_sequence(rows: DataFrame, keys: list[str], value: Column | None, stats: list[Stat],
                       order: list[str], time: str = "stime", source: DataFrame | None = None,
                       name: str = SLICE) -> DataFrame:
    """Damped statistics of rows taken in a given order instead of the order of time.

    A row that is older than the key's last one does not decay the sums, and the key's clock moves back to
    it.  So only forward steps decay: along the order they add up to a clock of the key's own, which never
    goes back, and in which the closed form of :func:`damped` holds.  ``value=None`` means the step itself
    (ms, negative where time goes back).  ``rows`` come from :func:`in_sequence`; ``source`` may give the
    same rows as they were written, so that totals do not repeat what was added to ``rows`` since.
    """
    source = rows if source is None else source
    seq = Window.partitionBy(name, *keys).orderBy(*order)
    ends = source.groupBy(name, *keys).agg(F.max_by(time, F.struct(*order)).alias("_last"))
    before = ends.withColumn("_last", F.lag("_last").over(Window.partitionBy(*keys).orderBy(name)))
    zero = F.lit(0).cast("bigint")

    def stepped(df: DataFrame) -> DataFrame:
        df = df.withColumn("_prev", F.lag(time).over(seq)).withColumn("_pos", F.row_number().over(seq))
        step = F.coalesce(F.col(time) - F.coalesce("_prev", "_last"), zero)
        return df.join(before, [name, *keys]).withColumn("_step", step).drop("_prev", "_last")

    steps = stepped(source)

    def clocked(df: DataFrame) -> DataFrame:
        return running_sums(df, keys, order, {"_clock": F.greatest("_step", zero)}, steps, name)

    x = F.col("_step") if value is None else value
    out = damped(clocked(stepped(rows)), keys, x, stats, time="_clock", row_id="_pos", source=clocked(steps), name=name)
    return out.drop("_clock", "_step", "_pos")
