"""Signal features of a group of flows: information, histogram entropy, Haar coefficients.

Everything is aggregated per (group, value) or (group, position pair) first, so a group holding a
large share of the rows is combined on many tasks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.counters import running_count
from flowloom.operators.prefix import spread, time_slices
from flowloom.session import materialize

_BINS = {"HH-L3-weight": 8, "HH-L0.01-weight": 100}


def mutual_information(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """MI (nats) of two discrete columns inside each group, from three count tables.

    The tables are stacked and summed by group in one aggregate, which nothing has to be sorted for.
    """
    c, none = F.col("c"), F.lit(None)
    joint = materialize(df.where(F.col(group).isNotNull()).groupBy(group, a, b).agg(F.count(F.lit(1)).alias("c")), "joint")
    term = c * F.log(c.cast("double"))
    parts = joint.select(group, c.alias("_n"), term.alias("_ij"), none.cast("double").alias("_i"), none.cast("double").alias("_j"))
    for name, col in (("_i", a), ("_j", b)):
        side = joint.groupBy(group, col).agg(F.sum("c").alias("c"))
        parts = parts.unionByName(side.select(group, term.alias(name)), allowMissingColumns=True)
    out = parts.groupBy(group).agg(*[F.sum(x).alias(x) for x in ("_n", "_ij", "_i", "_j")])
    n = F.col("_n").cast("double")
    mi = (F.col("_ij") - F.col("_i") - F.col("_j")) / n + F.log(n)
    return out.select(group, F.greatest(F.lit(0.0), mi).alias("MI-dir-L5-weight"))


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin with the last one closed; the bin edge decides rounding cases."""
    step = (hi - lo) / F.lit(float(bins))
    i = F.least(F.floor((x - lo) / (hi - lo) * F.lit(float(bins))), F.lit(bins - 1))
    i = F.when(x < lo + i * step, i - 1).otherwise(i)
    return F.when((i < bins - 1) & (x >= lo + (i + 1) * step), i + 1).otherwise(i)


def histogram_entropy(cells: DataFrame, group: str) -> DataFrame:
    """Entropy of the smoothed equal-width density, for each of the two bin counts.

    ``cells``: (group, x, c) value counts, the group's ``lo`` and ``hi`` and its size ``n4``.
    """
    same = F.col("lo") == F.col("hi")
    lo = F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo"))
    hi = F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi"))
    rows = cells.select(group, "n4", "c", (hi - lo).alias("width"), F.inline(F.array(*[
        F.struct(F.lit(b).alias("bins"), _bin(F.col("x"), lo, hi, b).alias("bin"))
        for b in _BINS.values()])))
    counts = rows.groupBy(group, "bins", "bin", "n4", "width").agg(F.sum("c").alias("c"))
    w = F.col("width") / F.col("bins")
    norm = 1 / w + F.col("bins") * 1e-10
    p, p0 = (F.col("c") / F.col("n4") / w + 1e-10) / norm, F.lit(1e-10) / norm
    parts = counts.withColumns({"_p": p * F.log(p), "_e": p0 * F.log(p0)})
    out = parts.groupBy(group, "bins").agg(
        F.sum("_p").alias("_p"), F.max("_e").alias("_e"), F.count(F.lit(1)).alias("_k"))
    value = -(F.col("_p") + (F.col("bins") - F.col("_k")) * F.col("_e"))
    return out.groupBy(group).agg(*[
        F.max(F.when(F.col("bins") == b, value)).alias(name) for name, b in _BINS.items()])


def haar_level(df: DataFrame, group: str) -> DataFrame:
    """One Haar step over (group, pos, v, n): pairs to one coefficient, an odd tail repeats.

    Signals shorter than four values count as zero-padded, so their tail is not repeated.
    """
    pairs = df.groupBy(group, F.floor(F.col("pos") / 2).alias("pos"), "n").agg(
        F.sum("v").alias("v"), F.count(F.lit(1)).alias("_k"))
    tail = F.when((F.col("_k") == 1) & (F.col("n") >= 4), 2.0).otherwise(1.0)
    return pairs.select(group, "pos", (F.col("v") * tail / math.sqrt(2.0)).alias("v"), "n")


def flow_group_features(df: DataFrame, group: str = "flow_id", src: str = "src_ip_bytes",
                        dst: str = "dst_ip_bytes", label: str = "label", time: str = "stime",
                        row_id: str = "row_id", slices: int | None = None) -> DataFrame:
    """MI, histogram entropies and Haar statistics of every group, with the label of its first row.

    Each part is written by a job of its own and the numbers meet in one aggregate, so that no task holds the
    sorts and hash tables of several parts at once.
    """
    source = materialize(time_slices(df.select(group, src, dst, label, time, row_id), time, row_id, slices), "group-rows")
    sizes = source.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.min(src).cast("double").alias("lo"),
        F.max(src).cast("double").alias("hi"),
        F.min_by(label, F.struct(time, row_id)).alias("label"))
    short = F.col("n") < 4  # padded with zeros up to four values
    sizes = sizes.withColumns({
        "n4": F.greatest("n", F.lit(4).cast("bigint")),
        "lo": F.when(short, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")),
        "hi": F.when(short, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi"))})
    sizes = materialize(sizes, "group-sizes")

    values = source.groupBy(group, F.col(src).cast("double").alias("x")).agg(
        F.count(F.lit(1)).alias("c"))
    padding = sizes.where(short).select(group, F.lit(0.0).alias("x"), (4 - F.col("n")).alias("c"))
    cells = values.unionByName(padding).join(sizes.select(group, "lo", "hi", "n4"), group)

    placed = running_count(spread(source), [group], "pos", source, [time, row_id])
    signal = placed.join(sizes.select(group, "n"), group).select(
        group, (F.col("pos") - 1).alias("pos"), F.col(src).cast("double").alias("v"), "n")
    coef = haar_level(haar_level(signal, group), group)
    v = F.col("v")
    haar = coef.groupBy(group).agg(
        F.sum(v * v).alias("HpHp-L0.01-weight"), F.avg(v).alias("HpHp-L0.01-mean"),
        F.stddev_pop(v).alias("HpHp-L0.01-std"), F.sqrt(F.sum(v * v)).alias("HpHp-L0.01-magnitude"))
    parts = [materialize(part, "group-part") for part in (
        mutual_information(source, group, src, dst), histogram_entropy(cells, group), haar)]
    names = [x for part in parts for x in part.columns if x != group]
    wide = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    wide = wide.groupBy(group).agg(*[F.max(f"`{x}`").alias(x) for x in names])
    return wide.join(sizes.select(group, "label"), group)
