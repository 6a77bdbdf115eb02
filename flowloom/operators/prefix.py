"""Ordered prefixes that never gather a whole key in one task.

A window over ``partitionBy(key).orderBy(time)`` sends every row of a key to one task, so a key
holding a third of the table would sink the job.  Here the order itself is cut into slices of
about equal row count; a window then covers ``(slice, key)`` only, and what came before the slice
is a small table of per-(slice, key) totals joined back.  Rows hashed once on the slice serve
every key family, whatever its skew.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.session import default_slices, materialize, quoted

SLICE = "_slice"
_FIRST = Window.unboundedPreceding


def _bucketize(df: DataFrame, position: Column, cuts: list[float], name: str) -> DataFrame:
    """Binary search of the position among the cut points, on the JVM side."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    bucketizer = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_position",
                            outputCol=name, handleInvalid="keep")
    out = bucketizer.transform(df.withColumn("_position", position)).drop("_position")
    return out.withColumn(name, F.col(name).cast("int"))


def _quantiles(position: Column, slices: int) -> Column:
    probs = [i / slices for i in range(1, slices)]
    return F.percentile_approx(position, probs, 8 * slices)


def time_slices(df: DataFrame, time: str = "stime", row_id: str = "row_id",
                slices: int | None = None, name: str = SLICE) -> DataFrame:
    """Add a slice number that never decreases in the order ``(time, row_id)``.

    One small aggregate finds the cut points.  Where a single time value fills several slices, the
    row id becomes the fraction between two times and the cut points are taken again.  Any cut
    points give the same results; they only decide how evenly the work is spread.
    """
    slices = slices or default_slices(df.sparkSession)
    t = F.col(time).cast("double")
    low = df.agg(F.min(row_id).alias("a"), F.max(row_id).alias("z"),
                 _quantiles(t, slices).alias("cuts")).first()
    cuts = low.cuts or []
    if len(set(cuts)) < len(cuts) and low.z > low.a:
        t = t + (F.col(row_id) - F.lit(low.a)).cast("double") / F.lit(float(low.z - low.a + 1))
        cuts = df.agg(_quantiles(t, slices).alias("cuts")).first().cuts
    return _bucketize(df, t, sorted(set(cuts)), name)


def value_slices(df: DataFrame, value: str, slices: int | None = None,
                 name: str = SLICE) -> DataFrame:
    """Add a slice number that never decreases in ``value``; equal values share a slice."""
    slices = slices or default_slices(df.sparkSession)
    x = F.col(value).cast("double")
    cuts = df.agg(_quantiles(x, slices).alias("cuts")).first().cuts or []
    return _bucketize(df, x, sorted(set(cuts)), name)


def order_slices(df: DataFrame, order: list[str], name: str = SLICE) -> DataFrame:
    """Deal rows by range and add a slice number that never decreases in ``order``; written once.

    With an order that tells rows apart, a value that many rows share spreads over slices.
    """
    return materialize(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()), "ordered")


def hash_slice(md5_key: Column, slices: int) -> Column:
    """At least ``slices`` even slices of an md5 text, in its own sort order."""
    digits = min(5, max(1, math.ceil(math.log(slices, 16))))
    return F.conv(F.substring(md5_key, 1, digits), 16, 10).cast("int")


def spread(df: DataFrame, name: str = SLICE) -> DataFrame:
    """The one wide exchange: every later (slice, key) window and join reuses it."""
    return df.repartition(name)


def sums_before(totals: DataFrame, keys: list[str], sums: list[str],
                name: str = SLICE) -> DataFrame:
    """Replace each total by the sum over the earlier slices of the same key."""
    earlier = Window.partitionBy(*keys).orderBy(name).rowsBetween(_FIRST, -1)
    return totals.withColumns(
        {c: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in sums})


def running_sums(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column],
                 source: DataFrame | None = None, name: str = SLICE) -> DataFrame:
    """Add inclusive running sums per key.

    ``source`` is the same table before :func:`spread`; totals taken from it are combined on the
    map side, so that only one row per (slice, key) moves.  Keys must not be null.
    """
    source = rows if source is None else source
    local = Window.partitionBy(name, *keys).orderBy(*order).rowsBetween(_FIRST, 0)
    carry = {f"_carry_{out}": value for out, value in sums.items()}
    totals = source.groupBy(name, *keys).agg(*[F.sum(v).alias(c) for c, v in carry.items()])
    before = sums_before(totals, keys, list(carry), name)
    out = rows.withColumns({f"_local_{o}": F.sum(v).over(local) for o, v in sums.items()})
    out = out.join(before, [name, *keys], "left")
    out = out.withColumns({o: F.col(f"_local_{o}") + F.col(f"_carry_{o}") for o in sums})
    return out.drop(*carry, *[f"_local_{o}" for o in sums])


def hash_rank(df: DataFrame, classes: list[str], key: Column, tie: str, out: str = "rn",
              below: Column | None = None, total: str | None = None) -> DataFrame:
    """Number the rows of each class 1, 2, ... in the order of a seeded md5 key.

    ``total`` names a column that gets the row count of the class.  ``below`` (an expression that
    may use the class and total columns) keeps only rows numbered at most that high; whole slices
    past it are dropped before anything is sorted.  Class columns must not be null.
    """
    cols = df.columns
    slices = default_slices(df.sparkSession)
    keyed = df.withColumn("_key", key).withColumn(SLICE, hash_slice(F.col("_key"), slices))
    # one row per (class, slice): a few thousand rows however large the table is
    counts = keyed.groupBy(SLICE, *classes).agg(F.count(F.lit(1)).alias("_before"))
    everything = Window.partitionBy(*(classes or [F.lit(1)]))
    counts = counts.withColumn(total or "_total", F.sum("_before").over(everything))
    # written: as a plan it is dealt by class alone, and the join would gather the rows of a class in one task
    before = materialize(sums_before(counts, classes or [total or "_total"], ["_before"]), "before")
    ranked = keyed.join(before, [SLICE, *classes])
    if below is not None:
        ranked = ranked.where(F.col("_before") < below)
    local = Window.partitionBy(SLICE, *classes).orderBy("_key", tie)
    ranked = ranked.withColumn(out, F.row_number().over(local) + F.col("_before"))
    if below is not None:
        ranked = ranked.where(F.col(out) <= below)
    return ranked.select(*quoted(cols), out, *([total] if total else []))


def key_cuts(df: DataFrame, classes: list[str], key: Column, tie: str, ranks: Callable[[DataFrame], DataFrame],
             names: list[str]) -> DataFrame:
    """Per class, the (key, tie) of the rows with given ranks in the order of a seeded md5 key.

    ``ranks`` turns class sizes (classes, ``_n``) into wanted ranks, one column per name; a rank of 0
    has no row and gives null.  Only counts per (class, slice) and the rows of the slices that hold a
    wanted rank move; everything else about a row then follows from comparing its key with the cut.
    """
    slices = default_slices(df.sparkSession)
    keyed = df.select(*classes, F.col(tie).alias("_tie"), key.alias("_key"))
    keyed = keyed.withColumn(SLICE, hash_slice(F.col("_key"), slices))
    counts = materialize(keyed.groupBy(SLICE, *classes).agg(F.count(F.lit(1)).alias("_rows")), "counts")
    wanted = ranks(counts.groupBy(*classes).agg(F.sum("_rows").alias("_n")))
    before = sums_before(counts.withColumn("_before", F.col("_rows")), classes, ["_before"])
    each = wanted.select(*classes, F.inline(F.array(*[F.struct(
        F.lit(n).alias("_name"), F.col(n).cast("bigint").alias("_rank")) for n in names])))
    hit = materialize(before.join(each, classes).where("_rank > _before and _rank <= _before + _rows")
                      .select(SLICE, *classes, "_name", (F.col("_rank") - F.col("_before")).alias("_at")), "cuts")
    slots = hit.select(SLICE, *classes).distinct()
    local = Window.partitionBy(SLICE, *classes).orderBy("_key", "_tie")
    inside = keyed.join(slots, [SLICE, *classes]).withColumn("_rn", F.row_number().over(local))
    found = inside.join(hit, [SLICE, *classes]).where("_rn = _at")
    cut = found.groupBy(*classes).agg(*[F.max(F.when(
        F.col("_name") == n, F.struct("_key", "_tie"))).alias(n) for n in names])
    return materialize(cut, "key-cuts")


def _overall_before(counts: DataFrame) -> DataFrame:
    one = counts.withColumn("_all", F.lit(1))  # one row per slice
    return sums_before(one, ["_all"], ["_before"]).drop("_all")


def value_rank(cells: DataFrame, groups: list[str], value: str, weight: str,
               out: str = "rows_before", name: str = SLICE) -> DataFrame:
    """Rows with a smaller value in the same group.

    ``cells`` has one row per (group, value) with its row count in ``weight``, and a slice column
    that never decreases in ``value``.
    """
    totals = cells.groupBy(name, *groups).agg(F.sum(weight).alias("_before"))
    before = (sums_before(totals, groups, ["_before"], name) if groups else
              _overall_before(totals))
    local = Window.partitionBy(name, *groups).orderBy(value).rowsBetween(_FIRST, -1)
    ranked = cells.withColumn("_local", F.coalesce(F.sum(weight).over(local), F.lit(0)))
    ranked = ranked.join(before, [name, *groups])
    return ranked.withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before")
