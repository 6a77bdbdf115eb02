"""Feature selection: mutual information, ranked-list union, leak screen."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.normalize import seeded_key
from flowloom.operators.balls import ball_counts, digamma
from flowloom.operators.prefix import SLICE
from flowloom.session import default_slices, materialize


def value_cells(df: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """Rows per (feature, value, ``by``), with a slice that never decreases in the value.

    Equal values collapse on the map side; one aggregate finds every feature's cut points.
    """
    slices = default_slices(df.sparkSession)
    probs = [i / slices for i in range(1, slices)]
    row = df.agg(*[F.percentile_approx(F.col(f"`{f}`").cast("double"), probs, 8 * slices)
                   .alias(f"c{i}") for i, f in enumerate(features)]).first()
    wide = df.select(*by, *[F.col(f"`{f}`").cast("double").alias(f"v{i}")
                            for i, f in enumerate(features)])
    for i in range(len(features)):
        cuts = sorted(set(row[i] or []))
        if cuts:
            wide = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol=f"v{i}",
                              outputCol=f"s{i}", handleInvalid="keep").transform(wide)
        else:
            wide = wide.withColumn(f"s{i}", F.lit(0.0))
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f"s{i}").cast("int").alias(SLICE),
                      F.col(f"v{i}").alias("value")) for i, f in enumerate(features)]
    long = wide.select(*by, F.inline(F.array(*cells)))
    return long.groupBy("feature", SLICE, "value", *by).agg(F.count(F.lit(1)).alias("n"))


def rows_below(cells: DataFrame, weight: str = "n", groups: tuple[str, ...] = ("feature",)):
    """Rows of the group with a strictly smaller value, as a column of ``cells``."""
    peers = Window.partitionBy(*groups, SLICE, "value")
    upto = Window.partitionBy(*groups, SLICE).orderBy("value").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    totals = cells.groupBy(*groups, SLICE).agg(F.sum(weight).alias("_before"))
    earlier = Window.partitionBy(*groups).orderBy(SLICE).rowsBetween(
        Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_before").over(earlier), F.lit(0)))
    below = F.sum(weight).over(upto) - F.sum(weight).over(peers)
    return (cells.withColumn("_below", below).join(totals, [*groups, SLICE])
            .withColumn("below", F.col("_below") + F.col("_before")).drop("_below", "_before"))


def mi_binned(df: DataFrame, features: list[str], target: str = "category",
              bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each feature with the target, over rank bins.

    A value's bin is ``floor(bins * rows_with_a_smaller_value / rows)``.
    """
    cells = rows_below(value_cells(df, features, [target]))
    # one row per feature
    sizes = cells.groupBy("feature").agg(F.sum("n").alias("n_all"))
    binned = cells.join(sizes, "feature").withColumn(
        "bin", F.floor(F.lit(bins) * F.col("below") / F.col("n_all")))
    joint = binned.groupBy("feature", "n_all", "bin", target).agg(F.sum("n").alias("n_ij"))
    # at most bins x classes rows per feature from here on
    by_bin = Window.partitionBy("feature", "bin")
    by_class = Window.partitionBy("feature", target)
    terms = joint.withColumns({
        "n_i": F.sum("n_ij").over(by_bin), "n_j": F.sum("n_ij").over(by_class)})
    part = (F.col("n_ij") / F.col("n_all")) * F.log(
        F.col("n_all").cast("double") * F.col("n_ij") / (F.col("n_i") * F.col("n_j")))
    return terms.groupBy("feature").agg(F.sum(part).alias("mi"))


def top_k(scores: DataFrame, k: int, score: str = "mi", name: str = "feature") -> DataFrame:
    """The k best names, best first; equal scores by name."""
    return scores.orderBy(F.desc(score), name).limit(k)


def in_column_order(selected: DataFrame, columns: list[str], name: str = "feature") -> DataFrame:
    position = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col(name))
    return selected.withColumn("ordinal", position.cast("int")).orderBy("ordinal")


def mi_knn(df: DataFrame, features: list[str], target: str = "category", k: int = 3,
           row_id: str = "row_id", seed: int = 42, block: int = 400_000) -> DataFrame:
    """Nearest-neighbour mutual information of a continuous and a discrete variable (Ross 2014).

    Rows of equal values are told apart by a seeded md5 number, which acts as an infinitely small jitter:
    the distance of two rows is the pair (difference of values, difference of numbers), the first part
    decides.  A row's ball reaches from its k-th neighbour of the same class to that neighbour's mirror
    image, both left out; the image ``2 x - y`` is kept with its rounding error, so comparisons are exact
    and the ball holds at least the row itself.  Rows are ordered by (value, number) and cut into slices of
    about ``block`` rows, however many rows share a value; a ball's rows are a difference of two ranks.

    Null and NaN values leave their feature; a class of one row does not count.
    """
    values = df.select(F.col(row_id).alias("_id"), F.col(target).alias("_c"), *[
        (F.col(f"`{f}`").cast("double") + F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)])
    values = materialize(values.where("_c is not null"), "values")
    slices = 1 + values.count() * len(features) // block
    rows, counts = _ordered_values(_marked(values), features, seed, k, slices)
    found = ball_counts(rows, counts, k).groupBy("f").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    classes = counts.groupBy("f", "_c").agg(F.sum("n").alias("n_c"), F.sum("with_id").alias("with_id"))
    sizes = classes.groupBy("f").agg(F.sum(F.col("with_id") * digamma(F.col("n_c"))).alias("sizes"))
    mean = (F.col("total") - F.col("sizes")) / F.col("n")
    return found.where("n > 0").join(F.broadcast(sizes), "f").select(  # one row per feature
        F.element_at(F.array(*[F.lit(f) for f in features]), F.col("f") + 1).alias("feature"),
        F.greatest(F.lit(0.0), digamma(F.col("n")) + mean).alias("mi"))


def _marked(values: DataFrame) -> DataFrame:
    """Rows with ``twice``: whether others have their id."""
    many = materialize(values.where("_id is not null").groupBy("_id").count().where("count > 1").select("_id"), "ids")
    if not many.limit(1).count():
        return values.withColumn("twice", F.lit(False))
    marked = values.join(many.withColumn("twice", F.lit(True)), "_id", "left")
    return marked.withColumn("twice", F.coalesce("twice", F.lit(False)))


def _ordered_values(values: DataFrame, features: list[str], seed: int, k: int, slices: int):
    """One row per row and feature in slices of the order (feature, value, number, id), and counts per slice and class.

    ``edge`` marks the first and last k rows of a class in a slice.
    """
    cells = [F.struct(F.lit(i).alias("f"), F.lit(f).alias("feature"), F.col(f"x{i}").alias("x"))
             for i, f in enumerate(features)]
    long = values.select("_id", "_c", "twice", F.inline(F.array(*cells))).where("x is not null and not isnan(x)")
    u = F.conv(F.substring(seeded_key(seed, F.col("_id"), F.col("feature")), 1, 12), 16, 10).cast("bigint")
    order = ["f", "x", "u", "_id"]
    long = (long.select("f", "_c", "x", u.alias("u"), "_id", "twice").repartitionByRange(slices, *order)
            .sortWithinPartitions(*order).withColumns({SLICE: F.spark_partition_id(), "pos": F.monotonically_increasing_id()}))

    def edges(batches):
        held = list(batches)  # one slice
        if not held:
            return
        t = pa.Table.from_batches(held)
        codes = t.column("_c").combine_chunks().dictionary_encode().indices.to_numpy()
        group = t.column("f").to_numpy().astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        size = np.diff(np.append(first, len(order)))
        nth = np.arange(len(order)) - np.repeat(first, size)
        edge = np.empty(len(order), bool)
        edge[order] = (nth < k) | (nth >= np.repeat(size, size) - k)
        yield from t.append_column("edge", pa.array(edge)).to_batches()

    schema = T.StructType([*long.schema.fields, T.StructField("edge", T.BooleanType())])
    rows = materialize(long.mapInArrow(edges, schema), "ordered")
    counts = materialize(rows.groupBy(SLICE, "f", "_c").agg(
        F.count(F.lit(1)).alias("n"), F.count("_id").alias("with_id"), F.min(F.struct("x", "u")).alias("first")), "counts")
    alone = counts.groupBy("f", "_c").agg(F.sum("n").alias("n"), F.min(SLICE).alias(SLICE)).where("n = 1").drop("n")
    if alone.limit(1).count():
        alone = materialize(alone, "alone")
        key = [SLICE, "f", "_c"]
        rows, counts = materialize(rows.join(alone, key, "left_anti"), "ordered"), counts.join(alone, key, "left_anti")
    return rows, counts


def feature_union(lists: DataFrame) -> DataFrame:
    """Ordered union of ranked lists (``list_no``, ``rank``, ``feature``); first one wins."""
    first = lists.groupBy("feature").agg(F.min(F.struct("list_no", "rank")).alias("_at"))
    order = Window.orderBy("_at.list_no", "_at.rank")  # one row per feature name
    return first.withColumn("ordinal", F.row_number().over(order)).select("ordinal", "feature")


def feature_overlap(lists: DataFrame) -> DataFrame:
    n = F.countDistinct("list_no").alias("n_lists")
    return lists.groupBy("feature").agg(n).where("n_lists > 1")


def project_union(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Keep the union features and the label; a feature the table lacks is an error."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"selected columns missing from the table: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in [*features, label]])


def leak_screen(df: DataFrame, features: list[str], target: str = "category",
                threshold: float = 0.999) -> DataFrame:
    """Single-feature ROC-AUC against the target; flags features that decide it alone."""
    one = F.sum(F.when(F.col(target) == 1, F.col("n")).otherwise(0))
    cells = value_cells(df, features, [target]).groupBy("feature", SLICE, "value").agg(
        one.alias("pos"), F.sum("n").alias("n"))
    ranked = rows_below(cells.withColumn("neg", F.col("n") - F.col("pos")), "neg")
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    auc = wins / (F.sum("pos").cast("double") * F.sum("neg"))
    out = ranked.groupBy("feature").agg(auc.alias("auc"))
    return out.withColumn("leak", F.greatest(F.col("auc"), 1 - F.col("auc")) >= threshold)
