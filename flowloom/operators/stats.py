"""Paired significance tests over metric tables; Spark pairs, ranks and sums, tails finish a row."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from flowloom.functions import tails

GROUP = ["comparison", "model", "metric"]


@F.pandas_udf(DoubleType())
def _wilcoxon_p(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([tails.wilcoxon_p(a, int(b), c) for a, b, c in zip(w, n, ties)])


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([math.nan if pd.isna(a) else tails.t_two_sided(a, b) for a, b in zip(t, df)])


@F.pandas_udf(DoubleType())
def _score(p: pd.Series) -> pd.Series:
    return p.map(tails.normal_quantile)


@F.pandas_udf(DoubleType())
def _shapiro_p(n: pd.Series, s: pd.Series, inner: pd.Series, spread: pd.Series, low: pd.Series,
               high: pd.Series) -> pd.Series:
    return pd.Series([
        tails.shapiro_tail(tails.shapiro_w(int(k), a, b, c, sorted(lo), sorted(hi, reverse=True)), int(k))
        if k >= 3 and c > 0 else math.nan for k, a, b, c, lo, hi in zip(n, s, inner, spread, low, high)])


def pair(table: DataFrame, comparisons: list[tuple[str, str]]) -> DataFrame:
    """Values of two datasets side by side, matched by model, metric and iteration."""
    out = None
    for a, b in comparisons:
        left = table.where(F.col("dataset") == a).select("model", "metric", "iteration",
                                                         F.col("value").alias("x"))
        right = table.where(F.col("dataset") == b).select("model", "metric", "iteration",
                                                          F.col("value").alias("y"))
        rows = left.join(right, ["model", "metric", "iteration"]).withColumn(
            "comparison", F.lit(f"{a} vs {b}"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("diff", F.col("y") - F.col("x"))


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """W+, W-, the number of non-zero pairs and the tie term, per group."""
    live = pairs.where("diff <> 0").withColumn("_a", F.abs("diff"))
    by_size = Window.partitionBy(*GROUP).orderBy("_a")
    same = Window.partitionBy(*GROUP, "_a")
    c = F.count(F.lit(1)).over(same)
    live = live.withColumn("_t", c).withColumn("_r", F.rank().over(by_size) + (F.col("_t") - 1) / 2)
    t = F.col("_t").cast("double")
    sums = live.groupBy(*GROUP).agg(
        F.sum(F.when(F.col("diff") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("diff") < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"),
        F.count(F.lit(1)).alias("n"), F.sum(t * t - 1).alias("ties"))
    every = pairs.select(*GROUP).distinct()
    return every.join(sums, GROUP, "left").fillna(0)


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """Signed-rank test; 1 when all pairs agree."""
    p = F.when(F.col("n") == 0, 1.0).otherwise(_wilcoxon_p("w_plus", "n", "ties"))
    return signed_ranks(pairs).withColumn("wilcoxon_p", p)


def paired_t(pairs: DataFrame) -> DataFrame:
    """t statistic of ``x - y`` and its two-sided p-value."""
    out = pairs.groupBy(*GROUP).agg((-F.avg("diff")).alias("_m"), F.stddev_samp("diff").alias("_s"),
                                    F.count("diff").alias("n"))
    out = out.withColumn("t", F.try_divide(F.col("_m"), F.col("_s") / F.sqrt("n")))
    return out.select(*GROUP, "n", "t", _t_p("t", F.col("n") - 1).alias("t_p"))


def shapiro(pairs: DataFrame) -> DataFrame:
    """Normality of the paired differences; 1 when all are equal, missing for fewer than three.

    A value's weight follows from its rank and the group's size, so the statistic is a few sums over
    ranked rows and holds for groups of any size; a group is one row per iteration.
    """
    whole = Window.partitionBy(*GROUP)
    rows = pairs.where("diff is not null").withColumn("_n", F.count(F.lit(1)).over(whole))
    rows = rows.withColumn("_i", F.row_number().over(whole.orderBy("diff")))
    rows = rows.withColumn("_d", F.col("diff") - F.avg("diff").over(whole))
    rows = rows.withColumn("_m", _score((F.col("_i") - 0.375) / (F.col("_n") + 0.25)))
    ends = rows.groupBy(*GROUP).agg(
        F.max("_n").alias("_n"), F.min("diff").alias("_lo"), F.max("diff").alias("_hi"),
        F.sum(F.col("_m") * F.col("_m")).alias("_s"), F.sum(F.col("_m") * F.col("diff")).alias("_in"),
        F.sum(F.col("_d") * F.col("_d")).alias("_sq"),
        F.collect_list(F.when(F.col("_i") <= 2, F.col("diff"))).alias("_low"),
        F.collect_list(F.when(F.col("_i") > F.col("_n") - 2, F.col("diff"))).alias("_high"))
    out = pairs.select(*GROUP).distinct().join(ends, GROUP, "left")
    p = F.when(F.col("_lo") == F.col("_hi"), 1.0).when(
        F.col("_n") >= 3, _shapiro_p("_n", "_s", "_in", "_sq", "_low", "_high"))
    return out.select(*GROUP, F.when(~F.isnan(p), p).alias("shapiro_p"))


def friedman(table: DataFrame, datasets: list[str]) -> DataFrame:
    """Rank test over three datasets, iterations as blocks; the tail is ``exp(-chi2 / 2)``."""
    k = len(datasets)
    if k != 3:
        raise ValueError("the closed tail holds for three datasets")
    block = Window.partitionBy("model", "metric", "iteration")
    rows = table.where(F.col("dataset").isin(datasets)).withColumn(
        "_k", F.count(F.lit(1)).over(block)).where(F.col("_k") == k)
    same = Window.partitionBy("model", "metric", "iteration", "value")
    rows = rows.withColumn("_t", F.count(F.lit(1)).over(same)).withColumn(
        "_r", F.rank().over(block.orderBy("value")) + (F.col("_t") - 1) / 2)
    t = F.col("_t").cast("double")
    sums = rows.groupBy("model", "metric", "dataset").agg(
        F.sum("_r").alias("_sum"), F.count(F.lit(1)).alias("_n"), F.sum(t * t - 1).alias("_tie"))
    tot = sums.groupBy("model", "metric").agg(
        F.sum(F.col("_sum") * F.col("_sum")).alias("_ss"), F.max("_n").alias("n"),
        F.sum("_tie").alias("_tie"))
    n = F.col("n").cast("double")
    raw = F.lit(12.0) / (n * k * (k + 1)) * F.col("_ss") - 3 * n * (k + 1)
    chi2 = F.try_divide(raw, 1 - F.col("_tie") / (n * k * (k * k - 1)))
    return tot.select("model", "metric", "n", chi2.alias("chi2"),
                      F.exp(-chi2 / 2).alias("friedman_p"))


def adaptive(pairs: DataFrame) -> DataFrame:
    """Paired t where the differences pass for normal, else the signed-rank test."""
    out = (shapiro(pairs).join(paired_t(pairs).drop("n"), GROUP)
           .join(wilcoxon(pairs).select(*GROUP, "wilcoxon_p"), GROUP))
    normal = F.col("shapiro_p") >= 0.05
    usable = F.col("t_p").isNotNull() & ~F.isnan("t_p")
    test = (F.when(normal & usable, "paired t").when(normal, "signed rank (fallback)")
            .otherwise("signed rank"))
    p = F.when(normal & usable, F.col("t_p")).otherwise(F.col("wilcoxon_p"))
    return out.select(*GROUP, test.alias("test"), F.round(p, 5).alias("p_value"))


def normality(pairs: DataFrame) -> DataFrame:
    out = shapiro(pairs)
    return out.select(*GROUP, F.round("shapiro_p", 5).alias("shapiro_p"),
                      F.when(F.col("shapiro_p") >= 0.05, "yes").otherwise("no").alias("normal"))


def holm(table: DataFrame, p: str = "p_value", alpha: float = 0.05,
         tie: list[str] = GROUP) -> DataFrame:
    """Step-down flags: reject while ``p < alpha / (m - i)``; a missing p is never rejected.

    The input has one row per test, so one ordered window over all of them is small.
    """
    known = F.col(p).isNotNull() & ~F.isnan(p)
    m = F.count(F.when(known, 1)).over(Window.partitionBy(F.lit(1)))
    seq = Window.orderBy(F.when(known, 0).otherwise(1), p, *tie)
    out = table.withColumn("_m", m).withColumn("_i", F.row_number().over(seq))
    fail = F.when(known & (F.col(p) < alpha / (F.col("_m") - F.col("_i") + 1)), 0).otherwise(1)
    out = out.withColumn("_f", fail)
    failed = F.max("_f").over(seq.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("significant", failed == 0).drop("_m", "_i", "_f")


def stats_table(table: DataFrame, comparisons: list[tuple[str, str]], datasets: list[str],
                metrics: list[str]) -> DataFrame:
    """Mean difference and all p-values per comparison, model and metric."""
    rows = table.where(F.col("metric").isin(metrics))
    pairs = pair(rows, comparisons)
    mean = pairs.groupBy(*GROUP).agg((F.avg("y") - F.avg("x")).alias("mean_diff"))
    out = (mean.join(shapiro(pairs), GROUP)
           .join(wilcoxon(pairs).select(*GROUP, "wilcoxon_p"), GROUP)
           .join(friedman(rows, datasets).select("model", "metric", "friedman_p"),
                 ["model", "metric"], "left"))
    return out.withColumn("significant", F.col("wilcoxon_p") < 0.05)


def sig_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.when(F.col("significant"), 1)).alias("n_significant"),
                     F.count(F.lit(1)).alias("n_tests"), F.max("wilcoxon_p").alias("max_p"))
