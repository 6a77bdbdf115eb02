"""Metric tables: wide and long forms, summaries, comparisons with a baseline."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from flowloom import schemas as S
from flowloom.functions.tails import t_quantile


@F.pandas_udf(DoubleType())
def _t975(n: pd.Series) -> pd.Series:
    known = {k: t_quantile(0.975, int(k) - 1) if k > 1 else 0.0 for k in n.unique()}
    return n.map(known)


def split_key(key: Column, models: list[str] = S.MODELS) -> tuple[Column, Column]:
    """``{metric}_{model}`` to (metric, model): a known model name, else the last underscore."""
    metric, model = None, None
    for m in models:
        hit = key.endswith(f"_{m}")
        cut = F.substring(key, F.lit(1), F.length(key) - len(m) - 1)
        metric = F.when(hit, cut) if metric is None else metric.when(hit, cut)
        model = F.when(hit, m) if model is None else model.when(hit, m)
    last = F.substring_index(key, "_", -1)
    head = F.substring(key, F.lit(1), F.greatest(F.lit(0), F.length(key) - F.length(last) - 1))
    return metric.otherwise(head), model.otherwise(last)


def wide(long: DataFrame, keys: tuple[str, ...] = ("dataset", "iteration"),
         columns: list[str] | None = None) -> DataFrame:
    """One row per iteration with ``{metric}_{model}`` columns.

    The column names are known beforehand, so the pivot needs no extra pass.
    """
    columns = columns or [f"{m}_{model}" for model in S.MODELS for m in S.METRICS]
    named = long.withColumn("_k", F.concat_ws("_", "metric", "model"))
    return named.groupBy(*keys).pivot("_k", columns).agg(F.first("value"))


def long(table: DataFrame, keys: tuple[str, ...] = ("dataset", "iteration")) -> DataFrame:
    """Back to (keys, model, metric, value); cells without a value are left out."""
    names = [c for c in table.columns if c not in keys]
    rows = table.unpivot(list(keys), [F.col(f"`{c}`").cast("double").alias(c) for c in names],
                         "_k", "value")
    metric, model = split_key(F.col("_k"))
    return (rows.where("value is not null")
            .select(*keys, model.alias("model"), metric.alias("metric"), "value"))


def stack_results(frames: dict[str, DataFrame | None]) -> DataFrame:
    """Long table over several datasets' wide files; a missing file is skipped."""
    out = None
    for tag, table in frames.items():
        if table is None:
            continue
        rows = long(table, ("iteration",)).withColumn("dataset", F.lit(tag))
        out = rows if out is None else out.unionByName(rows)
    return out


def metric_summary(table: DataFrame, groups: tuple[str, ...] = ("model", "metric"),
                   value: str = "value") -> DataFrame:
    """Mean, sample deviation (0 for one value), 95 % t interval and count; NaN is skipped."""
    v = F.when(~F.isnan(value), F.col(value))
    out = table.groupBy(*groups).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                                     F.count(v).alias("n")).where("n > 0")
    out = out.withColumn("std", F.when(F.col("n") > 1, F.col("std")).otherwise(0.0))
    half = F.when(F.col("n") > 1, _t975(F.col("n")) * F.col("std") / F.sqrt("n")).otherwise(0.0)
    out = out.withColumn("_h", half)
    return out.select(*groups, "mean", "std", (F.col("mean") - F.col("_h")).alias("ci95_low"),
                      (F.col("mean") + F.col("_h")).alias("ci95_high"), "n")


def metric_sem(table: DataFrame, groups: tuple[str, ...] = ("dataset", "model", "metric")):
    """Mean and error: counts are cut to whole numbers, supervised quality shows its deviation."""
    sd, n = F.stddev_samp("value"), F.count("value")
    out = table.groupBy(*groups).agg(F.avg("value").alias("_m"), sd.alias("_sd"),
                                     (sd / F.sqrt(n)).alias("_sem"), n.alias("n"))
    count = F.col("metric").isin(S.COUNT_METRICS)
    err = F.when(F.col("model").isin(S.SUPERVISED_MODELS) & ~count, F.col("_sd")).otherwise(
        F.col("_sem"))

    def whole(c: Column) -> Column:
        # a mean that is whole but for the order of its additions stays whole
        return F.when(count, F.round(c, 9).cast("bigint").cast("double")).otherwise(c)

    return out.select(*groups, whole(F.col("_m")).alias("mean"), whole(err).alias("error"), "n")


def clip_error(mean: Column, error: Column) -> Column:
    """An error bar that does not rise above 1."""
    return F.least(error, 1 - mean)


def box_stats(table: DataFrame, groups: tuple[str, ...] = ("dataset", "model", "metric")):
    """Five-number summary; the values of a group are one per iteration."""
    names = ["low", "q1", "median", "q3", "high"]
    p = F.percentile("value", F.array(*[F.lit(i / 4) for i in range(5)]))
    out = table.groupBy(*groups).agg(p.alias("_p"))
    return out.select(*groups, *[F.element_at("_p", i + 1).alias(c) for i, c in enumerate(names)])


def cross_dataset(table: DataFrame, datasets: list[str], value: str = "mean") -> DataFrame:
    """(model, metric) rows, one column per dataset; a pair one dataset lacks stays with null."""
    return table.groupBy("model", "metric").pivot("dataset", datasets).agg(F.first(value))


def against_baseline(table: DataFrame, baseline: str, value: str = "mean",
                     lower_is_better: bool = False) -> DataFrame:
    """Percent change against the baseline dataset of the same model and metric."""
    base = (table.where(F.col("dataset") == baseline)
            .select("model", "metric", F.col(value).alias("_base")))
    gain = F.col("_base") - F.col(value) if lower_is_better else F.col(value) - F.col("_base")
    pct = F.when(F.col("dataset") == baseline, 0.0).otherwise(gain / F.col("_base") * 100.0)
    return table.join(base, ["model", "metric"], "left").withColumn("pct", pct).drop("_base")


def profile(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n_rows"),
                     F.countDistinct("metric").alias("n_metrics"),
                     F.countDistinct("model").alias("n_models"),
                     F.countDistinct("dataset").alias("n_datasets"))
