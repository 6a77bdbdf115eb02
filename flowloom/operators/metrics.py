"""Classification metrics from one contingency aggregate, exact ROC-AUC from score cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.prefix import SLICE, value_slices
from flowloom.operators.select import rows_below


def _share(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def contingency(df: DataFrame, groups: list[str], truth: str, guess: str) -> DataFrame:
    return df.groupBy(*groups, truth, guess).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, groups: list[str] = (), truth: str = "truth",
              guess: str = "guess") -> DataFrame:
    """TP, TN, FP, FN with the attack class as positive; null when the truth has one class."""
    groups = list(groups)
    t, g = F.col(truth), F.col(guess)
    cells = {"TP": (t == 1) & (g == 1), "TN": (t == 0) & (g == 0),
             "FP": (t == 0) & (g == 1), "FN": (t == 1) & (g == 0)}
    out = df.groupBy(*groups).agg(*[F.count(F.when(c, 1)).alias(k) for k, c in cells.items()])
    both = (F.col("TP") + F.col("FN") > 0) & (F.col("TN") + F.col("FP") > 0)
    return out.select(*groups, *[F.when(both, F.col(k)).alias(k) for k in cells])


def per_class(df: DataFrame, groups: list[str] = (), truth: str = "truth",
              guess: str = "guess") -> DataFrame:
    """Precision, recall, f1 and support of every class seen in the truth or the guesses."""
    groups = list(groups)
    cells = contingency(df, groups, truth, guess)
    hit = F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    rows = cells.select(*groups, F.inline(F.array(
        F.struct(F.col(truth).alias("class"), F.col("n").alias("support"),
                 zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col(guess).alias("class"), zero.alias("support"), F.col("n").alias("predicted"),
                 zero.alias("tp")))))
    out = rows.groupBy(*groups, "class").agg(*[F.sum(c).alias(c)
                                               for c in ("support", "predicted", "tp")])
    return out.withColumns({
        "precision": _share(F.col("tp"), F.col("predicted")),
        "recall": _share(F.col("tp"), F.col("support")),
        "f1_score": _share(2 * F.col("tp"), F.col("predicted") + F.col("support"))})


def scores(df: DataFrame, groups: list[str] = (), truth: str = "truth", guess: str = "guess",
           average: str = "macro") -> DataFrame:
    """Accuracy, precision, recall, f1 and MCC per group.

    ``average``: ``macro`` takes the plain mean over classes, ``binary`` the class 1 alone.
    """
    groups = list(groups)
    classes = per_class(df, groups, truth, guess)
    x = [F.col(c).cast("double") for c in ("tp", "support", "predicted")]
    tp, support, predicted = x
    sums = [F.sum(tp).alias("_c"), F.sum(support).alias("_s"),
            F.sum(support * predicted).alias("_tp"), F.sum(predicted * predicted).alias("_pp"),
            F.sum(support * support).alias("_tt")]
    for m in ("precision", "recall", "f1_score"):
        one = F.coalesce(F.max(F.when(F.col("class") == 1, F.col(m))), F.lit(0.0))
        sums.append((F.avg(m) if average == "macro" else one).alias(m))
    out = classes.groupBy(*groups).agg(*sums)
    c = F.col
    cov = c("_c") * c("_s") - c("_tp")
    spread = F.sqrt((c("_s") * c("_s") - c("_pp")) * (c("_s") * c("_s") - c("_tt")))
    return out.select(*groups, (c("_c") / c("_s")).alias("accuracy"), "precision", "recall",
                      "f1_score", _share(cov, spread).alias("MCC"))


def auc(df: DataFrame, groups: list[str] = (), truth: str = "truth",
        score: str = "score") -> DataFrame:
    """Area under the ROC curve, ties at half weight; 0 when a class is missing.

    Equal scores collapse before anything is sorted, then ranks come from score slices.
    """
    groups = list(groups)
    keep = df.select(*groups, F.col(truth).alias("_t"), F.col(score).cast("double").alias("value"))
    flat = keep if groups else keep.withColumn("_g", F.lit(0))
    names = groups or ["_g"]
    cells = (value_slices(flat, "value").groupBy(*names, SLICE, "value")
             .agg(F.count(F.when(F.col("_t") == 1, 1)).alias("pos"),
                  F.count(F.when(F.col("_t") != 1, 1)).alias("neg")))
    ranked = rows_below(cells, "neg", tuple(names))
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    total = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.groupBy(*names).agg(_share(wins, total).alias("auc")).select(*groups, "auc")


def auc_label(df: DataFrame, groups: list[str] = (), truth: str = "truth",
              guess: str = "guess") -> DataFrame:
    """ROC-AUC of hard 0/1 predictions: the mean of both recalls."""
    c = confusion(df, groups, truth, guess)
    hit = _share(F.col("TP"), F.col("TP") + F.col("FN"))
    miss = _share(F.col("TN"), F.col("TN") + F.col("FP"))
    value = F.when(F.col("TP").isNull(), 0.0).otherwise((hit + miss) / 2)
    return c.select(*groups, value.alias("auc"))


def auc_ovr_macro(df: DataFrame, classes: dict[int, str], truth: str = "truth") -> DataFrame:
    """Mean of the one-vs-rest areas; ``classes`` maps a class to its score column."""
    rows = df.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("class"), (F.col(truth) == k).cast("int").alias("hit"),
                 F.col(s).cast("double").alias("score")) for k, s in classes.items()])))
    return auc(rows, ["class"], "hit", "score").agg(F.avg("auc").alias("auc"))


def composite(precision: Column, recall: Column, f1: Column, weight: float = 1 / 3) -> Column:
    return (precision + recall + f1) * F.lit(weight)


def evaluation(df: DataFrame, groups: list[str], average: str, truth: str = "truth",
               guess: str = "guess", score: str | None = None) -> DataFrame:
    """All quality metrics of one or more models: one row per group."""
    out = scores(df, groups, truth, guess, average)
    area = auc(df, groups, truth, score) if score else auc_label(df, groups, truth, guess)
    return out.join(area, groups).join(confusion(df, groups, truth, guess), groups)
