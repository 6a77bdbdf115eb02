"""Train / validation / test assignments as one extra column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.normalize import seeded_key
from flowloom.operators.prefix import hash_rank, key_cuts
from flowloom.session import quoted


def _test_quota(ranked_counts: DataFrame, scope: list[str], target: str, share: float) -> DataFrame:
    """Test rows per class: ``ceil(share * n)`` in all, spread by largest remainder."""
    whole = Window.partitionBy(*(scope or [F.lit(1)]))  # one row per class
    t = ranked_counts.withColumn("_all", F.sum("_n").over(whole))
    t = t.withColumn("_test", F.ceil(F.lit(share) * F.col("_all")))
    t = t.withColumn("_quota", F.expr("(_test * _n) div _all"))
    t = t.withColumn("_rest", F.expr("(_test * _n) % _all"))
    t = t.withColumn("_missing", F.col("_test") - F.sum("_quota").over(whole))
    order = Window.partitionBy(*(scope or [F.lit(1)])).orderBy(F.desc("_rest"), target)
    extra = F.when(F.row_number().over(order) <= F.col("_missing"), 1).otherwise(0)
    return t.select(*scope, target, (F.col("_quota") + extra).alias("_quota"))


def supervised_split(df: DataFrame, seed: int = 42, target: str = "category",
                     row_id: str = "row_id", share: float = 0.2,
                     scope: tuple[str, ...] = (), key=None) -> DataFrame:
    """Add ``split`` (train / test), stratified; the test side has ``ceil(share * n)`` rows."""
    scope = list(scope)
    key = seeded_key(seed, F.col(row_id)) if key is None else key
    cuts = key_cuts(df, [*scope, target], key, row_id, lambda counts: _test_quota(
        counts, scope, target, share), ["_quota"])
    side = F.when(_up_to(key, row_id, "_quota"), "test").otherwise("train")
    return (df.join(cuts, [*scope, target], "left").withColumn("split", side)
            .select(*quoted(df.columns), "split"))


def _up_to(key: Column, row_id: str, cut: str) -> Column:
    """Whether a row comes no later than the cut in the order of the key; never where there is no cut."""
    return F.coalesce(F.struct(key.alias("_key"), F.col(row_id).alias("_tie")) <= F.col(cut), F.lit(False))


def mccv_splits(df: DataFrame, k: int, seed: int = 42, target: str = "category",
                row_id: str = "row_id", share: float = 0.2) -> DataFrame:
    """K fresh stratified splits in one plan: each row once per iteration 1..K.

    The copies are made in the scan and only compared with the cuts; they are never shuffled.
    """
    rows = df.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(k))))
    key = seeded_key(F.lit(seed) + F.col("iteration") - 1, F.col(row_id))
    return supervised_split(rows, seed, target, row_id, share, ("iteration",), key)


def mccv_held(df: DataFrame, k: int, seed: int = 42, target: str = "category",
              row_id: str = "row_id", share: float = 0.2) -> Column:
    """The iterations 1..K of :func:`mccv_splits` in which a row is on the test side, as an array column.

    Per iteration and class one cut is collected; rows are only compared with them.
    """
    rows = df.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(k))))
    key = seeded_key(F.lit(seed) + F.col("iteration") - 1, F.col(row_id))
    cuts = key_cuts(rows, ["iteration", target], key, row_id, lambda counts: _test_quota(
        counts, ["iteration"], target, share), ["_quota"]).where("_quota is not null").collect()
    held = []
    for r in cuts:
        own = F.struct(seeded_key(seed + r["iteration"] - 1, F.col(row_id)).alias("_key"), F.col(row_id).alias("_tie"))
        cut = F.struct(F.lit(r["_quota"]["_key"]).alias("_key"), F.lit(r["_quota"]["_tie"]).alias("_tie"))
        held.append(F.when((F.col(target) == r[target]) & (own <= cut), F.lit(r["iteration"])))
    return F.array_compact(F.array(*held)).cast("array<int>") if held else F.array().cast("array<int>")


def nested_folds(df: DataFrame, outer: Column, n_outer: int, n_inner: int, seed: int = 42,
                 target: str = "category", row_id: str = "row_id") -> DataFrame:
    """Add ``inner``: per outer iteration that trains on the row, ``iteration * n_inner + fold`` of its fold.

    ``outer`` is the array of iterations that hold the row out.  All iterations are ranked in one pass.
    """
    rounds = F.sequence(F.lit(1), F.lit(n_outer))
    long = df.select(row_id, target, F.explode(F.array_except(rounds, outer)).alias("_o"))
    ranked = hash_rank(long, ["_o", target], seeded_key(F.lit(seed) + F.col("_o") - 1, F.col(row_id)), row_id)
    number = (F.col("_o") * n_inner + F.col("rn") % n_inner).cast("int")
    folds = ranked.groupBy(row_id).agg(F.collect_list(number).alias("inner"))
    return df.join(folds, row_id, "left").withColumn("inner", F.coalesce("inner", F.array().cast("array<int>")))


def unsupervised_split(df: DataFrame, seed: int = 42, target: str = "category",
                       row_id: str = "row_id") -> DataFrame:
    """Benign 60/20/20 into train / valid / test, attack 20 % valid and 20 % test, disjoint."""
    key = seeded_key(seed, F.col(row_id))

    def ranks(counts: DataFrame) -> DataFrame:
        n = F.col("_n")
        held = F.ceil(F.lit(0.4) * n)                # benign rows kept out of training
        pool = n - F.ceil(F.lit(0.6) * n)            # attack rows used at all
        used = F.when(F.col(target) == 0, held).otherwise(pool)
        return counts.select(target, used.alias("_used"), F.ceil(F.lit(0.5) * used).alias("_test"))

    cuts = key_cuts(df, [target], key, row_id, ranks, ["_used", "_test"])
    rest = F.when(F.col(target) == 0, "train").otherwise("unused")
    side = (F.when(_up_to(key, row_id, "_test"), "test").when(_up_to(key, row_id, "_used"), "valid")
            .otherwise(rest))
    return df.join(cuts, target, "left").withColumn("split", side).select(*quoted(df.columns), "split")


def unsupervised_split_overlap(df: DataFrame, seed: int = 42, target: str = "category",
                               row_id: str = "row_id") -> DataFrame:
    """The older rule: valid and test attack rows are drawn independently and may overlap."""
    benign = unsupervised_split(df.where(F.col(target) == 0), seed, target, row_id)
    attack = df.where(F.col(target) == 1)
    parts = [benign]
    for name, s in (("valid", seed + 2), ("test", seed + 3)):
        drawn = hash_rank(attack, [], seeded_key(s, F.col(row_id)), row_id,
                          below=F.ceil(F.lit(0.2) * F.col("_n")), total="_n")
        parts.append(drawn.drop("rn", "_n").withColumn("split", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def stratified_kfold(df: DataFrame, folds: int = 10, seed: int = 42, target: str = "category",
                     row_id: str = "row_id", out: str = "fold") -> DataFrame:
    ranked = hash_rank(df, [target], seeded_key(seed, F.col(row_id)), row_id)
    return ranked.withColumn(out, (F.col("rn") % folds).cast("int")).select(*quoted(df.columns), out)


def split_summary(df: DataFrame, target: str = "category") -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.avg(F.col(target).cast("double")).alias("attack_share"))
