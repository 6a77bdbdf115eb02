"""One method at every size: what used to switch, cap or drop at a row count."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.functions import tails
from flowloom.operators import detectors as D
from flowloom.operators import stats as T
from flowloom.operators.detectors.base import SingularData, quantile


@pytest.mark.parametrize("n", [1, 2, 4000, 30_000])
def test_quantile_is_exact_at_every_size(spark, n):
    rng = np.random.default_rng(n)
    x = np.where(rng.random(n) < 0.3, 1.5, np.exp(rng.normal(0, 4, n)))
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double").repartition(7)
    for p in (0.0, 0.1, 0.5, 0.937, 1.0):
        assert quantile(df, F.col("v"), p) == pytest.approx(np.percentile(x, 100 * p), rel=1e-12)


def test_quantile_of_nothing(spark):
    with pytest.raises(SingularData):
        quantile(spark.createDataFrame([(None,)], "v double"), F.col("v"), 0.5)


@pytest.mark.parametrize("n", [3, 5, 8, 30, 6000])
def test_normality_has_a_p_value_at_every_size(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    rows = [("a vs b", "m", "k", i, 0.0, float(v), float(v)) for i, v in enumerate(x)]
    pairs = spark.createDataFrame(rows, "comparison string, model string, metric string, iteration int, "
                                        "x double, y double, diff double")
    got = T.shapiro(pairs).first().shapiro_p
    assert got == pytest.approx(tails.shapiro_p(x), abs=1e-9) and 0 < got <= 1
    skew = pairs.withColumn("diff", F.exp("diff"))
    assert n < 30 or T.shapiro(skew).first().shapiro_p < 1e-3


@pytest.mark.parametrize("n, psi", [(300, 100), (5000, 64)])
def test_every_tree_draws_its_own_rows(spark, n, psi):
    df = spark.range(n).selectExpr("id as _id", "cast(id as double) as f0")
    near = D.IsolationForest(["row_id"], n_estimators=12)._tree_rows(df, ["f0"], n, psi).toPandas()
    # every tree has psi candidates at least, and they are the rows of its smallest numbers
    assert (near.groupby("tree").size() >= psi).all() and near.tree.nunique() == 12
    drawn = near.sort_values(["u", "_id"]).groupby("tree").head(psi)
    sizes = drawn.groupby("tree")["_id"].agg(["size", "nunique"])
    assert (sizes == psi).all().all()
    first, second = (set(drawn[drawn.tree == t]["_id"]) for t in (0, 1))
    assert first != second and (n > 12 * psi or first & second)


def test_histogram_trees_refuse_missing_values_and_depths(spark, monkeypatch):
    from flowloom.operators.detectors import supervised

    monkeypatch.setattr(supervised, "MOST_ROWS", 10)
    rows = [(i, i % 2, float(i) if i % 10 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id int, category int, f double")
    with pytest.raises(Exception, match="(?i)null|nan"):
        D.DecisionTree(["f"], max_depth=3).fit(df)
    with pytest.raises(ValueError, match="30 deep"):
        D.DecisionTree(["f"], max_depth=31).fit(df.dropna())


def test_large_forest_is_scored_in_parts(spark, monkeypatch):
    """A forest beyond one broadcast is neither collected nor broadcast, and scores the same."""
    from flowloom.operators.detectors import forest

    rng = np.random.default_rng(5)
    rows = [(i, float(a) if i % 50 else None, float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows + rows[:20], "row_id long, a double, b double")  # repeated rows stay
    make = D.IsolationForest(["a", "b"], n_estimators=12, max_samples=0.5, contamination=0.1)

    def result():
        model = make.fit(df)
        out = sorted((r.row_id, r.guess, r.score) for r in model.predict(df).collect())
        return model, out

    small, want = result()
    monkeypatch.setattr(forest, "MAX_BROADCAST", 24 * 1000)
    monkeypatch.setattr(forest, "_CHUNK", 100)
    monkeypatch.setattr(forest, "_shard_udf", None)
    large, got = result()
    assert small.n_shards == 1 and large.n_shards > 2 and len(got) == 420
    assert [g[:2] for g in got] == [w[:2] for w in want] and large.offset == pytest.approx(small.offset, rel=1e-12)
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-12)
