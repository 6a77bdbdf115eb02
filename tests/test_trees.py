"""Trees against brute force, and many models in one job against one at a time."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import detectors as D
from flowloom.operators.detectors import trees as T
from flowloom.operators.splits import mccv_held, mccv_splits, nested_folds, stratified_kfold, supervised_split


def impurity(y, w, criterion):
    t = np.array([w[y == k].sum() for k in range(3)])
    p = t[t > 0] / max(t.sum(), 1e-300)
    return t.sum() * ((1 - (p ** 2).sum()) if criterion == "gini" else -(p * np.log(p)).sum())


def left_side(x, f, cut, side):
    return np.where(np.isnan(x[:, f]), side, x[:, f] <= cut)


def all_cuts(x):
    for f in range(x.shape[1]):
        v, gone = np.unique(x[~np.isnan(x[:, f]), f]), np.isnan(x[:, f]).any()
        for a, b in zip(v, v[1:]):
            for side in ([False, True] if gone else [False]):
                yield f, (a + b) / 2, side
        if gone and len(v):
            yield f, v[-1], False


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
@pytest.mark.parametrize("missing", [0.0, 0.25])
def test_every_split_is_the_best_one(criterion, missing):
    rng = np.random.default_rng(int(missing * 100) + len(criterion))
    for _ in range(25):
        n = int(rng.integers(5, 40))
        x = rng.integers(0, 7, (n, 3)).astype(float)
        x[rng.random((n, 3)) < missing] = np.nan
        y, w, count = rng.integers(0, 3, n), rng.random(n) + 0.1, rng.integers(1, 4, n)
        spec = T.Spec(0, 0, 1, 4, None, 6, criterion, 0, False)
        feature, cut, side, child, share = T.grow(x, y, w, count, 3, spec, 0)
        todo = [(0, np.ones(n, bool), 0)]
        while todo:
            at, rows, depth = todo.pop()
            a, b, c, d = x[rows], y[rows], (w * count)[rows], count[rows]
            assert share[at] == pytest.approx(np.array([c[b == k].sum() for k in range(3)]) / c.sum())
            options = [impurity(b[m], c[m], criterion) + impurity(b[~m], c[~m], criterion)
                       for m in (left_side(a, *o) for o in all_cuts(a))]
            leaf = depth == 4 or d.sum() < 6 or len(set(b)) == 1 or not options
            assert (feature[at] < 0) == leaf
            if leaf:
                continue
            m = left_side(a, feature[at], cut[at], side[at])
            assert 0 < m.sum() < len(m)
            assert impurity(b[m], c[m], criterion) + impurity(b[~m], c[~m], criterion) == pytest.approx(min(options), abs=1e-7)
            whole = np.flatnonzero(rows)
            for k, part in ((0, whole[m]), (1, whole[~m])):
                mask = np.zeros(n, bool)
                mask[part] = True
                todo.append((child[at] + k, mask, depth + 1))


def table(spark, n=240, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, float(rng.normal() + 3 * (i % 3 == 0)), None if i % 11 == 0 else float(rng.normal()), int(i % 3 == 0))
            for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, category int")


def test_draws_follow_the_row_id():
    counts = T.drawn(np.arange(100_000), 42, 3)
    assert counts.mean() == pytest.approx(1, abs=0.02) and counts.var() == pytest.approx(1, abs=0.03)
    assert (T.drawn(np.arange(100_000)[::-1], 42, 3)[::-1] == counts).all()
    assert abs(np.corrcoef(counts, T.drawn(np.arange(100_000), 42, 4))[0, 1]) < 0.02


def test_many_models_equal_single_ones(spark):
    df = table(spark)
    folds = stratified_kfold(df, 3).select("row_id", "category", "a", "b", F.array("fold").alias("held"),
                                           F.array("fold").alias("skip"))
    from flowloom.operators.detectors.supervised import tree_rows

    rows = tree_rows(folds, ["a", "b"], "category", [0, 1], "skip", "held")
    made = [D.RandomForest(["a", "b"], 7, 5), D.DecisionTree(["a", "b"], 4, 5, "entropy")]
    specs = [m.spec(3 * i + k, k) for i, m in enumerate(made) for k in range(3)]
    many = T.score_many(rows, ["f0", "f1"], specs, T.fit_many(rows, ["f0", "f1"], specs, 2)).collect()
    assert len(many) == 2 * df.count()
    for i, m in enumerate(made):
        for k in range(3):
            alone = m.fit(folds.where(~F.array_contains("skip", k)).drop("skip", "held"))
            got = {r.row_id: (r.guess, r.score) for r in alone.predict(folds.where(F.array_contains("held", k))).collect()}
            assert {r["_id"]: (r["guess"], pytest.approx(r["score"])) for r in many if r["spec"] == 3 * i + k} == got


def test_forest_takes_missing_values_and_one_class(spark):
    df = table(spark)
    model = D.RandomForest(["a", "b"], 15, 6).fit(df)
    out = model.predict(df)
    assert out.where("guess = category").count() > 225 and out.where("score between 0 and 1").count() == 240
    again = D.RandomForest(["a", "b"], 15, 6).fit(df.repartition(7)).predict(df)
    assert sorted(r.score for r in again.collect()) == pytest.approx(sorted(r.score for r in out.collect()))
    one = D.DecisionTree(["a"]).fit(df.where("category = 1")).predict(df)
    assert {(r.guess, r.score) for r in one.collect()} == {(1, 1.0)}


def test_larger_tables_take_histogram_trees(spark, monkeypatch):
    from flowloom.operators.detectors import supervised

    monkeypatch.setattr(supervised, "MOST_ROWS", 100)
    model = D.DecisionTree(["a"], max_depth=2).fit(table(spark))
    assert isinstance(model, supervised.TreeModel) and model.predict(table(spark)).where("guess = category").count() > 215


def test_split_arrays_equal_the_split_tables(spark):
    df = table(spark, 95)
    held = df.select("row_id", mccv_held(df, 4).alias("held"))
    want = {(r.row_id, r.iteration) for r in mccv_splits(df, 4).where("split = 'test'").collect()}
    assert {(r.row_id, i) for r in held.collect() for i in r.held} == want
    one = {r.row_id for r in supervised_split(df, 42).where("split = 'test'").collect()}
    assert {i for i, k in want if k == 1} == one
    rows = nested_folds(df.join(held, "row_id"), F.col("held"), 4, 5).collect()
    for r in rows:
        assert sorted(i // 5 for i in r.inner) == [i for i in range(1, 5) if i not in r.held]
    for outer in range(1, 5):
        for fold in range(5):
            own = [r for r in rows if outer * 5 + fold in r.inner]
            assert 13 <= len(own) <= 18 and sum(r.category for r in own) in (4, 5, 6)


def split_rows(spark, n=600, missing=True):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.integers(0, 12) + 6 * (i % 3 == 0)), None if missing and i % 13 == 0 else float(rng.integers(0, 9)),
             int(i % 3 == 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, category int")
    return df, df.select("*", mccv_held(df, 2).alias("held")).withColumn("skip", F.col("held"))


def test_growing_and_scoring_in_one_task_equals_two_jobs(spark):
    from flowloom.operators.detectors.supervised import tree_rows

    _, splits = split_rows(spark)
    rows, names = tree_rows(splits, ["a", "b"], "category", [0, 1], "skip", "held"), ["f0", "f1"]
    made = [D.RandomForest(["a", "b"], 40, 5), D.DecisionTree(["a", "b"], 4, 5, "entropy")]
    specs = [m.spec(2 * i + k, k + 1) for i, m in enumerate(made) for k in range(2)]
    two = T.score_many(rows, names, specs, T.fit_many(rows, names, specs, 2)).collect()
    one = T.run_many(rows, names, specs, 2)
    assert {(r["spec"], r["_id"]): (r["_y"], r["guess"], pytest.approx(r["score"])) for r in two} == \
        {(r["spec"], r["_id"]): (r["_y"], r["guess"], r["score"]) for r in one.where("_y is not null").collect()}
    times = one.where("_y is null").collect()
    assert sorted(r["spec"] for r in times) == [0, 1, 2, 3] and all(r["grown"] > 0 and r["held"] == 0 for r in times)


def test_cells_of_few_values_give_the_exact_tree(spark):
    from flowloom.operators.detectors.supervised import tree_rows

    df, splits = split_rows(spark)
    rows, names = tree_rows(splits, ["a", "b"], "category", [0, 1], "skip", "held"), ["f0", "f1"]
    found = T.cells(rows, names, [1, 2], 64)
    sums = found.groupBy("split").agg(F.sum("train").alias("t"), F.sum("held").alias("h")).collect()
    assert {(r["split"], r["t"], r["h"]) for r in sums} == {(1, 480, 120), (2, 480, 120)}
    assert found.where("split = 1").count() < 480 and found.where("f1 is null").count() > 0
    specs = [D.DecisionTree(["a", "b"], 6).spec(k, k + 1) for k in range(2)]

    def guessed(table):
        out = T.run_many(table, names, specs, 2).where("_y is not null").groupBy("spec", "_y", "guess", F.round("score", 9))
        return sorted(map(tuple, out.agg(F.sum("held")).collect()))

    assert guessed(found) == guessed(rows)


def test_a_cell_is_drawn_as_often_as_its_rows(spark):
    x, y, times = np.array([[0.0], [1.0]]), np.array([0, 1]), np.array([5000, 20000])
    spec = T.Spec(0, 0, 30, 0, None, 2, "gini", 7, True)
    for nodes in [n for _, n, _ in T._grown(np.arange(2), x, y, times, 2, spec, range(30))]:
        assert nodes[4][0] == pytest.approx([0.5, 0.5], abs=0.02)  # balanced by the counts, not by the cells


def test_larger_protocols_grow_their_trees_over_cells(spark, monkeypatch):
    from flowloom.operators.detectors import supervised
    from flowloom.plans import protocols as P
    from flowloom.plans import runs

    def never(*_):
        raise AssertionError("one job of the library for each model")

    df, _ = split_rows(spark)
    made = {"Random Forest": lambda f, s: D.RandomForest(f, 60, 30, seed=s), "Naive Bayes": lambda f, s: D.NaiveBayes(f)}
    small = {(r.iteration, r.metric): r.value for r in
             P.mccv_supervised(df.fillna(0.0), ["a", "b"], 2, constructors=made).where("model = 'Random Forest'").collect()}
    monkeypatch.setattr(runs, "MOST_ROWS", 100)
    monkeypatch.setattr(supervised, "MOST_ROWS", 100)
    with monkeypatch.context() as m:
        m.setattr(supervised, "_fit_tree", never)
        got = P.mccv_supervised(df.fillna(0.0), ["a", "b"], 2, constructors=made).collect()
        assert {(r.iteration, r.model) for r in got} == {(i, m) for i in (1, 2) for m in made}
        large = {(r.iteration, r.metric): r.value for r in got if r.model == "Random Forest"}
        for i in (1, 2):
            assert sum(large[i, k] for k in ("TP", "TN", "FP", "FN")) == 120
            assert large[i, "accuracy"] == pytest.approx(small[i, "accuracy"], abs=0.06) and large[i, "train_time"] > 0
    # cells that one task cannot hold stay with the library, whole
    monkeypatch.setattr(T, "MOST_BINNED", 10)
    made = {"Decision Tree": lambda f, s: D.DecisionTree(f, 5, seed=s)}
    got = P.mccv_supervised(df.fillna(0.0), ["a", "b"], 1, constructors=made).where("metric in ('TP', 'TN', 'FP', 'FN')")
    assert got.agg(F.sum("value")).first()[0] == 120


def test_rows_with_one_id_are_scored_one_by_one(spark):
    from flowloom.operators.detectors.supervised import tree_rows

    df, _ = split_rows(spark, 200)
    ids = F.when(F.col("row_id") % 20 != 0, F.col("row_id") % 50)  # four rows an id, some without any
    held = F.when(F.col("row_id") < 80, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    rows = df.select(ids.alias("row_id"), "category", "a", "b", held.alias("held"), held.alias("skip"))
    rows = tree_rows(rows.unionByName(rows), ["a", "b"], "category", [0, 1], "skip", "held")
    specs = [D.RandomForest(["a", "b"], 90, 4).spec(0, 1)]
    out = T.run_many(rows, ["f0", "f1"], specs, 2).where("_y is not null")
    assert out.count() == 160 and out.where("score not between 0 and 1").count() == 0
    want = {r["_y"]: r["count"] for r in rows.where("size(held) > 0").groupBy("_y").count().collect()}
    assert {r["_y"]: r["n"] for r in out.groupBy("_y").agg(F.sum("held").alias("n")).collect()} == want


def test_the_size_of_a_table_does_not_change_its_trees(spark, monkeypatch):
    from flowloom.plans import protocols as P
    from flowloom.plans import runs

    df = table(spark, 400)
    made = {"Decision Tree": lambda f, s: D.DecisionTree(f, 6, seed=s, max_bins=4),
            "Random Forest": lambda f, s: D.RandomForest(f, 5, 6, seed=s, max_bins=4)}

    def measured():
        out = P.mccv_supervised(df, ["a", "b"], 1, constructors=made).where("metric not like '%time'")
        return sorted(map(tuple, out.collect()))

    whole = measured()
    monkeypatch.setattr(runs, "MOST_ROWS", 50)
    assert measured() == whole


def test_a_shallow_tree_is_the_top_of_a_deep_one():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 40, (500, 4)).astype(float), rng.integers(0, 2, 500)
    x[rng.random(x.shape) < 0.1] = np.nan
    count = T.drawn(np.arange(500), 5, 2)
    deep, *rest = [T.Spec(0, 0, 9, d, "sqrt", 2, "gini", 5, True) for d in (30, 0, 3, 7)]
    w = T._weights(y, 2)
    cut = T.shares_at(T.grow(x, y, w, count, 2, deep, 2), x, [0, 3, 7, 30])
    for s in (deep, *rest):
        assert (cut[s.depth] == T.shares(T.grow(x, y, w, count, 2, s, 2), x)).all()
    groups = T._shared([deep, T.Spec(1, 0, 20, 4, "log2", 2, "gini", 5, True), T.Spec(2, 0, 1, 4, None, 2, "gini", 5, False)], 4)
    assert [(g[0].trees, g[0].depth, [s.number for s in g[1:]]) for g in groups] == [(20, 30, [0, 1]), (1, 4, [2])]


def test_equal_rows_grow_the_trees_of_the_rows():
    rng = np.random.default_rng(4)
    x, y, ids = rng.integers(0, 4, (900, 3)).astype(float), rng.integers(0, 2, 900), rng.integers(0, 10 ** 9, 900)
    x[rng.random(x.shape) < 0.1] = np.nan
    spec = T.Spec(0, 0, 4, 12, "sqrt", 3, "gini", 8, True)
    for tree, nodes, _ in T._grown(ids, x, y, np.ones(900, np.int64), 2, spec, range(4)):
        want = T.grow(x, y, T._weights(y, 2), T.drawn(ids, 8, tree), 2, spec, tree)
        assert all((a == b).all() for a, b in zip(nodes, want))


def test_specs_that_share_trees_are_scored_as_if_alone(spark):
    from flowloom.operators.detectors.supervised import tree_rows

    _, splits = split_rows(spark)
    rows, names = tree_rows(splits, ["a", "b"], "category", [0, 1], "skip", "held"), ["f0", "f1"]
    specs = [D.RandomForest(["a", "b"], n, d).spec(i, 1) for i, (n, d) in enumerate([(40, 3), (70, 9)])]

    def scored(some):
        out = T.run_many(rows, names, some, 2).where("_y is not null").drop("grown", "used")
        return sorted(map(tuple, out.collect()))

    assert scored(specs) == sorted(scored(specs[:1]) + scored(specs[1:]))
