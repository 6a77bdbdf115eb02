"""Detectors, protocols and the whole experiment on small tables with a clear signal."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.operators import detectors as D
from flowloom.operators import metrics as M
from flowloom.operators.detectors.lof import lof_table
from flowloom.operators.splits import stratified_kfold
from flowloom.plans import experiment, protocols, tuning


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        y = int(i % 3 == 0)
        a, b = (rng.normal(6, 1.0, 2) if y else rng.normal(0, 1.0, 2))
        rows.append((i, float(a), float(b), float(rng.normal()), y))
    df = spark.createDataFrame(rows, "row_id long, a double, b double, noise double, category int")
    return df.persist()


def f1(model, df):
    return M.scores(model.predict(df), truth="category", average="binary").first().f1_score


@pytest.mark.parametrize("make", [
    lambda f: D.DecisionTree(f, max_depth=4), lambda f: D.NaiveBayes(f),
    lambda f: D.RandomForest(f, n_estimators=5, max_depth=4)])
def test_supervised(table, make):
    assert f1(make(["a", "b"]).fit(table), table) > 0.97


@pytest.mark.parametrize("make", [
    lambda f: D.IsolationForest(f, n_estimators=30, contamination=0.05),
    lambda f: D.IsolationForest(f, n_estimators=10, max_samples=0.2, max_features=0.5,
                                contamination=0.05),
    lambda f: D.LocalOutlierFactor(f, contamination=0.05),
    lambda f: D.EllipticEnvelope(f, contamination=0.05),
    lambda f: D.OneClassSVM(f, nu=0.05, gamma=0.1)])
def test_unsupervised(table, make):
    benign = table.where("category = 0")
    assert f1(make(["a", "b"]).fit(benign), table) > 0.8


def test_lof_equals_brute_force(spark):
    x = np.random.default_rng(2).normal(size=(60, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)],
                               "row_id long, a double, b double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    nb = np.argsort(d, axis=1)[:, :5]
    k = np.sort(d, axis=1)[:, 4]
    lrd = 1 / (np.maximum(np.take_along_axis(d, nb, 1), k[nb]).mean(1) + 1e-10)
    want = lrd[nb].mean(1) / lrd
    table = lof_table(df, "row_id", ["a", "b"], 5)
    assert [r.factor for r in table.orderBy("row_id").collect()] == pytest.approx(list(want))
    # outside the table every row is its own nearest neighbour
    nb, dist = np.argsort(np.where(np.isinf(d), 0, d), axis=1)[:, :5], np.sort(np.where(np.isinf(d), 0, d))[:, :5]
    score = lrd[nb].mean(1) * (np.maximum(dist, k[nb]).mean(1) + 1e-10)
    got = D.LocalOutlierFactor(["a", "b"], 5).fit(df).predict(df).orderBy("row_id").collect()
    assert [r.score for r in got] == pytest.approx(list(score))


def test_rows_of_short_rank_are_tolerated(spark):
    df = spark.range(200).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("a"),
                                 (F.col("id") * 2).cast("double").alias("b"))
    model = D.EllipticEnvelope(["a", "b"]).fit(df)
    assert model.predict(df).where("guess = 1").count() <= 25


def test_envelope_finds_the_lowest_determinant(spark):
    from itertools import combinations

    rng = np.random.default_rng(8)
    # two groups: the median start is drawn to the wide one
    x = np.vstack([rng.normal(0, 3, (7, 2)), rng.normal(9, 0.4, (7, 2))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double")
    h = 8
    least = min(np.linalg.slogdet(np.cov(x[list(c)].T, bias=True))[1] for c in combinations(range(14), h))
    model = D.EllipticEnvelope(["a", "b"], support_fraction=h / 14).fit(df)
    assert model.raw_logdet == pytest.approx(least, abs=1e-6)
    alone = D.EllipticEnvelope(["a", "b"], support_fraction=h / 14, starts=0).fit(df)
    assert model.raw_logdet <= alone.raw_logdet + 1e-9


@pytest.mark.parametrize("kernel", ["rbf", "linear", "poly"])
def test_one_class_svm_reaches_the_optimum(spark, kernel):
    from flowloom.operators.detectors.oneclass import feature_map, shortest_mixture

    rng = np.random.default_rng(3)
    x = rng.normal(2, 1, (120, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double")
    model = D.OneClassSVM(["a", "b"], nu=0.2, gamma=0.3, kernel=kernel, gap=0.002).fit(df)
    assert model.gap <= 0.002
    # the same dual by many plain steps over the kernel matrix of all rows
    phi = feature_map(kernel, 0.3, 2, x)
    z = phi(x)
    a = np.full(120, 1 / 120)
    for k in range(20_000):
        low = np.argsort(z @ (a @ z), kind="stable")[:24]
        a += (2 / (k + 2)) * (np.where(np.isin(np.arange(120), low), 1 / 24, 0) - a)
    want = float(np.sum((a @ z) ** 2))
    assert float(model.w @ model.w) == pytest.approx(want, rel=0.01)
    assert 20 <= model.predict(df).where("guess = 1").count() <= 26
    hull = rng.normal(1, 1, (30, 3))
    best = shortest_mixture(hull)
    assert (hull @ best >= best @ best - 1e-9).all()


def test_mccv_rows_and_determinism(table):
    one = {"Naive Bayes": protocols.SUPERVISED["Naive Bayes"]}
    got = [protocols.mccv_supervised(table, ["a", "b"], 2, constructors=one)
           .where("metric = 'f1_score'").orderBy("iteration").collect() for _ in range(2)]
    assert [r.iteration for r in got[0]] == [1, 2]
    assert got[0] == got[1]


def test_protocols_share_one_table(table):
    make = {"Naive Bayes": protocols.SUPERVISED["Naive Bayes"],
            "Decision Tree": lambda f, s: D.DecisionTree(f, max_depth=3, seed=s)}
    out = protocols.eval_nested(table, ["a", "b"], 2, 3, constructors=make)
    rows = {(r.iteration, r.model, r.metric): r.value for r in out.collect()}
    assert {k[:2] for k in rows} == {(i, m) for i in (1, 2) for m in make} | {(1, "all"), (2, "all")}
    assert all(rows[i, m, "TP"] + rows[i, m, "FN"] == 60 and rows[i, m, "f1_score"] > 0.95
               for i in (1, 2) for m in make)
    assert rows[1, "all", "iteration_time"] > sum(rows[1, m, "train_time"] for m in make)


def test_search_takes_the_best_trial(table):
    spaces = {"Decision Tree": {"max_depth": (0, 3), "min_samples_split": (2, 900), "criterion": ["gini", "entropy"]}}
    best, trials = tuning.search_supervised(table, ["a", "noise"], 4, folds=3, spaces=spaces)
    rows = trials.collect()
    top = max(rows, key=lambda r: (r.value, -r.trial))
    assert {k: str(v) for k, v in best["Decision Tree"].items()} == top.params and top.value > 0.9
    # a trial's fold metrics are those of its own models
    one = tuning.CLASSES["Decision Tree"](["a", "noise"], **best["Decision Tree"])
    folds = stratified_kfold(table, 3).persist()
    f1s = [M.scores(one.fit(folds.where(F.col("fold") != k)).predict(folds.where(F.col("fold") == k)),
                    truth="category").first().f1_score for k in range(3)]
    assert top.value == pytest.approx(sum(f1s) / 3)


def test_detectors_whose_rows_are_singular_score_zero(spark):
    flat = spark.createDataFrame([(i, 1.0, 1.0, i % 2) for i in range(60)], "row_id long, a double, b double, category int")
    _, trials = tuning.search_unsupervised(flat.where("category = 0"), flat, ["a", "b"], 1, spaces={
        "Elliptic Envelope": tuning.SPACES["Elliptic Envelope"]})
    assert [r.value for r in trials.collect()] == [0.0]


def test_experiment_smoke(table, tmp_path):
    spaces = {"Random Forest": {"n_estimators": (3, 4), "max_depth": (3, 4),
                                "max_features": ["sqrt"]},
              "Decision Tree": {"max_depth": (3, 4), "min_samples_split": (2, 3),
                                "criterion": ["log_loss"]},
              "Isolation Forest": {"n_estimators": (5, 6), "max_samples": (0.2, 0.3),
                                   "contamination": (0.05, 0.1), "max_features": (0.9, 1.0)},
              "One-Class SVM": {"nu": (0.05, 0.1), "gamma": ["scale"], "kernel": ["linear"]},
              "Local Outlier Factor": tuning.SPACES["Local Outlier Factor"],
              "Elliptic Envelope": tuning.SPACES["Elliptic Envelope"]}
    out = experiment.run_experiment(table, k=2, n_trials=1, n_subsample=200, iterations=1, folds=2,
                                    spaces=spaces)
    assert set(out.features) == {"a", "b"}
    assert out.summary.select("model").distinct().count() == len(S.MODELS)
    out.write(str(tmp_path), "T")
    names = {p.name for p in tmp_path.iterdir()}
    assert names == {"T_supervised_mccv", "T_unsupervised_mccv", "T_summary", "studies",
                     "run_metadata"}
