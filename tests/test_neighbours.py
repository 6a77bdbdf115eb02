"""The exact neighbour join, the local outlier factor and neighbour-based selection against brute force."""

from __future__ import annotations

import hashlib
import math
import os
from functools import reduce
from operator import add

import numpy as np
import pytest

from flowloom.operators import detectors as D
from flowloom.operators import neighbours as N
from flowloom.operators.detectors.base import quantile
from flowloom.operators.detectors.lof import lof_table
from flowloom.operators.select import mi_knn


def plain(points, counts, asked, k, own):
    """{query: [(pid, distance, weight)]} by comparing all pairs."""
    out = {}
    for q, x in asked:
        rest, got = k, []
        for d2, p in sorted((reduce(add, [(a - b) * (a - b) for a, b in zip(x, y)]), p) for p, y in points):
            w = min(counts[p] - (own and p == q), rest)
            if w > 0:
                got.append((p, math.sqrt(d2), w))
                rest -= w
        out[q] = got
    return out


def table(spark, rows, width, first="row_id"):
    names = ", ".join(f"f{i} double" for i in range(width))
    return spark.createDataFrame([(i, *map(float, x)) for i, x in rows], f"{first} long, {names}")


def data(kind, rng, n):
    if kind == "grid":  # many equal rows and equal distances
        return rng.integers(0, 7, (n, 2))
    if kind == "hot":  # a third of the rows in one place, the rest far apart
        return np.where(rng.random((n, 1)) < 0.35, [[1.0, 1.0, 1.0]], rng.normal(size=(n, 3)) * 100)
    if kind == "line":
        return np.column_stack([rng.normal(size=n), np.zeros(n)])
    return rng.normal(size=(n, 9))


@pytest.mark.parametrize("kind, own", [("grid", True), ("hot", True), ("hot", False), ("line", False), ("wide", True)])
def test_neighbours_equal_brute_force(spark, monkeypatch, kind, own):
    monkeypatch.setattr(N, "_BLOCK", 37)
    rng = np.random.default_rng(7)
    rows = list(enumerate(data(kind, rng, 400)))
    names = [f"f{i}" for i in range(len(rows[0][1]))]
    points = N.distinct_points(table(spark, rows, len(names)), names, "row_id")
    cells, placed = N.space_cells(points, names, per_cell=12)
    assert len(cells.ids) > 6
    known = [(r["pid"], tuple(r[n] for n in names)) for r in points.collect()]
    counts = {r["pid"]: r["m"] for r in points.collect()}
    assert sum(counts.values()) == 400
    asked = known if own else [(i, tuple(x)) for i, x in enumerate(
        np.vstack([data(kind, rng, 60), [[500.0] * len(names)], [rows[0][1]]]))]
    got = N.nearest(table(spark, asked, len(names), "qid"), cells, placed, 6, own).collect()
    want = plain(known, counts, asked, 6, own)
    found = {q: sorted((r["d"], r["pid"], r["w"]) for r in got if r["qid"] == q) for q in want}
    assert found == {q: sorted((d, p, w) for p, d, w in v) for q, v in want.items()}


def test_few_points_and_large_k(spark):
    rows = [(i, (i % 3, 0.0)) for i in range(10)]
    points = N.distinct_points(table(spark, rows, 2), ["f0", "f1"], "row_id")
    cells, placed = N.space_cells(points, ["f0", "f1"])
    got = N.nearest(table(spark, [(5, (9.0, 9.0))], 2, "qid"), cells, placed, 50).collect()
    assert sum(r["w"] for r in got) == 10 and {r["pid"] for r in got} == {0, 1, 2}


def test_rows_with_missing_features(spark):
    nan = float("nan")
    rows = [(i, (i % 7, i % 5)) for i in range(60)] + [(100, (nan, 1.0))]
    df = table(spark, rows, 2).unionByName(spark.createDataFrame([(101, None, 2.0)], "row_id long, f0 double, f1 double"))
    out = {r["row_id"]: r for r in lof_table(df, "row_id", ["f0", "f1"], 5).collect()}
    assert len(out) == 62 and out[100]["factor"] is None and out[101]["factor"] is None and out[3]["factor"] > 0
    model = D.LocalOutlierFactor(["f0", "f1"], 5, contamination=0.1).fit(df)
    seen = {r["row_id"]: r for r in model.predict(df).collect()}
    assert seen[101]["score"] is None and seen[101]["guess"] == 0 and seen[0]["score"] is not None
    with pytest.raises(ValueError):
        lof_table(df.where("row_id >= 100"), "row_id", ["f0", "f1"], 5)


def test_weighted_quantile(spark):
    rng = np.random.default_rng(0)
    v, w = rng.normal(size=9000).round(2), rng.integers(0, 4, 9000)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, w)], "v double, w long")
    from pyspark.sql import functions as F

    for p in (0.0, 0.1, 0.5, 0.99, 1.0):
        assert quantile(df, F.col("v"), p, F.col("w")) == pytest.approx(np.quantile(np.repeat(v, w), p), abs=1e-12)


# --- neighbour-based mutual information -------------------------------------------------------------------
def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def plain_mi(rows, name, k=3):
    """``rows``: (id, class, value).  Distance is (difference, difference of md5 numbers)."""
    at = [(x, int(hashlib.md5(f"{i}:{name}:42".encode()).hexdigest()[:12], 16), c) for i, c, x in rows]
    terms = []
    for x, u, c in at:
        def far(y, v):
            return (y - x, v - u) if (y, v) > (x, u) else (x - y, u - v)

        same = sorted(far(y, v) for y, v, cc in at if cc == c and (y, v) != (x, u))
        if same:
            radius = same[min(k, len(same)) - 1]
            m = 1 + sum(far(y, v) < radius for y, v, _ in at if (y, v) != (x, u))
            terms.append(psi(min(k, len(same))) - psi(len(same) + 1) - psi(m))
    return max(0.0, psi(len(terms)) + sum(terms) / len(terms))


@pytest.mark.parametrize("block", [50_000, 7])
def test_mi_knn_equals_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        c = int(rng.random() < 0.3)
        rows.append((i, c, float(rng.normal() + 2 * c), float(rng.integers(0, 3)), 0.0, float(2.0 ** 40 + c)))
    names = ["clear", "few_values", "constant", "two_values"]
    df = spark.createDataFrame(rows, "row_id long, category int, " + ", ".join(f"{n} double" for n in names))
    got = {r["feature"]: r["mi"] for r in mi_knn(df.repartition(5), names, block=block).collect()}
    for j, name in enumerate(names):
        assert got[name] == pytest.approx(plain_mi([(r[0], r[1], r[2 + j]) for r in rows], name), abs=1e-9)
    assert got["clear"] > got["constant"]


def test_mi_knn_on_missing_values_and_rare_classes(spark):
    rows = [(i, i % 2, float(i % 2)) for i in range(40)] + [(50, 7, 3.0), (51, 0, None), (52, 1, float("nan"))]
    df = spark.createDataFrame(rows, "row_id long, category int, x double")
    got = mi_knn(df, ["x"]).collect()
    assert got[0]["mi"] == pytest.approx(plain_mi([r for r in rows[:40]], "x"), abs=0.05)
    assert mi_knn(df.where("row_id < 0"), ["x"]).count() == 0


def test_mi_knn_sorts_no_ends_of_balls(spark):
    """Of rows whose balls end in their own slice only sums are written, and no row is written more than once in order."""
    names = ["a", "b"]
    rows = [(i, i % 2, float(i % 40), float(i * i % 101)) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, category int, a double, b double")
    mi_knn(df.limit(9), names).collect()
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    seen = set(os.listdir(root))
    got = {r["feature"]: r["mi"] for r in mi_knn(df, names, block=400).collect()}
    written = {n: spark.read.parquet(f"{root}/{n}").count() for n in set(os.listdir(root)) - seen}
    assert sum(c for n, c in written.items() if n.startswith("ordered-")) == 1200
    assert sum(c for n, c in written.items() if n.startswith("balls-")) < 300
    for j, name in enumerate(names):
        assert got[name] == pytest.approx(plain_mi([(r[0], r[1], r[2 + j]) for r in rows], name), abs=1e-9)


def test_lists_of_neighbours_are_cut_in_batches(spark):
    """The k nearest over all visits, points by what they still count; no expression copies a list per entry."""
    near = spark.createDataFrame([
        (1, [(0.5, 7, 2), (2.0, 1, 4)]), (1, [(0.5, 3, 1), (1.0, 9, 9)]), (2, [(0.0, 4, 1)]), (3, []),
    ], f"qid long, near {N._NEAR}")
    out = N._merged(near, 5)
    got = {r["qid"]: [tuple(e) for e in r["near"]] for r in out.collect()}
    assert got == {1: [(0.5, 3, 1), (0.5, 7, 2), (1.0, 9, 2)], 2: [(0.0, 4, 1)], 3: []}
    assert "aggregate(near" not in out._jdf.queryExecution().toString()


def test_boxes_in_reach_come_in_bounded_parts(spark):
    """However many boxes a row reaches, a task holds a fixed number of pairs."""
    rng = np.random.default_rng(3)
    names = ["f0", "f1", "f2"]
    points = N.distinct_points(table(spark, list(enumerate(rng.normal(size=(300, 3)))), 3), names, "row_id")
    cells, _ = N.space_cells(points, names, per_cell=10)
    x, bound = rng.normal(size=(40, 3)), np.where(np.arange(40) % 2, 0.3, np.inf)
    parts = list(cells.reach(x, bound, 16))
    every = np.arange(len(cells.ids))
    want = {(i, c) for i in range(40) for c, d in zip(every, cells.gaps(np.repeat(x[i:i + 1], len(every), 0), every))
            if d <= bound[i]}
    got = [(int(i), int(c)) for rows, at in parts for i, c in zip(rows, at)]
    assert len(got) == len(set(got)) and set(got) == want and len(got) > 500
    assert max(len(rows) for rows, _ in parts) <= 16


def test_products_choose_the_points_that_differences_choose(monkeypatch):
    rng = np.random.default_rng(11)
    r = rng.normal(size=(300, 20)) * 1e-3 + rng.integers(0, 3, (300, 1)) * 1e3  # far from 0: squares cancel
    r[40:60] = r[:20]  # equally near ones
    ids, m = rng.permutation(300), rng.integers(1, 3, 300)
    calls, rough = [], N._perhaps_near

    def counted(*args):
        calls.append(rough(*args))
        return calls[-1]

    monkeypatch.setattr(N, "_perhaps_near", counted)
    for shift, bound in ((0.0, np.inf), (0.0, 5e-5), (-1e3, np.inf), (1e200, np.inf)):
        x = r + shift
        args = (ids, m, x), (ids, np.full(300, bound), x), 7, True
        got = list(zip(*N._nearest(*args)))
        with monkeypatch.context() as wide:
            wide.setattr(N, "_WIDE", 10 ** 6)
            want = list(zip(*N._nearest(*args)))
        assert all((np.concatenate(a) == np.concatenate(b)).all() for a, b in zip(got, want))
    assert any(c is not None for c in calls) and calls[-1] is None
