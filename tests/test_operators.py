"""Hand-computed cases of the row, sampling, metric and test operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.functions import normalize as N
from flowloom.functions import signal as G
from flowloom.functions import tails
from flowloom.operators import contracts as C
from flowloom.operators import encode as E
from flowloom.operators import metrics as M
from flowloom.operators import report as R
from flowloom.operators import sampling as P
from flowloom.operators import select as X
from flowloom.operators import splits as L
from flowloom.operators import stats as T
from flowloom.operators.groupfeats import flow_group_features
from flowloom.plans import tuning
from flowloom.sources import files


def test_row_signals(spark):
    df = spark.createDataFrame([(1, 2, 3, 4), (5, 5, 5, 5), (0, 0, 0, 0), (7, 0, 0, 0)],
                               "a int, b int, c int, d int")
    v = G.signal(*[F.col(c) for c in "abcd"])
    rows = df.select(G.value_information(v).alias("mi"), G.haar(v)["mean"].alias("h"),
                     G.power_sum(v).alias("p")).collect()
    assert [r.mi for r in rows] == pytest.approx(
        [math.log(4), 0, 0, math.log(4) - 0.75 * math.log(3)], abs=1e-12)
    assert [r.h for r in rows] == [5, 10, 0, 3.5]
    assert rows[2].p == 0


def test_states_and_services(spark):
    df = spark.createDataFrame([(3, 0), (3, 2), (0, 0), (0, 2)], "s int, d int")
    got = [r[0] for r in df.select(N.state_from_packets(F.col("s"), F.col("d"))).collect()]
    assert got == ["S0", "SF", "OTH", "OTH"]
    apps = spark.createDataFrame([("DNS.over.HTTP",), ("HTTP",), ("Unrated",), ("",), (None,),
                                  ("SSH",)], "a string")
    got = [r[0] for r in apps.select(N.derive_service(F.lit(None), F.col("a"))).collect()]
    assert got == ["dns", "http", "-", "None", "None", "Other"]


def test_encoders(spark):
    df = spark.createDataFrame([("f0", 1.0, 5.0, "tcp"), ("f0", 3.0, 5.0, "None"),
                                ("f1", 5.0, 6.0, "sctp")],
                               "source_file string, x double, k double, proto string")
    out = E.fit_minmax(E.first_file(df), ["x", "k"]).transform(df).collect()
    assert [r.x for r in out] == [0.0, 1.0, 2.0]
    assert [r.k for r in out] == [0.0, 0.0, 1.0]
    hot = E.one_hot(df, {"proto": S.KNOWN_VOCAB["proto"]}).orderBy("x").collect()
    assert hot[0].proto_tcp == 1.0 and hot[1].proto_None == 1.0
    assert sum(hot[2][f"proto_{v}"] for v in S.KNOWN_VOCAB["proto"]) == 0


def test_align_and_contracts(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert C.align(df, ["b", "c"]).collect()[0].asDict() == {"b": 2, "c": 0}
    with pytest.raises(ValueError):
        C.require_columns(df, ["z"])
    with pytest.raises(ValueError):
        X.project_union(df, ["a", "z"], "b")


def test_quota_sample(spark):
    df = spark.range(13).select(F.col("id").alias("row_id"),
                                F.when(F.col("id") < 10, "a").otherwise("b").alias("label"))
    got = P.quota_sample(df, {"a": 5, "b": 5, "c": 5}).collect()
    a, b = ([r for r in got if r.label == c] for c in "ab")
    assert len(a) == 5 and len({r.row_id for r in a}) == 5
    assert len(b) == 5 and len({(r.row_id, r.dup_no) for r in b}) == 5
    assert not [r for r in got if r.label == "c"]


def test_subsamples(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    one, again, other = (P.subsample_rows(df, 100, s) for s in (1, 1, 2))
    assert one.count() == 100
    ids = [sorted(r.row_id for r in d.collect()) for d in (one, again, other)]
    assert ids[0] == ids[1] != ids[2]
    assert P.subsample_rows(df, 5000, 1).count() == 1000
    assert P.subsample_rows(df, None, 1).count() == 1000


def test_split_sizes_and_disjointness(spark):
    df = spark.range(1001).select(F.col("id").alias("row_id"),
                                  (F.col("id") % 10 < 3).cast("int").alias("category"))
    sup = L.supervised_split(df)
    assert sup.where("split = 'test'").count() == math.ceil(0.2 * 1001)
    uns = {r.split: r["count"] for r in
           L.unsupervised_split(df).where("category = 1").groupBy("split").count().collect()}
    n = df.where("category = 1").count()
    assert sum(uns.values()) == n and uns["unused"] == math.ceil(0.6 * n)
    folds = L.stratified_kfold(df).groupBy("fold").agg(F.sum("category").alias("s")).collect()
    assert max(r.s for r in folds) - min(r.s for r in folds) <= 1


def test_confusion_by_hand(spark):
    pairs = [(1, 1)] * 3 + [(0, 0)] * 4 + [(0, 1)] + [(1, 0)] * 2
    df = spark.createDataFrame(pairs, "truth int, guess int")
    c = M.confusion(df).first()
    assert (c.TP, c.TN, c.FP, c.FN) == (3, 4, 1, 2)
    s = M.scores(df, average="binary").first()
    assert (s.accuracy, s.precision, s.recall) == pytest.approx((0.7, 0.75, 0.6))
    assert s.f1_score == pytest.approx(2 / 3) and s.MCC == pytest.approx(10 / math.sqrt(600))
    one = spark.createDataFrame([(1, 1), (1, 0)], "truth int, guess int")
    assert M.confusion(one).first().TP is None
    assert M.auc_label(one).first().auc == 0.0 and M.scores(one).first().MCC == 0.0


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)],
                               "score double, truth int")
    assert M.auc(df).first().auc == pytest.approx(0.875)


def test_holm_by_hand(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.005), (4, None)],
                               "i int, p_value double")
    got = {r.i for r in T.holm(df, tie=["i"]).where("significant").collect()}
    assert got == {0, 3}


def test_tails():
    assert tails.t_quantile(0.975, 19) == pytest.approx(2.093024, abs=1e-5)
    assert tails.chi2_isf(0.025, 10) == pytest.approx(20.4832, abs=1e-3)
    assert tails.chi2_isf(0.5, 2) == pytest.approx(2 * math.log(2))
    assert tails.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert tails.wilcoxon_p(21, 6, 0) == pytest.approx(2 / 64)
    assert tails.wilcoxon_p(10.5, 6, 0) == pytest.approx(1.0)
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    assert tails.shapiro_p(weights) == pytest.approx(0.0067, abs=2e-4)
    assert math.isnan(tails.shapiro_p([1, 1, 1]))


def test_paired_tests(spark):
    rows = []
    for i, (x, y) in enumerate([(1, 2), (2, 4), (3, 3), (4, 5), (5, 9), (6, 5), (7, 9), (8, 11)]):
        rows += [("A", "m", "k", i, float(x)), ("B", "m", "k", i, float(y))]
    table = spark.createDataFrame(rows, "dataset string, model string, metric string, "
                                        "iteration int, value double")
    pairs = T.pair(table, [("A", "B")])
    w = T.signed_ranks(pairs).first()
    assert (w.n, w.w_plus, w.w_minus) == (7, 26.0, 2.0)
    d = np.array([1, 2, 0, 1, 4, -1, 2, 3], dtype=float)
    assert T.paired_t(pairs).first().t == pytest.approx(
        -d.mean() / (d.std(ddof=1) / math.sqrt(8)))
    same = T.pair(table, [("A", "A")])
    assert T.wilcoxon(same).first().wilcoxon_p == 1.0
    assert T.shapiro(same).first().shapiro_p == 1.0


def test_summary_and_key_split(spark):
    df = spark.createDataFrame([("m", "f", 0.8), ("m", "f", 0.9), ("m", "f", 0.85),
                                ("m", "f", float("nan")), ("m", "g", 1.0)],
                               "model string, metric string, value double")
    got = {r.metric: r for r in R.metric_summary(df).collect()}
    assert got["f"].mean == pytest.approx(0.85) and got["f"].n == 3
    assert got["f"].ci95_low < 0.85 < got["f"].ci95_high
    assert got["g"]["std"] == 0.0 and got["g"].ci95_low == 1.0
    keys = spark.createDataFrame([("f1_score_Decision Tree",), ("a_b_c",)], "k string")
    metric, model = R.split_key(F.col("k"))
    assert [tuple(r) for r in keys.select(metric, model).collect()] == [
        ("f1_score", "Decision Tree"), ("a_b", "c")]


def test_mi_ranks_and_leakage(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 1000)
    good, mid, noise = y + rng.normal(0, 0.1, 1000), 0.3 * y + rng.normal(0, 1, 1000), \
        rng.normal(0, 1, 1000)
    df = spark.createDataFrame([(i, int(a), float(b), float(c), float(d)) for i, (a, b, c, d) in
                                enumerate(zip(y, good, mid, noise))],
                               "row_id long, category int, good double, mid double, noise double")
    for scores in (X.mi_knn(df, ["good", "mid", "noise"]),
                   X.mi_binned(df, ["good", "mid", "noise"])):
        got = {r.feature: r.mi for r in scores.collect()}
        assert got["good"] > got["mid"] and got["good"] > got["noise"]
        assert X.top_k(scores, 1).first().feature == "good"


def test_mi_knn_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 300)
    x = y * 0.7 + rng.normal(0, 1, 300)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, x))],
                               "row_id long, category int, x double")
    got = X.mi_knn(df, ["x"], block=40).first().mi

    def psi(n):
        return -np.euler_gamma + sum(1.0 / i for i in range(1, int(n)))

    z = (x - x.mean()) / x.std()
    terms = []
    for i in range(300):
        d = np.sort(np.abs(z[y == y[i]] - z[i]))[3]
        m = int((np.abs(z - z[i]) < d * (1 - 1e-9)).sum())
        terms.append(psi(3) - psi((y == y[i]).sum()) - psi(m))
    assert got == pytest.approx(max(0.0, psi(300) + np.mean(terms)), abs=1e-4)


def test_group_features_of_short_and_constant_groups(spark):
    df = spark.createDataFrame(
        [("one", 4, 1, "x", 0, 0), ("flat", 2, 1, "y", 0, 1), ("flat", 2, 1, "y", 1, 2),
         ("flat", 2, 1, "y", 2, 3), ("flat", 2, 1, "y", 3, 4), ("flat", 2, 1, "y", 4, 5)],
        "flow_id string, src_ip_bytes long, dst_ip_bytes long, label string, stime long, "
        "row_id long")
    got = {r.flow_id: r for r in flow_group_features(df, slices=2).collect()}
    assert got["one"]["HpHp-L0.01-mean"] == pytest.approx(2.0)
    # level 1: 2r2, 2r2, 2r2 (tail repeated); level 2: 4, 4 (tail repeated)
    assert got["flat"]["HpHp-L0.01-mean"] == pytest.approx(4.0)
    assert got["flat"]["HpHp-L0.01-weight"] == pytest.approx(32.0)
    assert got["flat"]["HH-L3-weight"] == pytest.approx(0.0, abs=1e-6)
    assert got["flat"]["MI-dir-L5-weight"] == pytest.approx(0.0, abs=1e-12)


def test_search_ranges():
    assert tuning.SPACES["Elliptic Envelope"] == {"contamination": (0.01, 0.1),
                                                  "support_fraction": (0.1, 1.0)}
    assert tuning.SPACES["Isolation Forest"]["n_estimators"] == (150, 500)


def test_registry_and_normalised_frame(spark):
    assert set(files.DATASETS) == {"OG10", "Gen10", "GenS10"}
    df = spark.createDataFrame([(1.0, "Normal", 5), (2.0, "dos", 6), (3.0, None, 7)],
                               "f double, label string, ltime int")
    got = files.normalize_frame(df, files.DATASETS["GenS10"]).orderBy("f").collect()
    assert [r.asDict() for r in got] == [{"f": 1.0, "category": 0}, {"f": 2.0, "category": 1},
                                         {"f": 3.0, "category": 1}]


def test_folder_by_suffix(spark, tmp_path):
    (tmp_path / "a_base.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b_base.csv").write_text("x,y\n3,4\n5,6\n")
    (tmp_path / "c_other.csv").write_text("x,y\n7,8\n")
    schema = "x int, y int"
    from pyspark.sql.types import _parse_datatype_string

    got = files.read_folder(spark, str(tmp_path), "_base.csv", _parse_datatype_string(schema))
    assert sorted((r.source_file, r.x) for r in got.collect()) == [("a", 1), ("b", 3), ("b", 5)]
