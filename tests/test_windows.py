"""Ordered prefixes and damped statistics against plain recursions, hot keys included."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators.counters import running_count
from flowloom.operators.damped import Stat, damped
from flowloom.operators.flows import assemble_flows
from flowloom.operators.prefix import SLICE, hash_rank, spread, time_slices
from flowloom.functions.normalize import seeded_key

LAMS = (0.01, 0.1, 1.0, 3.0)


def recursion(rows, lam):
    """The online rule, one row after the other."""
    state, out = {}, {}
    for key, t, i, x in sorted(rows, key=lambda r: (r[1], r[2])):
        last, w, s, q = state.get(key, (None, 0.0, 0.0, 0.0))
        if last is not None and t > last:
            d = math.exp(-lam * (t - last) / 1000)
            w, s, q = w * d, s * d, q * d
        w, s, q = w + 1, s + x, q + x * x
        state[key] = (t, w, s, q)
        out[i] = (w, s / w, math.sqrt(max(0.0, q / w - (s / w) ** 2)))
    return out


def flows(n, seed, span):
    """Half of the rows share one key, a third of those one time."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}"
        t = span // 2 if key == "hot" and rng.random() < 0.33 else rng.randrange(span)
        rows.append((key, t, i, float(rng.randrange(1000))))
    return rows


@pytest.mark.parametrize("slices,span", [(1, 60_000), (7, 60_000), (64, 40_000_000)])
def test_damped_equals_recursion(spark, slices, span):
    rows = flows(1500, slices, span)
    df = spark.createDataFrame(rows, "key string, stime long, row_id long, x double")
    source = time_slices(df, slices=slices)
    stats = [Stat(f"{k}{i}", lam, k) for i, lam in enumerate(LAMS) for k in ("weight", "mean",
                                                                            "std")]
    got = damped(spread(source), ["key"], F.col("x"), stats, source=source).collect()
    assert len(got) == len(rows)
    for i, lam in enumerate(LAMS):
        want = recursion(rows, lam)
        for r in got:
            w, m, s = want[r.row_id]
            assert r[f"weight{i}"] == pytest.approx(w, rel=1e-9)
            assert r[f"mean{i}"] == pytest.approx(m, rel=1e-9)
            assert r[f"std{i}"] == pytest.approx(s, rel=1e-4, abs=1e-3)


def test_damped_by_hand(spark):
    df = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1000, 1, 2.0), ("a", 1000, 2, 3.0),
                                ("a", 3000, 3, 4.0)], "key string, stime long, row_id long, x double")
    out = damped(time_slices(df), ["key"], F.col("x"), [Stat("w", 1.0, "weight")])
    got = [r.w for r in out.orderBy("row_id").collect()]
    e = math.exp(-1)
    assert got == pytest.approx([1, 1 + e, 2 + e, 1 + (2 + e) * e * e])


@pytest.mark.parametrize("slices", [1, 16])
def test_jitter_crosses_slices(spark, slices):
    rows = flows(800, 3, 50_000)
    df = spark.createDataFrame(rows, "key string, stime long, row_id long, x double")
    out = damped(time_slices(df, slices=slices), ["key"], None, [Stat("m", 1.0, "mean")])
    last, gaps = {}, []
    for key, t, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        gaps.append((key, t, i, float(t - last[key]) if key in last else 0.0))
        last[key] = t
    want = recursion(gaps, 1.0)
    for r in out.collect():
        assert r.m == pytest.approx(want[r.row_id][1], rel=1e-9, abs=1e-9)


def test_one_time_value_is_spread_over_slices(spark):
    df = spark.range(4000).select(F.col("id").alias("row_id"), F.lit(5).cast("long").alias("stime"))
    sliced = time_slices(df, slices=16)
    sizes = [r["count"] for r in sliced.groupBy(SLICE).count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 1000
    got = running_count(spread(sliced), ["stime"], "n", sliced)
    assert got.where("n <> row_id + 1").count() == 0


def test_hash_rank_numbers_every_class_exactly(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"),
                                  F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("c"))
    key = seeded_key(1, F.col("row_id"))
    got = hash_rank(df, ["c"], key, "row_id", total="n").collect()
    for c in "ab":
        mine = sorted(r.rn for r in got if r.c == c)
        assert mine == list(range(1, len(mine) + 1))
        assert {r.n for r in got if r.c == c} == {len(mine)}
    top = hash_rank(df, ["c"], key, "row_id", below=F.lit(10)).collect()
    assert len(top) == 20
    assert {(r.row_id, r.rn) for r in top} == {(r.row_id, r.rn) for r in got if r.rn <= 10}


def test_flow_direction_and_gap(spark):
    packets = spark.createDataFrame(
        [(0, 0, "b", "a", 9, 5, 6, 10), (1, 50, "a", "b", 5, 9, 6, 20),
         (2, 1050, "a", "b", 5, 9, 6, 40)],
        "row_id long, ts long, src_ip string, dst_ip string, src_port int, dst_port int, "
        "protocol int, bytes long")
    first, second = assemble_flows(packets, gap_ms=1000, slices=2).orderBy("stime").collect()
    assert (first.src_ip, first.src_pkts, first.dst_pkts) == ("b", 1, 1)
    assert (first.src_ip_bytes, first.dst_ip_bytes, first.dur) == (10, 20, 0.05)
    assert (second.src_ip, second.src_pkts, second.dst_pkts) == ("a", 1, 0)


def test_enrichment_moves_the_rows_once(spark):
    from flowloom.catalog import bridge
    from flowloom.plans.enrich import enrich

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = enrich(bridge.base(spark, "/root/testdata/sf0.001"))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the rows themselves, and the narrow copy the jitter totals are taken from
    assert plan.count("REPARTITION_BY_COL") == 2
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 6 and all("SortMergeJoin [_slice" in line for line in joins)


def test_rows_of_one_class_are_ranked_in_many_tasks(spark):
    """The join with the counts deals rows by slice and class, not by class alone."""
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(4000).selectExpr("id as row_id", "if(id >= 0, 'a', 'b') as label")  # not a literal, which folds
        out = hash_rank(df, ["label"], seeded_key(42, F.col("row_id")), "row_id", total="n")
        got = out.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(r.rn for r in got) == list(range(1, 4001)) and {r.n for r in got} == {4000}
    assert len({r.task for r in got}) > 1
