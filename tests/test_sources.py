"""Damaged files, fingerprints and streams that end."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.sources import files as I
from flowloom.streaming import flows as R
from flowloom.streaming.replay import closing, feed, replay, replay_batches


def test_damaged_files_are_told_apart(spark, tmp_path):
    rng = np.random.default_rng(0)
    table = pa.table({"row_id": np.arange(4000), "x": [f"v{i}" for i in rng.integers(0, 10 ** 9, 4000)]})
    for name in ("a", "b"):
        pq.write_table(table, tmp_path / f"{name}.parquet", row_group_size=500, compression="snappy")
    pq.write_table(table.slice(0, 0), tmp_path / "empty.parquet")
    (tmp_path / "text.parquet").write_text("not a table")
    data = bytearray((tmp_path / "b.parquet").read_bytes())
    (tmp_path / "cut.parquet").write_bytes(bytes(data[:len(data) // 2]))
    at = pq.ParquetFile(tmp_path / "b.parquet").metadata.row_group(5).column(1).data_page_offset
    data[at + 30:at + 900] = b"\xff" * 870
    (tmp_path / "b.parquet").write_bytes(bytes(data))
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("x", T.StringType())])
    rows, report = I.read_checked(spark, str(tmp_path), schema)
    found = {r["file_path"].rsplit("/", 1)[1]: (r["status"], r["n_expected"]) for r in report.collect()}
    assert found == {"a.parquet": ("read", 4000), "b.parquet": ("half-read", 4000), "empty.parquet": ("empty", 0),
                     "text.parquet": ("unreadable", 0), "cut.parquet": ("unreadable", 0)}
    assert rows.count() == 4000 and rows.select("file_path").distinct().count() == 1


def test_fingerprint_tells_tables_apart(spark):
    def of(*rows):
        return tuple(I.fingerprint(spark.createDataFrame(list(rows), "a string, b string")).first())

    tables = [(("x|y", "z"),), (("x", "y|z"),), (("~", "z"),), ((None, "z"),), (("", "z"),), (("z", None),),
              (("x", "y"), ("x", "y")), (("x", "y"),)]
    assert len({of(*t) for t in tables}) == len(tables)
    assert of(("a", "b"), ("c", None)) == of(("c", None), ("a", "b"))
    assert of() == (0, "0", "0")


# --- streams ------------------------------------------------------------------------------------------
def rows_of(rng, n, start, span):
    return [(i + start * 10 ** 6, "hot" if rng.random() < 0.6 else f"k{rng.integers(0, 9)}",
             int(start + rng.integers(0, span)), float(rng.integers(0, 50))) for i in range(n)]


SCHEMA = "row_id long, key string, stime long, x double"


@pytest.mark.parametrize("lam", [0.01, 3.0])
def test_damped_stream_goes_on_after_each_batch(spark, lam):
    rng = np.random.default_rng(1)
    # the third part begins before the second one ends: clocks go back
    parts = [rows_of(rng, 150, 0, 60_000), rows_of(rng, 200, 60_000, 50_000), rows_of(rng, 100, 80_000, 9_000),
             rows_of(rng, 50, 300_000, 5_000)]
    frames = [spark.createDataFrame(p, SCHEMA) for p in parts]
    got = {r["row_id"]: (r["weight"], r["mean"]) for r in replay_batches(
        spark, frames, lambda s, root: R.damped_stream(s, ["key"], F.col("x"), lam, root, 10 ** 9)).collect()}
    state, want = {}, {}
    for part in parts:
        for i, key, t, x in sorted(part, key=lambda r: (r[2], r[0])):
            last, w, s = state.get(key, (t, 0.0, 0.0))
            fade = np.exp(-lam * max(t - last, 0) / 1000)
            w, s = w * fade + 1, s * fade + x
            state[key] = (t, w, s)
            want[i] = (w, s / w)
    assert set(got) == set(want)
    for i, pair in want.items():
        assert got[i] == pytest.approx(pair, rel=1e-9)


def test_state_is_bounded_and_old_keys_go(spark):
    parts = [spark.createDataFrame([(i, f"k{i}", i * 1000, 1.0)], SCHEMA) for i in range(4)]
    root = feed(spark, parts, lambda s, root: R.damped_stream(s, ["key"], F.col("x"), 1.0, f"{root}/keyed", 1500))
    assert {r["key"] for r in spark.read.parquet(f"{root}/keyed/states/3").collect()} == {"k2", "k3"}
    assert spark.read.parquet(f"{root}/keyed/out").count() == 4
    with pytest.raises(Exception, match="states/0"):
        spark.read.parquet(f"{root}/keyed/states/0").count()


def test_counters_stream(spark):
    rng = np.random.default_rng(2)
    parts = [rows_of(rng, 80, s * 1000, 1000) for s in range(3)]
    got = {r["row_id"]: (r["n"], r["total"]) for r in replay_batches(
        spark, [spark.createDataFrame(p, SCHEMA) for p in parts],
        lambda s, root: R.counters_stream(s, ["key"], F.col("x"), root)).collect()}
    n, total = {}, {}
    for i, key, t, x in (r for p in parts for r in sorted(p, key=lambda r: (r[2], r[0]))):
        n[key], total[key] = n.get(key, 0) + 1, total.get(key, 0) + int(x)
        assert got[i] == (n[key], total[key])


def test_a_closing_row_lets_the_last_windows_out(spark):
    packets = spark.createDataFrame([(0, 0, "a", "b", 1, 2, 6, 10), (1, 500, "b", "a", 2, 1, 6, 5)],
                                    "row_id long, ts long, src_ip string, dst_ip string, src_port int, "
                                    "dst_port int, protocol int, bytes long")
    parts = [packets, closing(packets, "ts", 3000)]
    flows = replay(spark, parts, lambda s: R.flow_assembly_stream(s, 1000)).collect()
    assert [(f["src_ip"], f["src_pkts"], f["dst_pkts"]) for f in flows] == [("a", 1, 1)]
    assert closing(packets.limit(0), "ts", 1).count() == 0
