"""Compare registered queries with their SQL twins on one scale factor.

``python tests/check.py [name ...]``; shared by the test-suite.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path}'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v == int(v) and abs(v) < 1e15 else v
    if hasattr(v, "is_finite"):
        return _cell(float(v))
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, name, query, sql, sf_dir) -> str | None:
    """None when both sides agree, else what differs."""
    df = query(spark, sf_dir)
    got_c, got = normal(df.columns, df.collect())
    cur = con.execute(sql)
    want_c, want = normal([d[0] for d in cur.description], cur.fetchall())
    if got_c != want_c:
        return f"columns {sorted(set(got_c) ^ set(want_c))}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first {got_c} {bad[0]}"
    return None


def session(cpus: int = 8, shuffle: int = 8):
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("flowloom-check")
             .config("spark.sql.shuffle.partitions", str(shuffle))
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(names):
    import __spark_entry__ as entry

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or list(queries):
        t0 = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, queries[name], oracles[name], sf_dir)
                note = "ok" if problem is None else f"FAIL {problem[:600]}"
            else:
                problem, rows = None, queries[name](spark, sf_dir).count()
                note = f"rows {rows}"
        except Exception as e:  # report and go on
            problem = str(e)
            note = f"ERROR {type(e).__name__} {problem[:700]}"
        failed += problem is not None
        print(f"{name:32s} {time.time() - t0:6.2f}s  {note}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main(sys.argv[1:])
