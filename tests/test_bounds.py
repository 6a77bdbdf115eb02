"""What one task has to hold, and fits that learn from every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.operators.groupfeats import flow_group_features


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_group_features_meet_in_one_aggregate(spark):
    rows = [(i, f"g{i % 3}" if i % 7 else None, i % 5 or None, i % 4, f"l{i % 2}", i // 3) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id int, flow_id string, src_ip_bytes int, dst_ip_bytes int, label string, stime int")
    out = flow_group_features(df)
    assert _plan(out).count("Join") == 1  # each join more is one more sort that the same task holds
    got = {r["flow_id"]: r for r in out.collect()}
    assert set(got) == {"g0", "g1", "g2"} and all(got[f"g{g}"]["label"] == f"l{(g or 3) % 2}" for g in range(3))
    assert all(v is not None for r in got.values() for v in r)


def test_quality_learns_from_every_label(spark):
    from flowloom.llm.ranking import quality_rank

    ids = spark.range(20_300).selectExpr("id as doc_id").withColumn("h", F.xxhash64("doc_id"))
    last = {r["doc_id"] for r in ids.orderBy(F.desc("h"), F.desc("doc_id")).limit(300).collect()}
    rows = [(i, "# # # & & |" if i in last else f"the plain words of a text that has {i % 9} more " + "and so on " * (i % 9),
             int(i not in last)) for i in range(20_300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int").repartition(4)
    # the only worse documents are those of the largest hashes
    for chunk in (20_000, 3_000):
        got = {r["doc_id"]: r for r in quality_rank(df, df, chunk=chunk).collect()}
        assert max(got[i]["score"] for i in last) < min(r["score"] for i, r in got.items() if i not in last)


def test_chunks_give_the_fit_of_one(spark):
    import numpy as np

    from flowloom.llm import ranking

    rng = np.random.default_rng(3)
    y = (rng.random(3000) < 0.6).astype(int)
    x = rng.normal(size=(3000, len(ranking.RATIOS) + 5)) + y[:, None] * np.array([1.5, -1] + [0] * 11)
    df = spark.createDataFrame([(i, int(a), [float(v) for v in b]) for i, (a, b) in enumerate(zip(y, x))],
                               "_id bigint, y int, x array<double>").repartition(5)
    whole, plain = ranking.fit(df), ranking.fit_pairs(x, y)
    assert np.allclose(whole["w"], plain["w"], atol=1e-7) and np.allclose(whole["mean"], plain["mean"])
    parts = ranking.fit(df, chunk=400)
    assert np.corrcoef(parts["w"], plain["w"])[0, 1] > 0.99 and ranking.fit(df.where("y = 1")) is None


def test_secret_formats_come_from_every_credential(spark):
    from flowloom.llm import secrets as X
    from flowloom.llm.grammar import learn

    one = "kind int, start int, end int, text string"
    plain = [f"{i * 7919 % 65536:04x}{i:020x}" for i in range(450)]
    words = [f"plainword{chr(97 + i % 26)}somewhat" for i in range(26)]
    texts = plain + [f"{'Z' * 20}{i}" for i in range(400)]
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame([(x,) for x in texts], "text string")
              .withColumn("h", F.xxhash64("text")).collect()}
    rare = sorted(texts[450:], key=hashes.get)[-30:]  # beyond the 400 smallest hashes

    def found(creds):
        return spark.createDataFrame([([(0, 0, len(x), x)], [(3, 0, len(w), w) for w in words]) for x in creds],
                                     f"spans array<struct<{one}>>, tokens array<struct<{one}>>").repartition(3)

    kept = sorted(plain, key=hashes.get)[:410]
    assert hashes[kept[399]] < min(map(hashes.get, rare))
    model = X.fit(found(kept + rare + ["Y" * 700]))
    a = model["kinds"][0]
    assert sum(a.of_shape(X.shape(x)) for x in rare) / 30 > -2 and a.of_shape("U" * 700) > a.floor / 2
    assert X.likelihood(model, rare[0]) > 0.5
    # few examples: the automaton of all of them, as if merged from one list
    few = X.fit(found(kept[:200] + rare))
    want = learn(kept[:200] + rare)
    assert few["kinds"][0].rows == want.rows and few["kinds"][0].floor == want.floor
    assert few["other"].rows == learn(words).rows


def test_rows_are_not_dealt_by_file(spark, monkeypatch):
    from flowloom.plans import enrich

    monkeypatch.setattr(enrich, "in_sequence", lambda df, order: df)
    df = spark.range(50_000).selectExpr("id as row_id", "id % 97 as stime", "concat('f', id % 3) as source_file")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000")
    try:
        rows = enrich.by_file(df)
        assert "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == 50_000 and rows.select("file_no").distinct().count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
