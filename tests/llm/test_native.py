"""Operators that SQL can express: the queries against DuckDB, and awkward rows."""

from __future__ import annotations

import pytest
from helpers import LONG, SF, documents, labels
from pyspark.sql import functions as F

import check
from flowloom.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, name):
    assert check.compare(spark, check.connect(SF), name, Q.QUERIES[name], Q.SQL[name], SF) is None


def test_every_operator_has_a_query():
    assert sorted(int(x[2:].split("_")[0]) for x in Q.QUERIES) == list(range(1, 14))


def test_rules_on_awkward_rows(spark):
    from flowloom.llm.rules import RULES, quality_rules

    rows = quality_rules(documents(spark)).collect()
    assert len(rows) == 11
    by_words = {r["n_words"]: r for r in rows}
    assert by_words[0]["base_failed"] and not by_words[0]["kept"]
    assert by_words[60_000]["n_repeat_words"] == 60_000 and by_words[60_000]["base_failed"]
    assert by_words[13]["kept"] and by_words[13]["broken_rules"] == []
    assert sum(r["n_words"] == 0 for r in rows) == 4
    assert quality_rules(documents(spark, [])).count() == 0
    assert {r.name for r in RULES} >= {"few_words", "symbols_per_word", "stop_words", "duplicate_lines"}


def test_repeated_windows_overlap(spark):
    from flowloom.llm.rules import quality_rules

    rows = [(1, "a " * 7, "en", "s"), (2, "a b c d e x a b c d e", "en", "s"), (3, "a b c d e f", "en", "s")]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules(documents(spark, rows)).collect()}
    assert got == {1: 7, 2: 10, 3: 0}


def test_mix_reaches_targets_and_repeats(spark):
    from flowloom.llm.mixing import pareto_mix

    rows = [(i, "w " * (5 + i * 37 % 90), "en", "abc"[i % 3] if i % 7 else None) for i in range(900)]
    first = pareto_mix(documents(spark, rows)).collect()
    again = pareto_mix(documents(spark, rows).repartition(5)).collect()
    assert sorted(first) == sorted(again) and len(first) == 900
    total = sum(r["size"] for r in first)
    targets = {r["source"]: r["target"] for r in first}
    assert abs(sum(targets.values()) - total) < 1e-6
    for source, target in targets.items():
        of = [r for r in first if r["source"] == source]
        assert abs(sum(r["taken"] for r in of) - target) < 10
        assert all(r["taken"] <= 3 * r["size"] for r in of) and target <= 3 * of[0]["source_size"]


def test_mix_prefers_larger_odds(spark):
    from flowloom.llm.mixing import pareto_mix

    rows = [(i, "w " * 10, "en", "ab"[i % 2]) for i in range(2000)]
    docs = documents(spark, rows).withColumn("odds", F.when(F.col("doc_id") < 1000, 9.0).otherwise(1.0))
    got = pareto_mix(docs, odds_col="odds").where("source = 'a'")
    taken = {r["early"]: r["n"] for r in got.groupBy((F.col("doc_id") < 1000).alias("early"))
             .agg(F.sum("copies").alias("n")).collect()}
    assert taken[True] > 1.5 * taken[False]


def test_mix_on_awkward_rows(spark):
    from flowloom.llm.mixing import pareto_mix

    rows = pareto_mix(documents(spark)).collect()
    assert len(rows) == 11 and all(r["taken"] == r["copies"] * r["size"] for r in rows)
    assert {r["source"] for r in rows} == {"a", "b", "c", "", None}
    assert pareto_mix(documents(spark, [])).count() == 0


def test_line_dedup_on_awkward_rows(spark):
    from flowloom.llm.lines import line_dedup

    line = " ".join(f"x{i}" for i in range(40))
    rows = [(2, f"intro\n{line}\nend", "en", "s"), (9, f"{line}\n\nother", "en", "s"), (9, None, "en", "s"),
            (None, f"own\n{line}", "en", "s"), (4, "", "en", "s")]
    out = {(r["doc_id"], r["text"]): r for r in line_dedup(documents(spark, rows)).collect()}
    # the null id comes first and keeps the line
    assert (None, f"own\n{line}") in out and (2, "intro\nend") in out and (9, "\nother") in out
    assert (9, None) in out and (4, "") in out
    assert out[2, "intro\nend"]["deleted"] == [1] and out[2, "intro\nend"]["_row"] == "x5"
    twice = line_dedup(documents(spark)).collect()
    assert len(twice) == 11 and sum(r["text"] == LONG for r in twice) == 1
    assert line_dedup(documents(spark, [])).count() == 0


def test_line_dedup_finds_runs_of_short_lines(spark):
    from flowloom.llm.lines import line_dedup

    run = [f"line {i} of run" for i in range(11)]
    docs = [(1, "\n".join(["a", *run, "b"]), "en", "s"), (2, "\n".join(["c", *run[:6], "d"]), "en", "s"),
            (3, "\n".join(["e", *run[2:], "f"]), "en", "s")]
    got = {r["doc_id"]: r["deleted"] for r in line_dedup(documents(spark, docs)).collect()}
    assert got == {1: [], 2: [], 3: list(range(1, 10))}


def test_ranking_on_awkward_rows(spark):
    from flowloom.llm.ranking import quality_rank

    docs = documents(spark)
    rows = quality_rank(docs, labels(spark)).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    none = quality_rank(docs, labels(spark, [])).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_rank(documents(spark, []), labels(spark)).count() == 0
