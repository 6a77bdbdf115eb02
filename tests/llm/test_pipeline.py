"""Every stage of the pipeline against a plain version on its own input."""

from __future__ import annotations

import duckdb
import pytest
from helpers import SF, documents, jaccard_components
from test_search import leaks

import corpus_pipeline as P
from flowloom.llm import oracles
from flowloom.session import configure, materialize


@pytest.fixture(scope="module")
def stages(spark):
    docs = configure(spark).read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), "stage"))
    return [d.collect() for d in out]


def test_columns(stages):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(list(rows[0].asDict()) == names for rows in stages[:5])
    assert list(stages[5][0].asDict())[:5] == names


def test_toxic_documents_go(spark, stages):
    from flowloom.llm.toxicity import toxicity

    scored = toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r["doc_id"] for r in scored.collect() if r["predicted"]}
    assert {r["doc_id"] for r in stages[1]} == {r["doc_id"] for r in stages[0]} - bad


def test_repeated_lines_go(stages):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(r["doc_id"], r["text"]) for r in stages[1]])
    cur = con.execute(oracles.OP4_LINE_DEDUP)
    names = [d[0] for d in cur.description]
    rows = [dict(zip(names, r)) for r in cur.fetchall()]
    want = {r["doc_id"]: r["text"] for r in rows if not 0 < r["n_lines"] == r["n_deleted"]}
    assert {r["doc_id"]: r["text"] for r in stages[2]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])


def test_one_document_of_a_group_stays(stages):
    groups = jaccard_components((r["doc_id"], r["text"]) for r in stages[2])
    assert {r["doc_id"] for r in stages[3]} == {top for _, top in groups.values()}


def test_leaks_go(stages):
    items = duckdb.sql(f"select * from '{SF}/benchmark.parquet'").fetchall()
    bad = {d for d, _ in leaks([(r["doc_id"], r["text"]) for r in stages[3]], items)}
    assert {r["doc_id"] for r in stages[4]} == {r["doc_id"] for r in stages[3]} - bad


def test_mix(stages):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in stages[4]])
    want = {r[0]: (r[1], r[4], r[5]) for r in con.execute(oracles.OP9_MIXING).fetchall() if r[5] > 0}
    assert {r["doc_id"]: (r["size"], r["taken"], r["copies"]) for r in stages[5]} == want


def test_stages_on_awkward_rows(spark):
    for rows in (None, []):
        docs = documents(spark) if rows is None else documents(spark, rows)
        for name, stage in P.STAGES:
            out = materialize(stage(spark, docs, SF), "awkward")
            assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
            if name != P.STAGES[-1][0]:
                assert out.columns == docs.columns, name
            docs = out
        assert rows is None or docs.count() == 0
