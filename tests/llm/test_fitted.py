"""Trained operators: contracts, held-out accuracy, gradients and parses against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import crc, documents, labels, real

from flowloom.llm import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label, folds, out, least", [
    ("op2_toxicity", 2, 4, 2, 0.6), ("op8_quality_classifier", 1, 5, 0, 0.9)])
def test_classifier_on_held_out_rows(spark, name, label, folds, out, least):
    truth = {r[0]: r[label] for r in real("labels", SF)}
    rows = Q.QUERIES[name](spark, SF).collect()
    assert len(rows) == 1000
    assert all(r["held_out"] == (crc(r["doc_id"], folds) == out) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    hits, said, true = sum(p & t for p, t in held), sum(p for p, _ in held), sum(t for _, t in held)
    assert 2 * hits / (said + true) >= least


def test_language_on_held_out_rows(spark):
    truth = {r[0]: r[2] for r in real("documents", SF)}
    rows = Q.QUERIES["op6_language_id"](spark, SF).collect()
    assert len(rows) == 1000 and all(r["held_out"] == (crc(r["doc_id"], 3) == 1) for r in rows)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(held) / len(held) >= 0.93


def test_language_on_awkward_rows(spark):
    from flowloom.llm.language import language_id

    docs = documents(spark)
    rows = language_id(docs, docs).collect()
    assert len(rows) == 11 and sum(r["lang_pred"] == "und" for r in rows) == 4
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in language_id(docs, docs.where("false")).collect()} == {"und"}
    assert language_id(documents(spark, []), docs).count() == 0
    assert language_id(documents(spark, [(1, "123 !? 45", "en", "s")]), docs).first()["lang_pred"] == "und"


def test_cross_parse_equals_greedy_search():
    from flowloom.llm.language import BLOCK, Model

    rng = np.random.default_rng(4)
    words = {x: ["".join(rng.choice(list(a), 4)) for _ in range(40)] for x, a in (("x", "abcd"), ("y", "cdef"))}
    train = {x: " ".join(rng.choice(w, 300)) for x, w in words.items()}
    texts = [" ".join(rng.choice(words["x" if i % 2 else "y"], 1 + i * 9)) for i in range(40)] + ["", "ZZ a?"]
    model = Model(train)

    def parse(text, corpus):
        n = 0
        for lo in range(0, len(text), BLOCK):
            part, phrase, n = text[lo:lo + BLOCK], "", n + 1
            for x in part:
                if phrase + x in corpus:
                    phrase += x
                else:
                    n, phrase = n + 1, x if x in corpus else ""
        return n

    got = model.phrases([t.lower() for t in texts])
    known = {chr(i) for i in np.flatnonzero(model.symbol)}
    want = [[parse("".join(x if x in known else "\0" for x in t.lower()), train[k].lower())
             for k in model.langs] for t in texts]
    assert got.tolist() == want


def test_gradients():
    from flowloom.llm.gru import Network

    rng = np.random.default_rng(0)
    net = Network(5, 3, rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, ids = rng.normal(size=(7, 5)), rng.integers(1, 7, (4, 6))
    ids[2, 4:] = 0

    def loss():
        gates = [g.astype(np.float64) for g in net.project(x)]
        logit, cache = net.run(gates, ids, keep=True)
        return float((logit * np.arange(1, 5)).sum()), gates, cache

    _, gates, cache = loss()
    g, dx = net.back(ids, gates, cache, np.arange(1, 5, dtype=np.float64))
    for k, d in enumerate("fb"):
        sums = np.zeros((7, 9))
        np.add.at(sums, ids.ravel(), dx[k].reshape(-1, 9))
        sums[0] = 0
        g["W" + d], g["c" + d] = x.T @ sums, sums.sum(0)
    for name, w in net.p.items():
        at = tuple(0 for _ in w.shape)
        step = 1e-2
        w[at] += step
        up = loss()[0]
        w[at] -= 2 * step
        down = loss()[0]
        w[at] += step
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-2 * max(1, abs(g[name][at])), name


def test_windows_cover_every_word():
    from flowloom.llm.toxicity import STRIDE, WINDOW, cut, pieces, windows

    sizes = np.array([0, 1, WINDOW, WINDOW + 1, 500])
    owner, first = cut(sizes)
    for i, n in enumerate(sizes):
        starts = first[owner == i]
        covered = {k for s in starts for k in range(s, min(n, s + WINDOW))}
        assert covered == set(range(n)) and (np.diff(starts) <= STRIDE).all()
    assert windows(np.zeros(0, np.int64), np.array([0]))[1].sum() == 0
    together, at = pieces(["ab", "abcdefghij"])
    alone = pieces(["ab"])[0]
    assert together[:at[1]].tolist() == alone.tolist()


def test_toxicity_on_awkward_rows(spark):
    from flowloom.llm.toxicity import toxicity

    docs = documents(spark)
    rows = toxicity(docs, labels(spark)).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 and r["windows"] >= 1 for r in rows)
    assert {r["score"] for r in toxicity(docs, labels(spark, [])).collect()} == {0.0}
    assert toxicity(documents(spark, []), labels(spark)).count() == 0


def test_pairs_rank_the_better(spark):
    from flowloom.llm.ranking import fit_pairs

    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.8).astype(float)
    x = rng.normal(size=(400, 3)) + y[:, None] * np.array([2, 0, -1])
    model = fit_pairs(x, y)
    assert model["w"][0] > 0.5 > abs(model["w"][1]) and model["w"][2] < 0
    assert fit_pairs(x, np.ones(400)) is None
