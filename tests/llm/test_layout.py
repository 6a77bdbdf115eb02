"""Whitening, Merkle manifest and packing against plain readings of their rules."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import LONG, SF, documents, real
from pyspark.sql import functions as F

from flowloom.llm import queries as Q

CLASH = ("n", "deviation", "explained", "_grid", "_got", "x", "block")


# --- whitening ------------------------------------------------------------------------------------------
def embeddings(spark, rows, kind="float", extra=CLASH):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")
    return df.select("*", *[F.lit("x").alias(c) for c in extra])


def plain_fit(vectors):
    x = np.array([[math.floor(64 * float(v)) + 1_000_000 for v in row] for row in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    deviation = [sum((int(n * a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    centred = fit - s / n
    values = np.linalg.eigvalsh(centred.T @ centred / n)[::-1]
    return n, deviation, values, centred.T @ centred / n, x - s / n


def check_whitened(rows, vectors, components):
    n, deviation, values, v, centred = plain_fit(vectors)
    assert [r["n"] for r in rows] == [n] * len(rows)
    assert [r["deviation"] for r in rows] == deviation
    z = np.array([r["whitened"] for r in rows])
    assert z.shape == (len(vectors), min(components, v.shape[0]))
    k = z.shape[1]
    assert np.allclose(rows[0]["explained"], values[:k] / np.trace(v), rtol=1e-9)
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9
    # the directions follow from the projections, and are eigenvectors of the covariance
    w = np.linalg.lstsq(centred, z * np.sqrt(values[:k]), rcond=None)[0]
    assert np.allclose(v @ w, w * values[:k], atol=1e-8 * values[0]) and np.allclose(w.T @ w, np.eye(k), atol=1e-8)


def test_whitening_query(spark):
    got = Q.QUERIES["op11_embedding_whitening"](spark, SF).collect()
    table = dict((r[0], r[1]) for r in real("embeddings"))
    assert len(got) == 16 * len(table)
    rows = defaultdict(dict)
    for r in got:
        rows[r["vec_id"]][r["component"]] = r
    ids = sorted(rows)
    whole = [dict(n=rows[i][1]["n"], deviation=rows[i][1]["deviation"], identity_error=rows[i][1]["identity_error"],
                  whitened=[rows[i][k + 1]["whitened"] for k in range(16)],
                  explained=[rows[i][k + 1]["explained"] for k in range(16)]) for i in ids]
    check_whitened(whole, [table[i] for i in ids], 16)


def test_whitening_of_repeats_and_steep_spectra(spark):
    from flowloom.llm.whiten import whiten

    rng = np.random.default_rng(3)
    base = (rng.normal(size=(300, 6)) * [4000, 300, 300, 20, 1, 0.1]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    vectors = [list(map(float, v)) for v in base] + [list(map(float, base[0]))] * 400
    df = embeddings(spark, list(enumerate(vectors)), "double").repartition(40)
    rows = sorted(whiten(df, components=4).collect(), key=lambda r: r["vec_id"])
    assert rows[0]["x"] == "x" and len(rows) == 700
    check_whitened(rows, vectors, 4)


def test_whitening_on_awkward_rows(spark):
    from flowloom.llm.whiten import whiten

    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 5.0]), (1, [1.0, 2.0, 5.0]), (None, [3.0, -2.0, 5.0]), (2, None), (3, [1.0, None, 2.0]),
            (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, [1.0]), (7, []), (8, [-inf, 0.0, 0.0, 0.0]), (9, [0.0, 0.5, 5.0])]
    got = whiten(embeddings(spark, rows)).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "9", "None"]
    assert all(r["n"] == 3 and len(r["whitened"]) == 3 for r in got)
    assert all(r["whitened"][2] is None and r["explained"][2] == 0 for r in got)  # the last entry never varies
    assert got[0]["identity_error"] < 1e-12
    one = whiten(embeddings(spark, rows[:2])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in one] == [(1, 0, [None] * 3, 0.0)] * 2
    assert whiten(embeddings(spark, [])).count() == whiten(embeddings(spark, rows[3:4])).count() == 0
    huge = whiten(embeddings(spark, [(1, [3e38, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 0.0])])).collect()
    assert {r["vec_id"]: r["deviation"] is None for r in huge} == {1: True, 2: True, 3: True}
    assert len(whiten(embeddings(spark, [(1, [0.5]), (2, [1.5])]), vector_col="embedding").collect()) == 2


@pytest.mark.parametrize("values", [
    np.ones(20), np.repeat([3.0, 1.0], 10), 1 + 1e-9 * np.arange(20), 10.0 ** -np.arange(20), np.arange(20) / 7.0,
    np.r_[np.zeros(15), np.ones(5)]])
def test_singular_vectors(values):
    from flowloom.llm.bidiagonal import right_singular

    rng = np.random.default_rng(5)
    q, w = (np.linalg.qr(rng.normal(size=(20, 20)))[0] for _ in range(2))
    m = (q * np.sqrt(values)) @ w.T
    got, z = right_singular(m, 8)
    want = np.sort(values)[::-1][:8]
    real = want > 1e-14 * want[0]
    assert np.allclose(got[real], want[real], rtol=1e-8) and not got[~real].any()
    assert np.allclose(z[:, real].T @ z[:, real], np.eye(real.sum()), atol=1e-9)
    assert np.abs(m.T @ (m @ z) - z * got).max() < 1e-13 * want[0]


# --- Merkle manifest ------------------------------------------------------------------------------------
def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def plain_tree(nodes):
    """(root, per node the list of (before, after))."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(paths):
            run = at[i] // 3 * 3
            p.append(("".join(level[run:at[i]]), "".join(level[at[i] + 1:run + 3])))
        level = [h(*level[i:i + 3]) for i in range(0, len(level), 3)]
        at = [a // 3 for a in at]
    return level[0], paths


def plain_manifest(docs, tampered):
    """docs: (doc_id, text, lang, source, n_chars)."""
    by, out = defaultdict(list), []
    for d in docs:
        by[d[3]].append(d)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        rows = [(leaf(d[0], s, d[2], d[4], d[1]), d) for d in by[s]]
        rows.sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[s] = rows, *plain_tree([x[0] for x in rows])
    root, upper = plain_tree([trees[s][1] for s in order])
    for s, above in zip(order, upper):
        rows, subroot, paths = trees[s]
        for (own, d), path in zip(rows, paths):
            at = leaf(d[0], s, d[2], d[4], tampered(d[0], d[1]))
            for before, after in path + above:
                at = h(before, at, after)
            out.append((d[0], own, subroot, root, h(*[a + b for a, b in path + above]), at, at == root))
    return out


def cut_lines(doc_id, text):
    return text.replace("\n", "") if text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_query(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        got = Q.QUERIES["op12_merkle_manifest"](spark, sf).select(*COLUMNS).collect()
        docs = [(d[0], d[1], d[2], d[3], d[4]) for d in real("documents", sf)]
        assert sorted(map(tuple, got)) == sorted(plain_manifest(docs, cut_lines))
        assert any(r["verified"] for r in got) and not all(r["verified"] for r in got)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_on_awkward_rows(spark, levels):
    from flowloom.llm.merkle import merkle_manifest

    rng = random.Random(levels)
    rows = [(1, "a\nb", "en", "a"), (1, "a\nb", "en", "a"), (1, "other", "en", "a"), (None, "no id", None, None),
            (None, None, None, None), (3, None, "en", "a"), (4, "", "en", "a"), (6, LONG, "en", "c"),
            (7, "Ünïcode 😀\n", "fr", ""), (8, "one", "en", "😀"), (9, "z", "en", "￿")]
    rows += [(i, f"text {rng.random()}\n", "en", "big") for i in range(100, 311)]
    rows += [(i, "x", "en", f"s{i}") for i in range(400, 409)]
    docs = documents(spark, rows).withColumn("leaf", F.lit("x"))
    table = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")).cast("binary")) % 2 == 0
    got = merkle_manifest(docs.repartition(7), levels=levels, claimed={
        "text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=key) == sorted(plain_manifest(table, cut_lines), key=key)


def test_manifest_of_few_rows(spark):
    from flowloom.llm.merkle import merkle_manifest

    assert merkle_manifest(documents(spark, [])).count() == 0
    (one,) = merkle_manifest(documents(spark, [(5, "t", None, None)])).collect()
    assert one["leaf"] == one["subroot"] == one["root"] == leaf(5, None, None, 1, "t")
    assert one["path"] == [] and one["proof_sha256"] == h("") and one["verified"]


# --- packing --------------------------------------------------------------------------------------------
def plain_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def check_packing(rows, capacity):
    """Sequences hold their pieces without gaps and within the capacity."""
    of = defaultdict(list)
    for r in rows:
        of[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in of.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(of)


def test_packing_query(spark):
    got = Q.QUERIES["op13_best_fit_packing"](spark, SF).collect()
    docs = real("documents")
    n = check_packing(got, 1024)
    ids = dict(zip((d[0] for d in docs), plain_ids([d[1] for d in docs])))
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == -(-len(ids[i]) // 1024)
        assert all(r["length"] == 1024 for r in own[1:])
        at = 0
        for r in own:
            part = ids[i][at:at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[i])
    assert n <= 1.02 * math.ceil(sum(map(len, ids.values())) / 1024)


def plain_packing(lengths, capacity):
    """Number of bins by the same rules, piece by piece."""
    large = sorted((x for x in lengths if 3 * x > capacity and x < capacity), reverse=True)
    gaps = []
    while large:
        x = large.pop(0)
        fits = [y for y in large if y <= capacity - x]
        if fits:
            large.remove(fits[0])
        gaps.append(capacity - x - (fits[0] if fits else 0))
    for x in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        room = [g for g in gaps if g >= x]
        if room:
            gaps.remove(min(room))
        gaps.append((min(room) if room else capacity) - x)
    return len(gaps) + sum(x == capacity for x in lengths)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_single_placement(seed):
    from flowloom.llm.packing import plan

    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 3, 10, 30, 97])
    top = rng.choice([capacity, max(1, capacity // 4)])
    lengths = [rng.randint(1, top) for _ in range(rng.choice([1, 7, 400]))] + [max(1, capacity // 5)] * rng.choice([0, 300])
    counts = {x: lengths.count(x) for x in set(lengths)}
    rows, seen = [], defaultdict(int)
    for length, rank, n, per, at, offset in plan(counts, capacity).tolist():
        assert rank == seen[length]
        seen[length] += n
        rows += [{"sequence_id": at + k // per, "offset": offset + k % per * length, "length": length} for k in range(n)]
    assert dict(seen) == counts
    assert check_packing(rows, capacity) == plain_packing(lengths, capacity)


def test_plan_is_short_for_many_pieces():
    from flowloom.llm.packing import plan

    rng = np.random.default_rng(1)
    for counts in (rng.integers(1, 10 ** 9, 1024), rng.integers(0, 2, 1024) * 10 ** 8, rng.integers(0, 40, 1024)):
        table = plan({i + 1: int(n) for i, n in enumerate(counts)})
        assert len(table) < 3 * 1024 * 10 and table[:, 2].sum() == counts.sum()


def test_packing_on_awkward_rows(spark):
    from flowloom.llm.packing import best_fit, sequences

    docs = documents(spark, extra=("n", "ids", "length", "offset", "_row"))
    placed, pieces = best_fit(docs, capacity=100)
    rows = placed.collect()
    check_packing(rows, 100)
    texts = [r["text"] for r in docs.collect()]
    assert sum(r["length"] for r in rows) == sum(map(len, plain_ids(texts)))
    assert sum(r["piece"] == 0 for r in rows) == 11 and sum(r["doc_id"] is None for r in rows) >= 2
    whole = sequences(placed, pieces).collect()
    assert sum(len(s["ids"]) for s in whole) == sum(r["length"] for r in rows)
    for s in whole:
        for p in s["pieces"]:
            part = s["ids"][p["offset"]:p["offset"] + p["length"]]
            assert any(r["sequence_id"] == s["sequence_id"] and r["offset"] == p["offset"]
                       and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) for r in rows)
    assert best_fit(documents(spark, []))[0].count() == 0


def test_long_texts_in_parts():
    from flowloom.llm import packing

    text = "Some words, and more of them; it's late. " * 900 + "  it's 5 o'clock \n\n" + "x" * 3000 + " Ünï cödé 😀 z" * 500 + "\t"
    cut = packing.parts(text, 50)
    assert len(cut) > 100 and "".join(cut) == text
    (whole,) = plain_ids([text])
    path = packing.vocabulary()
    joined = [i for p in packing.encode(path, cut) for i in p.tolist()]
    assert joined == whole[:-1] and packing.parts("x" * 500, 50) == ["x" * 500]


def test_both_encoders_agree():
    from flowloom.llm import packing

    texts = [d[1] for d in real("documents", "/root/testdata/sf0.01")] + [
        "a <|endoftext|> b", "", " ", "\u0000\x7f\xa0 \u2028\n\n", "it's 'S we'll  x\t\ty", "😀" * 9, "中文 текст ไทย", "\ud7ff\ue000"]
    rng = random.Random(2)
    signs = [chr(c) for c in (*range(0, 0x250), *range(0x370, 0x400), *range(0x4e00, 0x4e40), 0x1f600, 0x2028, 0xfeff)]
    texts += ["".join(rng.choices(signs, k=60)) for _ in range(300)] + ["".join(rng.choices("aeinst ", k=400)) for _ in range(100)]
    encoder = packing._encoder(packing.vocabulary())
    assert encoder.ranks is not None
    fast = encoder([t or "" for t in texts])
    assert [x.tolist() + [2] for x in fast] == plain_ids(texts)
    encoder = packing._Encoder(packing.vocabulary())
    encoder.ranks = None
    assert [x.tolist() for x in encoder(texts[-50:])] == [x.tolist() for x in fast[-50:]]
