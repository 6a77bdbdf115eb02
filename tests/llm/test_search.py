"""Jaccard join, decontamination, secrets and archives against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from helpers import SF, WORD, documents, jaccard_components, real, shingles

from flowloom.llm import queries as Q


def near_copies(seed=1, groups=12):
    """Groups of edited copies around the threshold, chains among them."""
    r = random.Random(seed)
    rows, vocabulary = [], [f"v{i}" for i in range(3000)]
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(6, 160))]
        for _ in range(r.randint(1, 14)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 18))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(w), "en", "s"))
            if r.random() < 0.3:
                base = w
    return rows


def test_jaccard_query(spark):
    docs = [(r[0], r[1]) for r in real("documents")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in Q.QUERIES["op3_jaccard_join"](spark, SF).collect()}
    assert got == jaccard_components(docs)


@pytest.mark.parametrize("limits", [dict(), dict(small=2, pivots=3, block=4), dict(small=4, pivots=1, block=3)])
def test_jaccard_regions_of_any_size(spark, limits, monkeypatch):
    """Regions joined in a task, around pivots, and in blocks give the same components."""
    from flowloom.llm import jaccard

    whole = jaccard.join_regions
    monkeypatch.setattr(jaccard, "join_regions", lambda m, p: whole(m, p, **limits))
    rows = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in jaccard.near_duplicates(documents(spark, rows), range_shingles=500).collect()}
    assert got == jaccard_components([r[:2] for r in rows])


def test_region_join_equals_all_pairs():
    import numpy as np

    from flowloom.llm.regions import Region
    from flowloom.llm.shingles import shingle_sets

    for seed in range(6):
        texts = [r[1] for r in near_copies(seed, 20)]
        region = Region(shingle_sets(texts), 75, pivots=4, small=5)
        region.run()
        want = jaccard_components(enumerate(texts))
        tops = [region.links.top(i) for i in range(len(texts))]
        assert all((tops[i] == tops[j]) == (want[i][1] == want[j][1])
                   for i in range(len(texts)) for j in range(i))
    assert Region([np.zeros(0, np.uint64)], 75).run() == []


def test_jaccard_on_awkward_rows(spark):
    from flowloom.llm.jaccard import near_duplicates

    rows = near_duplicates(documents(spark)).collect()
    assert len(rows) == 11
    assert all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for r in rows if r["doc_id"] in (3, 4, 5))
    assert sorted(r["component_id"] for r in rows if r["doc_id"] == 1) == [1, 1, 1]
    assert [r["n_shingles"] for r in rows if r["doc_id"] == 8] == [1]
    assert near_duplicates(documents(spark, [])).count() == 0


def leaks(docs, items, least=0.75):
    """All pairs whose best window reaches the similarity, by sliding over every position."""
    words = {k: WORD.findall(t.lower()) for k, t in items if WORD.search(t or "")}
    sets = {k: set(shingles(t, str.lower)) for k, t in items if k in words}
    df = Counter(x for v in sets.values() for x in v)
    top, holders, out = math.log1p(len(sets)), defaultdict(set), {}
    for k, v in sets.items():
        for x in v:
            holders[x].add(k)
    for d, t in docs:
        h = shingles(t or "", str.lower)
        for k in {k for x in h for k in holders.get(x, ())}:
            total = sum(math.log1p(len(sets) / df[x]) for x in sets[k])
            n = max(1, len(words[k]) - 4)
            for i in range(max(1, len(h) - n + 1)):
                window = set(h[i:i + n])
                both = sum(math.log1p(len(sets) / df[x]) for x in window & sets[k])
                s = both / (total + top * len(window - sets[k]))
                if s >= least - 1e-12:
                    out[d, k] = max(s, out.get((d, k), 0))
    return out


def test_decontamination_query(spark):
    want = leaks([r[:2] for r in real("documents")], real("benchmark"))
    got = {(r["doc_id"], r["item_id"]): r["similarity"]
           for r in Q.QUERIES["op5_decontamination"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_decontamination_of_edited_items(spark):
    from flowloom.llm.decontaminate import decontaminate, find_leaks

    r = random.Random(3)
    vocabulary = [f"v{i}" for i in range(900)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(12, 60)))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "two words"), (103, items[0][1])]
    docs = []
    for i in range(120):
        w = items[i % 30][1].split()
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = "other"
        if r.random() < 0.3:
            w.insert(r.randrange(len(w)), "more")
        pad = [r.choice(vocabulary) for _ in range(r.randint(0, 50))]
        docs.append((i, " ".join(pad + w + pad[::-1]), "en", "s"))
    docs += [(900, "Two  WORDS", "en", "s"), (901, None, "en", "s"), (902, "", "en", "s"), (None, items[1][1], "en", "s")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = find_leaks(documents(spark, docs), bench).collect()
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in found}
    want = leaks([d[:2] for d in docs], items)
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
    assert {k for k, s in want.items() if s > 0.8} <= set(got) and (900, 102) in got and (None, 1) in got
    kept = decontaminate(documents(spark, docs), bench)
    assert kept.count() == len(docs) - len({x["doc_id"] for x in found})
    assert find_leaks(documents(spark, docs), bench.where("false")).count() == 0
    assert find_leaks(documents(spark, []), bench).count() == 0


ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_secret_query(spark):
    rows = {r["doc_id"]: r for r in Q.QUERIES["op1_secret_scans"](spark, SF).collect()}
    docs = real("documents")
    assert len(rows) == len(docs)
    for k, text, *_ in docs:
        spans = base_spans(text)
        joined = ",".join(f"{a}:{b}:{e}" for a, b, e in spans)
        assert rows[k]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(rows[k]["spans"].split(","))
        assert [rows[k][f"n_{x}"] for x in ("assign", "access", "hex")] == [
            sum(s[0] == x for s in spans) for x in ("assign", "access", "hex")]


def test_secret_formats_are_learned(spark):
    from flowloom.llm.secrets import secret_scan

    r = random.Random(5)

    def key():
        return "sk-" + "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(28))

    rows = [(i, f'é😀 {r.randrange(9999)} Token : "{key()}" end averyordinarylongword', "en", "s") for i in range(200)]
    rows += [(1000, f"bare {key()} and averyordinarylongword", "en", "s"), (1001, None, "en", "s"),
             (1002, "secret: token: abcdef1 password=x", "en", "s"), (1003, "AKIA" + "A" * 16 + " AKIAB", "en", "s")]
    got = {x["doc_id"]: x["secrets"] for x in secret_scan(documents(spark, rows)).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[1000]] == [("format", 5, 36)]
    assert got[1001] == [] and got[1002] == [] and [s["kind"] for s in got[1003]] == ["access"]
    assert all([s["kind"] for s in got[i]] == ["assign"] for i in range(200))
    assert secret_scan(documents(spark)).count() == 11 and secret_scan(documents(spark, [])).count() == 0


def test_automaton_merges_states():
    from flowloom.llm.grammar import learn

    r = random.Random(2)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(300)]
    a = learn(hexes)
    assert len(a.rows) < 60 and learn([]) is None
    assert a.score(hexes[0]) > a.score("averyordinarylongwordwithoutdigits") + 1


def test_archives_round_trip(spark, tmp_path):
    from flowloom.llm.warc import read_archives, write_archives

    big = "<p>" + "x" * 200
    rows = [(3, "u", big), (1, "u\r\nX: y", big), (None, None, big), (2, None, None), (2, None, None),
            (5, "u", "short"), (6, "u", "short"), (7, "u", "é" * 60_000), (1, "v", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = f"file://{tmp_path}"
    index = write_archives(pages, folder, frame_bytes=500, archive_bytes=2000)
    got = read_archives(index, folder).collect()
    assert len(got) == len(rows)
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == Counter({(1, "response", None): 2, (3, "revisit", 1): 1, (None, "revisit", 1): 1,
                             (2, "response", None): 2, (5, "response", None): 1, (6, "response", None): 1,
                             (7, "response", None): 1})
    by = {r["page_id"]: r for r in got}
    assert by[3]["payload_digest"] == hashlib.sha256(big.encode()).hexdigest() and by[3]["payload_bytes"] == 203
    assert by[7]["payload"] == "é" * 60_000 and by[1]["payload"] == big and by[2]["payload_bytes"] == 0
    # one record by its place alone
    one = read_archives(index.where("page_id = 7"), folder).collect()
    assert [r["page_id"] for r in one] == [7]
    empty = write_archives(pages.where("false"), folder)
    assert read_archives(empty, folder).count() == 0


def test_archives_are_plain_zstandard(spark, tmp_path):
    import zstandard

    from flowloom.llm.warc import SEEKABLE, write_archives

    pages = spark.createDataFrame([(i, "u", f"page {i} " * 30) for i in range(50)],
                                  "page_id bigint, url string, html string").coalesce(1)
    write_archives(pages, f"file://{tmp_path}", frame_bytes=2000)
    files = sorted(tmp_path.glob("*.warc.zst"))
    data = b"".join(zstandard.ZstdDecompressor().stream_reader(f.read_bytes(), read_across_frames=True).read()
                    for f in files)
    assert data.count(b"WARC/1.1\r\n") == 50
    assert files[0].read_bytes()[-4:] == SEEKABLE.to_bytes(4, "little")


def test_jaccard_region_of_a_large_and_a_small_family(spark):
    """The small family's links survive when the large family's cells do not shrink."""
    import numpy as np

    from flowloom.llm.jaccard import join_regions

    def member(i, base, twin):  # 80 shared, 20 of the pair; twins differ in two
        own = [10_000 + 100 * twin + j for j in range(18)] + [1_000_000 + 2 * i, 1_000_001 + 2 * i]
        return np.sort(np.array(list(range(base, base + 80)) + own, np.uint64)).tobytes()

    rows = [(b"r", b"a%03d" % i, member(i, 0, 500 + i)) for i in range(85)]
    rows += [(b"r", b"b%03d" % i, member(85 + i, 1_000, i // 2)) for i in range(15)]
    members = spark.createDataFrame([tuple(map(bytearray, r)) for r in rows],
                                    "region binary, key binary, set binary")
    got = {frozenset((bytes(r.a), bytes(r.b))) for r in join_regions(members, 75, small=40, block=20).collect()}
    assert got == {frozenset((b"b%03d" % i, b"b%03d" % (i + 1))) for i in range(0, 14, 2)}
