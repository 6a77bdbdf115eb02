"""Secret scan: fixed patterns label credentials, inferred grammars find more of their format.

One pass over the texts finds the labelled spans and all candidate tokens.  The labelled credentials of each
kind teach one probabilistic automaton, the other candidates one for ordinary tokens: all of them are counted
on the cluster, only prefixes that many of them share come to the driver, which merges states.  Every candidate of every text is then scored: the best kind's log likelihood
per symbol, less that of the ordinary automaton.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.common import c
from flowloom.llm.grammar import (CLASSES, END, LETTERS, Automaton, automaton, merged, moves, shape, tree,
                                  visits)
from flowloom.operators.detectors.base import ranked
from flowloom.session import materialize

#: Kinds in the order in which equal starts are listed; the last one is that of inferred spans.
KINDS = ("assign", "access", "hex", "format")

# Letters of the keywords in either case, of ASCII only.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                     r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
# A failing shorter match of these two never hides a longer one, so the lengths stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_LEAST_WORD = 16
_BLOCK, _DEPTH = 32, 512  # symbols by which prefixes grow at once, and at most

_SPAN = "struct<kind:int,start:int,end:int,text:string>"


def long_words(raw: bytes) -> Iterator[tuple[int, str]]:
    """(code point offset, word) of the words that have at least 16 bytes."""
    a = np.frombuffer(raw, np.uint8)
    gaps = np.flatnonzero((a == 32) | ((a >= 9) & (a <= 13)))
    edges = np.concatenate(([-1], gaps, [len(a)]))
    found = np.flatnonzero(np.diff(edges) > _LEAST_WORD)
    if len(found):
        points = np.concatenate(([0], np.cumsum((a & 0xC0) != 0x80)))
        for i in found:
            start, end = int(edges[i]) + 1, int(edges[i + 1])
            yield int(points[start]), raw[start:end].decode("utf-8", "surrogatepass")


def scan(text: str) -> tuple[list[tuple], list[tuple]]:
    """(kind, start, end, credential) of the labelled spans, (start, end, token) of the candidates."""
    raw = text.encode("utf-8", "surrogatepass")
    low, spans, tokens = raw.lower(), [], []
    if any(k in low for k in _KEYWORDS):
        spans += [(0, m.start(), m.end(), m.group(2)) for m in _ASSIGN.finditer(text)
                  if len(m.group(2)) >= 6]
    for at, word in long_words(raw):
        for kind, pattern in ((1, _ACCESS), (2, _HEX)):
            spans += [(kind, at + m.start(), at + m.end(), m.group()) for m in pattern.finditer(word)]
        tokens += [(at + m.start(), at + m.end(), m.group()) for m in _CANDIDATE.finditer(word)]
    taken = sorted((s, e) for _, s, e, _ in spans)
    free = [t for t in tokens if not any(s < t[1] and t[0] < e for s, e in taken)] if taken else tokens
    return sorted(spans, key=lambda x: (x[1], x[0])), free


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans, tokens: the labelled spans and the candidates of every row."""
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, spans array<{_SPAN}>, tokens array<{_SPAN}>"
    fields = ["kind", "start", "end", "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                                   ("text", pa.string())]))
        for b in batches:
            both = [scan(t or "") for t in b.column(1).to_pylist()]
            spans = [[dict(zip(fields, s)) for s in x[0]] for x in both]
            tokens = [[dict(zip(fields, (3, *t))) for t in x[1]] for x in both]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(spans, span), pa.array(tokens, span)],
                names=["doc_id", "spans", "tokens"])

    return docs.select(c(id_col), c(text_col).cast("string")).mapInArrow(run, schema)


def shapes(found: DataFrame) -> DataFrame:
    """kind, shape, n: how many different credentials (kinds 0 to 2) or candidates (3) have each shape."""
    each = found.select(F.explode(F.concat("spans", "tokens")).alias("s")).select("s.kind", "s.text").distinct()
    plain = F.regexp_replace("text", "[^A-Za-z0-9+/_.=-]", "?")
    return each.groupBy("kind", F.translate(plain, LETTERS, CLASSES).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def following(rows: DataFrame, least: dict[int, int]) -> dict[int, dict[str, dict[str, int]]]:
    """Per kind, how often each symbol follows each prefix that ``least`` or more of ``rows`` share.

    Prefixes grow by a block of symbols at a time, only under those that were shared enough.
    """
    rows = rows.select("kind", F.concat("shape", F.lit(END)).alias("s"), "n")
    want = F.element_at(F.create_map(*[F.lit(x) for pair in least.items() for x in pair]), F.col("kind"))
    out: dict[int, dict[str, dict[str, int]]] = {k: {} for k in least}
    heads = None
    for lo in range(0, _DEPTH, _BLOCK):
        longer = rows.where(F.length("s") > lo)
        if heads is not None:
            few = rows.sparkSession.createDataFrame(heads, "kind int, head string")
            longer = longer.withColumn("head", F.substring("s", 1, lo)).join(F.broadcast(few), ["kind", "head"], "left_semi")
        each = longer.select("kind", "s", "n", F.explode(F.sequence(F.lit(lo + 1), F.least(F.length("s"), F.lit(lo + _BLOCK)))).alias("i"))
        counts = each.groupBy("kind", F.expr("substring(s, 1, i - 1)").alias("prefix"), F.expr("substring(s, i, 1)").alias("x")).agg(F.sum("n").alias("n"))
        shared = counts.groupBy("kind", "prefix").agg(F.sum("n").alias("n"), F.collect_list(F.struct("x", "n")).alias("flow"))
        shared = shared.where(F.col("n") >= want).collect()
        for r in shared:
            out[r["kind"]][r["prefix"]] = {f["x"]: f["n"] for f in r["flow"]}
        heads = [(r["kind"], r["prefix"] + f["x"]) for r in shared if len(r["prefix"]) == lo + _BLOCK - 1
                 for f in r["flow"] if f["x"] != END and f["n"] >= least[r["kind"]]]
        if not heads:
            break
    return out


def fit(found: DataFrame, *, branches: int = 400) -> dict:
    """Automata per labelled kind, one for ordinary tokens, and the lowest score of a format.

    Every different credential and candidate counts.  States are told apart along prefixes that one in
    ``branches`` credentials of a kind shares (one in three times as many of the other candidates, up to 512
    symbols); what follows a rarer prefix goes on from the first state.  All strings then run through the
    states, which gives the probabilities.  The lowest score is the one that 99 percent of the credentials
    reach, and at least 0.5 nats per symbol over ordinary tokens.
    """
    rows = materialize(shapes(found), "shapes")
    size = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    least = {k: -(-n // (branches if k < 3 else 3 * branches)) for k, n in size.items()}
    steps = {k: moves(merged(tree(x))) for k, x in following(rows, least).items()} if size else {}

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for b in batches:
            for kind, shaped, n in zip(*[x.to_pylist() for x in b.columns]):
                for at, x in visits(steps[kind], shaped):
                    total[kind, at, x] += n
        kinds, states, symbols = zip(*total) if total else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.int32()), pa.array(states, pa.int32()), pa.array(symbols, pa.string()),
             pa.array(total.values(), pa.int64())], names=["kind", "state", "x", "n"])

    flows = {k: [{} for _ in step] for k, step in steps.items()}
    taken = rows.mapInArrow(walk, "kind int, state int, x string, n bigint")
    for r in taken.groupBy("kind", "state", "x").agg(F.sum("n").alias("n")).collect():  # a few numbers per state
        flows[r["kind"]][r["state"]][r["x"]] = r["n"]
    model = {"kinds": [automaton(steps[k], flows[k], size[k]) for k in range(3) if k in steps],
             "other": automaton(steps[3], flows[3], size[3]) if 3 in steps else None}

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([_likelihood(model, x) for x in b.column(0).to_pylist()], pa.float64()), b.column(1)], names=["v", "w"])

    scored = rows.where((F.col("kind") < 3) & (F.length("shape") >= _LEAST_WORD)).select("shape", "n")
    low = ranked(scored.mapInArrow(score, "v double, w bigint"), lambda n: n // 100)
    model["least"] = float("inf") if low is None else max(0.5, low)
    return model


def _likelihood(model: dict, shaped: str) -> float:
    kinds: list[Automaton] = model["kinds"]
    other: Automaton | None = model["other"]
    return max((a.of_shape(shaped) for a in kinds), default=float("-inf")) - (
        other.of_shape(shaped) if other else -5.0)


def likelihood(model: dict, text: str) -> float:
    """Nats per symbol by which the best kind's format is likelier than an ordinary token's."""
    return _likelihood(model, shape(text))


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                branches: int = 400) -> DataFrame:
    """Credentials in every text: doc_id, secrets array<(kind, start, end, text, score)>.

    ``kind`` is assign, access or hex for the fixed patterns (spans of one kind do not overlap; score
    null), format for tokens of at least 16 characters that overlap none of them and whose likelihood
    reaches the learned least one.  Offsets are code points, end exclusive; spans are sorted by start,
    then kind.  Null and empty texts have none.  Every input row gives one row; repeated rows stay;
    other columns are ignored.  Without a labelled credential in the corpus no format is learned.
    """
    found = materialize(find(docs, id_col=id_col, text_col=text_col), "spans")
    model = fit(found, branches=branches)
    schema = (f"doc_id {found.schema['doc_id'].dataType.simpleString()}, secrets array<struct<"
              "kind:string,start:int,end:int,text:string,score:double>>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                   ("text", pa.string()), ("score", pa.float64())]))
        for b in batches:
            rows = []
            for spans, tokens in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                scored = [s | {"score": None} for s in spans]
                for t in tokens:
                    score = likelihood(model, t["text"])
                    if score >= model["least"]:
                        scored.append(t | {"score": score})
                scored.sort(key=lambda s: (s["start"], s["kind"]))
                rows.append([s | {"kind": KINDS[s["kind"]]} for s in scored])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)],
                                             names=["doc_id", "secrets"])

    return found.mapInArrow(run, schema)
