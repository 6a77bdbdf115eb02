"""Quality classifier by Bradley-Terry pairwise ranking.

Pairs of labelled documents, a better and a worse one, teach a utility linear in features of the text:
the probability that one is preferred is the logistic function of the difference of utilities.  The
decision threshold is a quantile of the utilities.  All labels teach: they are dealt into chunks of bounded
size, tasks add up the pairs of their chunks, and the driver takes Newton steps on the sums.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.common import c
from flowloom.llm.rules import metrics
from flowloom.operators.detectors.base import quantile
from flowloom.session import materialize

#: Ratios that make up a document's features, numerator by denominator.
RATIOS = (("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_shouts", "n_words"),
          ("n_stop_words", "n_words"), ("n_repeat_words", "n_words"), ("n_dup_lines", "n_lines"),
          ("n_bullet_lines", "n_lines"), ("n_words", "n_lines"))

#: Rows of the commoner label that one chunk holds, rows of the other that it has at least, if there are as many.
CHUNK, LEAST = 20_000, 1_000


def features(counts: DataFrame) -> DataFrame:
    """doc_id and ``x``: bounded features of the counts, 0 where a denominator is 0."""
    parts = [F.log1p(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)))
             for a, b in RATIOS]
    parts += [F.log1p(F.col("n_words").cast("double")), (F.col("n_words") < 10).cast("double"),
              (100 * F.col("n_repeat_words") > 20 * F.col("n_words")).cast("double"),
              (10 * F.col("n_symbols") > F.col("n_words")).cast("double"),
              (10 * F.col("n_shouts") > F.col("n_words")).cast("double")]
    return counts.select("doc_id", F.array(*parts).alias("x"))


def scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


def pair_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray, wider: int, partners: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Gradient and curvature of the logistic loss, summed over the pairs of a chunk, and their number.

    Every row labelled ``wider`` is paired with ``partners`` rows of the other label, taken in turn.
    """
    wide, few = np.flatnonzero(y == wider), np.flatnonzero(y != wider)
    g, h = np.zeros(len(w)), np.zeros((len(w), len(w)))
    if not len(wide) or not len(few):
        return g, h, 0
    i = np.arange(len(wide))
    for k in range(partners):
        d = (1.0 if wider == 1 else -1.0) * (z[wide] - z[few[(i * 7919 + k * 104729) % len(few)]])
        p = 1 / (1 + np.exp(d @ w))
        g -= d.T @ p
        h += (d * (p * (1 - p))[:, None]).T @ d
    return g, h, partners * len(wide)


def newton(width: int, sums: Callable[[np.ndarray], tuple], steps: int, ridge: float) -> np.ndarray:
    """Weights of the least ridge-penalised mean loss; steps end when they move by less than 1e-8."""
    w = np.zeros(width)
    for _ in range(steps):
        g, h, n = sums(w)
        move = np.linalg.solve(h / n + ridge * np.eye(width), g / n + ridge * w)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit_pairs(x: np.ndarray, y: np.ndarray, *, partners: int = 20, steps: int = 300,
              ridge: float = 1e-2) -> dict | None:
    """Weights from the preference pairs of one chunk; None unless both labels occur."""
    good, bad = int((y == 1).sum()), int((y == 0).sum())
    if not good or not bad:
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, wider = scaled(x, mean, scale), int(good >= bad)
    w = newton(x.shape[1], lambda w: pair_sums(z, y, w, wider, partners), steps, ridge)
    # the quantile of utilities below which the share of worse documents lies
    return {"mean": mean, "scale": scale, "w": w, "cut": float(np.quantile(z @ w, bad / len(y)))}


def _packed(rows: DataFrame, wider: int, wide: int, few: int, chunk: int) -> DataFrame:
    """One row (chunk, data) per chunk of the rows (_id, y, x).

    The commoner label is dealt by a hash of the id.  The rarer one is dealt alike, but so that each chunk gets
    about ``LEAST`` of its rows, or all of them, a row then goes to several chunks.
    """
    chunks = max(1, math.ceil(wide / chunk))
    copies = min(chunks, max(1, math.ceil(chunks * LEAST / few)))
    first = F.pmod(F.xxhash64("_id"), F.lit(chunks))
    each = F.sequence(F.lit(0), F.when(F.col("y") == wider, 0).otherwise(copies - 1))
    dealt = rows.select("_id", "y", "x", F.explode(each).alias("_k")).select(
        "_id", "y", "x", F.pmod(first + F.col("_k"), F.lit(chunks)).alias("chunk"))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("_id")
        out = io.BytesIO()
        np.savez(out, x=np.array(t.column("x").to_pylist(), float), y=t.column("y").to_numpy())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([out.getvalue()], pa.binary())})

    return dealt.groupBy("chunk").applyInArrow(pack, "chunk bigint, data binary")


def fit(rows: DataFrame, *, partners: int = 20, steps: int = 300, ridge: float = 1e-2, chunk: int = CHUNK) -> dict | None:
    """The model of :func:`fit_pairs` without its cut, from all ``rows`` (_id, y, x); None unless both labels occur."""
    width = len(RATIOS) + 5
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    each = [F.get("x", F.lit(k)) for k in range(width)]
    facts = rows.agg(*[F.avg(e) for e in each], *[F.stddev_pop(e) for e in each]).first()
    mean, scale = np.array(facts[:width]), np.array(facts[width:]) + 1e-9
    wider = int(n[1] >= n[0])
    packed = materialize(_packed(rows, wider, n[wider], n[1 - wider], chunk), "chunks")

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, data in zip(b.column(0), b.column(1)):
                    part = np.load(io.BytesIO(data.as_py()))
                    g, h, n = pair_sums(scaled(part["x"], mean, scale), part["y"], w, wider, partners)
                    yield pa.RecordBatch.from_pydict({
                        "chunk": pa.array([at.as_py()], pa.int64()), "n": pa.array([n], pa.int64()),
                        "sums": pa.array([[*g, *h.ravel()]], pa.list_(pa.float64()))})

        found = sorted(packed.mapInArrow(run, "chunk bigint, n bigint, sums array<double>").collect())
        total = np.sum([r["sums"] for r in found], axis=0)  # few numbers per chunk, added in one order
        return total[:width], total[width:].reshape(width, width), sum(r["n"] for r in found)

    return {"mean": mean, "scale": scale, "w": newton(width, sums, steps, ridge)}


def _utility(model: dict | None) -> Column:
    utility = F.lit(0.0)
    if model:
        for k, (m, s, w) in enumerate(zip(model["mean"], model["scale"], model["w"])):
            z = F.greatest(F.least((F.get("x", F.lit(k)) - float(m)) / float(s), F.lit(6.0)), F.lit(-6.0))
            utility = utility + z * float(w)
    return utility


def quality_rank(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id",
                 text_col: str = "text", label_col: str = "quality", chunk: int = CHUNK,
                 threshold: float = 0.3) -> DataFrame:
    """Score every row: doc_id, utility, score, predicted.

    ``labels`` holds the ids and labels (1 better, 0 worse) to learn from; all are fitted, ``chunk`` rows of
    the commoner label at a time.  Rows with a null id or label teach nothing; of an id
    with several labels the largest counts.  ``score`` is logistic in the utility and equals
    ``threshold`` at the quantile of the fitted utilities that leaves the share of worse documents
    below; ``predicted`` is 1 from there on.  Null and empty texts have zero features and a score like
    any other.  Without both labels every utility is 0 and every score 0.5.  Repeated rows stay.
    """
    rows = materialize(features(metrics(docs, id_col=id_col, text_col=text_col)), "features")
    known = (labels.select(c(id_col).alias("_id"), c(label_col).cast("int").alias("_y"))
             .where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y")))
    fitted = materialize(known.join(rows, known["_id"] == rows["doc_id"]).groupBy("_id")
                         .agg(F.max("_y").alias("y"), F.min("x").alias("x")), "fitted")
    model, shift = fit(fitted, chunk=chunk), 0.0
    if model:
        worse, n = fitted.agg(F.count(F.when(F.col("y") == 0, 1)), F.count(F.lit(1))).first()
        # the quantile of utilities below which the share of worse documents lies
        shift = float(np.log(threshold / (1 - threshold))) - quantile(fitted, _utility(model), worse / n)
    score = 1 / (1 + F.exp(-(F.col("utility") + shift)))
    return (rows.select("doc_id", _utility(model).alias("utility")).withColumn("score", score)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
