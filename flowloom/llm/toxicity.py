"""Toxicity by a bidirectional gated recurrent network over overlapping windows of words.

Inputs of a word: its own vector and those of its pieces, character n-grams.  Both start from how much
oftener labelled toxic documents hold the word or piece, beside random parts that tell words apart.  A text is cut into
overlapping windows, all of them are scored, and the highest logit is the text's.  The network is
trained in numpy on a bounded sample of labelled documents; Spark tasks score all texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.common import c
from flowloom.llm.gru import Adam, Network

WINDOW, STRIDE = 40, 30
_BITS, _SIZES, _PARTS, _EDGES = 15, (4, 7), 4, ".,!?;:\"'()[]{}*#$%&|<>"


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def pieces(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the pieces of all words, and where each word's begin.

    The pieces of a word are its byte n-grams of the two sizes of ``_SIZES``, a space before and after
    it counted; a shorter word is one piece.
    """
    raw = [f" {w} ".encode("utf-8", "surrogatepass") for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    joined = b"".join(w.ljust(max(_SIZES), b"\0") for w in raw)
    n, room = len(joined), np.maximum(sizes, max(_SIZES))
    first = np.cumsum(room) - room
    joined = np.frombuffer(joined + bytes(max(_SIZES)), np.uint8).astype(np.uint32)
    counts = [np.maximum(1, sizes - k + 1) for k in _SIZES]
    starts = np.cumsum(counts[0] + counts[1]) - counts[0] - counts[1]
    out = np.empty(int((counts[0] + counts[1]).sum()), np.int64)
    for size, count, to in zip(_SIZES, counts, (starts, starts + counts[0])):
        code = np.full(n, size, np.uint32)
        for k in range(size):
            code = (code ^ joined[k:n + k]) * np.uint32(16777619)
        code = (code ^ code >> np.uint32(15)) * np.uint32(2654435761) >> np.uint32(32 - _BITS)
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(to, count) + step] = code[np.repeat(first, count) + step]
    return out, starts


def cut(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of all windows; texts of at most one window have one at 0.

    Windows begin every ``STRIDE`` words; the last one ends with the text.
    """
    count = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return owner, np.maximum(0, np.minimum(nth * STRIDE, sizes[owner] - WINDOW))


def windows(numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each window, words of each window), short ones padded by 0."""
    owner, first = cut(sizes)
    at = first[:, None] + np.arange(WINDOW)
    inside = at < sizes[owner][:, None]
    base = np.cumsum(sizes) - sizes
    flat = np.minimum(base[owner][:, None] + at, max(0, len(numbers) - 1))
    return owner, np.where(inside, numbers[flat] if len(numbers) else 0, 0)


class Numbers(dict):
    """Word to row number; new words get the next one."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self) + 1
        self.new.append(word)
        return n


class Model:
    """Vectors of words and pieces, and the network."""

    def __init__(self, words: dict[str, int], word_rows: np.ndarray, gram_rows: np.ndarray,
                 network: Network, shift: float = 0.0):
        self.words, self.word_rows, self.gram_rows = words, word_rows, gram_rows
        self.network, self.shift = network, shift

    def vectors(self, vocabulary: list[str]) -> np.ndarray:
        """Inputs of words: word part (row 0 for unknown ones), mean and first-column peak of its pieces."""
        bare = [w.strip(_EDGES) for w in vocabulary]
        known = np.fromiter((self.words.get(w, 0) for w in bare), np.int64, len(bare))
        grams, starts = pieces(bare)
        rows = self.gram_rows[grams]
        sizes = np.diff(np.append(starts, len(grams)))[:, None]
        return np.concatenate((self.word_rows[known], np.add.reduceat(rows, starts) / sizes,
                               np.maximum.reduceat(rows[:, :1], starts)), 1).astype(np.float32)


def _evidence(with_toxic: np.ndarray, with_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Log odds of being seen in toxic documents, shrunk where little was seen."""
    seen = with_toxic + with_clean
    odds = np.log((with_toxic + 0.5) / (toxic + 1)) - np.log((with_clean + 0.5) / (clean + 1))
    return (odds * seen / (seen + 4)).astype(np.float32)


def train(rows: list[tuple[str, int]], *, hidden: int = 8, steps: int = 300, batch: int = 40,
          rate: float = 0.01, folds: int = 4, seed: int = 7) -> Model | None:
    """Fit on (text, label) rows; None unless both labels occur.  Repeats itself on the same rows.

    Rows are shown in whole rounds until ``steps`` batches or 60 rounds were seen.

    While the network is trained, a text's evidence comes from the other folds of the rows only, so
    that words of a single text do not give its label away; afterwards it comes from all rows.
    """
    labels = np.array([y for _, y in rows], np.float32)
    toxic, clean = int(labels.sum()), int((1 - labels).sum())
    if not toxic or not clean:
        return None
    rng = np.random.default_rng(seed)
    number = Numbers()
    coded = [np.fromiter((number[w] for w in tokens(t)), np.int32) - 1 for t, _ in rows]
    # labels are dealt over folds one by one, so that each fold has its share of either
    fold = np.empty(len(rows), np.int64)
    for y in (0, 1):
        of = np.flatnonzero(labels == y)
        fold[of] = np.arange(len(of)) % folds

    # texts of either label in each fold that hold a word, stripped of punctuation, or a bucket of pieces
    bare_of = Numbers()
    bare = np.array([bare_of[w.strip(_EDGES)] for w in number], np.int64) - 1
    held, starts = pieces(list(bare_of)) if bare_of else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    ends = np.append(starts[1:], len(held))
    words, grams = np.zeros((folds, 2, len(bare_of))), np.zeros((folds, 2, 1 << _BITS))
    for t, f, y in zip(coded, fold, labels.astype(int)):
        if len(t):
            own = np.unique(bare[t])
            words[f, y, own] += 1
            grams[f, y, np.unique(np.concatenate([held[starts[w]:ends[w]] for w in own]))] += 1
    names = list(bare_of)
    often = np.flatnonzero(words.sum((0, 1)) >= 3)
    often = often[np.argsort(np.array([names[i] for i in often], object), kind="stable")]
    index = {names[i]: k + 1 for k, i in enumerate(often)}
    learned_w = rng.normal(0, 0.05, (len(index) + 1, _PARTS)).astype(np.float32)
    learned_g = rng.normal(0, 0.05, (1 << _BITS, _PARTS)).astype(np.float32)
    network = Network(2 * _PARTS + 1, hidden, rng)

    def model_of(without: int | None) -> Model:
        use = [k for k in range(folds) if k != without]
        n = [int(((labels == y) & np.isin(fold, use)).sum()) for y in (0, 1)]
        w, g = learned_w.copy(), learned_g.copy()
        w[0] = 0
        clean_w, toxic_w = words[use].sum(0)[:, often]
        w[1:, 0] = _evidence(toxic_w, clean_w, n[1], n[0])
        clean_g, toxic_g = grams[use].sum(0)
        g[:, 0] = _evidence(toxic_g, clean_g, n[1], n[0])
        return Model(index, w, g, network)

    adam, vocabulary = Adam(rate), list(number)
    blocks = [np.zeros((1, 2 * _PARTS + 1), np.float32)]
    if vocabulary:
        blocks += [model_of(k).vectors(vocabulary) for k in range(folds)]
    vectors = np.concatenate(blocks)
    coded = [t.astype(np.int64) + 1 + f * len(vocabulary) for t, f in zip(coded, fold)]
    weight = np.where(labels == 1, 0.5 / toxic, 0.5 / clean) * len(rows)
    for _ in range(min(60, -(-steps // -(-len(rows) // batch)))):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            of = order[lo:lo + batch]
            sizes = np.array([len(coded[i]) for i in of])
            owner, ids = windows(np.concatenate([coded[i] for i in of]), sizes)
            used, ids = np.unique(np.concatenate((ids.ravel(), [0])), return_inverse=True)
            ids = ids[:-1].reshape(len(owner), WINDOW)
            x = vectors[used]
            gates = network.project(x)
            logit, cache = network.run(gates, ids, keep=True)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            # a text's logit is a soft maximum over its windows
            top = np.repeat(np.maximum.reduceat(logit, starts), np.diff(np.append(starts, len(owner))))
            share = np.exp(2 * (logit - top))
            share /= np.add.reduceat(share, starts)[owner]
            text = np.add.reduceat(share * logit, starts)
            error = (1 / (1 + np.exp(-text)) - labels[of]) * weight[of] / len(of)
            g, dx = network.back(ids, gates, cache, (share * error[owner]).astype(np.float32))
            flat = ids.ravel()
            at = np.argsort(flat, kind="stable")
            cuts = np.flatnonzero(np.diff(flat[at], prepend=-1))
            for k, d in enumerate("fb"):
                sums = np.zeros((len(used), dx[k].shape[2]), np.float32)
                sums[flat[at][cuts]] = np.add.reduceat(dx[k].reshape(len(flat), -1)[at], cuts)
                sums[0] = 0
                g["W" + d], g["c" + d] = x.T @ sums, sums.sum(0)
            adam.step(network.p, g)

    scores = np.empty(len(rows))
    for lo in range(0, len(rows), 200):
        owner, ids = windows(np.concatenate(coded[lo:lo + 200]), np.array([len(t) for t in coded[lo:lo + 200]]))
        used, ids = np.unique(np.concatenate((ids.ravel(), [0])), return_inverse=True)
        ids = ids[:-1].reshape(len(owner), WINDOW)
        logit = np.concatenate([network.run(network.project(vectors[used]), ids[k:k + 2048])[0]
                                for k in range(0, len(ids), 2048)])
        best = np.full(len(coded[lo:lo + 200]), -np.inf)
        np.maximum.at(best, owner, logit)
        scores[lo:lo + 200] = best
    model = model_of(None)
    model.shift = _best_cut(scores, labels)
    return model


def _best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest gap around the cut with the fewest errors, each class weighed by F1."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + labels.sum())
    k = int(np.argmax(f1))
    return float((s[k] + s[min(k + 1, len(s) - 1)]) / 2)


class Scorer:
    """Keeps the gate inputs of words between batches, of at most ``most`` words."""

    def __init__(self, model: Model, most: int = 150_000):
        self.model, self.most = model, most
        self._clear()

    def _clear(self):
        self.numbers, self.blocks = Numbers(), [self.model.network.project(
            np.zeros((1, 2 * _PARTS + 1), np.float32))]

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(logit, windows) of every text."""
        if len(self.numbers) > self.most:
            self._clear()
        split = [tokens(t) for t in texts]
        sizes = np.array([len(t) for t in split], np.int64)
        number = self.numbers
        ids = np.fromiter((number[w] for t in split for w in t), np.int64, int(sizes.sum()))
        if number.new:
            v = self.model.vectors(["", *number.new])  # project() overwrites the first row
            self.blocks.append([x[1:] for x in self.model.network.project(v)])
            number.new = []
        if len(self.blocks) > 1:
            self.blocks = [[np.concatenate([b[k] for b in self.blocks]) for k in (0, 1)]]
        owner, words = windows(ids, sizes)
        logit = np.concatenate([self.model.network.run(self.blocks[0], words[lo:lo + 2048])[0]
                                for lo in range(0, len(words), 2048)]) if len(words) else np.zeros(0)
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, owner, logit)
        return out, np.bincount(owner, minlength=len(texts))


def score(model: Model, texts: list, scorer: Scorer | None = None) -> tuple[np.ndarray, np.ndarray]:
    run = scorer or Scorer(model)
    parts = [run(texts[lo:lo + 200]) for lo in range(0, len(texts), 200)]
    if not parts:
        return np.zeros(0), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str,
        sample: int) -> bytes | None:
    """The pickled model of at most ``sample`` labelled ids, those of the smallest id hashes.

    The sampled texts go to one task that trains, so the driver holds ids and the finished model only.
    """
    few = (labels.select(c(id_col).alias("_id"), c(label_col).cast("int").alias("_y"))
           .where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
           .orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = (docs.select(c(id_col).alias("_id"), F.coalesce(c(text_col).cast("string"), F.lit("")).alias("_t"))
            .join(F.broadcast(few), "_id").select("_id", "_t", "_y"))  # ``sample`` bounds the broadcast

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(x for b in batches for x in zip(*(k.to_pylist() for k in b.columns)))
        if found:
            model = train([(t, y) for _, t, y in found])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    got = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(got[0]["model"]) if got else None


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", label_id_col: str | None = None, score_id_col: str | None = None,
             sample: int = 4_000, threshold: float = 0.3) -> DataFrame:
    """Score every row: doc_id, score, predicted, windows (how many were scored).

    ``labels`` holds ids (``label_id_col``, as ``id_col``) and labels (1 toxic, 0 clean) to learn from;
    ``score_id_col`` names another column of ``docs``, of any type, that the result holds as doc_id; ``sample`` bounds the rows that
    are fitted, nothing else.  Rows with a null id or label teach nothing; of an id with several labels
    the largest counts.  ``score`` is the logistic function of the text's highest window logit, moved
    so that the best cut on the fitted rows lies at ``threshold``; ``predicted`` is 1 from there on.
    Null, empty and blank texts are scored as one window of padding.  Without both labels every score is
    0.  Every input row gives one row; repeated rows stay; other columns are ignored.
    """
    labels = labels.select(c(label_id_col or id_col).alias(id_col), c(label_col))
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample)
    id_col = score_id_col or id_col
    sent = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary of at most ``sample`` texts
    base = float(np.log(threshold / (1 - threshold)))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, windows bigint"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent.value) if sent.value else None
        scorer = Scorer(model) if model else None
        for b in batches:
            texts = b.column(1).to_pylist()
            if scorer:
                logit, count = score(model, texts, scorer)
                p = 1 / (1 + np.exp(-np.clip(logit - model.shift + base, -500, 500)))
            else:
                p, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(count, pa.int64())],
                                             names=["doc_id", "score", "windows"])

    out = docs.select(c(id_col), c(text_col).cast("string")).mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
