"""Classification trees, grown level by level in tasks, for many models in one job.

A model is a spec: how many trees, how deep, which rows are held out of it.  The rows of every spec go
to a few tasks, each of which grows some of its trees; a forest's rows are drawn by a hash of (seed, tree,
row id), so neither their order nor the number of tasks matters.  Splits are exact: all midpoints between
neighbouring values of a node are tried, rows with a missing value go to the side where they fit better,
and a node of fewer than ``min_split`` drawn rows is a leaf.  Of equally good cuts the first feature's
smallest one is taken.

Models that differ only in the number or depth of their trees share them: a shallower tree is the upper part of a
deeper one, a smaller forest the first trees of a larger one.  Rows that are equal in everything but their id are
one row with a count, whose draws are the sum of theirs, so that the trees are the same.

:func:`cells` cuts a table into bins for callers that want histogram trees; protocols and searches do not use it.
"""

from __future__ import annotations

import math
import pickle
import time
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.session import materialize

#: Rows up to which a single ``fit`` grows exact trees; beyond, it takes the library's.
MOST_ROWS = 500_000
#: Bin numbers (cells of one split times features) that a task is asked to hold.
MOST_BINNED = 20_000_000
_CHUNK = 50_000  # held-out rows scored at once
_EQUAL = 0.8  # equal rows are put together where that leaves at most this share of them


@dataclass(frozen=True)
class Spec:
    number: int
    split: int  # rows with this in their ``skip`` array are not trained on, rows with it in ``held`` are scored
    trees: int
    depth: int
    max_features: str | None
    min_split: int
    criterion: str
    seed: int
    bootstrap: bool


def uniforms(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number in [0, 1) for each row id, of this tree alone."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) % 2 ** 64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def drawn(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson with mean 1, from a hash of the row id."""
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
    return np.searchsorted(steps, uniforms(ids, seed, tree), "right")


def _goodness(left: list[np.ndarray], right: list[np.ndarray], criterion: str) -> np.ndarray:
    """Larger is purer; one array of weights per class."""
    def part(c: list[np.ndarray]) -> np.ndarray:
        n = sum(c[1:], c[0])
        whole = np.where(n > 0, n, 1)
        if criterion == "gini":
            return sum((a * a for a in c[1:]), c[0] * c[0]) / whole
        logs = [a * np.log(np.where(a > 0, a, 1)) for a in c]
        return sum(logs[1:], logs[0]) - n * np.log(whole)

    return part(left) + part(right)


@dataclass
class Coded:
    """Rows whose values are numbered along each feature: ``code[f]`` is the place in ``values[f]``, missing ones last."""

    code: np.ndarray
    values: list[np.ndarray]


def coded(x: np.ndarray) -> Coded:
    code, values = np.empty((x.shape[1], len(x)), np.int32 if len(x) < 2 ** 31 else np.int64), []
    for f in range(x.shape[1]):
        there = ~np.isnan(x[:, f])
        found, place = np.unique(x[there, f], return_inverse=True)
        code[f], values = len(found), [*values, found.astype(float)]
        code[f, there] = place
    return Coded(code, values)


_PACK = float(1 << 26)  # whole units of two classes are added up as one number


@dataclass
class _Layout:
    """A row's sort key of one feature: node, code and kind, each in its bits.  Rows of a kind have one class, count
    and weight; ``parts`` are the kind's units per class, ``factor`` what a unit weighs."""

    kind_bits: int
    code_bits: list[int]
    parts: np.ndarray
    factor: np.ndarray
    packed: np.ndarray | None = None  # the units of both classes of a kind

    def sums(self, key: np.ndarray, bits: int, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The (node, code) that occur, in order, and per class the units up to each."""
        mask, table = (1 << self.kind_bits) - 1, self.parts if self.packed is None else self.packed[None]
        if size << bits <= len(key) // 2:  # few values: counted
            place, kind = key >> self.kind_bits, key & mask
            found = [np.bincount(place, t.take(kind)) for t in table]
            there = np.flatnonzero(found[0] if len(found) == 1 else np.bincount(place))
            place, upto = there, [np.cumsum(f[there]) for f in found]
        else:
            key.sort()
            place, kind, last = key >> self.kind_bits, key & mask, np.ones(len(key), bool)
            np.not_equal(place[1:], place[:-1], out=last[:-1])
            ends = np.flatnonzero(last)  # the last row of every value of a node
            place, upto = place.take(ends), [np.cumsum(t.take(kind)).take(ends) for t in table]
        if self.packed is not None:
            one = np.floor(upto[0] / _PACK)
            upto = [upto[0] - one * _PACK, one]
        return place, upto


def _bits(n: int) -> int:
    return max(1, int(n).bit_length())


def _kinds(y: np.ndarray, weight: np.ndarray, count: np.ndarray, classes: int):
    """The kind of every row, and per kind the units of each class and the count; the weight of a unit by class."""
    factor = np.ones(classes)
    for c in range(classes):
        own = weight[y == c]
        if len(own) and (own != own[0]).any():
            factor = None
            break
        factor[c] = own[0] if len(own) else 1.0
    # whole numbers add up without error; rows of unlike weights in a class are added as weights
    unit = count if factor is not None else weight * count
    sizes, size = np.unique(unit, return_inverse=True)
    counts, times = np.unique(count, return_inverse=True)
    found, kind = np.unique((size * len(counts) + times) * classes + y, return_inverse=True)
    units = sizes[found // (len(counts) * classes)]
    parts = np.where(found % classes == np.arange(classes)[:, None], units, 0)
    return kind, parts, counts[found // classes % len(counts)], np.ones(classes) if factor is None else factor


def _best_cuts(key: np.ndarray, values: np.ndarray, total: list[np.ndarray], layout: _Layout, criterion: str):
    """Per node the best cut of one feature: (goodness, threshold, code below it, missing to the left), -inf without any.

    ``key``: the sort keys of its rows.  ``total`` has the weights of the nodes, an array per class.
    """
    size = len(total[0])
    good, cut, below, to_left = np.full(size, -np.inf), np.zeros(size), np.zeros(size, np.int64), np.zeros(size, bool)
    bits = _bits(len(values))
    place, upto = layout.sums(key, bits, size)
    node, code = place >> bits, place & ((1 << bits) - 1)
    first = np.flatnonzero(np.diff(node, prepend=-1))
    # a cut lies after a value that has a successor in the node; missing is the last one
    i = np.flatnonzero(node[1:] == node[:-1])
    if not len(i):
        return good, cut, below, to_left
    k, left, before, own = node[i], [], np.zeros(size), node[first]
    for c, f in zip(upto, layout.factor):
        before[own[1:]] = c[first[1:] - 1]
        before[own[0]] = 0
        left.append((c[i] - before[k]) * f)
    whole = [t[k] for t in total]
    score = _goodness(left, [t - c for t, c in zip(whole, left)], criterion)
    side = np.zeros(len(i), bool)
    # per unit of weight and rounded, so that equal cuts stay equal: the smallest value then wins
    unit = sum(whole[1:], whole[0])
    score = np.round(score / unit, 10)
    gone = code == len(values)
    if gone.any():
        at = np.flatnonzero(gone)
        missing = []
        for c, f in zip(upto, layout.factor):
            m = np.zeros(size)
            m[node[at]] = (c[at] - np.where(at > 0, c[at - 1], 0)) * f
            missing.append(m[k])
        with_left = [c + m for c, m in zip(left, missing)]
        other = np.round(_goodness(with_left, [t - c for t, c in zip(whole, with_left)], criterion) / unit, 10)
        # nothing else would be on the right, or nothing is missing: not a cut of its own
        other[gone[i + 1] | (sum(missing[1:], missing[0]) == 0)] = -np.inf
        side = other > score
        score = np.maximum(score, other)
    first = np.flatnonzero(np.diff(k, prepend=-1))
    top = np.maximum.reduceat(score, first)
    hit = np.flatnonzero(score == np.repeat(top, np.diff(np.append(first, len(k)))))
    hit = hit[np.flatnonzero(np.diff(k[hit], prepend=-1))]
    own, j = k[hit], i[hit]
    low = values[code[j]]
    high = np.where(gone[j + 1], low, values[np.minimum(code[j + 1], len(values) - 1)])
    middle = low + (high - low) / 2
    good[own], to_left[own], below[own] = score[hit], side[hit], code[j]
    cut[own] = np.where(middle < high, middle, low)
    return good, cut, below, to_left


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, count: np.ndarray, classes: int, spec: Spec, tree: int,
         codes: Coded | None = None):
    """Nodes of one tree: feature (-1: leaf), threshold, missing to the left, left child, class shares.

    Rows with a count of 0 are not in the tree.  ``codes``: :func:`coded` of ``x``, if known.  The rows of a node
    follow each other from level to level; rows of leaves are dropped.
    """
    rng = np.random.default_rng([spec.seed, tree])
    codes = codes or coded(x)
    p = len(codes.values)
    tried = features_tried(spec, p)
    rows = np.flatnonzero(count)
    kind, parts, times, factor = _kinds(y[rows], weight[rows], count[rows], classes)
    layout = _Layout(_bits(len(times) - 1), [_bits(len(v)) for v in codes.values], parts, factor)
    if classes == 2 and parts.dtype.kind == "i" and count.sum() < _PACK:
        layout.packed = parts[0] + parts[1] * _PACK
    most = layout.kind_bits + max(layout.code_bits, default=0)
    if most + _bits(len(rows)) > 63:
        raise ValueError("too many rows of unlike values for the trees of one task")
    small = np.int32 if most < 32 else np.int64
    kind = kind.astype(np.int32)
    keys = [(c[rows].astype(small) << layout.kind_bits) | kind.astype(small) for c in codes.code]
    each, width, order = np.array([len(rows)]), 1, None  # rows of every node of the level, and where they lay before
    feature, threshold, to_left, child, share = [], [], [], [], []
    first = depth = 0  # the number of the level's first node
    while width:
        starts = np.cumsum(each) - each
        total = np.column_stack([np.add.reduceat(u[kind], starts) * f for u, f in zip(parts, factor)]) if len(kind) \
            else np.zeros((width, classes))
        n = np.add.reduceat(times[kind], starts) if len(kind) else np.zeros(width)
        open_ = (n >= spec.min_split) & ((total > 0).sum(1) > 1) & (depth < spec.depth)
        size = int(open_.sum())
        f_best, cut, side = np.full(width, -1), np.zeros(width), np.zeros(width, bool)
        if size:
            if size < width:
                go = np.flatnonzero(np.repeat(open_, each))
                kind, order = kind.take(go), go if order is None else order.take(go)
            if order is not None:
                keys = [k.take(order) for k in keys]
            each = each[open_]
            *best, below = _best_features(keys, each, [t[open_] for t in total.T], min(tried, p), rng, spec.criterion,
                                          layout, codes.values)
            f_best[open_], cut[open_], side[open_] = best
            each, order = _parted(keys, each, best[0], below, best[2], layout, codes.values)
            kind = kind.take(order)
        split = f_best >= 0
        kids = 2 * (np.cumsum(split) - 1)
        feature.append(f_best)
        threshold.append(cut)
        to_left.append(side)
        child.append(np.where(split, first + width + kids, 0))
        share.append(total / np.maximum(total.sum(1), 1e-300)[:, None])
        first, width, depth = first + width, 2 * int(split.sum()), depth + 1
    return tuple(np.concatenate(a) for a in (feature, threshold, to_left, child, share))


def features_tried(spec: Spec, p: int) -> int:
    return {"sqrt": max(1, int(math.sqrt(p))), "log2": max(1, int(math.log2(p)))}.get(spec.max_features, p) if p else 0


def _parted(keys: list, each: np.ndarray, f_best: np.ndarray, below: np.ndarray, side: np.ndarray, layout: _Layout,
            values: list):
    """Rows of every node of the next level, and where they lie; those of a node keep their order."""
    way = np.full(int(each.sum()), 2, np.int8)  # 0 left, 1 right, 2 ends here
    for f, key in enumerate(keys):
        own = f_best == f
        if own.any():
            rows = slice(None) if own.all() else np.flatnonzero(np.repeat(own, each))
            code, n = key[rows] >> layout.kind_bits, each[own]
            goes = code > np.repeat(below[own].astype(code.dtype), n)
            if side[own].any():
                goes &= ~((code == len(values[f])) & np.repeat(side[own], n))
            way[rows] = goes
    left, right, split = np.flatnonzero(way == 0), np.flatnonzero(way == 1), f_best >= 0
    if not split.any():
        return each[:0], left
    n_right = np.add.reduceat(way, np.cumsum(each) - each, dtype=np.int64)[split]
    each = np.column_stack([each[split] - n_right, n_right]).ravel()
    place = np.repeat(np.tile([False, True], len(n_right)), each)
    order = np.empty(len(place), np.int64)
    order[place], order[~place] = right, left
    return each, order


def _best_features(keys: list, each: np.ndarray, total: list, tried: int, rng, criterion: str, layout: _Layout,
                   values: list):
    """Feature (-1: none), threshold, side of missing values and code below the cut: the best of every open node."""
    size, starts = len(each), np.cumsum(each) - each
    # a feature cuts a node if not all of its rows have one value there, or all none
    can = np.array([np.maximum.reduceat(k, starts) >> layout.kind_bits > np.minimum.reduceat(k, starts) >> layout.kind_bits
                    for k in keys])
    # of the features that can cut a node, a random few are compared
    order = rng.random(can.shape)
    order[~can] = np.inf
    can &= order <= np.sort(order, axis=0)[tried - 1]
    good, cut, side = np.full(can.shape, -np.inf), np.zeros(can.shape), np.zeros(can.shape, bool)
    below = np.zeros(can.shape, np.int64)
    node = np.repeat(np.arange(size, dtype=np.int32), each)
    for f, key in enumerate(keys):
        if can[f].any():
            bits = layout.kind_bits + layout.code_bits[f]
            kind = np.int32 if bits + _bits(size) < 32 else np.int64
            key = (node.astype(kind) << bits) | key
            key = key if can[f].all() else key[np.repeat(can[f], each)]
            good[f], cut[f], below[f], side[f] = _best_cuts(key, values[f], total, layout, criterion)
    pick, k = np.argmax(good, axis=0), np.arange(size)
    return np.where(good[pick, k] > -np.inf, pick, -1), cut[pick, k], side[pick, k], below[pick, k]


def shares(nodes, x: np.ndarray) -> np.ndarray:
    """Class shares of the leaf of every row."""
    return next(iter(shares_at(nodes, x, [None]).values()))


def shares_at(nodes, x: np.ndarray, depths: list[int | None]) -> dict[int | None, np.ndarray]:
    """Class shares of every row's leaf in the tree cut off at each of the depths (None: the whole tree)."""
    feature, threshold, to_left, child, share = nodes
    at, rows, depth, out = np.zeros(len(x), np.int64), np.arange(len(x)), 0, {}
    while len(out) < len(depths):
        f = feature[at]
        go = f >= 0
        if depth in depths:
            out[depth] = share[at]
        if not go.any():
            return out | {d: share[at] for d in depths if d not in out}
        value = x[rows, np.maximum(f, 0)]
        right = np.where(np.isnan(value), ~to_left[at], value > threshold[at])
        at = np.where(go, child[at] + right, at)
        depth += 1
    return out


def _matrix(t: pa.Table, names: list[str], kind=float) -> np.ndarray:
    return np.column_stack([t.column(c).to_numpy().astype(kind) for c in names])


def _weights(y: np.ndarray, classes: int, times: np.ndarray | None = None) -> np.ndarray:
    """``n / (classes seen * n_c)`` per row; ``times`` says how many rows a row stands for."""
    n = np.bincount(y, times, classes)
    return (n.sum() / ((n > 0).sum() * np.maximum(n, 1)))[y]


def _equal_rows(codes: Coded, y: np.ndarray) -> np.ndarray:
    """Numbers the rows that are equal in class and features."""
    out = y.astype(np.int64)
    for code, values in zip(codes.code, codes.values):
        out = np.unique(out * (len(values) + 1) + code, return_inverse=True)[1]
    return out


def _ready(x: np.ndarray, y: np.ndarray, times: np.ndarray, classes: int):
    """What all trees over the same rows share: codes, rows, classes and weights, and the number of every row's like."""
    codes, weight = coded(x), _weights(y, classes, times)
    if not (times == 1).all():
        return codes, x, y, weight, None
    cell = _equal_rows(codes, y)
    first = np.unique(cell, return_index=True)[1]
    if len(first) > _EQUAL * len(cell):
        return codes, x, y, weight, None
    return Coded(codes.code[:, first], codes.values), x[first], y[first], weight[first], cell


def _grown(ids: np.ndarray, x: np.ndarray, y: np.ndarray, times: np.ndarray, classes: int, spec: Spec, trees: range,
           ready: tuple | None = None):
    """Nodes and seconds of some of a model's trees; a cell of ``times`` rows is drawn as often as they would be."""
    codes, x, y, weight, cell = ready or _ready(x, y, times, classes)
    single = bool((times == 1).all())
    for tree in trees:
        start, count = time.perf_counter(), times
        if spec.bootstrap:
            count = drawn(ids, spec.seed, tree) if single else np.random.default_rng([spec.seed, tree, 1]).poisson(times)
            if not count.any():
                count = times
        if cell is not None:
            count = np.bincount(cell, count, len(y)).astype(np.int64)
        nodes = grow(x, y, weight, count, classes, spec, tree, codes)
        yield tree, nodes, time.perf_counter() - start


def _shared(specs: list[Spec], p: int) -> list[list[Spec]]:
    """Specs that differ only in the number and depth of their trees, the one that says how to grow them first."""
    out: dict[tuple, list[Spec]] = {}
    for s in specs:
        key = s.split, features_tried(s, p), s.min_split, s.criterion == "gini", s.seed, s.bootstrap
        out.setdefault(key, []).append(s)
    return [[replace(own[0], number=i, trees=max(s.trees for s in own), depth=max(s.depth for s in own)), *own]
            for i, own in enumerate(out.values())]


def _dealt(specs: list[Spec], cores: int) -> tuple[int, int]:
    """Trees of a model that one task grows, and the number of such parts."""
    per = max(1, sum(s.trees for s in specs) // (4 * cores))
    return per, sum(-(-s.trees // per) for s in specs)


def _tasks(leads: list[Spec], p: int, cores: int) -> list[tuple[int, list[tuple[int, range]]]]:
    """Per task its split and which trees of which models it grows; the longest tasks first."""
    costs = [features_tried(s, p) for s in leads]
    most = max(1, sum(s.trees * c for s, c in zip(leads, costs)) // (8 * cores))
    out = []
    for split in sorted({s.split for s in leads}):
        own, room = [], most
        for i, s in enumerate(leads):
            lo = 0
            while s.split == split and lo < s.trees:
                if own and room < costs[i]:
                    out.append((split, own))
                    own, room = [], most
                hi = min(s.trees, lo + max(1, room // costs[i]))
                own.append((i, range(lo, hi)))
                lo, room = hi, room - (hi - lo) * costs[i]
        out.append((split, own))
    return sorted(out, key=lambda t: -sum(len(trees) * costs[i] for i, trees in t[1]))


def _with_parts(specs: list[Spec], per: int):
    """Array of (spec, split, part) of all tasks."""
    every = [(s.number, s.split, part) for s in specs for part in range(-(-s.trees // per))]
    return F.array(*[F.struct(F.lit(a).alias("spec"), F.lit(b).alias("split"), F.lit(c).alias("part")) for a, b, c in every])


def fit_many(rows: DataFrame, names: list[str], specs: list[Spec], classes: int) -> DataFrame:
    """Grow all trees of all specs: spec, tree, nodes (pickled), seconds.

    ``rows`` has _id, _y (class number), ``skip`` (array of splits) and the features ``names``.
    """
    per, groups = _dealt(specs, rows.sparkSession.sparkContext.defaultParallelism)
    by = {s.number: s for s in specs}
    each = rows.select("_id", "_y", *names, F.inline(F.filter(
        _with_parts(specs, per), lambda s: ~F.array_contains("skip", s["split"])))).drop("split")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        spec, part = by[key[0].as_py()], key[1].as_py()
        order = np.argsort(t.column("_id").to_numpy(), kind="stable")
        ids, y, x = t.column("_id").to_numpy()[order], t.column("_y").to_numpy()[order], _matrix(t, names)[order]
        trees = range(part * per, min(spec.trees, (part + 1) * per))
        out = [(spec.number, tree, pickle.dumps(nodes), seconds)
               for tree, nodes, seconds in _grown(ids, x, y, np.ones(len(ids), np.int64), classes, spec, trees)]
        return pa.table({c: pa.array(v, k) for (c, k), v in zip(
            (("spec", pa.int32()), ("tree", pa.int32()), ("nodes", pa.binary()), ("seconds", pa.float64())), zip(*out))})

    dealt = each.repartition(min(2000, 3 * groups), "spec", "part").groupBy("spec", "part")
    return materialize(dealt.applyInArrow(run, "spec int, tree int, nodes binary, seconds double"), "trees")


def cells(rows: DataFrame, names: list[str], splits: list[int], bins: int) -> DataFrame | None:
    """Rows in the same bins of all features: split, _id, _y, ``names`` (bin numbers, null if missing), ``train`` and
    ``held`` (how many of them a split trains on and scores).  None where one task could not hold a split's cells.

    Bins end at quantiles of all rows.
    """
    coded = [f"_b{i}" for i in range(len(names))]
    known = rows.select("_y", "skip", "held", *[F.nanvl(c, F.lit(None)).alias(c) for c in names])
    cutter = QuantileDiscretizer(numBucketsArray=[bins] * len(names), inputCols=names, outputCols=coded,
                                 handleInvalid="keep")
    filled = known.select("*", *[F.col(c).isNull().alias(f"_m{i}") for i, c in enumerate(names)])
    binned = cutter.fit(known).transform(filled.fillna(0.0, names)).select("_y", "skip", "held", *[
        F.when(~F.col(f"_m{i}"), F.col(b)).cast("float").alias(c) for i, (b, c) in enumerate(zip(coded, names))])
    each = binned.select("_y", *names, "skip", "held", F.explode(F.array(*[F.lit(s) for s in splits])).alias("split"))
    each = each.select("split", "_y", *names, (~F.array_contains("skip", F.col("split"))).cast("int").alias("train"),
                       F.array_contains("held", F.col("split")).cast("int").alias("held"))
    found = each.groupBy("split", "_y", *names).agg(F.sum("train").alias("train"), F.sum("held").alias("held"))
    number = F.xxhash64("_y", *[F.coalesce(c, F.lit(-1.0)) for c in names])  # a hash passes over what is missing
    found = materialize(found.where("train > 0 or held > 0").withColumn("_id", number), "cells")
    most = max((r["count"] for r in found.groupBy("split").count().collect()), default=0)
    return found if most * len(names) <= MOST_BINNED else None


def _nth(ids: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Numbers rows of one id, in any order of arrival the same (up to rows that are equal in everything)."""
    out, order = np.zeros(len(ids), np.int64), np.argsort(ids, kind="stable")
    if len(ids) and (ids[order][1:] == ids[order][:-1]).any():
        order = np.lexsort((*x.T, y, ids))
        first = np.flatnonzero(np.diff(ids[order], prepend=ids[order[0]]) != 0)
        starts = np.concatenate([[0], first])
        out[order] = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    return out


_UNIT = float(1 << 40)  # class shares are added up as whole numbers, in any order with the same sum


def _scores(ids: np.ndarray, nth: np.ndarray, y: np.ndarray, held: np.ndarray, sums: list[str], spec: Spec,
            total: np.ndarray, grown: float, used: float) -> pa.Table:
    """Summed class shares of one spec's rows in whole units, and one more row with its seconds."""
    fixed, n = total.astype(np.int64), len(ids)
    return pa.table({"spec": pa.array(np.full(n + 1, spec.number, np.int32)), "_id": pa.array(np.append(ids, 0), pa.int64()),
                     "_nth": pa.array(nth, pa.int64()),
                     "_y": pa.concat_arrays([pa.array(y, pa.int32()), pa.nulls(1, pa.int32())]),
                     "held": pa.array(np.append(held, 0), pa.int64()),
                     **{c: pa.array(np.append(fixed[:, i], 0), pa.int64()) for i, c in enumerate(sums)},
                     "grown": pa.array(np.append(np.zeros(n), grown)), "used": pa.array(np.append(np.zeros(n), used))})


def run_many(rows: DataFrame, names: list[str], specs: list[Spec], classes: int) -> DataFrame:
    """Grow all trees of all specs and let the same tasks score what is held out, so that no tree is written or sent.

    ``rows`` has _id, _y, the features ``names`` and either the arrays ``skip`` and ``held`` or, from :func:`cells`,
    split and the counts train and held.  Written: spec, _id, _y, held (rows that it stands for), guess (class
    number) and score (of class 1); and per spec a row without a class, with the seconds grown and used (those of
    trees that specs share count in each).  Row ids may repeat or be missing: each row is scored by itself.
    """
    shared = _shared(specs, len(names))
    leads, members = [g[0] for g in shared], [g[1:] for g in shared]
    tasks = _tasks(leads, len(names), rows.sparkSession.sparkContext.defaultParallelism)
    by = {s.number: s for s in specs}
    parts = F.array(*[F.struct(F.lit(split).alias("split"), F.lit(i).alias("task")) for i, (split, _) in enumerate(tasks)])
    if "split" in rows.columns:
        each = rows.select("*", F.inline(F.filter(parts, lambda s: s["split"] == rows["split"])).alias("_s", "task"))
    else:
        each = rows.select("_id", "_y", *names, F.inline(parts).alias("_s", "task"), "skip", "held").select(
            "_id", "_y", *names, "task", (~F.array_contains("skip", F.col("_s"))).cast("bigint").alias("train"),
            F.array_contains("held", F.col("_s")).cast("bigint").alias("held")).where("train > 0 or held > 0")
    each = each.select("task", F.coalesce("_id", F.lit(-1 << 63)).alias("_id"), "_y", *names, "train", "held")
    sums = [f"p{c}" for c in range(classes)]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        work = tasks[key[0].as_py()][1]
        own = [s for i, _ in work for s in members[i]]
        ids, y, times, held = (t.column(c).to_numpy() for c in ("_id", "_y", "train", "held"))
        x = _matrix(t, names, t.schema.field(names[0]).type.to_pandas_dtype() if names else float)
        ask, fit = held > 0, np.flatnonzero(times)
        fit = fit[np.argsort(ids[fit], kind="stable")]
        asked, n = x[ask], int(ask.sum())
        train = ids[fit], x[fit], y[fit], times[fit], classes
        ready, total = _ready(*train[1:]) if len(fit) else None, {s.number: np.zeros((n, classes)) for s in own}
        grown, used = dict.fromkeys(total, 0.0), dict.fromkeys(total, 0.0)
        for lead, tree, nodes, seconds in ((i, *g) for i, trees in (work if len(fit) else ())
                                           for g in _grown(*train, leads[i], trees, ready)):
            start = time.perf_counter()
            users = [s for s in members[lead] if tree < s.trees]
            depths = sorted({s.depth for s in users})
            for lo in range(0, n, _CHUNK):
                found = shares_at(nodes, asked[lo:lo + _CHUNK], depths)
                found = {d: np.rint(p * _UNIT) for d, p in found.items()}
                for s in users:
                    total[s.number][lo:lo + _CHUNK] += found[s.depth]
            scored = time.perf_counter() - start
            for s in users:
                grown[s.number], used[s.number] = grown[s.number] + seconds, used[s.number] + scored
        nth = np.append(_nth(ids[ask], y[ask], asked), 0)
        return pa.concat_tables([_scores(ids[ask], nth, y[ask], held[ask], sums, *a)
                                 for a in ((s, total[s.number], grown[s.number], used[s.number]) for s in own)])

    dealt = each.repartitionById(len(tasks), F.col("task")).groupBy("task")  # each task has a partition
    kinds = ", ".join(f"{c} bigint" for c in sums)
    found = materialize(dealt.applyInArrow(run, f"spec int, _id bigint, _nth bigint, _y int, held bigint, {kinds}, grown double, used double"),
                        "part-scores")
    found = found.groupBy("spec", "_id", "_nth", "_y", "held").agg(*[F.sum(c).alias(c) for c in (*sums, "grown", "used")])
    trees = F.element_at(F.array(*[F.lit(float(by[i].trees) if i in by else 1.0) for i in range(max(by) + 1)]),
                         F.col("spec") + 1)
    top = F.greatest(*sums, F.lit(0))
    guess = F.coalesce(*[F.when(F.col(c) == top, F.lit(i)) for i, c in enumerate(sums)])
    score = F.col("p1") / (_UNIT * trees) if classes > 1 else F.lit(0.0)
    return materialize(found.select("spec", "_id", "_y", "held", guess.alias("guess"), score.alias("score"),
                                    "grown", "used"), "scored")


def score_many(rows: DataFrame, names: list[str], specs: list[Spec], trees: DataFrame) -> DataFrame:
    """Every spec over its held-out rows: spec, _id, _y, guess (class number), score (of class 1), seconds."""
    splits = F.array(*[F.struct(F.lit(s.number).alias("spec"), F.lit(s.split).alias("split")) for s in specs])
    each = rows.select("_id", "_y", *names, F.inline(F.filter(splits, lambda s: F.array_contains("held", s["split"]))))
    chunks = max(1, rows.count() // _CHUNK)
    each = each.withColumn("chunk", F.pmod(F.xxhash64("_id"), F.lit(chunks)).cast("int")).drop("split")
    every = trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select("spec", "chunk", "nodes")

    def run(key: tuple, t: pa.Table, model: pa.Table) -> pa.Table:
        start = time.perf_counter()
        x, total = _matrix(t, names), 0.0
        for blob in model.column("nodes").to_pylist():
            total = total + shares(pickle.loads(blob), x)
        p = np.atleast_2d(total / max(1, len(model)))
        n = t.num_rows
        guess = p.argmax(1) if n and len(model) else np.zeros(n, np.int64)
        score = p[:, 1] if n and len(model) and p.shape[1] > 1 else np.zeros(n)
        used = np.full(n, (time.perf_counter() - start) / max(n, 1))
        return pa.table({"spec": pa.array(np.full(n, key[0].as_py(), np.int32)), "_id": t.column("_id"), "_y": t.column("_y"),
                         "guess": pa.array(guess.astype(np.int32)), "score": pa.array(score), "seconds": pa.array(used)})

    n = min(2000, 3 * len(specs) * chunks)
    left, right = (d.repartition(n, "spec", "chunk").groupBy("spec", "chunk") for d in (each, every))
    schema = "spec int, _id bigint, _y int, guess int, score double, seconds double"
    return materialize(left.cogroup(right).applyInArrow(run, schema), "scored")
