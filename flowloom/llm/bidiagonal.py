"""Singular values and right singular vectors of a small matrix by bidiagonal qd transforms.

Householder reflections make the matrix upper bidiagonal, dqds (Fernando and Parlett 1994) finds the
squared singular values to high relative accuracy without subtractions other than the shift, and twisted
factorisations (Dhillon and Parlett 2004) give a vector per value.
"""

from __future__ import annotations

import math

import numpy as np

_EPS = float(np.finfo(float).eps)


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """A unit vector v with (I - 2 v v') x along the first axis."""
    norm = np.linalg.norm(x)
    if norm == 0 or not x[1:].any():
        return None
    v = x / norm
    v[0] += np.copysign(1.0, v[0])
    return v / np.linalg.norm(v)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, W) with U' r W upper bidiagonal for some orthogonal U."""
    a = np.array(r, float)
    d = a.shape[0]
    w = np.eye(d)
    for k in range(d):
        v = _reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= np.outer(2 * v, v @ a[k:, k:])
        if k < d - 2:
            v = _reflector(a[k, k + 1:])
            if v is not None:
                a[k:, k + 1:] -= np.outer(a[k:, k + 1:] @ v, 2 * v)
                w[:, k + 1:] -= np.outer(w[:, k + 1:] @ v, 2 * v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, int]:
    """One dqds transform: (q, e, last d, place); the place is short of the end where the shift was too large."""
    m, d = len(q), q[0] - shift
    qs, es = [0.0] * m, [0.0] * (m - 1)
    for i in range(m - 1):
        if not d >= 0:
            return qs, es, d, i
        qs[i] = d + e[i]
        t = q[i + 1] / qs[i] if qs[i] else 0.0
        es[i] = e[i] * t
        d = d * t - shift
    qs[-1] = d
    return qs, es, d, m if d >= 0 else m - 1


def _bound(q: list[float], e: list[float]) -> float:
    """A lower bound of the smallest value: the reciprocal of the trace of the inverse."""
    d, trace = q[0], 0.0
    for i in range(len(q) - 1):
        if d <= 0:
            return 0.0
        trace += 1 / d
        d *= q[i + 1] / (d + e[i])
    return 1 / (trace + 1 / d) if d > 0 else 0.0


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values, falling, of the upper bidiagonal matrix with diagonal a, superdiagonal b."""
    found: list[float] = []
    todo = [([float(x) for x in a * a], [float(x) for x in b * b], 0.0)]
    while todo:
        q, e, total = todo.pop()
        rounds, most, limit = 0, math.inf, 100 * len(q)
        while len(q) > 1:
            m, rounds = len(q), rounds + 1
            if rounds > limit:
                raise ArithmeticError("qd transforms did not converge")
            cut = next((i for i in range(m - 2, -1, -1)
                        if e[i] <= _EPS * _EPS * (total + min(q[i], q[i + 1])) or e[i] < 1e-290), None)
            if cut == m - 2:
                found.append(total + q.pop())
                e.pop()
                most = math.inf
                continue
            if cut is not None:
                todo.append((q[:cut + 1], e[:cut], total))
                q, e = q[cut + 1:], e[cut + 1:]
                most = math.inf
                continue
            # no diagonal entry, and no eigenvalue of the last 2 x 2 block, is below the smallest value
            x, y, z = q[-2] + e[-1], q[-1], q[-1] * e[-1]
            mean, root = (x + y) / 2, math.hypot((x - y) / 2, z ** 0.5)
            last = max(0.0, (x * y - z) / (mean + root)) if mean + root else 0.0
            most = min(most, last, min(map(float.__add__, q, [*e, 0.0])))
            shift = last if last <= most * 1.001 else most / 2
            got = _step(q, e, shift)
            if got[3] == m - 1 and shift + got[2] > 0:  # only the last place failed: it tells by how much
                most, shift = min(most, shift), shift + got[2]
                got = _step(q, e, shift)
            if got[3] < m:
                most, shift = min(most, shift), _bound(q, e) * (1 - 4 * m * _EPS)
                if shift < most / 4:
                    half = _step(q, e, most / 2)
                    shift, got = (most / 2, half) if half[3] == m else (shift, got)
                    most = most / 2 if half[3] < m else most
            if got[3] < m:
                got = _step(q, e, shift)
            if got[3] < m:
                shift = 0.0
                got = _step(q, e, shift)
            most = max(most - shift, 0.0)
            q, e, total = got[0], got[1], total + shift
        if q:
            found.append(total + q[0])
    return np.sort(np.array(found))[::-1]


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(up, down, gamma): multipliers of the twisted factorisations of B'B - value I at every twist."""
    m, tiny = len(a), _EPS * max(value, 1e-290)
    low = a[:-1] * b
    diag = a * a
    up, down = np.zeros(max(m - 1, 0)), np.zeros(max(m - 1, 0))
    s, p = np.empty(m), np.empty(m)
    s[0] = -value
    for i in range(m - 1):
        pivot = s[i] + diag[i]
        up[i] = low[i] / (pivot if pivot else tiny)
        s[i + 1] = up[i] * (b[i] / a[i]) * s[i] - value
    p[-1] = diag[-1] - value
    for i in range(m - 2, -1, -1):
        pivot = b[i] * b[i] + p[i + 1]
        t = diag[i] / (pivot if pivot else tiny)
        down[i] = (b[i] / a[i]) * t
        p[i] = p[i + 1] * t - value
    return up, down, s + p + value


def _vector(up: np.ndarray, down: np.ndarray, twist: int) -> np.ndarray:
    z = np.zeros(len(up) + 1)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(twist, len(up)):
        z[i + 1] = -down[i] * z[i]
    return z / np.linalg.norm(z)


def _block(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest squared singular values of an unreduced block, and their vectors as columns."""
    values = dqds(a, b)
    vectors: list[np.ndarray] = []
    for k, value in enumerate(values[:most]):
        up, down, gamma = _twisted(a, b, float(value))
        order = np.argsort(np.abs(gamma), kind="stable")
        near = [vectors[i] for i in range(k) if values[i] - value <= 1e-5 * values[i]]
        z = None
        for twist in order:
            z = _vector(up, down, int(twist))
            for _ in range(2):
                for other in near:  # values this near share a plane: keep the vectors orthogonal
                    z = z - (other @ z) * other
            norm = np.linalg.norm(z)
            if norm > 0.1:
                z = z / norm
                break
        vectors.append(z)
    return values[:most], np.array(vectors).T


def right_singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest squared singular values of a square matrix, falling, and right vectors as columns.

    Values that vanish against the largest (by the size of the matrix times the rounding unit) are 0 with
    vectors of zeros.
    """
    d, size = r.shape[0], float(np.abs(r).max(initial=0.0))
    most = min(most, d)
    values, vectors = np.zeros(most), np.zeros((d, most))
    if not size:
        return values, vectors
    a, b, w = bidiagonalise(r / size)
    floor = _EPS * d
    a = np.where(np.abs(a) < floor * 1e-8, floor * 1e-8, a)  # far below rounding; the qd form divides by it
    cuts = [0, *(np.flatnonzero(np.abs(b) <= _EPS * (np.abs(a[:-1]) + np.abs(a[1:])) * 0.1) + 1), d]
    every = []
    for lo, hi in zip(cuts, cuts[1:]):
        s, z = _block(a[lo:hi], b[lo:hi - 1], most)
        every += [(float(x), lo, z[:, i]) for i, x in enumerate(s)]
    every.sort(key=lambda x: -x[0])
    for k, (value, lo, z) in enumerate(every[:most]):
        if value > (floor ** 2) * every[0][0]:
            values[k] = value * size * size
            vectors[:, k] = w[:, lo:lo + len(z)] @ z
    return values, vectors
