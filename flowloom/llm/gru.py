"""A bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a vector of character and word parts.  Words are numbered; number 0 pads and leaves
the state as it is.  All windows of a batch go through the network in step.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """``p`` holds all weights; hidden size ``h``, two directions."""

    def __init__(self, inputs: int, h: int, rng: np.random.Generator):
        self.h = h
        self.p = {}
        for d in "fb":
            self.p["W" + d] = rng.normal(0, inputs ** -0.5, (inputs, 3 * h)).astype(np.float32)
            self.p["U" + d] = rng.normal(0, h ** -0.5, (h, 3 * h)).astype(np.float32)
            self.p["c" + d] = np.zeros(3 * h, np.float32)
        self.p["a"] = rng.normal(0, 0.1, 2 * h).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.3, 2 * h).astype(np.float32)
        self.p["k"] = np.full(1, -2.0, np.float32)

    def project(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Gate inputs of every word, per direction; the pad's update gate is shut."""
        out = []
        for d in "fb":
            x = vectors @ self.p["W" + d] + self.p["c" + d]
            x[0] = 0
            x[0, :self.h] = 40
            out.append(x.astype(np.float32))
        return out

    def run(self, gates: list[np.ndarray], ids: np.ndarray, keep: bool = False):
        """Logits of windows ``ids`` (windows x steps), and what the backward pass needs."""
        n, steps = ids.shape
        h, states = self.h, np.empty((ids.shape[1], n, 2 * self.h), np.float32)
        saved = []
        for k, d in enumerate("fb"):
            u, s = self.p["U" + d], np.zeros((n, h), np.float32)
            for t in range(steps) if k == 0 else range(steps - 1, -1, -1):
                x, g = gates[k][ids[:, t]], s @ u
                zr = _sigmoid(x[:, :2 * h] + g[:, :2 * h])
                z, r = zr[:, :h], zr[:, h:]
                cand = np.tanh(x[:, 2 * h:] + r * g[:, 2 * h:])
                new = cand + z * (s - cand)
                if keep:
                    saved.append((k, t, s, z, r, cand, g[:, 2 * h:]))
                states[t, :, k * h:(k + 1) * h] = s = new
        score = states @ self.p["a"]
        score[(ids == 0).T] = -1e9
        score -= score.max(0)
        w = np.exp(score)
        w /= w.sum(0)
        pooled = np.einsum("tn,tnh->nh", w, states)
        logit = pooled @ self.p["o"] + self.p["k"][0]
        return logit, (states, w, pooled, saved)

    def back(self, ids: np.ndarray, gates: list[np.ndarray], cache, dlogit: np.ndarray):
        """Gradients of the weights and of the gate inputs, given those of the logits."""
        states, w, pooled, saved = cache
        h, p = self.h, self.p
        g = {x: np.zeros_like(v) for x, v in p.items()}
        dx = [np.zeros((*ids.shape, 3 * h), np.float32) for _ in "fb"]
        g["o"], g["k"] = pooled.T @ dlogit, np.array([dlogit.sum()], np.float32)
        dpool = dlogit[:, None] * p["o"]
        dw = np.einsum("nh,tnh->tn", dpool, states)
        ds = w * (dw - (w * dw).sum(0))
        g["a"] = np.einsum("tn,tnh->h", ds, states)
        dstate = w[:, :, None] * dpool[None] + ds[:, :, None] * p["a"]
        carry = [np.zeros((len(ids), h), np.float32) for _ in "fb"]
        for k, t, s, z, r, cand, gn in reversed(saved):
            u = p["U" + "fb"[k]]
            d = dstate[t, :, k * h:(k + 1) * h] + carry[k]
            dn = d * (1 - z) * (1 - cand * cand)
            dz = d * (s - cand) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dx[k][:, t] = np.concatenate((dz, dr, dn), 1)
            dg = np.concatenate((dz, dr, dn * r), 1)
            g["U" + "fb"[k]] += s.T @ dg
            carry[k] = d * z + dg @ u.T
        return g, dx


class Adam:
    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.t = rate, {}, {}, 0

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        for x, d in g.items():
            m = self.m[x] = 0.9 * self.m.get(x, 0) + 0.1 * d
            v = self.v[x] = 0.999 * self.v.get(x, 0) + 0.001 * d * d
            p[x] -= self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.999 ** self.t)) + 1e-8)
