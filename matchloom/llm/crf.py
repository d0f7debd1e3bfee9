"""Linear-chain conditional random field over two labels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking."""
    value, grad = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, alphas = -grad, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            alphas.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y) / (y @ y)
        else:
            d = d / max(1.0, np.abs(d).max())
        for (s, y), a in zip(pairs, reversed(alphas)):
            d = d + s * (a - (y @ d) / (s @ y))
        slope, step = grad @ d, 1.0
        if slope >= 0:
            d, slope = -grad, -(grad @ grad)
        while True:
            v, g = f(x + step * d)
            if v <= value + 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, y = step * d, g - grad
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = abs(value - v) < 1e-7 * max(1.0, abs(value))
        x, value, grad = x + s, v, g
        if done:
            break
    return x


@dataclass
class ChainCRF:
    """``weights`` scores label 1 against label 0 at a position; ``trans`` holds the log potentials 0->1, 1->0, 1->1 (0->0 is 0)."""

    weights: np.ndarray
    trans: np.ndarray

    @staticmethod
    def fit(features: np.ndarray, lengths: np.ndarray, labels: np.ndarray, l2: float = 1.0, steps: int = 80, row_weight: np.ndarray | None = None) -> ChainCRF:
        """Maximum likelihood over sequences stored one after another; deterministic."""
        n, d = features.shape
        longest = int(lengths.max())
        seq = np.repeat(np.arange(len(lengths)), lengths)
        pos = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        w8 = np.ones(len(lengths)) if row_weight is None else row_weight
        wt = w8[seq]
        mask = np.zeros((longest, len(lengths)), bool)
        mask[pos, seq] = True
        prev, cur = labels[:-1], labels[1:]
        same = seq[:-1] == seq[1:]
        seen = np.array([((prev == a) & (cur == b) & same) @ wt[1:] for a, b in ((0, 1), (1, 0), (1, 1))], float)

        def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
            w, t = x[:d], x[d:]
            s = np.clip(features @ w, -40, 40)
            e = np.ones((longest, len(lengths)))
            e[pos, seq] = np.exp(s)
            a00, a01, a10, a11 = 1.0, *np.exp(np.clip(t, -20, 20))
            f1 = np.empty_like(e)
            norm = np.ones_like(e)
            z = 1 + e[0]
            f1[0], norm[0] = e[0] / z, z
            for i in range(1, longest):
                p = f1[i - 1]
                on, off = (p * a11 + (1 - p) * a01) * e[i], p * a10 + (1 - p) * a00
                z = on + off
                keep = mask[i]
                f1[i], norm[i] = np.where(keep, on / z, p), np.where(keep, z, 1.0)
            b0, b1 = np.ones(len(lengths)), np.ones(len(lengths))
            post = np.empty_like(e)
            pairs = np.zeros(3)
            for i in range(longest - 1, -1, -1):
                q = f1[i] * b1
                post[i] = q / (q + (1 - f1[i]) * b0)
                if i:
                    keep = mask[i]
                    p, z = f1[i - 1], norm[i]
                    both = np.stack([(1 - p) * a01 * e[i] * b1, p * a10 * b0, p * a11 * e[i] * b1])
                    all4 = both.sum(0) + (1 - p) * a00 * b0
                    pairs += (np.where(keep, both / all4, 0) * w8).sum(1)
                    n0, n1 = (a00 * b0 + a01 * e[i] * b1) / z, (a10 * b0 + a11 * e[i] * b1) / z
                    b0, b1 = np.where(keep, n0, b0), np.where(keep, n1, b1)
            logz = (np.log(norm).sum(0)) @ w8
            value = logz - (s * labels) @ wt - seen @ t + 0.5 * l2 * (x @ x)
            grad = np.concatenate([features.T @ ((post[pos, seq] - labels) * wt), pairs - seen]) + l2 * x
            return float(value), grad

        x = minimise(loss, np.zeros(d + 3), steps)
        return ChainCRF(x[:d], x[d:])

    def marginals(self, scores: list[float]) -> list[float]:
        """P(label 1) at each position, by forward and backward recursions on odds.

        Odds stay between fixed multiples of the emission odds, so chains of any
        length neither overflow nor underflow.
        """
        a01, a10, a11 = np.exp(np.clip(self.trans, -20, 20)).tolist()
        e = np.exp(np.clip(scores, -40, 40)).tolist()
        if not e:
            return []
        forward, odds = [], e[0]
        forward.append(odds)
        for x in e[1:]:
            odds = x * (odds * a11 + a01) / (odds * a10 + 1.0)
            forward.append(odds)
        out, back = [0.0] * len(e), 1.0
        for i in range(len(e) - 1, -1, -1):
            o = forward[i] * back
            out[i] = o / (1.0 + o)
            y = e[i] * back
            back = (a11 * y + a10) / (a01 * y + 1.0)
        return out
