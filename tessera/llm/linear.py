"""Ridge-penalised logistic regression over sparse rows, by L-BFGS."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows as (row, column, value) triples."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, shape: tuple[int, int]):
        self.row, self.col, self.val, self.shape = row, col, val, shape

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.shape[0])

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], self.shape[1])

    def take(self, which: np.ndarray) -> Rows:
        place = np.full(self.shape[0], -1)
        place[which] = np.arange(len(which))
        own = place[self.row] >= 0
        return Rows(place[self.row[own]], self.col[own], self.val[own], (len(which), self.shape[1]))

    def only(self, columns: np.ndarray) -> Rows:
        """Other columns (False in ``columns``) count as 0, so a model gives them no weight."""
        own = columns[self.col]
        return Rows(self.row[own], self.col[own], self.val[own], self.shape)

    def with_column(self, values: np.ndarray) -> Rows:
        n, d = self.shape
        return Rows(np.concatenate((self.row, np.arange(n))), np.concatenate((self.col, np.full(n, d))), np.concatenate((self.val, values)), (n, d + 1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: Rows, y: np.ndarray, ridge: float = 0.1, most: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias; the bias is not penalised. With one class only: no weights and that class's odds, smoothed; without rows a probability of 0."""
    n, d = x.shape
    if n == 0:
        return np.zeros(d), -35.0
    share = (y.sum() + 0.5) / (n + 1)
    w = np.zeros(d + 1)
    w[d] = np.log(share / (1 - share))
    if y.min() == y.max():
        return w[:d], float(w[d])

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.times(w[:d]) + w[d]
        g = sigmoid(z) - y
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge / 2 * w[:d] @ w[:d]), np.concatenate((x.transposed_times(g) + ridge * w[:d], [g.sum()]))

    f, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(most):
        if np.abs(g).max() < 1e-4 * max(1.0, n / 1000):
            break
        q, alphas = g.copy(), []
        for s, t, rho in reversed(past):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * t
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(g))
        for (s, t, rho), a in zip(past, reversed(alphas), strict=True):
            q += (a - rho * (t @ q)) * s
        step, slope = 1.0, -(g @ q)
        while step > 1e-10:
            new = w - step * q
            f_new, g_new = loss(new)
            if f_new <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, t = new - w, g_new - g
        if s @ t > 1e-12:
            past = [*past[-9:], (s, t, 1 / (s @ t))]
        w, f, g = new, f_new, g_new
    return w[:d], float(w[d])
