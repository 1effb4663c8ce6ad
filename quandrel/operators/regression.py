"""Small numpy fits that run on one group's rows inside a task."""

from __future__ import annotations

import numpy as np


def quantile_regression(x: np.ndarray, y: np.ndarray, level: float, rounds: int = 500, tolerance: float = 1e-7) -> np.ndarray:
    """Coefficients that minimise the pinball loss, by reweighted least squares with a floor that shrinks.

    Collinear columns are allowed: each step is a least-norm solution.  The best coefficients seen are returned.
    """
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    scale = max(float(np.std(y)), 1e-12)
    best, lowest = beta, pinball_loss(y - x @ beta, level)
    floor = 0.1 * scale
    for _ in range(rounds):
        residual = y - x @ beta
        weight = np.where(residual >= 0, level, 1 - level) / np.maximum(np.abs(residual), floor)
        root = np.sqrt(weight)
        new = np.linalg.lstsq(x * root[:, None], y * root, rcond=None)[0]
        loss = pinball_loss(y - x @ new, level)
        if loss < lowest:
            best, lowest = new, loss
        moved = float(np.max(np.abs(x @ (new - beta)))) if len(y) else 0.0
        beta = new
        if moved < tolerance * scale:
            if floor <= 1e-6 * scale:
                break
        floor = max(floor * 0.7, 1e-6 * scale)
    return best


def pinball_loss(residual: np.ndarray, level: float) -> float:
    return float(np.mean(np.maximum(level * residual, (level - 1) * residual))) if len(residual) else 0.0


def nelder_mead(f, start: np.ndarray, rounds: int = 2000, tolerance: float = 1e-8) -> np.ndarray:
    """The point of least ``f`` that a downhill simplex from ``start`` finds (Nelder and Mead, 1965)."""
    n = len(start)
    points = [start.astype(float)]
    for i in range(n):
        p = start.astype(float).copy()
        p[i] = p[i] * 1.05 if p[i] else 0.00025
        points.append(p)
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tolerance and max(np.max(np.abs(p - points[0])) for p in points[1:]) <= tolerance:
            break
        centre = np.mean(points[:-1], axis=0)
        reflected = centre + (centre - points[-1])
        at = f(reflected)
        if at < values[0]:
            wider = centre + 2 * (centre - points[-1])
            far = f(wider)
            points[-1], values[-1] = (wider, far) if far < at else (reflected, at)
        elif at < values[-2]:
            points[-1], values[-1] = reflected, at
        else:
            inner = centre + 0.5 * ((reflected if at < values[-1] else points[-1]) - centre)
            near = f(inner)
            if near < min(at, values[-1]):
                points[-1], values[-1] = inner, near
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]


class Stumps:
    """Gradient-boosted stumps for one level: each stump's leaves hold quantiles of the residuals (Friedman, 2001)."""

    def __init__(self, level: float, rounds: int = 50, rate: float = 0.1, bins: int = 16):
        self.level, self.rounds, self.rate, self.bins = level, rounds, rate, bins
        self.base, self.stumps = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Stumps:
        self.base = float(np.quantile(y, self.level))
        now = np.full(len(y), self.base)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        for _ in range(self.rounds):
            residual = y - now
            slope = np.where(residual >= 0, self.level, self.level - 1)
            best = None
            for j, at in enumerate(cuts):
                for c in at:
                    left = x[:, j] <= c
                    n = int(left.sum())
                    if 0 < n < len(y):
                        gain = slope[left].sum() ** 2 / n + slope[~left].sum() ** 2 / (len(y) - n)
                        if best is None or gain > best[0]:
                            best = (gain, j, c, left)
            if best is None:
                break
            _, j, c, left = best
            low, high = (self.rate * float(np.quantile(residual[m], self.level)) for m in (left, ~left))
            self.stumps.append([float(j), float(c), low, high])
            now += np.where(left, low, high)
        return self
