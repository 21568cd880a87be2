"""Calibration of score components against ordinal labels: ridge and log-linear fits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Fit:
    names: list[str]
    weights: list[float]
    bias: float
    kind: str = "linear"

    def column(self) -> Column:
        """The score of a row that has a column for each name."""
        z = F.lit(self.bias)
        for name, w in zip(self.names, self.weights):
            z = z + F.col(name) * w
        return 1 / (1 + F.exp(-z)) if self.kind == "log-linear" else z

    def expression(self, source: str = ".") -> str:
        """The score in the expression language, components in order of names."""
        terms = " + ".join(f'(."{n}" * {w:.6f})' for n, w in sorted(zip(self.names, self.weights)))
        z = f"{terms} + {self.bias:.6f}" if terms else f"{self.bias:.6f}"
        return f"{source} | 1 / (1 + (-1 * ({z}) | exp))" if self.kind == "log-linear" else f"{source} | {z}"

    def by_weight(self) -> list[tuple[str, float]]:
        return sorted(zip(self.names, self.weights), key=lambda x: -abs(x[1]))


def ridge(df: DataFrame, names: Sequence[str], label: str, alpha: float = 0.01) -> Fit:
    """Closed form: one aggregate gives the moments, a system of len(names) equations is solved on the driver."""
    x, y = [F.col(n).cast("double") for n in names], F.col(label).cast("double")
    k = len(x)
    sums = [F.count("*"), F.sum(y), *(F.sum(c) for c in x), *(F.sum(c * y) for c in x), *(F.sum(x[i] * x[j]) for i in range(k) for j in range(i + 1))]
    row = [float(v or 0) for v in df.agg(*sums).first()]
    n, sy, sx, sxy, rest = row[0], row[1], np.array(row[2 : 2 + k]), np.array(row[2 + k : 2 + 2 * k]), row[2 + 2 * k :]
    if not n:
        return Fit(list(names), [0.0] * k, 0.0)
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i + 1):
            g[i, j] = g[j, i] = rest[i * (i + 1) // 2 + j]
    w = np.linalg.solve(g - np.outer(sx, sx) / n + alpha * np.eye(k), sxy - sx * sy / n) if k else np.zeros(0)
    return Fit(list(names), w.tolist(), float(sy / n - sx @ w / n))


def log_linear(df: DataFrame, names: Sequence[str], label: str, steps: int = 200, tolerance: float = 1e-9) -> Fit:
    """Least squares of a sigmoid by Gauss-Newton with damping; each step is one aggregate over the rows."""
    k = len(names) + 1
    theta, damping, last = np.zeros(k), 1e-3, np.inf
    columns = [F.col(n).cast("double") for n in names] + [F.lit(1.0)]
    y = F.col(label).cast("double")

    def moments(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = sum((c * float(t) for c, t in zip(columns, theta)), F.lit(0.0))
        base = df.select(*(c.alias(f"x{i}") for i, c in enumerate(columns)), y.alias("y"), (1 / (1 + F.exp(-z))).alias("s"))
        d, r = F.col("s") * (1 - F.col("s")), F.col("s") - F.col("y")
        x = [F.col(f"x{i}") for i in range(k)]
        row = base.agg(F.avg(r * r), *(F.avg(r * d * a) for a in x), *(F.avg(d * d * x[i] * x[j]) for i in range(k) for j in range(i + 1))).first()
        h = np.zeros((k, k))
        for i in range(k):
            for j in range(i + 1):
                h[i, j] = h[j, i] = row[1 + k + i * (i + 1) // 2 + j] or 0.0
        return float(row[0] or 0.0), np.array([v or 0.0 for v in row[1 : 1 + k]]), h

    loss, g, h = moments(theta)
    for _ in range(steps):
        trial = theta - np.linalg.solve(h + damping * (np.diag(np.diag(h)) + 1e-12 * np.eye(k)), g)
        new = moments(trial)
        if new[0] <= loss:
            last, (loss, g, h), theta, damping = loss, new, trial, max(damping / 5, 1e-9)
            if last - loss < tolerance:
                break
        else:
            damping *= 10
            if damping > 1e9:
                break
    return Fit(list(names), theta[:-1].tolist(), float(theta[-1]), "log-linear")


def clipped(fit: Fit) -> Column:
    """The fitted score as its metrics see it: linear scores are clipped to [0, 1]."""
    return F.greatest(F.least(fit.column(), F.lit(1.0)), F.lit(0.0)) if fit.kind == "linear" else fit.column()
