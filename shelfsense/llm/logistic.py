"""Small logistic regressions on bounded samples, deterministic and without dependence on row order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def sample_labels(labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, float]:
    """(doc_id, y) of about ``per_class`` labelled rows of each class at most, drawn by a hash of the id.

    The number beside it is what the draw took from the log-odds of class 1; a calibrated curve adds it again.

    A doc_id labelled more than once counts with its largest label. Null ids and labels take no part.
    """
    clean = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in clean.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, per_class / n) for y, n in counts.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    wanted = F.lit(False)
    for y, s in share.items():
        wanted = wanted | ((F.col("y") == y) & (draw < s))
    return clean.where(wanted), float(np.log(share.get(0, 1.0) / share.get(1, 1.0)))


def fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, l2: float, steps: int = 80) -> tuple[np.ndarray, float]:
    """Weights and bias of a sparse, class-balanced logistic regression (full-batch Adam)."""
    n = len(y)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b = np.zeros(width), 0.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[columns] * values, minlength=n) + b
        g = share * (sigmoid(z) - y)
        gw = np.bincount(columns, weights=g[rows] * values, minlength=width) + l2 * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 / (1 + t / steps * 4)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    return w, float(b)


def calibrate(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights of a dense logistic regression (last column is the bias), by damped Newton steps; smoothed targets."""
    x = np.column_stack([x, np.ones(len(x))])
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(x.shape[1])
    ridge = l2 * np.eye(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - target) / len(y) + ridge @ w
        hess = (x.T * np.maximum(p * (1 - p), 1e-6)) @ x / len(y) + ridge
        w -= np.linalg.solve(hess, grad)
    return w
