"""Bounded training samples and small linear models for the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, worst: Callable[..., Column]) -> DataFrame:
    """``docs`` (doc_id, ...) with ``_label`` (0/1) for at most ``max_rows`` labelled ids.

    The ids of lowest digest are taken.  Null labels and ids are left out.  Repeated label rows of
    one id count once, with the worst label: ``worst`` is ``F.min`` for quality, ``F.max`` for toxicity.
    """
    some = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(worst(label).cast("int").alias("_label"))
        .orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(max_rows)
    )
    return docs.join(F.broadcast(some), "doc_id")  # max_rows rows of 12 bytes


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression, by Newton steps.

    One class only, or no rows: zero weights and a smoothed log-odds intercept.
    """
    n, k = x.shape
    base = (y.sum() + 0.5) / (n + 1)
    w, b = np.zeros(k), float(np.log(base / (1 - base)))
    if n == 0 or y.min() == y.max():
        return w, b
    x1 = np.hstack([x, np.ones((n, 1))]).astype(np.float64)
    ridge = np.append(np.full(k, l2), 1e-6)
    theta = np.append(w, b)
    for _ in range(steps):
        p = sigmoid(x1 @ theta)
        gradient = x1.T @ (p - y) + ridge * theta
        hessian = (x1 * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x1 + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        theta -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return theta[:-1], float(theta[-1])
