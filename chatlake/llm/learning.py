"""What the two trained operators share: folds, bounded samples of labels, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A labelled text over this size isn't trained on, so that what the driver gets is bounded in bytes as in rows. It is scored like any other.
TRAIN_BYTES = 1 << 20


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def sampled_labels(labels: DataFrame, label: str, held_out: Column, rows: int) -> DataFrame:
    """(doc_id, label) of at most ``rows`` labelled ids outside the held-out fold, picked by hash.

    Only 0 and 1 are labels; an id that has both is left out.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out)
    one = known.groupBy("doc_id").agg(F.min(F.col(label).cast("long")).alias("label"), F.max(F.col(label).cast("long")).alias("other")).filter("label = other")
    return one.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge, x.T @ (p - y) / len(x) + penalty * w)
        w -= step * min(1.0, 5.0 / (np.linalg.norm(step) + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


class Adam:
    """Adam steps on arrays that are changed in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float) -> None:
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m, self.v = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for a, g, m, v in zip(self.arrays, gradients, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
