"""Bounded, repeatable samples of labelled documents, and calibration of margins on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the crc32 of the id, as text, is divisible by folds: these rows are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, y (0 or 1), text of at most max_rows labelled documents that are not held out: those with the least hash of
    their ids, one row for each id (the greatest label and the least text, if there are several). Rows with a null id or
    label are left out; a null text is empty."""
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    ids = ids.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the broadcast side has max_rows rows of two numbers at most
    return text.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of sigmoid(a * margin + b), by Newton's method on smoothed targets."""
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    if not len(y) or margin.std() == 0:
        return 0.0, float(np.log((pos + 1) / (neg + 1)))
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    centre, scale = margin.mean(), margin.std()
    x = np.stack([(margin - centre) / scale, np.ones_like(margin)], 1)
    w = np.array([0.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - goal) + 1e-3 * w * [1, 0])
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1] - w[0] * centre / scale)
