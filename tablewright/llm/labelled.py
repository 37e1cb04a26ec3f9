"""What the learned operators share: a bounded sample of labelled rows, and a small logistic regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import Scratch

#: Rows of a whole sample, at about this many the fraction of the rest is set by their number.
MOST_ROWS = 20_000


def labelled_sample(labels: DataFrame, label: str, train: Column, most_rows: int, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, label) of at most about `most_rows` labelled documents that `train` allows, chosen by a hash of their ids.

    Missing ids and labels do not count, nor do documents whose rows contradict each other.
    """
    rows = labels.where(train).select(F.col(id_column).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where("doc_id is not null and label is not null")
    fraction = min(1.0, most_rows / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(fraction * 1_000_000)))
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("high"))
    return rows.where("label = high and label in (0, 1)").drop("high")


def labelled_texts(docs: DataFrame, sample: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, text, label) of the sample, written down; its ids are few by construction, so they are sent to all tasks."""
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    return Scratch(docs.sparkSession, "labelled").save(source.join(F.broadcast(sample), "doc_id"))


@dataclass
class Logistic:
    """score = 1 / (1 + exp(-(bias + weights . (x - mean) / scale)))"""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = self.bias + ((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5) -> Logistic:
    """Newton's method with a small ridge; one label alone gives a constant, none 0.5."""
    width = x.shape[1] if x.ndim == 2 else 0
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        return Logistic(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(share / (1 - share))))
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1.0)
    a = np.column_stack((np.ones(len(x)), (x - mean) / scale))
    w, penalty = np.zeros(a.shape[1]), ridge * len(x) * np.eye(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return Logistic(mean, scale, w[1:], float(w[0]))
