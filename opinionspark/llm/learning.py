"""What the classifiers share: a bounded labelled sample, and Adam."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_or_empty


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int) -> DataFrame:
    """(doc_id, text, y) of rows of each class, none of them held out: at most ``per_class`` with ``most_bytes`` of text.

    Labels come from (doc_id, ``label``); nulls are left out and a doc_id with
    both labels counts as 1. Rows are taken in the order of a hash of their id, so
    the choice doesn't change between runs; a row whose text no longer fits is
    left out, and the others are taken whole. Of rows that share an id the
    smallest text counts. The ids are at most 2 * per_class rows and are
    therefore broadcast, and their sizes are added up on the driver.
    """
    known = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col(label)).cast("double").alias("y"))
    )
    order = F.xxhash64("doc_id", F.lit(5))
    chosen = [known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0.0, 1.0)]

    def texts(ids: DataFrame) -> DataFrame:
        rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")
        return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    sizes = texts(chosen[0].unionByName(chosen[1])).select(
        "doc_id", "y", F.octet_length("text").alias("size"), order.alias("place")
    )
    left, taken = {0.0: most_bytes, 1.0: most_bytes}, []
    for row in sorted(sizes.collect(), key=lambda r: (r.place, r.doc_id)):
        if row.size <= left[row.y]:
            left[row.y] -= row.size
            taken.append((row.doc_id, row.y))
    return texts(docs.sparkSession.createDataFrame(taken, "doc_id long, y double"))


class Adam:
    """Adam over a dictionary of float arrays, which it changes in place."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.01, decay: float = 0.0):
        self._weights, self._rate, self._decay, self._step = weights, rate, decay, 0
        self._mean = {k: np.zeros_like(w) for k, w in weights.items()}
        self._square = {k: np.zeros_like(w) for k, w in weights.items()}

    def update(self, gradients: dict[str, np.ndarray]) -> None:
        self._step += 1
        rate = self._rate * np.sqrt(1 - 0.999**self._step) / (1 - 0.9**self._step)
        for k, g in gradients.items():
            w = self._weights[k]
            g = g + self._decay * w
            self._mean[k] += 0.1 * (g - self._mean[k])
            self._square[k] += 0.001 * (g * g - self._square[k])
            w -= rate * self._mean[k] / (np.sqrt(self._square[k]) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))
