"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded; gated attention,
learned from the labels of documents alone, weighs the passages; the weighted
passage representation gives the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, parts_of, text_or_empty
from .learning import Adam, labelled_sample, sigmoid
from .shingles import text_slices, word_hashes, word_starts

#: Words of a passage.
PASSAGE = 64
#: The sample that is learned from: documents of each class at most, and bytes of their texts, each taken whole.
PER_CLASS, SAMPLE_BYTES = 3000, 1 << 24
HIDDEN, GATE, EPOCHS = 24, 12, 40
THRESHOLD = 0.3

#: Classes of bytes: each ASCII sign on its own, then lower, upper, digit, line feed, other space, other ASCII, beyond ASCII.
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASSES = len(_SIGNS) + 7
_CLASS = np.full(256, len(_SIGNS) + 5, np.int64)
_CLASS[_SIGNS] = np.arange(len(_SIGNS))
_CLASS[ord("a") : ord("z") + 1] = len(_SIGNS)
_CLASS[ord("A") : ord("Z") + 1] = len(_SIGNS) + 1
_CLASS[ord("0") : ord("9") + 1] = len(_SIGNS) + 2
_CLASS[ord("\n")] = len(_SIGNS) + 3
_CLASS[[9, 11, 12, 13, 32]] = len(_SIGNS) + 4
_CLASS[128:] = len(_SIGNS) + 6
_LAGS = (1, 2, 3, 4)
FEATURES = _CLASSES + len(_LAGS) + 3


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, first passage of each row); every row has a passage, if an empty one.

    Features: the shares of the classes of bytes, how often a word equals one
    of the four before it, its words' mean length, and how full it is.
    """
    words, rows = word_hashes(data, offsets)
    counts = np.diff(rows)
    per_row = np.maximum(1, -(-counts // PASSAGE))
    first = np.concatenate(([0], np.cumsum(per_row)))
    row = np.repeat(np.arange(len(counts)), counts)
    passage = first[row] + (np.arange(len(words)) - rows[row]) // PASSAGE
    n = int(first[-1])
    # A byte belongs to the passage of the last word that starts at or before it in its row.
    step = np.zeros(len(data) + 1, np.int64)
    np.maximum.at(step, np.minimum(offsets[:-1], len(data)), first[:-1])
    if len(words):
        new = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        step[word_starts(data, offsets)[new]] = passage[new]
    of_byte = np.maximum.accumulate(step)[:-1]
    shares = np.bincount(of_byte * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES)
    size = np.maximum(shares.sum(axis=1), 1)
    held = np.bincount(passage, minlength=n)
    repeats = [
        np.bincount(passage[lag:], (words[lag:] == words[:-lag]) & (passage[lag:] == passage[:-lag]), minlength=n)
        for lag in _LAGS
    ]
    per_word = [r / np.maximum(held, 1) for r in repeats]
    length = np.log1p(size / np.maximum(held, 1))
    features = np.column_stack((np.sqrt(shares / size[:, None]), *per_word, length, held / PASSAGE, held == 0))
    return features.astype(np.float32), first


class AttentionModel:
    """h = tanh(xW + b); a = softmax(w . (tanh(hV) * sigmoid(hU))); score = sigmoid(c . sum(a h) + d)."""

    def __init__(self, seed: int = 7):
        draw = np.random.Generator(np.random.PCG64(seed))
        normal = lambda *shape: draw.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.weights = {
            "W": normal(FEATURES, HIDDEN),
            "b": np.zeros(HIDDEN),
            "V": normal(HIDDEN, GATE),
            "U": normal(HIDDEN, GATE),
            "w": normal(GATE),
            "c": normal(HIDDEN),
            "d": np.zeros(1),
        }
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def _forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, starts, sizes = self.weights, first[:-1], np.diff(first)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": sigmoid(z @ p["c"] + p["d"][0])}

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The score of each bag of passages; bags begin at ``first`` and none is empty."""
        return self._forward(x, first)["y"]

    def _gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f, sizes = self.weights, self._forward(x, first), np.diff(first)
        dz = (f["y"] - y) * weight / weight.sum()
        bag = np.repeat(dz, sizes)[:, None] * p["c"]
        h, a = f["h"], f["a"]
        da = (bag * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), sizes))
        dt, ds = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = (a[:, None] * bag + dt @ p["V"].T + ds @ p["U"].T) * (1 - h**2)
        return {
            "W": f["x"].T @ dh,
            "b": dh.sum(axis=0),
            "V": h.T @ dt,
            "U": h.T @ ds,
            "w": (f["t"] * f["s"]).T @ de,
            "c": f["z"].T @ dz,
            "d": dz.sum(keepdims=True),
        }

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> AttentionModel:
        """Learns from bags and their labels, both classes with the same total weight."""
        if not len(bags):
            return self
        every = np.concatenate(bags).astype(np.float64)
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 0.02
        share = min(max(y.mean(), 0.01), 0.99)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        adam, draw = Adam(self.weights, 0.01, 1e-5), np.random.Generator(np.random.PCG64(seed))
        for _ in range(epochs):
            for some in np.array_split(draw.permutation(len(bags)), max(1, len(bags) // 64)):
                first = np.concatenate(([0], np.cumsum([len(bags[i]) for i in some])))
                adam.update(self._gradients(np.concatenate([bags[i] for i in some]), first, y[some], weight[some]))
        return self


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, y, bag): all passages of each row."""
    for batch in parts_of(batches):
        bags = []
        for _, _, data, offsets in text_slices(batch["text"]):
            x, first = passages(data, offsets)
            for a, b in zip(first[:-1], first[1:]):
                bags.append(x[a:b].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["y"], pa.array(bags, pa.binary())], ["doc_id", "y", "bag"]
        )


def learned(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES
) -> AttentionModel:
    """The model of at most ``per_class`` labelled documents and ``sample_bytes`` of text a class.

    The passages' features reach the driver, under half as many bytes as the texts have.
    """
    sample = labelled_sample(docs, labels, "quality", per_class, sample_bytes).select("doc_id", "text", "y")
    rows = sample.mapInArrow(_bags, "doc_id long, y double, bag binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.bag)))
    bags = [np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES) for r in rows]
    return AttentionModel().fit(bags, np.array([r.y for r in rows]))


def _scored(docs: DataFrame, labels: DataFrame, sample: tuple[int, int], *columns: str) -> DataFrame:
    """(_row, _score): the named columns of each document, and its score."""
    model = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, *sample))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            found = [
                model.value.scores(*passages(data, offsets)) for _, _, data, offsets in text_slices(batch["_text"])
            ]
            values = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["_row"], pa.array(values)], ["_row", "_score"])

    rows = docs.select(F.struct(*columns).alias("_row"), text_or_empty().alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(score, f"_row {kind}, _score double")


def quality_scores(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, from its whole text.

    score: 0 to 1, higher the likelier the label is 1; predicted: 1 from 0.3 on.
    Only the text is scored. A null or empty text is one empty passage. A null
    doc_id is scored and not held out. Repeated rows are scored alike, no
    documents give no rows, without labels every score is that of an untrained
    model, and other columns are ignored. ``per_class`` and ``sample_bytes``
    bound the labelled rows that are learned from, each of them whole.
    """
    doc_id, score = F.col("_row.doc_id"), F.col("_score")
    return _scored(docs, labels, (per_class, sample_bytes), "doc_id").select(
        doc_id.alias("doc_id"),
        F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"),
        score.alias("score"),
        (score >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES
) -> DataFrame:
    """The documents that are predicted to have label 1, with all their columns.

    Null and empty texts are judged as ``quality_scores`` judges them, repeated
    rows alike, and a table without rows gives none; a column may have any name but ``_row``, ``_text`` and ``_score``.
    """
    scored = _scored(docs, labels, (per_class, sample_bytes), *docs.columns)
    return scored.filter(F.col("_score") >= THRESHOLD).select("_row.*")
