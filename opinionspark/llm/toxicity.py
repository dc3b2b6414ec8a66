"""Toxicity by a bidirectional gated recurrent network over characters and words.

A text is read in overlapping windows of words, without ASCII signs and case. The input of a word is an
embedding of the word, if the training texts have it often enough, and the
mean embedding of its character trigrams. A gated recurrent network reads each
window in both directions, attention pools its states, and a text scores as
its highest window. Only texts are labelled, so training lets the window that
scores highest stand for its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, parts_of, text_or_empty
from .learning import Adam, labelled_sample, sigmoid
from .shingles import mixed, text_slices, word_edges, word_hashes

#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 32, 16
#: The sample that is learned from: texts of each class at most, and bytes of them, each taken whole.
PER_CLASS, SAMPLE_BYTES = 1500, 1 << 23
#: Words in at least so many texts of the sample have embeddings of their own, the most frequent ones.
LEAST_TEXTS, MOST_WORDS = 5, 8192
TRIGRAMS, WORD_SIZE, CHAR_SIZE, HIDDEN, GATE = 4096, 12, 12, 12, 8
EPOCHS = 10
THRESHOLD = 0.5
_U = np.uint64
#: Bytes as they are read: ASCII letters in lower case, ASCII signs as white space.
_PLAIN = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_PLAIN[65:91] += 32


class Words:
    """The distinct words of some texts: which word stands where, and each word's character trigrams."""

    hashes: np.ndarray
    #: Trigrams of word i are ``trigrams[first[i]:first[i + 1]]``.
    first: np.ndarray
    trigrams: np.ndarray
    #: The word at each place, and the first place of each row.
    index: np.ndarray
    rows: np.ndarray

    @classmethod
    def merged(cls, parts: list[Words]) -> Words:
        """The words of several slices, whose rows follow each other."""
        made = cls.__new__(cls)
        made.hashes, sample, where = np.unique(
            np.concatenate([p.hashes for p in parts]), return_index=True, return_inverse=True
        )
        size = np.concatenate([np.diff(p.first) for p in parts])
        begin = np.cumsum(size) - size
        made.first = np.concatenate(([0], np.cumsum(size[sample])))
        inner = np.arange(int(made.first[-1])) - np.repeat(made.first[:-1], size[sample])
        made.trigrams = np.concatenate([p.trigrams for p in parts])[np.repeat(begin[sample], size[sample]) + inner]
        offset = np.cumsum([0] + [len(p.hashes) for p in parts])
        made.index = np.concatenate([where[o : o + len(p.hashes)].astype(np.int32)[p.index] for p, o in zip(parts, offset)])
        places = np.cumsum([0] + [len(p.index) for p in parts])
        made.rows = np.concatenate([[0], *[p.rows[1:] + o for p, o in zip(parts, places)]])
        return made

    def packed(self) -> dict[str, bytes]:
        """What a task sends of them."""
        kinds = {"hashes": "<u8", "first": "<i4", "trigrams": "<u2", "index": "<i4", "rows": "<i4"}
        return {k: getattr(self, k).astype(t).tobytes() for k, t in kinds.items()}

    @classmethod
    def unpacked(cls, sent: dict[str, bytes]) -> Words:
        made = cls.__new__(cls)
        for k, t in {"hashes": "<u8", "first": "<i4", "trigrams": "<u2", "index": "<i4", "rows": "<i4"}.items():
            setattr(made, k, np.frombuffer(sent[k], t))
        return made

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lower = _PLAIN[data]
        hashes, self.rows = word_hashes(lower, offsets)
        self.hashes, sample, self.index = np.unique(hashes, return_index=True, return_inverse=True)
        starts, ends = word_edges(lower, offsets)
        starts, ends = starts[sample], ends[sample]
        size = ends - starts + 2
        self.first = np.concatenate(([0], np.cumsum(size - 2)))
        # Each word between two marks, then three neighbouring bytes to a trigram.
        begin = np.concatenate(([0], np.cumsum(size)))
        text = np.full(int(begin[-1]), 0x20, np.uint64)
        inner = np.arange(int(self.first[-1])) - np.repeat(self.first[:-1], size - 2)
        at = np.repeat(begin[:-1] + 1, size - 2) + inner
        text[at] = lower[np.repeat(starts, size - 2) + inner]
        self.trigrams = (
            mixed((text[at - 1] << _U(16)) | (text[at] << _U(8)) | text[at + 1]) % _U(TRIGRAMS)
        ).astype(np.uint16)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of each window, its length, first window of each row); a row without words has one empty window."""
        counts = np.diff(self.rows)
        per_row = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
        first = np.concatenate(([0], np.cumsum(per_row)))
        row = np.repeat(np.arange(len(counts)), per_row)
        start = (np.arange(int(first[-1])) - first[row]) * STRIDE
        length = np.minimum(WINDOW, counts[row] - start)
        at = (self.rows[row] + start)[:, None] + np.arange(WINDOW)
        inside = np.arange(WINDOW) < length[:, None]
        none = len(self.hashes)
        padded = np.append(self.index, none).astype(np.int32)
        return np.where(inside, padded[np.minimum(at, len(self.index))], none), length, first


class Network:
    """Embeddings, two gated recurrent layers (one per direction), attention pooling, a logistic output."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 11):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.vocabulary = vocabulary
        inputs = WORD_SIZE + CHAR_SIZE

        def normal(*shape: int) -> np.ndarray:
            return (draw.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)

        self.weights = {
            "words": (draw.normal(0, 0.3, (len(vocabulary) + 1, WORD_SIZE))).astype(np.float32),
            "chars": (draw.normal(0, 0.3, (TRIGRAMS, CHAR_SIZE))).astype(np.float32),
            "A": normal(2 * HIDDEN, GATE),
            "a": normal(GATE),
            "c": normal(2 * HIDDEN),
            "d": np.zeros(1, np.float32),
        }
        for k in ("f", "b"):
            self.weights |= {
                f"{k}W": normal(inputs, 3 * HIDDEN),
                f"{k}U": normal(HIDDEN, 3 * HIDDEN),
                f"{k}B": np.zeros(3 * HIDDEN, np.float32),
            }

    def known(self, words: Words) -> np.ndarray:
        """The row of each distinct word in the word embeddings; 0 for words that have none."""
        at = np.minimum(np.searchsorted(self.vocabulary, words.hashes), max(len(self.vocabulary) - 1, 0))
        if not len(self.vocabulary):
            return np.zeros(len(words.hashes), np.int64)
        return np.where(self.vocabulary[at] == words.hashes, at + 1, 0)

    def inputs(self, known: np.ndarray, trigrams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The input vector of each distinct word, and zeros for the place after the last."""
        out = np.zeros((len(known) + 1, WORD_SIZE + CHAR_SIZE), np.float32)
        if len(known):
            out[:-1, :WORD_SIZE] = self.weights["words"][known]
            sums = np.add.reduceat(self.weights["chars"][trigrams], first[:-1], axis=0)
            out[:-1, WORD_SIZE:] = sums / np.diff(first)[:, None]
        return out

    def _read(self, x: np.ndarray, windows: np.ndarray, inside: np.ndarray, k: str, keep: bool) -> dict[str, list]:
        """Reads windows (transposed: step by step) in one direction; states stay as they are where words end.

        Only with ``keep`` is there more in the result than the states.
        """
        p, n = self.weights, windows.shape[1]
        projected = x @ p[f"{k}W"] + p[f"{k}B"]
        h = np.zeros((n, HIDDEN), np.float32)
        out = {"h": [None] * WINDOW, "before": [None] * WINDOW, "z": [None] * WINDOW, "r": [None] * WINDOW, "m": [None] * WINDOW, "u": [None] * WINDOW}
        for t in range(WINDOW) if k == "f" else range(WINDOW - 1, -1, -1):
            own = projected[windows[t]]
            u = h @ p[f"{k}U"]
            gates = sigmoid(own[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            m = np.tanh(own[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            if keep:
                out["before"][t], out["z"][t], out["r"][t], out["m"][t], out["u"][t] = h, z, r, m, u[:, 2 * HIDDEN :]
            h = h + inside[t] * z * (m - h)
            out["h"][t] = h
        return out

    def forward(self, x: np.ndarray, windows: np.ndarray, length: np.ndarray, keep: bool = True) -> dict:
        """The scores of windows; with ``keep`` also what gradients need."""
        p = self.weights
        steps = np.ascontiguousarray(windows.T)
        inside = (np.arange(WINDOW)[:, None] < length).astype(np.float32)[:, :, None]
        f, b = self._read(x, steps, inside, "f", keep), self._read(x, steps, inside, "b", keep)
        h = np.concatenate((np.stack(f["h"]), np.stack(b["h"])), axis=2)
        g = np.tanh(h @ p["A"])
        e = np.where(inside[:, :, 0] > 0, g @ p["a"], -1e4)
        e[0] = np.where(length > 0, e[0], 0)
        e = np.exp(e - e.max(axis=0))
        a = e / e.sum(axis=0)
        pooled = (a[:, :, None] * h).sum(axis=0)
        score = sigmoid(pooled @ p["c"] + p["d"][0])
        if not keep:
            return {"score": score}
        return {"steps": steps, "inside": inside, "f": f, "b": b, "h": h, "g": g, "a": a, "pooled": pooled, "score": score}

    def window_scores(self, x: np.ndarray, windows: np.ndarray, length: np.ndarray, together: int = 2048) -> np.ndarray:
        """The score of each window, a bounded number at a time."""
        found = [
            self.forward(x, windows[i : i + together], length[i : i + together], keep=False)["score"]
            for i in range(0, len(windows), together)
        ]
        return np.concatenate(found) if found else np.zeros(0, np.float32)

    def scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(score of each window, first window of each row)."""
        windows, length, first = words.windows()
        return self.window_scores(self.inputs(self.known(words), words.trigrams, words.first), windows, length), first

    def gradients(self, known, trigrams, first, windows, length, y, weight) -> dict[str, np.ndarray]:
        p = self.weights
        x = self.inputs(known, trigrams, first)
        f = self.forward(x, windows, length)
        ds = ((f["score"] - y) * weight / weight.sum()).astype(np.float32)
        out = {"c": f["pooled"].T @ ds, "d": ds.sum(keepdims=True)}
        dpooled = ds[:, None] * p["c"]
        h, a, g = f["h"], f["a"], f["g"]
        da = (h * dpooled).sum(axis=2)
        de = a * (da - (a * da).sum(axis=0)) * f["inside"][:, :, 0]
        out["a"] = np.tensordot(de, g, axes=([0, 1], [0, 1]))
        dg = de[:, :, None] * p["a"] * (1 - g * g)
        out["A"] = np.tensordot(h, dg, axes=([0, 1], [0, 1]))
        dh = a[:, :, None] * dpooled + dg @ p["A"].T
        dx = np.zeros_like(x)
        for k, part in (("f", dh[:, :, :HIDDEN]), ("b", dh[:, :, HIDDEN:])):
            r_ = f[k]
            dW, dU, dB = np.zeros_like(p[f"{k}W"]), np.zeros_like(p[f"{k}U"]), np.zeros_like(p[f"{k}B"])
            carry = np.zeros_like(part[0])
            for t in range(WINDOW - 1, -1, -1) if k == "f" else range(WINDOW):
                before, z, r, m, u = (r_[n][t] for n in ("before", "z", "r", "m", "u"))
                total, on = part[t] + carry, f["inside"][t]
                dz, dm = total * on * (m - before) * z * (1 - z), total * on * z * (1 - m * m)
                dr = dm * u * r * (1 - r)
                own = np.concatenate((dz, dr, dm), axis=1)
                back = np.concatenate((dz, dr, dm * r), axis=1)
                dU += before.T @ back
                dB += own.sum(axis=0)
                at = f["steps"][t]
                dW += x[at].T @ own
                np.add.at(dx, at, own @ p[f"{k}W"].T)
                carry = total * (1 - on * z) + back @ p[f"{k}U"].T
            out |= {f"{k}W": dW, f"{k}U": dU, f"{k}B": dB}
        out["words"], out["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
        np.add.at(out["words"], known, dx[:-1, :WORD_SIZE])
        per = dx[:-1, WORD_SIZE:] / np.maximum(np.diff(first), 1)[:, None]
        np.add.at(out["chars"], trigrams, np.repeat(per, np.diff(first), axis=0))
        return out


def _vocabulary(words: Words) -> np.ndarray:
    """Hashes of the most frequent words of at least LEAST_TEXTS rows, sorted."""
    row = np.repeat(np.arange(len(words.rows) - 1), np.diff(words.rows))
    seen = np.unique(row * (len(words.hashes) + 1) + words.index) % (len(words.hashes) + 1)
    texts = np.bincount(seen, minlength=len(words.hashes))
    order = np.argsort(-texts, kind="stable")[:MOST_WORDS]
    return np.sort(words.hashes[order[texts[order] >= LEAST_TEXTS]])


def train(words: Words | None, y: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> Network:
    """A network of labelled texts, the rows of ``words``, whose classes have the same total weight."""
    if words is None:
        return Network(np.zeros(0, np.uint64))
    network = Network(_vocabulary(words))
    known = network.known(words)
    windows, length, first = words.windows()
    draw = np.random.Generator(np.random.PCG64(seed))
    share = min(max(float(np.mean(y)), 0.01), 0.99)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    adam = Adam(network.weights, 0.01, 1e-6)
    for epoch in range(epochs):
        if epoch < 2:  # any window of a text may be the one
            best = first[:-1] + draw.integers(np.diff(first))
        else:
            found = network.window_scores(network.inputs(known, words.trigrams, words.first), windows, length)
            best = np.array([a + found[a:b].argmax() for a, b in zip(first[:-1], first[1:])])
        for some in np.array_split(draw.permutation(len(y)), max(1, len(y) // 48)):
            at = windows[best[some]]
            # The batch's distinct words only, so that a step costs as much as its windows.
            used, place = np.unique(at, return_inverse=True)
            none = used[-1] == len(words.hashes)
            used = used[:-1] if none else used
            size = np.diff(words.first)[used]
            begin = np.concatenate(([0], np.cumsum(size)))
            inner = np.arange(int(begin[-1])) - np.repeat(begin[:-1], size)
            trigrams = words.trigrams[np.repeat(words.first[used], size) + inner]
            adam.update(
                network.gradients(
                    known[used], trigrams, begin, place.reshape(at.shape), length[best[some]], y[some], weight[some]
                )
            )
    return network


def learned(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES
) -> Network:
    """The network of at most ``per_class`` labelled texts and ``sample_bytes`` of them a class.

    Tasks number the words of each text; its word numbers and its distinct
    words' hashes and trigrams reach the driver, no more bytes than the text has
    but for very short words.
    """

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            sent = [Words(data, offsets).packed() for _, _, data, offsets in text_slices(batch["text"], 0)]
            columns = [pa.array([x[k] for x in sent], pa.binary()) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], *columns], ["doc_id", "y", *kinds])

    kinds = ("hashes", "first", "trigrams", "index", "rows")
    sample = labelled_sample(docs, labels, "toxic", per_class, sample_bytes).select("doc_id", "text", "y")
    rows = sample.mapInArrow(numbered, "doc_id long, y double, " + ", ".join(f"{k} binary" for k in kinds)).collect()
    rows.sort(key=lambda r: r.doc_id)
    words = Words.merged([Words.unpacked(r.asDict()) for r in rows]) if rows else None
    return train(words, np.array([r.y for r in rows], dtype=np.float32))


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, from all windows of its whole text.

    score: 0 to 1, higher the likelier the text is toxic; predicted: 1 from 0.5
    on. Only the text is scored. A null or empty text is one window without
    words. A null doc_id is scored and not held out. Repeated rows are scored
    alike, no documents give no rows, without labels every score is that of an
    untrained network, and other columns are ignored. ``per_class`` and
    ``sample_bytes`` bound the labelled rows that are learned from; training
    and scoring take all windows of a text.
    """
    network = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, per_class, sample_bytes))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            found = []
            for _, _, data, offsets in text_slices(batch["text"], 1 << 20):
                scores, first = network.value.scores(Words(data, offsets))
                found.append(np.maximum.reduceat(scores, first[:-1]))
            values = np.concatenate(found).astype(np.float64) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(values)], ["doc_id", "score"])

    rows = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(score, "doc_id long, score double")
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return rows.select("doc_id", out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
