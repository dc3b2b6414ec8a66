"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read as bytes in chunks of fixed length. A gated recurrent layer
reads each chunk forwards, another one backwards, and every position is
labelled with a probability per language from both states there. A document's
probabilities are the means over all its positions. The network is trained in
numpy by backpropagation through time, every position of a chunk being labelled
with its document's language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parts_of, text_or_empty
from .learning import Adam
from .shingles import text_slices

#: Bytes of a chunk. A text's last chunk may be shorter.
CHUNK = 64
#: The sample that is learned from: documents of a language, chunks of one of them, spread over its whole length,
#: and languages, those with the most documents.
PER_LANG, CHUNKS, MOST_LANGS = 400, 8, 256
EMBEDDED, HIDDEN = 8, 8
#: Passes over the sample, and steps at least, so that a small one is learned as well.
EPOCHS, BATCH, LEAST_STEPS = 4, 256, 150
#: What a text without letters is given.
UNDETERMINED = "und"
#: Chunks that are read side by side.
_TOGETHER = 2048


def chunks_of(sizes: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte within the row, length) of each chunk of rows of so many bytes; empty rows have none."""
    per_row = -(-sizes // chunk)
    row = np.repeat(np.arange(len(sizes)), per_row)
    place = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = place * chunk
    return row, start, np.minimum(chunk, sizes[row] - start)


def steps_of(data: np.ndarray, first: np.ndarray, length: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """(step, chunk): the bytes of chunks that begin at ``first``; what lies behind a chunk's end is 0."""
    at = np.arange(chunk)[:, None]
    return np.where(at < length, data[np.minimum(first + at, len(data) - 1)], 0).astype(np.uint8)


class Network:
    """Byte embeddings, a gated recurrent layer in each direction, and a softmax over languages at every position."""

    def __init__(self, langs: list[str], seed: int = 5):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.langs = langs

        def normal(*shape: int) -> np.ndarray:
            return (draw.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)

        self.weights = {
            "bytes": draw.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32),
            "V": normal(2 * HIDDEN, len(langs)),
            "v": np.zeros(len(langs), np.float32),
        }
        for k in "fb":
            self.weights |= {
                f"{k}W": normal(EMBEDDED, 3 * HIDDEN),
                f"{k}U": normal(HIDDEN, 3 * HIDDEN),
                f"{k}B": np.zeros(3 * HIDDEN, np.float32),
            }

    def _order(self, k: str, steps: int) -> range:
        return range(steps) if k == "f" else range(steps - 1, -1, -1)

    def _states(self, steps: np.ndarray, length: np.ndarray, k: str, out: np.ndarray, trace: list | None = None) -> None:
        """Writes the states of all positions in one direction to ``out`` (step, HIDDEN, chunk).

        The backward layer starts at each chunk's own last byte: until then its state stays zero. The forward
        layer's states behind the end are never looked at. Gates are 1 / (1 + exp(-x)), and tanh(x) is
        1 - 2 / (1 + exp(2 * x)); signs and factors are put into the weights.
        """
        p, n, two = self.weights, steps.shape[1], 2 * HIDDEN
        table = p["bytes"] @ p[f"{k}W"] + p[f"{k}B"]
        gates, fresh = np.ascontiguousarray(-table[:, :two].T), np.ascontiguousarray(2 * table[:, two:].T)
        recur, recur_fresh = np.ascontiguousarray(-p[f"{k}U"][:, :two].T), np.ascontiguousarray(2 * p[f"{k}U"][:, two:].T)
        h = np.zeros((HIDDEN, n), np.float32)
        short = int(length.min()) if n else 0
        for t in self._order(k, len(steps)):
            zr = recur @ h
            zr += np.take(gates, steps[t], axis=1)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:HIDDEN], zr[HIDDEN:]
            u = recur_fresh @ h
            m = r * u
            m += np.take(fresh, steps[t], axis=1)
            np.exp(m, out=m)
            m += 1
            np.divide(-2, m, out=m)
            m += 1
            if trace is not None:
                trace.append((h, z, r, m, u / 2))
            step = m - h
            step *= z
            if k == "b" and t >= short:
                step *= t < length
            h = h + step
            out[t] = h

    def labels(self, steps: np.ndarray, length: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """(step, language, chunk): the probabilities of every position; behind a chunk's end they mean nothing."""
        p, n = self.weights, steps.shape[1]
        h = np.empty((len(steps), 2 * HIDDEN, n), np.float32)
        steps = steps.astype(np.intp)
        with np.errstate(over="ignore"):
            for k, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
                self._states(steps, length, k, h[:, part], None if trace is None else trace.setdefault(k, []))
        logits = np.ascontiguousarray(p["V"].T) @ h
        logits += p["v"][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        if trace is not None:
            trace["h"] = h
        return logits

    def document_probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(row, language): the mean probabilities of each row's positions; equal ones for rows without bytes."""
        sizes = np.diff(offsets)
        row, start, length = chunks_of(sizes)
        sums = np.zeros((len(sizes), len(self.langs)))
        # Chunks of equal length side by side; nearly all are full.
        order = np.argsort(-length, kind="stable")
        for i in range(0, len(order), _TOGETHER):
            some = order[i : i + _TOGETHER]
            steps = steps_of(data, offsets[row[some]] + start[some], length[some])[: length[some].max()]
            found = self.labels(steps, length[some])
            if length[some[-1]] < len(steps):
                found *= (np.arange(len(steps))[:, None] < length[some])[:, None, :]
            np.add.at(sums, row[some], found.sum(axis=0).T)
        sums[sizes == 0] = 1
        return sums / sums.sum(axis=1, keepdims=True)

    def gradients(self, steps: np.ndarray, length: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions, each labelled with its chunk's language ``y``."""
        p, trace = self.weights, {}
        found = self.labels(steps, length, trace)
        inside = (np.arange(len(steps))[:, None] < length).astype(np.float32)
        found[:, y, np.arange(len(y))] -= 1
        found *= (inside / inside.sum())[:, None, :]
        h = trace["h"]
        out = {"V": np.einsum("thn,tln->hl", h, found, optimize=True), "v": found.sum(axis=(0, 2))}
        out["bytes"] = np.zeros_like(p["bytes"])
        dh = p["V"] @ found
        for k, part in (("f", dh[:, :HIDDEN]), ("b", dh[:, HIDDEN:])):
            dU, dtable = np.zeros_like(p[f"{k}U"]), np.zeros((256, 3 * HIDDEN), np.float32)
            carry = np.zeros_like(part[0])
            order = list(self._order(k, len(steps)))
            for t, (before, z, r, m, u) in zip(reversed(order), reversed(trace[k])):
                total = part[t] + carry
                moved = total * (t < length) if k == "b" else total
                dz, dm = moved * (m - before) * z * (1 - z), moved * z * (1 - m * m)
                dr = dm * u * r * (1 - r)
                back = np.concatenate((dz, dr, dm * r))
                dU += before @ back.T
                np.add.at(dtable, steps[t], np.concatenate((dz, dr, dm)).T)
                carry = total - moved * z + p[f"{k}U"] @ back
            out |= {f"{k}U": dU, f"{k}W": p["bytes"].T @ dtable, f"{k}B": dtable.sum(axis=0)}
            out["bytes"] += dtable @ p[f"{k}W"].T
        return out


def train(chunks: list[bytes], y: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 3) -> Network:
    """A network of labelled chunks."""
    network = Network(langs)
    some = [i for i, c in enumerate(chunks) if c]
    if not some or len(langs) < 2:
        return network
    length = np.array([len(chunks[i]) for i in some])
    data = np.frombuffer(b"".join(chunks[i] for i in some), np.uint8)
    steps = steps_of(data, np.cumsum(length) - length, length, int(length.max()))
    y = y[some]
    adam, draw = Adam(network.weights, 0.01), np.random.Generator(np.random.PCG64(seed))
    batches = max(1, len(some) // BATCH)
    for _ in range(max(epochs, -(-LEAST_STEPS // batches))):
        for at in np.array_split(draw.permutation(len(some)), batches):
            adam.update(network.gradients(steps[:, at], length[at], y[at]))
    return network


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32(doc_id as text) mod 3 is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _share_of_draws(share: float) -> int:
    """Up to which of all 64-bit numbers so large a share of them lies."""
    return min(int(min(share, 1.0) * 2**64) - 2**63, 2**63 - 1)


def learned(
    docs: DataFrame, per_lang: int = PER_LANG, chunks: int = CHUNKS, most_langs: int = MOST_LANGS
) -> Network:
    """The network of at most ``per_lang`` documents of each of ``most_langs`` languages, ``chunks`` chunks of each.

    Documents are chosen by a hash of their id, so the choice doesn't change
    between runs. Only the chosen chunks reach the driver.
    """
    may = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = may.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    counted = {r.lang: r.n for r in sizes.collect()}
    langs = sorted(counted)
    known = may.select("doc_id", "lang").distinct().withColumn("_draw", F.xxhash64("doc_id", F.lit(13)))
    # Of a language with many documents only those with a low draw can be chosen, several times as many as needed.
    low = [
        F.when((F.col("lang") == lang) & (F.col("_draw") <= _share_of_draws((4 * per_lang + 100) / n)), True)
        for lang, n in sorted(counted.items())
    ]
    order = Window.partitionBy("lang").orderBy("_draw", "doc_id")
    ids = known.filter(F.coalesce(*low, F.lit(False))) if low else known.limit(0)
    ids = ids.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= per_lang)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            found = []
            for _, _, data, _ in text_slices(batch["text"], 0):
                _, start, _ = chunks_of(np.array([len(data)]))
                picked = start[np.unique(np.linspace(0, len(start) - 1, min(chunks, len(start))).astype(np.int64))]
                found.append([data[s : s + CHUNK].tobytes() for s in picked])
            lists = pa.array(found, pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], lists], ["doc_id", "lang", "chunks"])

    # At most per_lang * most_langs ids.
    chosen = may.join(F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"])
    rows = chosen.select("doc_id", "lang", text_or_empty().alias("text")).mapInArrow(
        cut, "doc_id long, lang string, chunks array<binary>"
    ).collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang, r.chunks))
    pieces = [bytes(c) for r in rows for c in r.chunks]
    number = {lang: i for i, lang in enumerate(langs)}
    y = np.array([number[r.lang] for r in rows for _ in r.chunks], dtype=np.int64)
    return train(pieces, y, langs)


def languages(
    docs: DataFrame, per_lang: int = PER_LANG, chunks: int = CHUNKS, most_langs: int = MOST_LANGS
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, from all bytes of its whole text.

    Only the text is looked at for a prediction; ``lang`` is learned from where
    it isn't null and the document isn't held out. ``lang_pred`` is the
    language with the highest mean probability, ties going to the first by
    code point, and ``score`` that probability. A text that is null or has no
    letter is ``und`` with score 0, and so is every text if there is no
    language to learn. A null doc_id isn't held out nor learned from. Repeated
    rows are predicted alike, no rows give none, other columns are ignored.
    The sample is bounded by ``per_lang``, ``chunks`` and ``most_langs``;
    predictions take all of a text.
    """
    network = docs.sparkSession.sparkContext.broadcast(learned(docs, per_lang, chunks, most_langs))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = network.value.langs
        for batch in parts_of(batches):
            best, score = [], []
            for _, _, data, offsets in text_slices(batch["text"]):
                found = network.value.document_probabilities(data, offsets) if langs else np.zeros((len(offsets) - 1, 1))
                best.append(found.argmax(axis=1))
                score.append(found.max(axis=1))
            at = np.concatenate(best) if best else np.zeros(0, np.int64)
            named = pa.array([langs[i] for i in at] if langs else [UNDETERMINED] * len(at), pa.string())
            values = pa.array(np.concatenate(score) if score else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["letters"], named, values], names)

    names = ["doc_id", "letters", "lang_pred", "score"]
    rows = docs.select("doc_id", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), text_or_empty().alias("text"))
    found = rows.mapInArrow(predict, "doc_id long, letters boolean, lang_pred string, score double")
    return found.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.when(F.col("letters"), F.col("lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"),
    )
