"""Near-duplicate documents by consistent weighted sampling of TF-IDF shingles.

Texts are compared by the weighted Jaccard similarity of their five-word
shingles, each weighted by tf * idf. Improved consistent weighted sampling
draws from each text a sample that two texts share with a probability equal to
their similarity. Samples are put into bands. Of the texts that share a band,
those whose whole samples differ too much are parted, which leaves families of
candidates, and within families the exact similarity is verified.

Texts of a band, and of a family, are compared in tiles of bounded size. A
comparison emits no pairs but the edges of a spanning forest, at most one per
text, and skips texts that it has already connected.

The idf of a shingle is the mean idf of its words, so that a large group of
copies doesn't make its own shingles weightless. Words are counted exactly
over all documents. A word of fewer than one in 65,536 texts counts as one of so
many, so only words above that share are broadcast, and their number is bounded
by 65,536 times the mean number of words of a text, however large the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import WORD, parts_of, stored, text_or_empty
from .shingles import mixed, shingles, text_slices, word_hashes

THRESHOLD = 0.8
#: Samples of a text.
SAMPLES = 48
#: A pair at the threshold misses all bands, or has too few equal samples, with at most these probabilities.
MISSED, TOO_FEW = 1.1e-5, 1e-6
#: Words of fewer than one in so many texts have the idf of that share.
RAREST = 1 << 16
#: A tile of a band has about so many texts, a tile of a family so many bytes of text.
BAND_TILE, FAMILY_TILE = 2048, 1 << 20
#: A task's word counts go on to the shuffle when there are so many.
_MOST_COUNTS = 1 << 20
#: Shingles that are sampled together; their arrays stay in the processor's cache.
_TOGETHER = 1 << 14


def banding(threshold: float) -> tuple[int, int, int]:
    """(bands, samples of a band, least number of equal samples) that find pairs at the threshold.

    Bands are as long as they can be; 0.8 gives 16 bands of 3 samples, of which
    24 have to be equal.
    """
    if not 0.25 <= threshold <= 1:
        raise ValueError("thresholds are from 0.25 to 1")
    rows = max(r for r in range(1, 9) if r == 1 or (1 - threshold**r) ** (SAMPLES // r) <= MISSED)
    bands = next(b for b in range(1, SAMPLES // rows + 1) if b == SAMPLES // rows or (1 - threshold**rows) ** b <= MISSED)
    least, below = 0, 0.0
    while least < SAMPLES:
        below += math.comb(SAMPLES, least) * threshold**least * (1 - threshold) ** (SAMPLES - least)
        if below > TOO_FEW:
            break
        least += 1
    return bands, rows, least


class WordIdf:
    """ln((1 + texts) / (1 + texts with the word)) + 1 of words by their hashes; absent ones are in ``least`` texts."""

    def __init__(self, words: np.ndarray, n: np.ndarray, texts: int):
        order = np.argsort(words)
        self._words, self._n, self.texts = words[order], n[order].astype(np.uint32), texts
        self.least = max(1.0, texts / RAREST)
        # Hashes are uniform: their top bits lead to runs of about two words.
        self._bits = max(1, (len(words) >> 1).bit_length())
        edges = np.arange(1 << self._bits, dtype=np.uint64) << np.uint64(64 - self._bits)
        self._first = np.append(np.searchsorted(self._words, edges), len(words)).astype(np.uint32)

    def counts(self, words: np.ndarray) -> np.ndarray:
        """In how many texts each word is, ``least`` for the rarest."""
        out = np.full(len(words), self.least)
        run = (words >> np.uint64(64 - self._bits)).astype(np.int64)
        at, end, left = self._first[run].astype(np.int64), self._first[run + 1], np.arange(len(words))
        while True:
            more = np.flatnonzero(at < end)
            if not len(more):
                return out
            at, end, left = at[more], end[more], left[more]
            here = self._words[at]
            hit = here == words[left]
            out[left[hit]] = self._n[at[hit]]
            on = here < words[left]
            at, end, left = at[on] + 1, end[on], left[on]

    def __call__(self, words: np.ndarray) -> np.ndarray:
        return np.log((1 + self.texts) / (1 + self.counts(words))) + 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, n): in how many texts each word is; a null word counts texts with words."""
    texts, held, size = 0, [], 0

    def summed(held: list) -> tuple[np.ndarray, np.ndarray]:
        words, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return words, np.bincount(at, np.concatenate([h[1] for h in held])).astype(np.int64)

    def rows(words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    for batch in parts_of(batches):
        for _, _, data, offsets in text_slices(batch["text"]):
            hashes, first = word_hashes(data, offsets)
            texts += int(np.count_nonzero(np.diff(first)))
            if not len(hashes):
                continue
            words, at = np.unique(hashes, return_inverse=True)
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            seen = np.unique(row * len(words) + at) % len(words)
            held.append((words, np.bincount(seen, minlength=len(words))))
            size += len(words)
            if size > _MOST_COUNTS:
                held = [summed(held)]
                size = len(held[0][0])
                if size > _MOST_COUNTS // 2:
                    yield rows(*held[0])
                    held, size = [], 0
    if held:
        yield rows(*summed(held))
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([texts])], ["word", "n"])


def word_idf(docs: DataFrame) -> WordIdf:
    """The idf of words over all documents; the words above the rarest share, 12 bytes each, reach the driver."""
    rows = docs.select(text_or_empty().alias("text")).mapInArrow(_counts, "word long, n long")
    sums = stored(rows.groupBy("word").agg(F.sum("n").alias("n")), "words")
    texts = sums.filter("word is null").agg(F.sum("n")).first()[0] or 0
    several = sums.filter(F.col("word").isNotNull() & (F.col("n") > max(1.0, texts / RAREST)))
    found = several.select("word", F.col("n").cast("int").alias("n")).toArrow()
    words, n = (found[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("word", "n"))
    return WordIdf(words.view(np.uint64), n, texts)


class Sampler:
    """Improved consistent weighted sampling with ``samples`` independent draws.

    A draw gives each shingle a step r ~ Gamma(2, 1), a level c ~ Gamma(2, 1) and a
    shift b ~ U(0, 1), all from its hash, 16 bits each; with t = floor(ln(weight) / r + b)
    the shingle with the least ln(c) - r * (t - b + 1) is the sample. That number
    stands for shingle and t, as both follow from it but for chance.
    """

    def __init__(self, samples: int):
        # Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) * exp(-x), by interpolation.
        x = np.concatenate((np.geomspace(1e-5, 0.1, 200_000), np.linspace(0.1, 40, 400_000)[1:]))
        at = -np.expm1(-x) - x * np.exp(-x)
        gamma = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), at, x)
        self._r, self._inverse, self._level = (v.astype(np.float32) for v in (gamma, 1 / gamma, np.log(gamma)))
        self._seeds = mixed(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def draw(self, hashes: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(rows, samples): the samples of each row; rows of shingles start at ``first`` and none is empty."""
        logs, n = np.log(weights).astype(np.float32), len(hashes)
        out = np.empty((len(first), len(self._seeds)), np.float32)
        h, high, shift = np.empty(n, np.uint64), np.empty(n, np.uint64), np.empty(n, np.float32)
        bits = h.view(np.uint16).reshape(-1, 4)
        for k, seed in enumerate(self._seeds):
            np.multiply(hashes, seed, out=h)
            np.right_shift(h, np.uint64(32), out=high)
            h ^= high
            h *= np.uint64(0xD6E8FEB86659FD93)
            step = bits[:, 3].astype(np.intp)
            np.multiply(bits[:, 1], np.float32(2**-16), out=shift)
            t = self._inverse.take(step)
            t *= logs
            t += shift
            np.floor(t, out=t)
            t -= shift
            t += 1
            t *= self._r.take(step)
            level = self._level.take(bits[:, 2])
            level -= t
            out[:, k] = np.minimum.reduceat(level, first)
        return out


def _row_runs(first: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(first) - 1:
        end = max(start + 1, int(np.searchsorted(first, first[start] + most, side="right")) - 1)
        yield start, end
        start = end


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def signatures(docs: DataFrame, idf: Broadcast, bands: int, band_rows: int) -> DataFrame:
    """(doc_id, digest, bands, samples): the bands' hashes, and 16 bits of each sample; null for a text without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(SAMPLES)
        salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in parts_of(batches):
            signed = []
            for _, _, data, offsets in text_slices(batch["text"]):
                hashes, weights, first = shingles(*word_hashes(data, offsets), idf.value)
                for start, end in _row_runs(first, _TOGETHER):
                    own, at = slice(first[start], first[end]), first[start : end + 1] - first[start]
                    some = np.flatnonzero(np.diff(at))
                    keys = np.zeros((end - start, bands), np.int64)
                    samples = np.zeros((end - start, SAMPLES), np.uint16)
                    if len(some):
                        drawn = sampler.draw(hashes[own], weights[own], at[some]).view(np.uint32).astype(np.uint64)
                        samples[some] = mixed(drawn) >> np.uint64(48)
                        key = np.broadcast_to(salt, (len(some), bands)).copy()
                        for r in range(band_rows):
                            key = mixed(key ^ drawn[:, r : bands * band_rows : band_rows])
                        keys[some] = key.view(np.int64)
                    signed.append((keys, np.diff(at) > 0, samples))
            if not signed:
                continue
            keys, some, samples = (np.concatenate(x) for x in zip(*signed))
            sizes = np.concatenate(([0], np.cumsum(np.where(some, bands, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(keys[some].ravel()), mask=pa.array(~some))
            digests = pa.array([d if s else None for d, s in zip(batch["digest"].to_pylist(), some)], pa.binary())
            packed = pa.array([x.tobytes() if s else None for x, s in zip(samples, some)], pa.binary())
            names = ["doc_id", "digest", "bands", "samples"]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], digests, lists, packed], names)

    text = text_or_empty()
    rows = docs.select("doc_id", text.alias("text"), digest(text).alias("digest"))
    return rows.mapInArrow(sign, "doc_id long, digest binary, bands array<long>, samples binary")


def _spread(rows: DataFrame, key: str, size: Column, most: int) -> DataFrame:
    """``rows`` with _i and _j, once for each pair of tiles of its key that its own tile _own is in.

    A key's rows are dealt over as many tiles as its total size has ``most``,
    by a hash of rep, and every two of its tiles meet in one group.
    """
    tiles = stored(
        rows.groupBy(key).agg(F.ceil(F.sum(size) / most).cast("int").alias("_tiles"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"),
        "tiles",
    )
    own = rows.join(tiles, key).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_other")
    return own.select("*", other).select(
        *rows.columns, "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j")
    )


def _forest(ids: list[int], sides: np.ndarray, compare) -> list[tuple[int, int]]:
    """Edges that connect what ``compare`` links: (row, other rows) -> which of them are linked to the row.

    sides: 0 or 1 for each row. Rows of side 0 are compared with those of side 1,
    or with each other if there is no side 1. Rows that are connected already
    aren't compared again.
    """
    labels, edges = np.arange(len(ids)), []
    across = sides.any()
    targets = np.flatnonzero(sides == 1) if across else np.arange(len(ids))
    for p in np.flatnonzero(sides == 0):
        rest = targets if across else targets[targets > p]
        rest = rest[labels[rest] != labels[p]]
        if not len(rest):
            continue
        hit = rest[compare(p, rest)]
        if len(hit):
            joined, one = np.unique(labels[hit], return_index=True)
            edges += [(ids[p], ids[q]) for q in hit[one]]
            labels[np.isin(labels, joined)] = labels[p]
    return edges


def _edge_frame(edges: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame({"a": [min(e) for e in edges], "b": [max(e) for e in edges]}, dtype="int64")


def _alike_samples(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Edges between texts of a band of whose samples at least ``least`` agree.

    Rows come sorted by band and pair of tiles. There are many small groups, so
    they aren't handed over one by one: all rows are first compared with their
    group's first row at once, and only groups that this doesn't connect are
    looked into. The last group of a batch waits for the next.
    """
    waiting = None
    for batch in batches:
        columns = [batch[c].to_numpy() for c in ("band", "_i", "_j", "_own", "rep")]
        samples = np.frombuffer(b"".join(batch["samples"].to_pylist()), np.uint16).reshape(len(batch["rep"]), -1)
        rows = [np.concatenate(x) for x in zip(waiting, [*columns, samples])] if waiting else [*columns, samples]
        if not len(rows[0]):
            continue
        band, i, j = rows[:3]
        new = np.flatnonzero((band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        last = int(new[-1]) if len(new) else 0
        waiting = [x[last:] for x in rows]
        yield _edges_batch(_band_edges([x[:last] for x in rows], np.append(0, new[:-1]) if last else new, least))
    if waiting:
        yield _edges_batch(_band_edges(waiting, np.array([0]), least))


def _band_edges(rows: list[np.ndarray], first: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The edges of whole groups that begin at ``first``."""
    _, i, j, own, rep, samples = rows
    if not len(first):
        return []
    sizes = np.diff(np.append(first, len(rep)))
    lead = np.repeat(first, sizes)
    near = (samples == samples[lead]).sum(axis=1) >= least
    simple = np.minimum.reduceat(near & (i == j), first)
    direct = np.repeat(simple, sizes) & (lead != np.arange(len(rep)))
    edges = list(zip(rep[lead[direct]].tolist(), rep[direct].tolist()))
    for k in np.flatnonzero(~simple):
        at = slice(first[k], first[k] + sizes[k])
        mine, sides = samples[at], ((own[at] == j[at]) & (i[at] != j[at])).astype(np.int64)
        edges += _forest(rep[at].tolist(), sides, lambda p, rest: (mine[rest] == mine[p]).sum(axis=1) >= least)  # noqa: B023
    return edges


def _edges_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = [pa.array([f(e) for e in edges], pa.int64()) for f in (min, max)]
    return pa.RecordBatch.from_arrays(columns, ["a", "b"])


def _similar_texts(idf: Broadcast, threshold: float):
    """Compares texts of two tiles by their weighted Jaccard similarity."""

    def link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep")
        sides = ((group["_own"] == group["_j"]) & (group["_i"] != group["_j"])).to_numpy(np.int64)
        sets = Shingled(group["text"].tolist(), idf.value)
        return _edge_frame(_forest(group["rep"].tolist(), sides, lambda p, rest: sets.similar(p, rest, threshold)))

    return link


class Shingled:
    """The weighted shingle sets of some texts, for comparing one with many."""

    def __init__(self, texts: list[str], idf: WordIdf):
        parts = [
            shingles(*word_hashes(data, offsets), idf)
            for _, _, data, offsets in text_slices(pa.array(texts, pa.large_string()))
        ]
        hashes, self._weights = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        self._sizes = np.concatenate([np.diff(p[2]) for p in parts])
        self._first = np.concatenate(([0], np.cumsum(self._sizes)))
        values, self._ids = np.unique(hashes, return_inverse=True)
        self._one = np.zeros(len(values))
        row = np.repeat(np.arange(len(texts)), self._sizes)
        self.totals = np.bincount(row, self._weights, minlength=len(texts))
        several = np.bincount(self._ids, minlength=len(values))[self._ids] > 1
        self._common = np.bincount(row, self._weights * several, minlength=len(texts))

    def similarity(self, p: int, rest: np.ndarray) -> np.ndarray:
        own = slice(self._first[p], self._first[p + 1])
        sizes = self._sizes[rest]
        begin = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(self._first[:-1][rest] - begin, sizes)
        self._one[self._ids[own]] = self._weights[own]
        shared = np.add.reduceat(np.minimum(self._weights[at], self._one[self._ids[at]]), begin)
        self._one[self._ids[own]] = 0
        return shared / (self.totals[p] + self.totals[rest] - shared)

    def similar(self, p: int, rest: np.ndarray, threshold: float) -> np.ndarray:
        """Which of the texts ``rest`` are similar to text p; those that cannot be, by their weights, aren't compared."""
        least = threshold * (1 - 1e-9)
        out = np.zeros(len(rest), bool)
        if self._common[p] < least * self.totals[p]:
            return out
        low, high = np.minimum(self.totals[rest], self.totals[p]), np.maximum(self.totals[rest], self.totals[p])
        able = (low >= least * high) & (self._common[rest] >= least * self.totals[rest])
        if able.any():
            out[able] = self.similarity(p, rest[able]) >= threshold - 1e-9
        return out


def text_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every row, and (key, class, class_id) of every key, both stored.

    The key of a row is its text's digest; of a text without words, its id. A
    class has a number of its own, whatever the ids of its rows, and the
    smallest of their ids.
    """
    bands, band_rows, least = banding(threshold)
    idf = docs.sparkSession.sparkContext.broadcast(word_idf(docs))
    signed = stored(signatures(docs, idf, bands, band_rows), "signatures")
    key = F.coalesce("digest", F.col("doc_id").cast("string").cast("binary"), F.lit(b""))
    rows = signed.withColumn("key", key)
    grouped = rows.groupBy("key").agg(
        F.min("doc_id").alias("least_id"), F.any_value("bands").alias("bands"), F.any_value("samples").alias("samples")
    )
    texts = stored(grouped.withColumn("rep", F.monotonically_increasing_id()), "distinct")
    whole = texts.filter(F.col("bands").isNotNull())
    banded = whole.select("rep", F.explode("bands").alias("band"))
    shared = stored(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band"), "shared")
    buckets = stored(banded.join(shared, "band").join(whole.select("rep", "samples"), "rep"), "buckets")
    edge = "a long, b long"
    group = ("band", "_i", "_j")
    tiles = _spread(buckets, "band", F.lit(1), BAND_TILE).repartition(*group).sortWithinPartitions(*group)
    near = tiles.mapInArrow(lambda batches: _alike_samples(batches, least), edge)
    families = connected_components(stored(near.distinct(), "near")).select(
        F.col("node").alias("rep"), F.col("component").alias("family")
    )
    named = stored(families.join(whole.select("rep", "key", "least_id"), "rep"), "families")
    # Texts are shuffled at every size: families grow with the corpus and aren't for broadcasting. Of the rows
    # with a text one with its smallest id is taken, so a text of many rows is no hot key.
    rows_of = docs.select("doc_id", text_or_empty().alias("text")).withColumn("_key", digest(F.col("text")))
    same = (F.col("_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("least_id"))
    members = rows_of.join(named.hint("merge"), same).select("rep", "text", "family")
    members = stored(members.dropDuplicates(["rep"]), "members")
    tiled = _spread(members, "family", F.octet_length("text"), FAMILY_TILE)
    links = tiled.groupBy("family", "_i", "_j").applyInPandas(_similar_texts(idf, threshold), edge)
    classes = stored(connected_components(stored(links, "links")), "classes")
    joined = texts.join(classes, F.col("rep") == F.col("node"), "left").select(
        "key", F.coalesce("component", "rep").alias("class"), "least_id"
    )
    ids = joined.groupBy("class").agg(F.min("least_id").alias("class_id"))
    return rows.select("doc_id", "key"), stored(joined.join(ids, "class").select("key", "class", "class_id"), "named")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id): documents whose texts are linked, directly or over others, share a class.

    Two texts are linked if they are equal or their similarity is at least
    ``threshold``, which may be 0.25 to 1. The class id is the smallest doc_id
    of the class, or null if it has none. A text without words (null, empty or
    blank) is in the class of its own id. Texts of fewer than five words are
    compared as one shingle, texts of any length whole. Each row has the class of
    its own text, also where rows share a doc_id; equal rows share one. No rows
    give none, and other columns are ignored.
    """
    rows, named = text_classes(docs, threshold)
    return rows.join(named, "key").select("doc_id", "class_id")


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of ``near_duplicates``, with all columns.

    It is the row with the smallest doc_id, a null counting as the largest; of
    rows that share that id, the one whose digest over all columns is the
    smallest; of equal rows any one. Columns may have any names but ``_key``,
    ``_row`` and ``_class``. No rows give none.
    """
    _, named = text_classes(docs, threshold)
    text = text_or_empty()
    wordless = ~text.rlike(WORD)
    own = F.when(wordless, F.coalesce(F.col("doc_id").cast("string").cast("binary"), F.lit(b""))).otherwise(digest(text))
    keyed = docs.withColumns({"_key": own, "_row": F.md5(F.to_json(F.struct(*[F.col(c) for c in docs.columns])))})
    marked = keyed.select("_key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("_row"))
    joined = marked.join(named.select(F.col("key").alias("_key"), F.col("class").alias("_class")), "_key")
    counted = joined.groupBy("_class", "_key", "_row").agg(F.count(F.lit(1)).alias("n"))
    best = stored(counted.groupBy("_class").agg(F.min(F.struct("_row", "_key", "n")).alias("b")).select("_class", "b.*"), "best")

    def chosen(which: str) -> DataFrame:
        few = best.filter(which).select("_key", F.col("_row._row").alias("_row"), "_class")
        return keyed.join(few, ["_key", "_row"])

    once = chosen("n = 1").select(*docs.columns)
    # Only rows that have equals are shuffled to be told apart.
    return once.unionByName(chosen("n > 1").dropDuplicates(["_class"]).select(*docs.columns))
