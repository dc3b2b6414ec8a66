"""Ranked lexical search by the Best Position Algorithm.

Items are ranked against all documents by a sum of term impacts. Documents are
indexed by the items' terms only. The index is searched in shards of bounded
size: a shard has an impact list for each term, highest impacts first. For an
item its terms' lists are read in turn. A document that turns up is accessed
directly in all lists, which gives its score and its positions there. A list's
best position is the last one before its first unseen position, so direct
accesses move it on as well. No unseen document can score more than the sum of
the impacts at the best positions, and once that is below the k-th score the
item's search ends.

A k-th score is first found over a fixed share of the documents and then
sent to all shards, so that most of them stop early and return few rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parts_of, stored, text_or_empty
from .shingles import text_slices, word_hashes

#: Items that are searched together have about so many bytes of text, or are one longer item.
BLOCK_BYTES = 1 << 24
#: Documents and postings of a shard at most; a single document may have more postings.
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 22
#: One document in so many is searched first, for the k-th scores.
FIRST_SHARE = 32
#: Positions of a list that are read at first, and at most, before direct accesses.
STEP, MOST_STEP = 16, 1024
#: Bytes as terms have them: ASCII letters in lower case, other ASCII signs as white space.
_PLAIN = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_PLAIN[65:91] += 32


def term_hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash of each term, first term of each row) of slices of a string column without nulls."""
    for _, _, data, offsets in text_slices(column):
        yield word_hashes(_PLAIN[data], offsets)


class Items:
    """Some items' terms: ``terms`` sorted hashes, and of each item (item_id, its terms' numbers, how often each)."""

    def __init__(self, rows: list[tuple[int, str]]):
        hashed, first = zip(*term_hashes(pa.array([t or "" for _, t in rows], pa.large_string()))) if rows else ((), ())
        own = [h[f[i] : f[i + 1]] for h, f in zip(hashed, first) for i in range(len(f) - 1)]
        self.terms = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        self.ids = [item_id for item_id, _ in rows]
        self.lists = [np.unique(np.searchsorted(self.terms, h), return_counts=True) for h in own]


def forward_index(docs: DataFrame, terms) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term, stored: its terms' number, and those of ``terms`` with counts.

    terms: a broadcast sorted array of hashes; a document's are numbered by it, rising.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for batch in parts_of(batches):
            counts, sizes, found, tfs = [], [], [], []
            for hashes, first in term_hashes(batch["text"]):
                n = np.diff(first)
                at = np.searchsorted(known, hashes)
                hit = at < len(known)
                hit[hit] = known[at[hit]] == hashes[hit]
                row = np.repeat(np.arange(len(n)), n)[hit]
                key, tf = np.unique(row * max(len(known), 1) + at[hit], return_counts=True)
                counts.append(n)
                sizes.append(np.bincount(key // max(len(known), 1), minlength=len(n)))
                found.append(key % max(len(known), 1))
                tfs.append(tf)
            if not counts:
                continue
            n, size = np.concatenate(counts), np.concatenate(sizes)
            offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32))) for x in (found, tfs)
            ]
            whole = pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n.astype(np.int64)), *lists], names)
            yield whole.filter(pa.array(n > 0))

    names = ["doc_id", "n", "terms", "tfs"]
    schema = "doc_id long, n long, terms array<int>, tfs array<int>"
    rows = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(index, schema)
    return stored(rows, "forward")


def term_weights(df: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 * ln((2 * n + 2) / (2 * df + 1))), in doubles."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Shard:
    """Impact lists of some documents, and the same postings by document for direct access."""

    def __init__(self, doc_ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, corpus: tuple[int, int]):
        documents, words = corpus
        m = 100 - 25 + (25 * n * documents) // words
        doc = np.repeat(np.arange(len(n)), sizes)
        tf = tfs.astype(np.int64)
        impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        self.doc_ids, self.first = doc_ids, np.concatenate(([0], np.cumsum(sizes)))
        self.term_of, self.impact_of = terms, impact
        order = np.lexsort((-impact, terms))
        self.doc_at, self.impact_at = doc[order], impact[order]
        self.position_of = np.empty(len(order), np.int64)
        self.position_of[order] = np.arange(len(order))
        self.list_first = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self._read = np.zeros(len(order), bool)
        self._met = np.zeros(len(n), bool)
        self._times = np.zeros(len(weights), np.int64)

    def top(self, terms: np.ndarray, times: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores) of all that can be among the best k and score ``least`` or more; and how many were met.

        Which documents turn up first depends on the lists' order; that those with the k best scores, ties
        included, are among them doesn't.
        """
        begin, end = self.list_first[terms], self.list_first[terms + 1]
        some = end > begin
        terms, times, begin, end = terms[some], times[some], begin[some], end[some]
        self._times[terms] = times
        best, step = begin.copy(), STEP
        docs, scores, read, bar = [], [], [], least
        while True:
            open_ = best < end
            bound = int((times[open_] * self.impact_at[best[open_]]).sum())
            # Strictly below: a document that ties with the k-th may have a smaller id.
            if not open_.any() or bound < bar:
                break
            at = (best[open_, None] + np.arange(step)).ravel()
            at = at[at < np.repeat(end[open_], step)]
            new = self.doc_at[at]
            new = np.unique(new[~self._met[new]])
            if len(new):
                self._met[new] = True
                size = self.first[new + 1] - self.first[new]
                begin_of = np.cumsum(size) - size
                own = np.arange(int(size.sum())) + np.repeat(self.first[new] - begin_of, size)
                wanted = self._times[self.term_of[own]]
                score = np.add.reduceat(wanted * self.impact_of[own], begin_of)
                position = self.position_of[own[wanted > 0]]
                self._read[position] = True
                read.append(position)
                docs.append(new)
                scores.append(score)
                held = np.concatenate(scores)
                if len(held) >= k:
                    bar = max(least, int(np.partition(held, len(held) - k)[len(held) - k]))
            # On to each list's first unseen position.
            going = np.flatnonzero(open_)
            while len(going):
                ahead = best[going, None] + np.arange(step)
                inside = ahead < end[going, None]
                seen = self._read[np.minimum(ahead, len(self._read) - 1)] & inside
                run = np.where(seen.all(axis=1), step, seen.argmin(axis=1))
                best[going] += run
                going = going[run == step]
            step = min(2 * step, MOST_STEP)
        for x in read:
            self._read[x] = False
        for x in docs:
            self._met[x] = False
        self._times[terms] = 0
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        found, score = np.concatenate(docs), np.concatenate(scores)
        good = score >= max(bar, 1)
        return found[good], score[good], len(found)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()


def search(index: DataFrame, items, weights, corpus: tuple[int, int], least: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): of each shard the documents that can be among an item's best k, by number of item."""
    bars = index.sparkSession.sparkContext.broadcast(least)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch["terms"].offsets.to_numpy())
            total, start = np.cumsum(sizes), 0
            while start < batch.num_rows:
                before = total[start - 1] if start else 0
                end = min(int(np.searchsorted(total, before + SHARD_POSTINGS, side="right")), start + SHARD_DOCS)
                end = max(end, start + 1)
                yield batch.slice(start, end - start)
                start = end

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shards(batches):
            sizes, terms = _flat(part["terms"])
            _, tfs = _flat(part["tfs"])
            shard = Shard(
                np.arange(part.num_rows), part["n"].to_numpy(), sizes, terms, tfs, weights.value, corpus
            )
            item, row, score = [], [], []
            for i, (own, times) in enumerate(items.value.lists):
                if not len(own):
                    continue
                docs, scores, _ = shard.top(own, times, k, int(bars.value[i]))
                item.append(np.full(len(docs), i))
                row.append(docs)
                score.append(scores)
            if not item:
                continue
            columns = [np.concatenate(x).astype(np.int64) for x in (item, row, score)]
            ids = part["doc_id"].take(pa.array(columns[1]))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), ids, pa.array(columns[2])], ["item", "doc_id", "score"])

    return index.mapInArrow(look, "item long, doc_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item with their rank; rows that share an id and a score stand next to each other."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text).

    Terms are runs of ASCII letters, digits and characters outside ASCII, ASCII
    letters in lower case, told apart by 64-bit hashes. Documents and items of
    any length are read whole; null and empty ones have no terms, find nothing
    and are not counted. Equal scores are ordered by doc_id, a null last; each
    row of ``docs`` is a document and each row of ``items`` an item, also where
    they repeat. Scores are above 0. Without documents or items there are no
    rows, and other columns are ignored.

    Items are worked on in blocks of ``block_bytes`` of text: their terms go to
    the driver and to all tasks. Documents are never collected or shuffled.
    """
    spark = docs.sparkSession
    asked = stored(items.select("item_id", text_or_empty().alias("text")), "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    found = None
    for block in range(blocks):
        own = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block
        # About block_bytes of text.
        rows = sorted(((r.item_id, r.text) for r in asked.filter(own).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        part = _searched(docs, Items(rows), k)
        named = spark.createDataFrame(list(enumerate(r[0] for r in rows)), "_item long, item_id long")
        part = part.join(F.broadcast(named), F.col("item") == F.col("_item")).select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    return found


def _searched(docs: DataFrame, items: Items, k: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    index = forward_index(docs, context.broadcast(items.terms))
    total = index.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("words")).first()
    corpus = (total.documents, total.words or 1)
    df = np.zeros(len(items.terms), np.int64)
    # At most as many rows as the block has terms.
    counts = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for row in counts.collect():
        df[row.term] = row.df
    weights, shared = context.broadcast(term_weights(df, corpus[0])), context.broadcast(items)
    first = index.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FIRST_SHARE)) == 0)
    least = np.zeros(len(items.ids), np.int64)
    kth = best(search(first, shared, weights, corpus, least, k), k).filter(F.col("rank") == k)
    # At most one row per item of the block.
    for row in kth.select("item", "score").collect():
        least[row.item] = row.score
    everything = search(index, shared, weights, corpus, least, k)
    return best(everything, k).select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rows of the registered query.
SEARCH_SQL = f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM documents
), postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY doc_id),
corpus AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS words FROM sizes),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark
  ) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(c.documents) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM postings CROSS JOIN corpus c WHERE term IN (SELECT term FROM asked) GROUP BY term
), scored AS (
  SELECT a.item_id, p.doc_id, CAST(sum(a.times * w.w
    * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (100 - 25 + ((25 * s.n * c.documents) // c.words))))) AS BIGINT) AS score
  FROM asked a JOIN weights w ON w.term = a.term JOIN postings p ON p.term = a.term JOIN sizes s ON s.doc_id = p.doc_id
  CROSS JOIN corpus c GROUP BY ALL
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ordered WHERE rank <= 20
"""
