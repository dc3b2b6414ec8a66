"""Exact top-k search by inner product with a KD-tree per shard.

Rows are dealt over shards of bounded size by a hash of their id. A shard's
tree splits at the median of its widest dimension and keeps tight bounding
boxes. A query walks a tree best first, by the largest inner product that a
box allows, and stops when no box can beat its k-th score. That score is first
found in the query's own shard and then propagated to all others.
"""

from __future__ import annotations

import heapq
from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Rows of a shard, of a leaf, and queries that visit a shard together.
SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES = 4096, 128, 2048
_FOUND = "query_id long, vec_id long, score long"


class Tree:
    """A KD-tree over integer vectors; ``order`` sorts rows so that a node is a range of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.arange(len(ids))
        self.children: list[tuple[int, int] | None] = []
        self.ranges: list[tuple[int, int]] = []
        low, high, first = [], [], []

        def build(start: int, end: int) -> int:
            node = len(self.ranges)
            own = vectors[order[start:end]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            first.append(ids[order[start:end]].min())
            self.ranges.append((start, end))
            self.children.append(None)
            spread = high[node] - low[node]
            if end - start > leaf and spread.max() > 0:
                half = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(own[:, spread.argmax()], half)]
                self.children[node] = (build(start, start + half), build(start + half, end))
            return node

        build(0, len(ids))
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high, self.first = np.array(low), np.array(high), np.array(first)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with any point of each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query_id: int, query: np.ndarray, bounds: list[float], k: int, worst: tuple, dot) -> list[tuple]:
        """Up to k (score, -id) above ``worst``, best last; the walk ends when no box can hold a better one."""
        best: list[tuple] = []
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < worst[0]:
                break
            if (-bound, -self.first[node]) <= worst:
                continue
            if self.children[node] is not None:
                for child in self.children[node]:
                    if bounds[child] >= worst[0]:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            start, end = self.ranges[node]
            scores = dot(self.vectors[start:end], query)
            for at in np.flatnonzero(scores >= worst[0]):
                item = (scores[at], -int(self.ids[start + at]))
                if item > worst and -item[1] != query_id:
                    insort(best, item)
                    if len(best) > k:
                        best.pop(0)
                    if len(best) == k:
                        worst = max(worst, best[0])
        return best


def _matrix(vectors: list, width: int) -> np.ndarray:
    """floor(256 * x) of every component; shorter vectors are filled with zeros."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = np.floor(256.0 * np.asarray(v, dtype=np.float64))
    return out


def _exact_dot(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of integers of any size, cut to the range of a long."""
    q, top = [int(x) for x in query], 2**63 - 1
    out = np.empty(len(vectors), dtype=object)
    out[:] = [max(-top - 1, min(top, sum(int(a) * b for a, b in zip(v, q)))) for v in vectors]
    return out


def search_shard(shard: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The up to k best rows of a shard for each query: shard (vec_id, v), queries (query_id, v, score, vec_id)."""
    if shard.empty or queries.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    width = max(shard["v"].map(len).max(), queries["v"].map(len).max(), 1)
    tree = Tree(shard["vec_id"].to_numpy(np.int64), _matrix(shard["v"].tolist(), width))
    asked = _matrix(queries["v"].tolist(), width)
    with np.errstate(over="ignore", invalid="ignore"):
        exact = np.abs(tree.vectors).max() * np.abs(asked).max() * width < 2**53
        bounds = tree.bounds(asked)
    dot = np.matmul
    if not exact:  # beyond a double's integers: every leaf is visited and Python's integers count
        dot, bounds = _exact_dot, np.full(bounds.shape, np.inf)
    rows = []
    for query_id, query, own, score, worst in zip(
        queries["query_id"].tolist(), asked, bounds.tolist(), queries["score"].tolist(), queries["worst"].tolist()
    ):
        known = (score, -int(worst)) if exact and not pd.isna(score) else (-np.inf, 0)
        rows += [(query_id, -i, int(s)) for s, i in tree.search(query_id, query, own, k, known, dot)]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"], dtype="int64")


def whole(vector: Column) -> Column:
    """Neither null nor holding a null or a component that is not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` (vec_id, embedding) with the highest inner products.

    Components are floor(256 * x). Ties go to the smaller vec_id. A row with a
    null id, or a vector that is null or holds a null or non-finite component,
    takes no part. Vectors of different length are compared over the
    components that both have. Rows that share a query's vec_id are never its
    candidates; of queries that share a vec_id the smallest vector asks.
    Scores outside a long are cut to its range. Fewer candidates give fewer
    rows, no rows give none, and other columns are ignored.
    """
    ready = vectors.filter(F.col("vec_id").isNotNull() & whole(F.col("embedding"))).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asks")
    )
    count = ready.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asks")).first()
    shards, blocks = -(-count.n // shard_rows) or 1, -(-count.asks // block_queries) or 1
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    rows = ready.select("vec_id", "v", shard.alias("shard"))
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    queries = (
        ready.filter("asks")
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
        .select(F.col("vec_id").alias("query_id"), "v", shard.alias("own"), block.alias("block"))
    )
    none = (F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("worst"))

    def search(_, found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return search_shard(found, asked, k)

    at_home = queries.select("query_id", "v", F.col("own").alias("shard"), *none)
    near = stored(
        _best(rows.groupBy("shard").cogroup(at_home.groupBy("shard")).applyInPandas(search, _FOUND), k), "near"
    )
    kth = near.filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("score"), F.col("vec_id").alias("worst"))
    everywhere = (
        queries.join(kth, "query_id", "left")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .filter(F.col("shard") != F.col("own"))
        .select("query_id", "v", "shard", "block", "score", "worst")
    )
    dealt = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    far = dealt.groupBy("shard", "block").cogroup(everywhere.groupBy("shard", "block")).applyInPandas(search, _FOUND)
    both = near.select("query_id", "vec_id", "score").unionByName(far)
    return _best(both, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The rows of the registered query.
TOP_K_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""
