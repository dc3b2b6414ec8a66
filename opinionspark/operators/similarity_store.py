"""Groups of similar texts that grow batch by batch.

The store keeps, for every batch, its posts and its distinct texts as sets of
token hashes; and the groups of all texts so far. A batch's texts meet each
other and the stored sets, block by block (see ``tiles``). Similarity is the
Jaccard measure of the token sets, which no later text changes, so batches give
the groups that one run over all posts gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.checkpoints import checkpoint
from ..sources.snapshots import snapshot_versions, version_folder, write_version
from . import tiles
from .components import connected_components
from .similarity import _numbered

_TILE = 1000  # texts of a block that are compared at once
TEXTS = "rep long, text_key string, tokens array<long>, size int"
POSTS = "post_id long, rep long"
GROUPS = "rep long, component long"
SETTINGS = "threshold double"


class SimilarityStore:
    """A folder with the groups of all posts that were added; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.85, tokenizer: T.Tokenizer = T.word_tokens):
        if not 0 < threshold <= 1:
            raise ValueError("thresholds are above 0 and at most 1")
        self._spark, self.path, self.threshold, self._tokenizer = spark, path.rstrip("/"), float(threshold), tokenizer

    def _folders(self) -> list[str]:
        return [version_folder(self._spark, self.path, v) for v in snapshot_versions(self._spark, self.path)]

    def _all(self, folders: list[str], name: str, schema: str) -> DataFrame:
        """A table of all batches."""
        if not folders:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).parquet(*[f"{f}/{name}" for f in folders])

    def _token_sets(self, posts: DataFrame) -> DataFrame:
        """(post_id, text_key, tokens): the sorted distinct token hashes; the key is null without tokens."""
        tokens = posts.select("post_id", T.tokenize("content", self._tokenizer).alias("t"))
        sets = tokens.select("post_id", F.sort_array(F.array_distinct(F.transform("t", lambda t: F.xxhash64(t)))).alias("tokens"))
        key = F.when(F.size("tokens") > 0, F.sha2(F.concat_ws(",", F.transform("tokens", lambda t: t.cast("string"))), 256))
        return sets.select("post_id", key.alias("text_key"), "tokens")

    def add(self, posts: DataFrame) -> int:
        """Adds posts (post_id, content) and joins or merges groups; returns the store's new version.

        Posts whose id is stored already are left out, so a batch may be added
        again. The store changes at once when all is written.
        """
        folders = self._folders()
        known = self._all(folders[:1], "settings", SETTINGS).first()
        if known is not None and known.threshold != self.threshold:
            raise ValueError(f"the store's threshold is {known.threshold}")
        spark = self._spark

        def write(target: str) -> None:
            def kept(rows: DataFrame, name: str, schema: str) -> DataFrame:
                rows.select(*[c.split()[0] for c in schema.split(", ")]).write.parquet(f"{target}/{name}")
                return spark.read.schema(schema).parquet(f"{target}/{name}")

            fresh = posts.join(self._all(folders, "posts", POSTS).select("post_id"), "post_id", "left_anti")
            own = checkpoint(self._token_sets(fresh.dropDuplicates(["post_id"])))
            old_texts = self._all(folders, "texts", TEXTS)
            met = own.filter(F.col("text_key").isNotNull()).groupBy("text_key").agg(
                F.min("post_id").alias("rep"), F.first("tokens").alias("tokens")
            )
            new = met.join(old_texts.select("text_key"), "text_key", "left_anti")
            texts = kept(new.withColumn("size", F.size("tokens")), "texts", TEXTS)
            keys = old_texts.select("text_key", "rep").unionByName(texts.select("text_key", "rep"))
            kept(own.select("post_id", "text_key").join(keys, "text_key", "left"), "posts", POSTS)
            kept(spark.createDataFrame([(self.threshold,)], SETTINGS), "settings", SETTINGS)
            own_blocks = self._blocks(texts, linking=_TILE)
            linked = self._met(own_blocks, None)
            if folders:
                linked = linked.unionByName(self._met(own_blocks, self._blocks(old_texts)))
            groups = self._all(folders[-1:], "groups", GROUPS).unionByName(texts.select("rep", F.col("rep").alias("component")))
            kept(self._merged(groups, checkpoint(linked)), "groups", GROUPS)

        return write_version(spark, self.path, write)

    def _blocks(self, texts: DataFrame, linking: int = 0) -> DataFrame:
        """The texts' token sets in blocks."""
        tokens = texts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        return tiles.set_blocks(texts, tokens, self.threshold, linking)

    def _met(self, first: DataFrame, second: DataFrame | None) -> DataFrame:
        """Pairs (a, b) that connect the similar texts of the blocks."""
        return tiles.meet(first, second, "jaccard", self.threshold, _TILE, links=True).select("a", "b")

    @staticmethod
    def _merged(groups: DataFrame, edges: DataFrame) -> DataFrame:
        """Groups (rep, component) after edges between their texts; a component is named by its smallest one."""
        named = groups.select(F.col("rep").alias("a"), F.col("component").alias("group_a"))
        ends = edges.join(named, "a").join(named.withColumnsRenamed({"a": "b", "group_a": "group_b"}), "b")
        moved = connected_components(ends.select("group_a", "group_b"), "group_a", "group_b").select(
            "node", F.col("component").alias("to")
        )
        joined = groups.join(moved, F.col("component") == F.col("node"), "left")
        return joined.select("rep", F.coalesce("to", "component").alias("component"))

    def groups(self, min_cluster_size: int = 2) -> DataFrame:
        """(post_id, text_similarity_group) of all posts, numbered as ``text_clusters`` does over all of them."""
        folders = self._folders()
        posts = self._all(folders, "posts", POSTS).join(self._all(folders[-1:], "groups", GROUPS), "rep", "left")
        leaders = posts.filter(F.col("component").isNotNull()).groupBy("component").agg(
            F.min("post_id").alias("leader"), F.count(F.lit(1)).alias("size")
        )
        placed = posts.join(leaders, "component", "left").select(
            "post_id", F.coalesce("leader", "post_id").alias("leader"), F.coalesce("size", F.lit(1)).alias("size")
        )
        numbered = _numbered(placed.filter(F.col("leader") == F.col("post_id")).select("leader"), "leader")
        total = posts.agg(F.count(F.lit(1)).alias("n"), F.count("component").alias("with_tokens")).first()
        wanted = (F.col("size") >= min_cluster_size) & F.lit(total.with_tokens > 0)
        group = F.lit(0) if total.n == 1 else F.when(wanted, F.col("number")).otherwise(-1)
        return placed.join(numbered, "leader").select("post_id", group.cast("bigint").alias("text_similarity_group"))
