"""Belief network operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import belief_weight, let, rnd
from ..plans.shapes import whole
from .topics import unordered_pairs


def _signals():
    """``array<struct<signal, category>>`` of one post.

    A signal is a sub category, or the category itself when it has none.
    """

    def of_item(item):
        category = F.nullif(item["category"], F.lit(""))
        listed = F.size(F.coalesce(item["subcategories"], F.array().cast("array<string>"))) > 0
        subs = F.transform(
            F.filter(item["subcategories"], lambda s: F.nullif(s, F.lit("")).isNotNull()),
            lambda s: F.struct(s.alias("signal"), F.coalesce(category, s).alias("category")),
        )
        own = F.array(F.struct(category.alias("signal"), category.alias("category")))
        return F.when(listed, subs).when(category.isNotNull(), own).otherwise(F.filter(own, lambda x: F.lit(False)))

    return F.coalesce(F.flatten(F.transform("belief_signals", of_item)), F.array().cast(
        "array<struct<signal:string,category:string>>"))


def _distinct_signals():
    """The entries with each signal once; its last entry names the category."""
    return let(
        _signals(),
        lambda entries: F.transform(
            F.array_distinct(F.transform(entries, lambda e: e["signal"])),
            lambda s: F.struct(
                s.alias("signal"),
                F.element_at(F.filter(entries, lambda e: e["signal"] == s), -1)["category"].alias("category"),
            ),
        ),
    )


def belief_signals_flat(posts: DataFrame) -> DataFrame:
    """Each distinct signal of each post, with its category; no shuffle."""
    return posts.select("post_id", F.inline(_distinct_signals()))


def _weighted(posts: DataFrame) -> DataFrame:
    entries = posts.select("post_id", belief_weight().alias("w"), _distinct_signals().alias("entries"))
    return entries.filter(F.size("entries") > 0)


def _signal_sets(posts: DataFrame) -> DataFrame:
    """Total weight per distinct set of signals; pairs are formed per set."""
    return (
        _weighted(posts)
        .groupBy(F.sort_array(F.transform("entries", lambda e: e["signal"])).alias("signals"))
        .agg(F.sum("w").alias("w"))
    )


def belief_edges(posts: DataFrame) -> DataFrame:
    """Weighted edges: a loop for a lone signal, else every pair of a post."""
    sets = _signal_sets(posts)
    lone = F.array(F.struct(F.col("signals")[0].alias("a"), F.col("signals")[0].alias("b")))
    pairs = F.when(F.size("signals") == 1, lone).otherwise(unordered_pairs("signals"))
    return (
        sets.select("w", F.inline(pairs))
        .groupBy(F.col("a").alias("source"), F.col("b").alias("target"))
        .agg(rnd(F.sum("w"), 6).alias("weight"))
        .withColumn("type", F.when(F.col("source") == F.col("target"), "Loop").otherwise("Regular"))
    )


def belief_nodes(posts: DataFrame) -> DataFrame:
    """Every signal with its co-occurrence weight, (k-1)·w for a post of k signals."""
    share = F.col("w") * (F.size("entries") - 1)
    rows = _weighted(posts).select("post_id", share.alias("share"), F.inline("entries"))
    return rows.groupBy("signal").agg(
        F.min_by("category", "post_id").alias("category"), rnd(F.sum("share"), 6).alias("co_occurrence_weight")
    )


def belief_network_nodes(posts: DataFrame) -> DataFrame:
    """Nodes with loop weight, total weight and the drawn inner ratio."""
    loops = belief_edges(posts).filter(F.col("type") == "Loop").select(
        F.col("source").alias("signal"), F.col("weight").alias("self_weight")
    )
    joined = belief_nodes(posts).join(loops, "signal", "left").withColumn(
        "self_weight", F.coalesce("self_weight", F.lit(0.0))
    )
    total = F.col("co_occurrence_weight") + F.col("self_weight")
    ratio = F.when(total > 0, F.sqrt(F.col("self_weight") / total)).otherwise(0.0)
    return joined.select(
        "signal", "category", "co_occurrence_weight", "self_weight", rnd(total, 6).alias("total_weight"),
        rnd(ratio, 4).alias("inner_ratio"),
    )


def belief_network_edges(posts: DataFrame) -> DataFrame:
    """Regular edges with a strength class 1..5 by quintiles of the weights."""
    # Edges join two signals of a closed list, so all of them fit one window.
    regular = belief_edges(posts).filter(F.col("type") == "Regular")
    cuts = F.percentile("weight", F.array(*[F.lit(q) for q in (0.2, 0.4, 0.6, 0.8)])).over(whole())
    classed = regular.withColumn("cuts", F.transform(cuts, lambda c: rnd(c, 6)))
    level = F.lit(5)
    for i in (3, 2, 1, 0):
        level = F.when(F.col("weight") <= F.col("cuts")[i], i + 1).otherwise(level)
    return classed.select("source", "target", "weight", level.alias("strength"))
