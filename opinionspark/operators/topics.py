"""Topic operators.

Most take ``mentions``: one row per topic of a post, made by
``explode_topics`` from nested posts or read from a normalised table.
Counting starts from one aggregate over mentions; ranks, totals and dense
grids are derived from that small result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_words
from ..functions.values import EMERGING, FALLING, FLAT, RISING, percent, rnd, time_bucket, time_label
from ..plans.shapes import (
    by_time,
    whole,
    bucketed,
    focus_bounds,
    focus_filter,
    kept_cells,
    row_count,
    spread,
    top,
    top_keys,
    zero_filled,
)


def explode_topics(posts: DataFrame, *columns: str) -> DataFrame:
    """One row per topic entry, with its position and the asked post columns."""
    return posts.select("post_id", *columns, F.posexplode("topics").alias("position", "t")).select(
        "post_id", *columns, "position", "t.parent_topic", "t.sub_topic"
    )


def _nested(mentions: DataFrame) -> bool:
    """Whether these are posts with topic lists, not single mentions."""
    return "topics" in mentions.columns


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def _with_parent(mentions: DataFrame) -> DataFrame:
    return mentions.filter(_filled("parent_topic").isNotNull())


def _pair_counts(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy(_filled("parent_topic").alias("parent_topic"), _filled("sub_topic").alias("sub_topic")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _parent_counts(mentions: DataFrame) -> DataFrame:
    return _with_parent(mentions).groupBy("parent_topic").agg(F.count(F.lit(1)).alias("n"))


def topic_frequency(mentions: DataFrame, posts: DataFrame) -> DataFrame:
    """Mentions per parent and per sub topic, with their share of posts."""
    both = F.array(
        F.struct(F.lit("parent").alias("level"), F.col("parent_topic").alias("topic")),
        F.struct(F.lit("sub").alias("level"), F.col("sub_topic").alias("topic")),
    )
    flat = _pair_counts(mentions).select(F.inline(both), "n").filter(F.col("topic").isNotNull())
    return flat.groupBy("level", "topic").agg(F.sum("n").alias("count")).select(
        "level", "topic", "count", percent(F.col("count"), row_count(posts)).alias("percentage")
    )


def topic_pairs_top(mentions: DataFrame, posts: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent parent > sub combinations."""
    pairs = _pair_counts(mentions).filter(F.col("parent_topic").isNotNull() & F.col("sub_topic").isNotNull())
    named = pairs.select(F.concat("parent_topic", F.lit(" > "), "sub_topic").alias("topic"), F.col("n").alias("count"))
    return top(named, k, "count", "topic").select(
        "topic", "count", percent(F.col("count"), row_count(posts)).alias("percentage")
    )


def topic_coverage(mentions: DataFrame, posts: DataFrame) -> DataFrame:
    """How many posts have topics at all; ``mentions`` may be posts with their topic lists, which need no shuffle."""
    if _nested(mentions):
        covered = mentions.agg(F.count_if(F.size("topics") > 0).alias("posts_with_topics"))
    else:
        covered = mentions.agg(F.count_distinct("post_id").alias("posts_with_topics"))
    total = row_count(posts)
    return covered.withColumn("total_posts", total).withColumn(
        "percentage", percent(F.col("posts_with_topics"), F.col("total_posts"))
    )


def topic_ranking(mentions: DataFrame, posts: DataFrame, top_n: int = 10) -> DataFrame:
    counts = _parent_counts(mentions).withColumnRenamed("n", "count")
    return top(counts, top_n, "count", "parent_topic").select(
        "parent_topic", "count", percent(F.col("count"), row_count(posts)).alias("percentage")
    )


def _counts_by_time(mentions: DataFrame, granularity: str) -> DataFrame:
    """Counts per bucket and parent; mentions without a time keep a null bucket."""
    return (
        _with_parent(mentions)
        .groupBy(time_bucket("publish_time", granularity).alias("bucket"), "parent_topic")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def topic_time_evolution(mentions: DataFrame, granularity: str = "day", top_n: int = 5) -> DataFrame:
    """Counts per time of the leading parents (only times that have them)."""
    counts = _counts_by_time(mentions, granularity)
    keep = top_keys(counts, "parent_topic", top_n)
    cells = kept_cells(counts, ["bucket"], "parent_topic", keep, rows_where=F.col("bucket").isNotNull())
    return cells.select("bucket", F.explode("_cells").alias("parent_topic", "count")).select(
        time_label("bucket", granularity).alias("time"), "parent_topic", "count"
    )


def topic_evolution_dense(mentions: DataFrame, granularity: str = "day", top_n: int = 5) -> DataFrame:
    """The leading parents, zero-filled over the times that have any of them."""
    counts = _counts_by_time(mentions, granularity)
    keep = top_keys(counts, "parent_topic", top_n)
    timed = F.col("bucket").isNotNull()
    dense = zero_filled(counts, ["bucket"], "parent_topic", keep, only_kept=True, rows_where=timed)
    return dense.select(time_label("bucket", granularity).alias("time"), "parent_topic", F.col("n").alias("count"))


def topic_focus_evolution(
    mentions: DataFrame, posts: DataFrame, granularity: str = "day", top_n: int = 5
) -> DataFrame:
    """The dense evolution with a flag for times inside the focus window."""
    bounds = focus_bounds(posts)
    start = bounds.select(F.col("start").cast("string")).scalar()
    end = bounds.select(F.col("end").cast("string")).scalar()
    day = F.substring("time", 1, 10)
    return topic_evolution_dense(mentions, granularity, top_n).withColumn(
        "in_focus", (day >= start) & (day <= end)
    )


def topic_trends(mentions: DataFrame, granularity: str = "day", top_n: int = 5) -> DataFrame:
    """First against last third of the times, per leading parent."""
    counts = _counts_by_time(mentions, granularity)
    keep = top_keys(counts, "parent_topic", top_n)
    timed = F.col("bucket").isNotNull()
    rows = kept_cells(counts, ["bucket"], "parent_topic", keep, only_kept=True, rows_where=timed)
    placed = rows.withColumn("time", F.col("bucket")).select(
        "time",
        "_cells",
        F.row_number().over(by_time()).alias("at"),
        F.count(F.lit(1)).over(whole()).alias("points"),
    )
    dense = spread(placed, ["at", "points"], "parent_topic", keep)
    size_first = F.when(F.col("points") >= 3, F.floor(F.col("points") / 3)).otherwise(1)
    size_last = F.when(F.col("points") >= 3, F.ceil(F.col("points") / 3)).otherwise(1)
    sums = (
        dense.filter(F.col("points") >= 2)
        .groupBy("parent_topic")
        .agg(
            F.sum(F.when(F.col("at") <= size_first, F.col("n")).otherwise(0)).alias("s1"),
            F.sum(F.when(F.col("at") > F.col("points") - size_last, F.col("n")).otherwise(0)).alias("s2"),
            F.max(size_first).alias("k1"),
            F.max(size_last).alias("k2"),
        )
    )
    first, last = F.col("s1") / F.col("k1"), F.col("s2") / F.col("k2")
    change = F.try_divide((last - first) * 100.0, first)
    known_change = rnd(change, 9)
    trend = (
        F.when((first == 0) & (last > 0), EMERGING)
        .when(known_change > 10, RISING)
        .when(known_change < -10, FALLING)
        .otherwise(FLAT)
    )
    return sums.select(
        "parent_topic",
        rnd(first, 2).alias("first_period_avg"),
        rnd(last, 2).alias("last_period_avg"),
        F.coalesce(rnd(change, 2), F.lit(0.0)).alias("change_percentage"),
        trend.alias("trend"),
    )


def _focus_counts(mentions: DataFrame, posts: DataFrame, window_days: int) -> DataFrame:
    inside = bucketed(focus_filter(_with_parent(mentions), posts, window_days), "day")
    return inside.groupBy("bucket", "parent_topic").agg(F.count(F.lit(1)).alias("n"))


def topic_focus_trend(
    mentions: DataFrame, posts: DataFrame, window_days: int = 14, top_n: int = 5
) -> DataFrame:
    """The leading parents of each single day of the focus window."""
    counts = _focus_counts(mentions, posts, window_days)
    by_day = Window.partitionBy("bucket").orderBy(F.desc("n"), "parent_topic")
    return (
        counts.withColumn("rank", F.row_number().over(by_day))
        .filter(F.col("rank") <= top_n)
        .select(time_label("bucket", "day").alias("time"), "rank", "parent_topic", F.col("n").alias("count"))
    )


def topic_focus_distribution(
    mentions: DataFrame, posts: DataFrame, window_days: int = 14, top_n: int = 5
) -> DataFrame:
    """Daily counts of the window's leading parents, on days that have posts."""
    counts = _focus_counts(mentions, posts, window_days)
    keep = top_keys(counts, "parent_topic", top_n)
    days = bucketed(focus_filter(posts, posts, window_days), "day").select("bucket").distinct()
    return zero_filled(_with_rows(counts, days, "parent_topic"), ["bucket"], "parent_topic", keep).select(
        time_label("bucket", "day").alias("time"), "parent_topic", F.col("n").alias("count")
    )


def _with_rows(counts: DataFrame, days: DataFrame, key: str) -> DataFrame:
    """Counts plus an empty entry per day, so every day has a row in the grid."""
    return counts.unionByName(
        days.select("bucket", F.lit(None).cast("string").alias(key), F.lit(0).cast("bigint").alias("n"))
    )


def explode_words(posts: DataFrame) -> DataFrame:
    """One row per content word of a post."""
    return posts.select("post_id", "publish_time", F.explode(content_words("content")).alias("word"))


def topic_focus_keywords(posts: DataFrame, window_days: int = 14, top_n: int = 12) -> DataFrame:
    """Counts of the window's leading words on every calendar day of it."""
    inside = bucketed(explode_words(focus_filter(posts, posts, window_days)), "day")
    counts = inside.groupBy("bucket", "word").agg(F.count(F.lit(1)).alias("n"))
    keep = top_keys(counts, "word", top_n)
    days = focus_bounds(posts, window_days).select(F.explode(F.sequence("start", "end")).alias("bucket"))
    return zero_filled(_with_rows(counts, days, "word"), ["bucket"], "word", keep).select(
        time_label("bucket", "day").alias("time"), "word", F.col("n").alias("count")
    )


def topic_keyword_trend(posts: DataFrame, granularity: str = "day", top_n: int = 8) -> DataFrame:
    """Counts of the leading words over all times that have any word."""
    counts = bucketed(explode_words(posts), granularity).groupBy("bucket", "word").agg(
        F.count(F.lit(1)).alias("n")
    )
    keep = top_keys(counts, "word", top_n)
    return zero_filled(counts, ["bucket"], "word", keep).select(
        time_label("bucket", granularity).alias("time"), "word", F.col("n").alias("count")
    )


def topic_sets(mentions: DataFrame) -> DataFrame:
    """How many posts have each set of two or more parents.

    The sets come from a closed taxonomy, so both a post's set and the number
    of different sets stay small. Pairs are formed per distinct set and
    weighted by its post count, not per post. Posts with topic lists have their
    set in the row; single mentions are grouped by post first.
    """
    if _nested(mentions):
        parents = F.filter(F.transform("topics", lambda t: t["parent_topic"]), lambda p: F.nullif(p, F.lit("")).isNotNull())
        per_post = mentions.select(F.sort_array(F.array_distinct(parents)).alias("topics"))
        return per_post.filter(F.size("topics") >= 2).groupBy("topics").agg(F.count(F.lit(1)).alias("n"))
    per_post = _with_parent(mentions).groupBy("post_id").agg(F.sort_array(F.collect_set("parent_topic")).alias("topics"))
    return per_post.filter(F.size("topics") >= 2).groupBy("topics").agg(F.count(F.lit(1)).alias("n"))


def unordered_pairs(items: str) -> Column:
    """All pairs (a before b) of a sorted array, as ``array<struct<a, b>>``."""
    return F.flatten(
        F.transform(
            F.col(items),
            lambda a, i: F.transform(
                F.slice(F.col(items), i + 2, F.size(items)), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
    )


def pair_counts(mentions: DataFrame) -> DataFrame:
    pairs = topic_sets(mentions).select("n", F.inline(unordered_pairs("topics")))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))


def topic_cooccurrence(mentions: DataFrame, posts: DataFrame, min_support: int = 2, k: int = 20) -> DataFrame:
    """The most frequent parent pairs, with the number of pairs seen at all."""
    pairs = pair_counts(mentions)
    seen = row_count(pairs)
    return top(pairs.filter(F.col("count") >= min_support), k, "count", "a", "b").select(
        F.col("a").alias("topic_a"),
        F.col("b").alias("topic_b"),
        "count",
        percent(F.col("count"), row_count(posts)).alias("support"),
        seen.alias("total_pairs_analyzed"),
    )


def topic_association_matrix(mentions: DataFrame, min_support: int = 2) -> DataFrame:
    """Pair counts between all topics that occur in a supported pair."""
    pairs = pair_counts(mentions)
    supported = pairs.filter(F.col("count") >= min_support)
    ends = F.explode(F.array("a", "b")).alias("topic")
    # Bounded by the taxonomy: the topics of the supported pairs.
    keep = supported.select(ends).agg(F.sort_array(F.collect_set("topic"))).scalar()
    both = F.array(
        F.struct(F.col("a").alias("topic1"), F.col("b").alias("topic2")),
        F.struct(F.col("b").alias("topic1"), F.col("a").alias("topic2")),
    )
    directed = pairs.select(F.inline(both), "count")
    wanted = F.array_contains(keep, F.col("topic1"))
    return zero_filled(directed, ["topic1"], "topic2", keep, "count", rows_where=wanted).filter(
        F.col("topic1") != F.col("topic2")
    )


def topic_network_edges(mentions: DataFrame, min_support: int = 3, k: int = 20) -> DataFrame:
    """Edges of the topic network with their weight relative to the strongest."""
    edges = top(pair_counts(mentions).filter(F.col("count") >= min_support), k, "count", "a", "b")
    strongest = F.max("count").over(whole())
    return edges.select(
        F.col("a").alias("topic_a"),
        F.col("b").alias("topic_b"),
        "count",
        rnd(F.col("count") / strongest, 4).alias("relative_weight"),
    )


def topic_network_nodes(mentions: DataFrame, min_support: int = 3, k: int = 20) -> DataFrame:
    """Topics on the network's edges with their mention counts."""
    edges = top(pair_counts(mentions).filter(F.col("count") >= min_support), k, "count", "a", "b")
    names = edges.select(F.explode(F.array("a", "b")).alias("topic")).agg(F.collect_set("topic")).scalar()
    counts = _parent_counts(explode_topics(mentions) if _nested(mentions) else mentions)
    return counts.filter(F.array_contains(names, F.col("parent_topic"))).select(
        F.col("parent_topic").alias("topic"), F.col("n").alias("count")
    )
