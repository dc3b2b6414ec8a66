"""Data profiling and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import engagement, rnd
from ..plans.shapes import top
from ..sources.schema import ENRICHED_FIELDS


def _present(posts: DataFrame, name: str) -> Column:
    return F.col(name).isNotNull() if name in posts.columns else F.lit(False)


def overview_totals(posts: DataFrame) -> DataFrame:
    """Totals and means of a post table in one aggregate."""
    processed = F.lit(False)
    for name in ENRICHED_FIELDS:
        processed = processed | _present(posts, name)
    images = F.when(F.col("image_urls").isNotNull(), F.size("image_urls")).otherwise(0)

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    return posts.agg(
        F.count(F.lit(1)).alias("total_posts"),
        F.count_if(processed).alias("processed_posts"),
        total("repost_count").alias("total_reposts"),
        total("comment_count").alias("total_comments"),
        total("like_count").alias("total_likes"),
        rnd(F.avg("repost_count"), 6).alias("avg_reposts"),
        rnd(F.avg("comment_count"), 6).alias("avg_comments"),
        rnd(F.avg("like_count"), 6).alias("avg_likes"),
        F.count_distinct(F.nullif(F.col("user_id"), F.lit(""))).alias("unique_users"),
        F.coalesce(F.sum(images), F.lit(0)).alias("total_images"),
        F.count_if(images > 0).alias("posts_with_images"),
        rnd(F.avg(F.coalesce(F.length("content"), F.lit(0))), 6).alias("avg_content_length"),
    )


def overview_empty_fields(posts: DataFrame) -> DataFrame:
    """Posts without each enriched field; empty belief lists count as missing."""
    beliefs = F.coalesce(F.size("belief_signals"), F.lit(0)) if "belief_signals" in posts.columns else F.lit(0)
    return posts.agg(
        F.count_if(~_present(posts, "sentiment_polarity")).alias("sentiment_polarity_empty"),
        F.count_if(~_present(posts, "sentiment_attribute")).alias("sentiment_attribute_empty"),
        F.count_if(~_present(posts, "topics")).alias("topics_empty"),
        F.count_if(~_present(posts, "publisher")).alias("publisher_empty"),
        F.count_if(beliefs <= 0).alias("belief_system_empty"),
        F.count_if(~_present(posts, "publisher_decision")).alias("publisher_decision_empty"),
    )


def overview_top_users(posts: DataFrame, k: int = 10) -> DataFrame:
    """Users by total engagement; the name is that of the user's first post."""
    users = (
        posts.filter(F.nullif(F.col("user_id"), F.lit("")).isNotNull())
        .groupBy("user_id")
        .agg(F.min_by("username", "post_id").alias("username"), F.sum(engagement()).alias("total_engagement"))
    )
    return top(users, k, "total_engagement", "user_id")


def overview_hours(posts: DataFrame) -> DataFrame:
    """Posts per hour of the day as ``HH:00``."""
    hour = F.hour("publish_time")
    grouped = posts.filter(F.col("publish_time").isNotNull()).groupBy(hour.alias("h")).agg(
        F.count(F.lit(1)).alias("count")
    )
    return grouped.select(F.concat(F.lpad(F.col("h").cast("string"), 2, "0"), F.lit(":00")).alias("hour"), "count")


def _value_counts(posts: DataFrame, name: str) -> DataFrame:
    return posts.filter(F.nullif(F.col(name), F.lit("")).isNotNull()).groupBy(name).agg(
        F.count(F.lit(1)).alias("count")
    )


def overview_geo(posts: DataFrame) -> DataFrame:
    return _value_counts(posts, "location")


def overview_publishers(posts: DataFrame) -> DataFrame:
    return _value_counts(posts, "publisher")


def data_summary(posts: DataFrame) -> DataFrame:
    """Post count, time range and interaction totals."""
    span = F.timestamp_diff("SECOND", F.min("publish_time"), F.max("publish_time")) / 3600.0
    return posts.agg(
        F.count(F.lit(1)).alias("total_posts"),
        F.min("publish_time").cast("string").alias("start"),
        F.max("publish_time").cast("string").alias("end"),
        rnd(span, 1).alias("span_hours"),
        F.sum("repost_count").alias("total_reposts"),
        F.sum("comment_count").alias("total_comments"),
        F.sum("like_count").alias("total_likes"),
    )


def data_summary_counts(posts: DataFrame, mentions: DataFrame, k: int = 10) -> DataFrame:
    """Counts per polarity and publisher, and of the top topics and locations.

    The three post dimensions are counted in one pass over the posts.
    """
    dims = F.array(
        F.struct(F.lit("sentiment").alias("dimension"), F.col("sentiment_polarity").cast("string").alias("value")),
        F.struct(F.lit("publisher").alias("dimension"), F.col("publisher").alias("value")),
        F.struct(F.lit("location").alias("dimension"), F.col("location").alias("value")),
    )
    flat = posts.select(F.inline(dims)).unionByName(
        mentions.select(F.lit("topic").alias("dimension"), F.col("parent_topic").alias("value"))
    )
    counts = (
        flat.filter(F.nullif(F.col("value"), F.lit("")).isNotNull())
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # Polarity and publisher are listed whole: each value is its own group of one.
    own = F.when(F.col("dimension").isin("sentiment", "publisher"), F.col("value"))
    rank = F.row_number().over(Window.partitionBy("dimension", own).orderBy(F.desc("count"), "value"))
    return counts.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def _draw(seed: int) -> Column:
    """A reproducible pseudo-random order of posts that any engine can repeat."""
    key = F.col("post_id").cast("string")
    return F.md5(key if seed == 0 else F.concat(key, F.lit(f"#{seed}")))


def sample_posts(posts: DataFrame, sample_size: int = 10, strategy: str = "random", seed: int = 0) -> DataFrame:
    """A sample: ``random``, ``influential`` (most engagement) or ``diverse``.

    Diverse takes an equal number per polarity (a missing one counts as
    neutral) and tops up at random. All three are top-k selections: tasks
    keep their best few rows before anything is moved.
    """
    if strategy == "influential":
        return posts.orderBy(F.desc(engagement()), "post_id").limit(sample_size)
    if strategy != "diverse":
        return posts.orderBy(_draw(seed), "post_id").limit(sample_size)
    per_level = max(1, sample_size // 5)
    level = F.coalesce("sentiment_polarity", F.lit(3))
    place = F.row_number().over(Window.partitionBy("_level").orderBy("_draw", "post_id"))
    ranked = (
        posts.withColumns({"_level": level, "_draw": _draw(seed)})
        .withColumn("_place", place)
        .filter(F.col("_place") <= per_level + sample_size)
    )
    chosen = F.col("_place") <= per_level
    return (
        ranked.orderBy(
            F.when(chosen, 0).otherwise(1), F.when(chosen, F.col("_level")), "_draw", "post_id"
        )
        .limit(sample_size)
        .drop("_level", "_draw", "_place")
    )


def sample_for_report(posts: DataFrame, k: int = 10, seed: int = 0) -> DataFrame:
    return sample_posts(posts, k, "random", seed)
