"""Geographic operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import (
    MOSTLY_NEGATIVE,
    MOSTLY_POSITIVE,
    NEUTRAL,
    UNKNOWN,
    percent,
    place,
    polarity,
    rnd,
    time_label,
)
from ..plans.shapes import bucketed, row_count, top, top_keys, zero_filled


def _located(posts: DataFrame) -> DataFrame:
    return posts.withColumn("location", place()).filter(F.col("location").isNotNull())


def _location_counts(posts: DataFrame) -> DataFrame:
    return _located(posts).groupBy("location").agg(F.count(F.lit(1)).alias("count"))


def geo_distribution(posts: DataFrame, total: Column | None = None) -> DataFrame:
    """Count and share of all posts per location.

    The total is a row count, which a Parquet table answers from its footers;
    pass ``total`` when ``posts`` is a costly view.
    """
    whole = row_count(posts) if total is None else total
    return _location_counts(posts).withColumn("percentage", percent(F.col("count"), whole))


def geo_coverage(posts: DataFrame) -> DataFrame:
    """How many posts have a location, and how many locations there are."""
    counts = posts.groupBy(place().alias("location")).agg(F.count(F.lit(1)).alias("count"))
    named = F.col("location").isNotNull()
    return counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_posts"),
        F.coalesce(F.sum(F.when(named, F.col("count"))), F.lit(0)).alias("posts_with_location"),
        F.count("location").alias("unique_locations"),
    ).select(
        "*", percent(F.col("posts_with_location"), F.col("total_posts")).alias("coverage_percentage")
    )


def geo_top(posts: DataFrame, k: int = 10, total: Column | None = None) -> DataFrame:
    return top(geo_distribution(posts, total), k, "count", "location")


def geo_hotspots(posts: DataFrame, threshold_percentile: float = 90, total: Column | None = None) -> DataFrame:
    """Locations at or above a percentile of the location counts."""
    counts = _location_counts(posts)
    threshold = counts.agg(F.percentile("count", F.lit(threshold_percentile / 100.0))).scalar()
    hot_total = counts.filter(F.col("count") >= threshold).agg(F.sum("count")).scalar()
    all_total = counts.agg(F.sum("count")).scalar()
    return geo_distribution(posts, total).filter(F.col("count") >= threshold).select(
        "location",
        "count",
        "percentage",
        rnd(threshold, 2).alias("threshold"),
        percent(hot_total, all_total).alias("hotspot_concentration"),
    )


def _rated(posts: DataFrame, min_posts: int) -> DataFrame:
    p = polarity()
    return (
        posts.select(place().alias("location"), p.alias("p"))
        .filter(F.col("location").isNotNull() & F.col("p").isNotNull())
        .groupBy("location")
        .agg(
            F.count("p").alias("post_count"),
            F.avg(F.col("p").cast("double")).alias("mean"),
            percent(F.count_if(F.col("p") >= 4), F.count("p")).alias("positive_ratio"),
            percent(F.count_if(F.col("p") <= 2), F.count("p")).alias("negative_ratio"),
        )
        .filter(F.col("post_count") >= min_posts)
    )


def geo_sentiment(posts: DataFrame, min_posts: int = 5) -> DataFrame:
    """Sentiment per location with enough rated posts; flags the extremes.

    Of equal means the one with the smaller name is the most positive, and
    the one with the greater name the most negative.
    """
    rated = _rated(posts, min_posts)
    mean = rnd(F.col("mean"), 9)
    label = F.when(mean >= 3.5, MOSTLY_POSITIVE).when(mean <= 2.5, MOSTLY_NEGATIVE).otherwise(NEUTRAL)
    shown = rated.select(
        "location", "post_count", rnd(F.col("mean"), 2).alias("avg_polarity"), "positive_ratio", "negative_ratio",
        label.alias("sentiment_label"),
    )
    # Highest mean, then smallest name; lowest mean, then greatest name.
    best = shown.agg(F.min(F.struct((-F.col("avg_polarity")).alias("neg"), "location"))["location"]).scalar()
    worst = shown.agg(F.max(F.struct((-F.col("avg_polarity")).alias("neg"), "location"))["location"]).scalar()
    return shown.withColumns(
        {"most_positive": F.col("location") == best, "most_negative": F.col("location") == worst}
    )


_METRICS = ("avg_polarity", "positive_ratio", "negative_ratio", "post_count")


def geo_metric_matrix(posts: DataFrame, k: int = 15, min_posts: int = 5) -> DataFrame:
    """The biggest locations × four metrics, scaled to 0..1 per metric.

    A metric that is the same everywhere is 0.5; one location gives nothing.
    """
    rated = _rated(posts, min_posts).withColumn("avg_polarity", rnd(F.col("mean"), 2))
    best = top(rated, k, "post_count", "location")
    cells = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in _METRICS]
    )
    by_metric = Window.partitionBy("metric")
    low, high = F.min("value").over(by_metric), F.max("value").over(by_metric)
    scaled = F.when(high > low, (F.col("value") - low) / (high - low)).otherwise(0.5)
    return (
        best.select("location", F.inline(cells))
        .select("location", "metric", "value", rnd(scaled, 4).alias("scaled"), F.count(F.lit(1)).over(by_metric).alias("_n"))
        .filter(F.col("_n") >= 2)
        .drop("_n")
    )


def geo_ranking(
    posts: DataFrame, top_n: int = 15, min_posts: int = 5, total: Column | None = None
) -> DataFrame:
    """The biggest locations with their sentiment class (unknown when too few)."""
    p = polarity()
    # Counts and means come from one aggregate, so no join is needed.
    whole = row_count(posts) if total is None else total
    grouped = _located(posts).groupBy("location").agg(
        F.count(F.lit(1)).alias("count"), F.count(p).alias("rated"), F.avg(p.cast("double")).alias("mean")
    )
    shown = rnd(F.col("mean"), 2)
    label = (
        F.when(F.col("rated") < min_posts, UNKNOWN)
        .when(shown >= 3.5, MOSTLY_POSITIVE)
        .when(shown <= 2.5, MOSTLY_NEGATIVE)
        .otherwise(NEUTRAL)
    )
    return top(grouped, top_n, "count", "location").select(
        "location", "count", percent(F.col("count"), whole).alias("percentage"), label.alias("sentiment_label")
    )


def geo_sentiment_compare(posts: DataFrame, top_n: int = 12, min_posts: int = 5) -> DataFrame:
    rated = top(_rated(posts, min_posts), top_n, "post_count", "location")
    return rated.select(
        "location", "post_count", "positive_ratio", "negative_ratio", rnd(F.col("mean"), 2).alias("avg_polarity")
    )


def geo_topic_matrix(mentions: DataFrame, top_regions: int = 10, top_topics: int = 8) -> DataFrame:
    """Leading locations × leading topics within them, zero-filled."""
    named = F.nullif(F.col("parent_topic"), F.lit("")).isNotNull() & place().isNotNull()
    counts = mentions.filter(named).groupBy(place().alias("location"), "parent_topic").agg(
        F.count(F.lit(1)).alias("n")
    )
    wanted = F.array_contains(top_keys(counts, "location", top_regions), F.col("location"))
    topics = top_keys(counts, "parent_topic", top_topics, F.when(wanted, F.col("n")))
    return zero_filled(counts, ["location"], "parent_topic", topics, rows_where=wanted).withColumnRenamed("n", "count")


def geo_time_matrix(posts: DataFrame, granularity: str = "day", top_regions: int = 8) -> DataFrame:
    """Leading locations × all times, zero-filled. An empty location counts as one."""
    counts = (
        bucketed(posts.filter(F.col("location").isNotNull()), granularity)
        .groupBy("bucket", "location")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    regions = top_keys(counts, "location", top_regions)
    return zero_filled(counts, ["bucket"], "location", regions).select(
        "location", time_label("bucket", granularity).alias("time"), F.col("n").alias("count")
    )
