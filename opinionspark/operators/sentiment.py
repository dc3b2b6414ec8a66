"""Sentiment operators. Posts in, flat frames out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import (
    FALLING,
    FLAT,
    INSUFFICIENT,
    RISING,
    known,
    percent,
    polarity,
    polarity_label,
    rnd,
    time_label,
)
from ..plans.shapes import bucketed, focus_filter, top, top_keys, whole, zero_filled
from . import timeline

_LEVELS = (1, 2, 3, 4, 5)


def _shares(level):
    total = F.count(F.lit(1))
    return {
        "count": total,
        "avg_polarity": rnd(F.avg(level.cast("double")), 2),
        "positive_ratio": percent(F.count_if(level >= 4), total),
        "negative_ratio": percent(F.count_if(level <= 2), total),
    }


def sentiment_distribution(posts: DataFrame) -> DataFrame:
    """Five fixed rows with counts and shares, plus the overall figures.

    One pass: every level is a conditional count of the same aggregate.
    """
    p = polarity()
    one = posts.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count(p).alias("valid_count"),
        F.avg(p.cast("double")).alias("mean"),
        *[F.count_if(p == v).alias(f"n{v}") for v in _LEVELS],
    )
    best = F.array_max(F.array(*[F.struct(F.col(f"n{v}").alias("n"), F.lit(-v).alias("neg")) for v in _LEVELS]))
    dominant = F.when(F.col("valid_count") > 0, -best["neg"]).otherwise(3)
    rows = F.array(*[F.struct(F.lit(v).alias("v"), F.col(f"n{v}").alias("n")) for v in _LEVELS])
    return one.withColumn("dominant", dominant).select(F.explode(rows).alias("r"), "*").select(
        F.col("r.v").alias("polarity_value"),
        polarity_label(F.col("r.v")).alias("label"),
        F.col("r.n").alias("count"),
        percent(F.col("r.n"), F.col("total_count")).alias("percentage"),
        "total_count",
        "valid_count",
        rnd(F.coalesce("mean", F.lit(3.0)), 2).alias("avg_polarity"),
        polarity_label(F.col("dominant")).alias("dominant_polarity"),
    )


def sentiment_share(posts: DataFrame) -> DataFrame:
    """The non-empty slices of the distribution."""
    return (
        sentiment_distribution(posts)
        .filter(F.col("count") > 0)
        .select("polarity_value", "label", "count", "percentage")
    )


def sentiment_time_series(posts: DataFrame, granularity: str = "hour") -> DataFrame:
    """Count, mean and positive/negative share per hour or day."""
    shares = _shares(polarity())
    grouped = bucketed(posts, granularity).groupBy("bucket").agg(*[c.alias(n) for n, c in shares.items()])
    return grouped.select(time_label("bucket", granularity).alias("time"), *shares)


def sentiment_bucket_trend(posts: DataFrame, granularity: str = "hour") -> DataFrame:
    """Posts per time and sentiment bucket, zero-filled, one column per bucket."""
    p = polarity()
    grouped = bucketed(posts, granularity).groupBy("bucket").agg(*_bucket_counts(p))
    return grouped.select(time_label("bucket", granularity).alias("time"), *_BUCKETS)


_BUCKETS = ("negative", "neutral", "positive", "unknown")


def _bucket_counts(p):
    return (
        F.count_if(p <= 2).alias("negative"),
        F.count_if(p == 3).alias("neutral"),
        F.count_if(p >= 4).alias("positive"),
        F.count_if(p.isNull()).alias("unknown"),
    )


def sentiment_focus_buckets(posts: DataFrame, window_days: int = 14) -> DataFrame:
    inside = bucketed(focus_filter(posts, posts, window_days), "day")
    return inside.groupBy("bucket").agg(*_bucket_counts(polarity())).select(
        time_label("bucket", "day").alias("time"), *_BUCKETS
    )


def sentiment_focus_daily(posts: DataFrame, window_days: int = 14) -> DataFrame:
    """Daily mean and number of rated posts inside the focus window."""
    inside = bucketed(focus_filter(posts, posts, window_days), "day")
    p = polarity()
    return (
        inside.groupBy("bucket")
        .agg(rnd(F.avg(p.cast("double")), 2).alias("avg_polarity"), F.count(p).alias("count"))
        .select(time_label("bucket", "day").alias("time"), "avg_polarity", "count")
    )


def sentiment_focus_publisher(
    posts: DataFrame, window_days: int = 14, top_n: int | None = None
) -> DataFrame:
    """Daily mean and median per publisher inside the focus window.

    ``top_n`` keeps the publishers with most posts in the window. The exact
    median counts distinct values, of which there are five.
    """
    inside = bucketed(focus_filter(posts, posts, window_days), "day").withColumn("publisher", known("publisher"))
    p = polarity()
    grouped = inside.groupBy("bucket", "publisher").agg(
        F.count(F.lit(1)).alias("_posts"),
        rnd(F.avg(p.cast("double")), 2).alias("mean"),
        rnd(F.percentile(p.cast("double"), F.lit(0.5)), 2).alias("median"),
        F.count(p).alias("count"),
    )
    if top_n is not None:
        # At most one row per window day and publisher type: small enough to rank as a whole.
        total = F.sum("_posts").over(Window.partitionBy("publisher"))
        rank = F.dense_rank().over(Window.orderBy(F.desc("_total"), "publisher"))
        grouped = grouped.withColumn("_total", total).withColumn("_rank", rank).filter(F.col("_rank") <= top_n)
    return grouped.select(time_label("bucket", "day").alias("time"), "publisher", "mean", "median", "count")


def explode_attributes(posts: DataFrame) -> DataFrame:
    """One row per sentiment attribute; null lists and entries add nothing."""
    return posts.select(
        "post_id", "publish_time", F.explode("sentiment_attribute").alias("attribute")
    ).filter(F.col("attribute").isNotNull())


def attribute_trend(posts: DataFrame, granularity: str = "hour", top_n: int = 10) -> DataFrame:
    """Counts of the most used attributes per time, zero-filled."""
    rows = bucketed(explode_attributes(posts), granularity)
    counts = rows.groupBy("bucket", "attribute").agg(F.count(F.lit(1)).alias("n"))
    keep = top_keys(counts, "attribute", top_n)
    dense = zero_filled(counts, ["bucket"], "attribute", keep, only_kept=True)
    return dense.select(time_label("bucket", granularity).alias("time"), "attribute", "n")


def attribute_turning_points(posts: DataFrame, granularity: str = "hour", limit: int = 5) -> DataFrame:
    """The biggest step of each leading attribute."""
    return timeline.attribute_changes(attribute_trend(posts, granularity, 10), limit)


def sentiment_trend_label(posts: DataFrame, granularity: str = "hour") -> DataFrame:
    """Direction from the first to the last bucket mean."""
    series = sentiment_time_series(posts, granularity)
    edge = series.agg(
        F.count(F.lit(1)).alias("points"),
        F.min(F.struct("time", "avg_polarity")).alias("f"),
        F.max(F.struct("time", "avg_polarity")).alias("l"),
    )
    first, last = F.col("f.avg_polarity"), F.col("l.avg_polarity")
    label = (
        F.when(F.col("points") < 2, INSUFFICIENT)
        .when(last > first, RISING)
        .when(last < first, FALLING)
        .otherwise(FLAT)
    )
    return edge.select(
        F.col("f.time").alias("start"), F.col("l.time").alias("end"), "points", label.alias("trend")
    )


def peak_periods(posts: DataFrame, granularity: str = "hour", k: int = 3) -> DataFrame:
    return top(sentiment_time_series(posts, granularity), k, "count", "time")


def hourly_distribution(posts: DataFrame) -> DataFrame:
    """Posts per hour of the day."""
    timed = posts.filter(F.col("publish_time").isNotNull())
    return timed.groupBy(F.hour("publish_time").alias("hour")).agg(F.count(F.lit(1)).alias("count"))


def peak_hours(posts: DataFrame, k: int = 3) -> DataFrame:
    return top(hourly_distribution(posts), k, "count", "hour")


def _min_change(granularity: str) -> float:
    return 0.05 if granularity == "hour" else 0.1


def growth_rate(posts: DataFrame, granularity: str = "hour") -> DataFrame:
    series = sentiment_time_series(posts, granularity).select("time", "count")
    return timeline.growth_rate(series)


def turning_points(posts: DataFrame, granularity: str = "hour") -> DataFrame:
    series = sentiment_time_series(posts, granularity)
    return timeline.turning_points(series, min_change=_min_change(granularity))


def volume_spikes(posts: DataFrame, granularity: str = "hour") -> DataFrame:
    return timeline.volume_spikes(sentiment_time_series(posts, granularity))


def sentiment_trend_series(posts: DataFrame, granularity: str = "hour") -> DataFrame:
    """The plotted series: means, shares, and turning point and spike flags."""
    series = timeline.with_volume_zscore(sentiment_time_series(posts, granularity))
    flagged = timeline.with_turning_points(series, min_change=_min_change(granularity))
    return flagged.select(
        "time",
        "count",
        "avg_polarity",
        "positive_ratio",
        rnd(F.lit(100.0) - F.col("positive_ratio") - F.col("negative_ratio"), 2).alias("neutral_ratio"),
        "negative_ratio",
        "is_turning_point",
        F.coalesce(F.col("_z") >= 2.0, F.lit(False)).alias("is_spike"),
    )


def sentiment_anomalies(posts: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Hours whose mean or volume is more than ``threshold`` deviations off.

    Needs three hours of data; the baseline figures are repeated on each row.
    """
    series = sentiment_time_series(posts, "hour")
    mean_p, std_p = F.avg("avg_polarity").over(whole()), F.stddev_pop("avg_polarity").over(whole())
    mean_c, std_c = F.avg("count").over(whole()), F.stddev_pop("count").over(whole())
    z_p = rnd(F.try_divide(F.abs(F.col("avg_polarity") - mean_p), std_p), 9)
    z_c = rnd(F.try_divide(F.abs(F.col("count") - mean_c), std_c), 9)
    scored = series.select(
        "time",
        "avg_polarity",
        "count",
        F.count(F.lit(1)).over(whole()).alias("_points"),
        z_p.alias("_zp"),
        z_c.alias("_zc"),
        rnd(mean_p, 2).alias("mean_polarity"),
        rnd(std_p, 2).alias("std_polarity"),
        rnd(mean_c, 2).alias("mean_count"),
        rnd(std_c, 2).alias("std_count"),
    )
    odd_p = F.coalesce(F.col("_zp") > threshold, F.lit(False))
    odd_c = F.coalesce(F.col("_zc") > threshold, F.lit(False))
    return scored.filter((F.col("_points") >= 3) & (odd_p | odd_c)).select(
        "time",
        "avg_polarity",
        "count",
        F.when(odd_p, rnd(F.col("_zp"), 1)).alias("polarity_zscore"),
        F.when(odd_c, rnd(F.col("_zc"), 1)).alias("count_zscore"),
        "mean_polarity",
        "std_polarity",
        "mean_count",
        "std_count",
    )
