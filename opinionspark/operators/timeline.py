"""Trend primitives over time series frames (one row per hour or day)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import rnd
from ..plans.shapes import by_time, focus_bounds, whole


def focus_window(posts: DataFrame, window_days: int = 14) -> DataFrame:
    """Start and end day of the busiest window, with its post count."""
    return focus_bounds(posts, window_days).select(
        F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "posts"
    )


def growth_rate(series: DataFrame) -> DataFrame:
    """Relative change of the count against the previous bucket present."""
    previous = F.lag("count").over(by_time())
    change = F.try_divide((F.col("count") - previous).cast("double"), previous.cast("double"))
    return series.withColumn("growth_rate_vs_prev", rnd(change, 2))


def with_turning_points(
    series: DataFrame, field: str = "avg_polarity", min_change: float = 0.1, window: int = 3
) -> DataFrame:
    """The series with a turning point flag, and the slopes around each point.

    A turning point is where the smoothed series changes direction by at
    least ``min_change``. Series with fewer than three points have none.
    """
    smooth = F.avg(field).over(by_time().rowsBetween(-(window - 1), 0))
    curr = rnd(F.col("_smooth") - F.lag("_smooth").over(by_time()), 9)
    sloped = (
        series.withColumn("_smooth", smooth)
        .withColumn("_curr", curr)
        .withColumn("_prev", F.lag("_curr").over(by_time()))
        .withColumn("_bend", F.col("_curr") - F.col("_prev"))
    )
    turns = (F.signum("_prev") != F.signum("_curr")) & (rnd(F.abs("_bend"), 9) >= min_change)
    return sloped.withColumn("is_turning_point", F.coalesce(turns, F.lit(False)))


def turning_points(
    series: DataFrame, field: str = "avg_polarity", min_change: float = 0.1, window: int = 3
) -> DataFrame:
    """The turning points with their direction and change of slope."""
    return with_turning_points(series, field, min_change, window).filter("is_turning_point").select(
        "time",
        rnd(F.col(field), 2).alias(field),
        F.when(F.col("_prev") > 0, "up_to_down").otherwise("down_to_up").alias("direction"),
        rnd(F.col("_bend"), 3).alias("delta"),
    )


def with_volume_zscore(series: DataFrame) -> DataFrame:
    """The series with each count's distance from the mean in deviations."""
    mean, std = F.avg("count").over(whole()), F.stddev_pop("count").over(whole())
    return series.withColumn("_z", rnd(F.try_divide(F.col("count") - mean, std), 9))


def volume_spikes(series: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Buckets whose count lies at least ``threshold`` deviations above the mean."""
    return (
        with_volume_zscore(series.select("time", "count"))
        .filter(F.col("_z") >= threshold)
        .select("time", "count", rnd(F.col("_z"), 2).alias("zscore"))
    )


def attribute_changes(dense: DataFrame, limit: int = 5) -> DataFrame:
    """Per attribute the largest step of its dense series; the biggest few."""
    per_attribute = Window.partitionBy("attribute").orderBy("time")
    step = (F.col("n") - F.lag("n").over(per_attribute)).alias("change")
    steps = dense.select("attribute", "time", step).filter(F.col("change").isNotNull())
    # Largest |change| first, then the earliest time: both in one aggregate.
    peak = F.min(F.struct((-F.abs("change")).alias("size"), "time", "change"))
    return (
        steps.groupBy("attribute")
        .agg(peak.alias("p"))
        .filter(F.col("p.size") <= -1)
        .orderBy("p.size", "attribute")
        .limit(limit)
        .select("attribute", F.col("p.time").alias("time"), F.col("p.change").alias("change"))
    )
