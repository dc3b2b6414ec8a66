"""Windowed series over post streams with bounded state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.values import percent, polarity, rnd


def _timed(posts: DataFrame, late: str) -> DataFrame:
    """Posts with an event time and a watermark; watermarks need zoned times."""
    return posts.withColumn("event_time", F.col("publish_time").cast("timestamp")).withWatermark("event_time", late)


#: Nothing of a finished input is late, in whatever order its files come: its windows stay open until its end.
UNTIL_END = "3000 years"


def needed_lateness(stored: DataFrame) -> str:
    """The least lateness with which a stream over the stored files loses no post, however few files a batch takes.

    ``stored`` has publish_time and of each post its file_path and
    file_modification_time; a file stream reads the oldest files first. A post is
    as late as the latest one in an earlier file is ahead of it, so windows close
    as soon as the files' order allows, and state is bounded by how far files
    overlap in time. One row per file is ordered as a whole.
    """
    files = stored.groupBy("file_modification_time", "file_path").agg(
        F.min("publish_time").alias("first"), F.max("publish_time").alias("last")
    )
    earlier = Window.orderBy("file_modification_time", "file_path").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.timestamp_diff("SECOND", F.col("first"), F.max("last").over(earlier))
    most = files.select(ahead.alias("ahead")).agg(F.max("ahead")).first()[0]
    return f"{max(0, most or 0) + 1} seconds"


def _marker(posts: DataFrame, time: str = "9000-01-01 00:00:00") -> DataFrame:
    return posts.sparkSession.range(1).select(
        *[F.lit(time if f.name == "publish_time" else None).cast(f.dataType).alias(f.name) for f in posts.schema.fields]
    )


def ended(posts: DataFrame, path: str) -> DataFrame:
    """A stream of posts and of the still empty folder ``path``, into which ``mark_end`` puts the end of the input."""
    _marker(posts).limit(0).write.parquet(path)
    return posts.unionByName(posts.sparkSession.readStream.schema(posts.schema).parquet(path))


def mark_end(posts: DataFrame, path: str) -> None:
    """Closes the last windows of a stream made by ``ended``, once all posts are read and it is run again.

    A post far in the future moves the watermark past all windows, and posts
    read after it are late; so the stream first has to run to the end of its
    posts. The marker's own window never closes, so nothing of it is ever shown.
    """
    _marker(posts).write.mode("append").parquet(path)


def run_to_end(
    posts: DataFrame, series: Callable[[DataFrame], DataFrame], path: str, progress: list | None = None
) -> StructType:
    """All windows of a finished input, written below ``path``/out; gives their schema.

    The stream runs to the end of the posts, gets the marker and runs on from
    the same checkpoint. The batches' progress is added to ``progress``.
    """
    stream = series(ended(posts, f"{path}/end"))

    def run() -> None:
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{path}/out")
            .option("checkpointLocation", f"{path}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        if progress is not None:
            progress.extend(query.recentProgress)

    run()
    mark_end(posts, f"{path}/end")
    run()
    return stream.schema


def sentiment_series_stream(posts: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count, mean and shares per window. A window closes once it is ``late`` old."""
    p = polarity()
    total = F.count(F.lit(1))
    grouped = _timed(posts, late).groupBy(F.window("event_time", every)).agg(
        total.alias("count"),
        rnd(F.avg(p.cast("double")), 2).alias("avg_polarity"),
        percent(F.count_if(p >= 4), total).alias("positive_ratio"),
        percent(F.count_if(p <= 2), total).alias("negative_ratio"),
    )
    time = F.date_format("window.start", "yyyy-MM-dd HH:mm")
    return grouped.select(time.alias("time"), "count", "avg_polarity", "positive_ratio", "negative_ratio")


def participants_stream(posts: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Exact number of different users per window.

    A user is kept once per open window, so state is bounded by the users of
    the windows that are still open.
    """
    seen = (
        _timed(posts, late)
        .select(F.window("event_time", every).alias("window"), "user_id", "event_time")
        .dropDuplicates(["window", "user_id"])
    )
    grouped = seen.groupBy("window").agg(F.count("user_id").alias("active_users"))
    return grouped.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("time"), "active_users")
