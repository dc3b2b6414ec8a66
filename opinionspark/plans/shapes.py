"""Plan building blocks shared by the operators.

Small results (a grand total, the bounds of a window, the names of the top
few keys) enter other plans as scalar subqueries. Spark runs them first and
inserts the value as a literal, so there is no cross join, nothing is
broadcast, and range predicates built from them can reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.values import time_bucket

def by_time() -> WindowSpec:
    """The order of a time series as a whole.

    A series holds one row per hour or day that has data, so its size is
    bounded by the calendar, not by the number of posts. Only such aggregated
    frames, never raw posts, are ordered or averaged as a whole.
    """
    return Window.orderBy("time")


def whole() -> WindowSpec:
    """All rows of a small aggregated frame."""
    return Window.partitionBy()


def row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def top(df: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    """First ``k`` rows by a descending measure; ties broken ascending."""
    return df.orderBy(F.desc(by), *[F.asc(t) for t in ties]).limit(k)


def _leading(counts: DataFrame, key: str, k: int, n: Column) -> DataFrame:
    totals = counts.groupBy(key).agg(F.sum(n).alias("_total"))
    # Tested on the sum, not on the key: see the note on ``zero_filled``.
    best = top(totals.filter(F.col("_total") > 0), k, "_total", key)
    pairs = F.collect_list(F.struct((-F.col("_total")).alias("neg"), F.col(key).alias("key")))
    return best.agg(F.sort_array(pairs).alias("entries"))


def top_entries(counts: DataFrame, key: str, k: int, n: str | Column = "n") -> Column:
    """Scalar ``array<struct<neg, key>>`` of the k largest keys, in rank order.

    ``counts`` may hold several rows per key; keys are not null.
    """
    return _leading(counts, key, k, F.col(n) if isinstance(n, str) else n).scalar()


def top_keys(counts: DataFrame, key: str, k: int, n: str | Column = "n") -> Column:
    """Scalar array of the k largest keys, in rank order."""
    entries = _leading(counts, key, k, F.col(n) if isinstance(n, str) else n)
    return entries.select(F.transform("entries", lambda x: x["key"])).scalar()


def keyed_map(key: str, n: str, keep: Column) -> Column:
    """Aggregate to ``map<key, n>`` over the few kept keys of a group."""
    return F.map_from_entries(
        F.collect_list(F.when(F.array_contains(keep, F.col(key)), F.struct(F.col(key), F.col(n))))
    )


def kept_cells(
    counts: DataFrame,
    rows: list[str],
    key: str,
    keep: Column,
    n: str = "n",
    only_kept: bool = False,
    rows_where: Column | None = None,
) -> DataFrame:
    """Sparse counts as one row per row group with a ``_cells`` map of the kept keys.

    The kept keys come from the same ``counts``. A filter on them would be
    pushed below the aggregate and make it a different plan, so the input
    would be read once for the ranking and once more for the result. All
    conditions therefore sit inside the aggregate or test its results: both
    uses share one scan and one shuffle.
    """
    parts = [keyed_map(key, n, keep).alias("_cells")]
    if rows_where is not None:
        parts.append(F.bool_or(rows_where).alias("_wanted"))
    cells = counts.groupBy(*rows).agg(*parts)
    if only_kept:
        cells = cells.filter(F.size("_cells") > 0)
    if rows_where is not None:
        cells = cells.filter("_wanted").drop("_wanted")
    return cells


def spread(df: DataFrame, rows: list[str], key: str, keep: Column, n: str = "n") -> DataFrame:
    """Turn rows carrying a ``_cells`` map into one zero-filled row per kept key."""
    filled = df.withColumn("_keep", keep).select(*rows, "_cells", F.explode("_keep").alias(key))
    return filled.select(*rows, key, F.coalesce(F.col("_cells")[F.col(key)], F.lit(0)).alias(n))


def zero_filled(counts: DataFrame, rows: list[str], key: str, keep: Column, n: str = "n", **conditions) -> DataFrame:
    """Dense rows × kept-keys grid from sparse counts, without a grid join."""
    return spread(kept_cells(counts, rows, key, keep, n, **conditions), rows, key, keep, n)


def focus_bounds(posts: DataFrame, window_days: int = 14) -> DataFrame:
    """One row (start, end, posts): the busiest stretch of ``window_days`` days.

    Every day with posts adds its count to the windows that end on it or on
    the following days. Summing those contributions gives the trailing sum of
    every day, also over gaps, without ordering the days in one partition. A
    window ending after the last day can never beat the one ending on it, and
    the earliest end wins a tie.
    """
    span = int(window_days)
    daily = (
        posts.filter(F.col("publish_time").isNotNull())
        .groupBy(F.to_date("publish_time").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ends = F.explode(F.sequence(F.col("day"), F.date_add("day", span - 1)))
    sums = daily.select(ends.alias("end"), "n").groupBy("end").agg(F.sum("n").alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.unix_date("end")).alias("neg_end")))
    end = F.date_from_unix_date(-F.col("best.neg_end"))
    return (
        sums.agg(best.alias("best"))
        .filter(F.col("best").isNotNull())
        .select(F.date_sub(end, span - 1).alias("start"), end.alias("end"), F.col("best.n").alias("posts"))
    )


def focus_filter(rows: DataFrame, posts: DataFrame, window_days: int = 14) -> DataFrame:
    """Rows of ``rows`` whose time lies in the focus window of ``posts``.

    The bounds are found from the post times alone. A table stored by
    ``publish_date`` is then read for the days of the window only.
    """
    bounds = focus_bounds(posts, window_days)
    start, end = bounds.select("start").scalar(), bounds.select("end").scalar()
    stop = bounds.select(F.date_add("end", 1).cast("timestamp_ntz")).scalar()
    inside = rows.filter(
        (F.col("publish_time") >= bounds.select(F.col("start").cast("timestamp_ntz")).scalar())
        & (F.col("publish_time") < stop)
    )
    if "publish_date" in rows.columns:
        inside = inside.filter((F.col("publish_date") >= start) & (F.col("publish_date") <= end))
    return inside


def bucketed(df: DataFrame, granularity: str) -> DataFrame:
    """Rows with a known time, plus their ``bucket``."""
    return df.filter(F.col("publish_time").isNotNull()).withColumn(
        "bucket", time_bucket("publish_time", granularity)
    )
