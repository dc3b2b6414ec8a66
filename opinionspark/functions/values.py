"""Shared value rules: labels, buckets, rounding and time keys.

Everything here is a plain column expression, so it fuses into whole-stage
codegen wherever an operator uses it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Output labels that existing reports rely on.
POLARITY_LABELS = {1: "极度悲观", 2: "悲观", 3: "中性", 4: "乐观", 5: "极度乐观"}
NEGATIVE, NEUTRAL, POSITIVE = "负面", "中性", "正面"
UNKNOWN = "未知"
RISING, FALLING, FLAT, EMERGING, INSUFFICIENT = "上升", "下降", "平稳", "新兴", "数据不足"
MOSTLY_POSITIVE, MOSTLY_NEGATIVE = "正面主导", "负面主导"
STRONG, MEDIUM, WEAK = "强", "中", "弱"


def rnd(value: Column, digits: int) -> Column:
    """Round half up on the first 12 decimals, so float noise never decides a tie."""
    return F.round(value.cast("decimal(38,12)"), digits).cast("double")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """part/whole in percent; 0 when the whole is 0."""
    share = F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))
    return F.coalesce(rnd(share, digits), F.lit(0.0))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    Binding through a lambda variable keeps the optimizer from inlining an
    expensive array expression into another lambda, where it would be
    recomputed for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def polarity(column: str | Column = "sentiment_polarity") -> Column:
    """Polarity restricted to the five levels; anything else counts as missing."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.between(1, 5), c)


def polarity_label(value: Column) -> Column:
    out = F.when(value == 1, POLARITY_LABELS[1])
    for level in (2, 3, 4, 5):
        out = out.when(value == level, POLARITY_LABELS[level])
    return out


def sentiment_bucket(value: Column | None = None) -> Column:
    v = polarity() if value is None else value
    return (
        F.when(v <= 2, NEGATIVE).when(v >= 4, POSITIVE).when(v.isNotNull(), NEUTRAL).otherwise(UNKNOWN)
    )


def known(column: str) -> Column:
    """The column, with null and empty replaced by the unknown label."""
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(UNKNOWN))


def place(column: str = "location") -> Column:
    """Trimmed location; null when there is none."""
    return F.nullif(F.trim(F.col(column)), F.lit(""))


def engagement() -> Column:
    """Plain engagement: every interaction counts one."""
    return F.col("repost_count") + F.col("comment_count") + F.col("like_count")


def influence() -> Column:
    """Influence: a repost counts three, a comment two, a like one."""
    return F.col("repost_count") * 3 + F.col("comment_count") * 2 + F.col("like_count")


def belief_weight() -> Column:
    """Weight of a post in the belief network: log(1 + 5r + 3c + l)."""
    return F.log1p(
        (F.col("repost_count") * 5 + F.col("comment_count") * 3 + F.col("like_count")).cast("double")
    )


def time_bucket(ts: str | Column, granularity: str) -> Column:
    """Fixed-width grouping key: a date, or an integer hour number."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if granularity == "hour":
        return F.unix_date(F.to_date(c)) * 24 + F.hour(c)
    return F.to_date(c)


def time_label(bucket: str | Column, granularity: str) -> Column:
    """Printable form of a ``time_bucket``; sorts like the bucket itself."""
    c = F.col(bucket) if isinstance(bucket, str) else bucket
    if granularity == "hour":
        hour = F.pmod(c, F.lit(24))
        day = F.date_from_unix_date(((c - hour) / 24).cast("int"))
        return F.concat(day.cast("string"), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))
    return c.cast("string")


def content_preview(column: str = "content", size: int = 100) -> Column:
    """The first code points of a text, with an ellipsis when it is longer."""
    c = F.coalesce(F.col(column), F.lit(""))
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def dim_value(name: str) -> Column:
    """A post's value in a named dimension of the cross matrix."""
    if name == "publisher":
        return known("publisher")
    if name == "location":
        return known("location")
    if name == "sentiment_polarity":
        return F.coalesce(polarity_label(polarity()), F.lit(UNKNOWN))
    if name == "topic":
        first = F.get(F.col("topics"), F.lit(0))["parent_topic"]
        return F.coalesce(first, F.lit(UNKNOWN))
    return F.lit(UNKNOWN)
