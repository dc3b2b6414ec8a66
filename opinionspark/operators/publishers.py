"""Publisher, influence, participant, cross-dimension and correlation operators."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import (
    time_bucket,
    MEDIUM,
    NEGATIVE,
    NEUTRAL,
    POSITIVE,
    STRONG,
    UNKNOWN,
    WEAK,
    content_preview,
    dim_value,
    engagement,
    influence,
    known,
    percent,
    polarity,
    rnd,
    time_label,
)
from ..plans.shapes import (
    by_time,
    whole,
    bucketed,
    focus_filter,
    keyed_map,
    top,
    top_entries,
    top_keys,
    zero_filled,
)


def publisher_distribution(posts: DataFrame) -> DataFrame:
    """Counts, mean interactions, mean sentiment and engagement per publisher."""
    p = polarity()
    grouped = posts.groupBy(known("publisher").alias("publisher")).agg(
        F.count(F.lit(1)).alias("count"),
        rnd(F.avg("repost_count"), 2).alias("avg_reposts"),
        rnd(F.avg("comment_count"), 2).alias("avg_comments"),
        rnd(F.avg("like_count"), 2).alias("avg_likes"),
        rnd(F.avg(p.cast("double")), 2).alias("avg_sentiment"),
        F.sum(engagement()).alias("total_engagement"),
    )
    # One row per publisher type, a closed list, so the total is a small window.
    return grouped.withColumn("percentage", percent(F.col("count"), F.sum("count").over(whole())))


def top_publishers(posts: DataFrame, k: int = 5) -> DataFrame:
    return top(publisher_distribution(posts), k, "count", "publisher")


def publisher_bar(posts: DataFrame) -> DataFrame:
    """The distribution with a sentiment class per publisher."""
    mean = F.col("avg_sentiment")
    label = (
        F.when(mean.isNull(), UNKNOWN).when(mean >= 3.5, POSITIVE).when(mean <= 2.5, NEGATIVE).otherwise(NEUTRAL)
    )
    return publisher_distribution(posts).select("publisher", "count", "avg_sentiment", label.alias("sentiment_class"))


def top_accounts(posts: DataFrame, k: int = 20) -> DataFrame:
    """Each account's single best post; the best accounts.

    The best post is a maximum, so it is combined before the shuffle and a
    hot account costs no more than any other.
    """
    name = F.coalesce(F.nullif("username", F.lit("")), F.nullif("publisher", F.lit("")), F.lit(UNKNOWN))
    best = F.max(F.struct(engagement().alias("e"), (-F.col("post_id")).alias("neg"), "publisher", "followers_count"))
    accounts = posts.groupBy(name.alias("username")).agg(best.alias("b"))
    return top(
        accounts.select(
            "username",
            F.coalesce(F.col("b.publisher"), F.lit(UNKNOWN)).alias("publisher"),
            F.col("b.e").alias("engagement"),
            "b.followers_count",
        ),
        k,
        "engagement",
        "username",
    )


def representative_posts(posts: DataFrame, k: int = 50) -> DataFrame:
    """The posts with most engagement."""
    rows = posts.select(
        "post_id", "username", known("publisher").alias("publisher"), "publish_time", engagement().alias("engagement"),
        "content",
    )
    return top(rows, k, "engagement", "post_id").withColumn("publish_time", F.col("publish_time").cast("string"))


def cross_matrix(
    posts: DataFrame, dim1: str = "publisher", dim2: str = "sentiment_polarity", k: int = 10
) -> DataFrame:
    """Two dimensions crossed: top values each, counts, row and column shares.

    Totals cover all rows, also values that did not make the top list.
    """
    counts = posts.groupBy(dim_value(dim1).alias("value1"), dim_value(dim2).alias("value2")).agg(
        F.count(F.lit(1)).alias("n")
    )
    rows = top_keys(counts, "value1", k)
    columns = top_entries(counts, "value2", k)
    names = top_keys(counts, "value2", k)
    cells = (
        counts.groupBy("value1")
        .agg(
            F.sum("n").alias("row_total"),
            keyed_map("value2", "n", names).alias("_cells"),
            F.bool_or(F.array_contains(rows, F.col("value1"))).alias("_wanted"),
        )
        .filter("_wanted")
    )
    spread_out = cells.withColumn("_columns", columns).select(
        "value1", "row_total", "_cells", F.explode("_columns").alias("c")
    )
    count = F.coalesce(F.col("_cells")[F.col("c.key")], F.lit(0))
    return spread_out.select(
        "value1", F.col("c.key").alias("value2"), count.alias("count"), "row_total", (-F.col("c.neg")).alias("col_total")
    ).withColumns(
        {
            "row_percentage": percent(F.col("count"), F.col("row_total")),
            "col_percentage": percent(F.col("count"), F.col("col_total")),
        }
    )


def influence_top(posts: DataFrame, top_n: int = 20) -> DataFrame:
    """The most influential posts, with a preview of each."""
    rows = posts.select(
        "post_id",
        F.coalesce("username", F.lit("")).alias("username"),
        content_preview().alias("content_preview"),
        F.col("publish_time").cast("string").alias("publish_time"),
        "repost_count",
        "comment_count",
        "like_count",
        influence().alias("influence_score"),
        polarity().alias("sentiment_polarity"),
        known("publisher").alias("publisher"),
    )
    return top(rows, top_n, "influence_score", "post_id")


def influence_summary(posts: DataFrame, top_n: int = 20) -> DataFrame:
    """Total and mean score, and the share of the total the top posts hold.

    Works on the histogram of scores: the best ``top_n`` posts lie within the
    ``top_n`` largest distinct scores.
    """
    scores = posts.groupBy(influence().alias("score")).agg(F.count(F.lit(1)).alias("n"))
    largest = scores.orderBy(F.desc("score")).limit(top_n)
    before = F.coalesce(
        F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    taken = F.greatest(F.least(F.col("n"), F.lit(top_n) - F.col("before")), F.lit(0))
    head = largest.withColumn("before", before).agg(F.sum(F.col("score") * taken)).scalar()
    total = scores.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_posts"),
        F.coalesce(F.sum(F.col("score") * F.col("n")), F.lit(0)).alias("total_engagement"),
    )
    return total.select(
        "total_posts",
        "total_engagement",
        rnd(F.try_divide(F.col("total_engagement").cast("double"), F.col("total_posts").cast("double")), 2).alias(
            "avg_influence_score"
        ),
        percent(F.coalesce(head, F.lit(0)), F.col("total_engagement")).alias("influence_concentration"),
    )


def publisher_influence(posts: DataFrame, k: int = 10) -> DataFrame:
    grouped = posts.groupBy(known("publisher").alias("publisher")).agg(F.sum(influence()).alias("total_influence"))
    return top(grouped, k, "total_influence", "publisher")


FEATURES = (
    "sentiment_polarity",
    "repost_count",
    "comment_count",
    "like_count",
    "content_length",
    "image_count",
    "topic_count",
)


def post_features(posts: DataFrame, topic_count=None) -> DataFrame:
    """Numeric features of the rated posts."""
    topics = F.coalesce(F.size("topics"), F.lit(0)) if topic_count is None else topic_count
    return posts.filter(polarity().isNotNull()).select(
        polarity().cast("double").alias("sentiment_polarity"),
        F.col("repost_count").cast("double").alias("repost_count"),
        F.col("comment_count").cast("double").alias("comment_count"),
        F.col("like_count").cast("double").alias("like_count"),
        F.coalesce(F.length("content"), F.lit(0)).cast("double").alias("content_length"),
        F.when(F.col("image_urls").isNotNull(), F.size("image_urls")).otherwise(0).cast("double").alias("image_count"),
        topics.cast("double").alias("topic_count"),
    )


def correlation_matrix(features: DataFrame) -> DataFrame:
    """Pearson correlation of every feature pair; 0 without variance.

    Fewer than ten rated posts give nothing. All pairs are one aggregate.
    """
    pairs = list(combinations(FEATURES, 2))
    one = features.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs],
        *[F.stddev_pop(a).alias(f"sd__{a}") for a in FEATURES],
    ).filter(F.col("n") >= 10)

    def cell(a, b, value):
        return F.struct(F.lit(a).alias("feature1"), F.lit(b).alias("feature2"), value.alias("correlation"))

    cells = [cell(a, a, F.when(F.col(f"sd__{a}") > 0, 1.0).otherwise(0.0)) for a in FEATURES]
    for a, b in pairs:
        varied = (F.col(f"sd__{a}") > 0) & (F.col(f"sd__{b}") > 0)
        value = F.when(varied, rnd(F.col(f"{a}__{b}"), 3)).otherwise(0.0)
        cells += [cell(a, b, value), cell(b, a, value)]
    return one.select(F.inline(F.array(*cells)), F.col("n").alias("sample_size"))


def correlation_significant(features: DataFrame, threshold: float = 0.3) -> DataFrame:
    r = F.abs("correlation")
    strength = F.when(r >= 0.7, STRONG).when(r >= 0.5, MEDIUM).otherwise(WEAK)
    return (
        correlation_matrix(features)
        .filter((F.col("feature1") < F.col("feature2")) & (r >= threshold))
        .select("feature1", "feature2", "correlation", strength.alias("strength"))
    )


def publisher_buckets(posts: DataFrame, top_n: int = 10) -> DataFrame:
    """Sentiment buckets of the publishers with most posts."""
    p = polarity()
    grouped = posts.groupBy(known("publisher").alias("publisher")).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(p <= 2).alias("negative"),
        F.count_if(p == 3).alias("neutral"),
        F.count_if(p >= 4).alias("positive"),
        F.count_if(p.isNull()).alias("unknown"),
    )
    return top(grouped, top_n, "count", "publisher")


def publisher_focus(posts: DataFrame, window_days: int = 14, top_n: int = 5) -> DataFrame:
    """Daily counts of the leading publishers inside the focus window, zero-filled."""
    inside = bucketed(focus_filter(posts, posts, window_days), "day")
    counts = inside.groupBy("bucket", known("publisher").alias("publisher")).agg(F.count(F.lit(1)).alias("n"))
    keep = top_keys(counts, "publisher", top_n)
    return zero_filled(counts, ["bucket"], "publisher", keep, only_kept=True).select(
        time_label("bucket", "day").alias("time"), "publisher", F.col("n").alias("count")
    )


def publisher_topics(mentions: DataFrame, top_publishers: int = 8, top_topics: int = 8) -> DataFrame:
    """Leading publishers by topic mentions × leading topics within them."""
    counts = (
        mentions.filter(F.nullif(F.col("parent_topic"), F.lit("")).isNotNull())
        .groupBy(known("publisher").alias("publisher"), "parent_topic")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    wanted = F.array_contains(top_keys(counts, "publisher", top_publishers), F.col("publisher"))
    topics = top_keys(counts, "parent_topic", top_topics, F.when(wanted, F.col("n")))
    return zero_filled(counts, ["publisher"], "parent_topic", topics, rows_where=wanted).withColumnRenamed("n", "count")


def participant_trend(posts: DataFrame, granularity: str = "day") -> DataFrame:
    """Posts, users, new users and cumulative users per time.

    Posts are first reduced to one row per user and time, so even a user with
    a third of all posts is a short series when its first time is looked up.
    """
    active = (
        bucketed(posts.filter(F.col("user_id").isNotNull()), granularity)
        .groupBy("user_id", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _trend_of(active, granularity)


def _trend_of(active: DataFrame, granularity: str) -> DataFrame:
    """The trend of (user_id, bucket, n), one row per user and time."""
    first = F.min("bucket").over(Window.partitionBy("user_id"))
    grouped = (
        active.withColumn("is_new", F.col("bucket") == first)
        .groupBy("bucket")
        .agg(
            F.sum("n").alias("active_posts"),
            F.count(F.lit(1)).alias("active_users"),
            F.count_if("is_new").alias("new_users"),
            F.sum(F.when(F.col("is_new"), F.col("n")).otherwise(0)).alias("new_user_posts"),
        )
    )
    running = by_time().rowsBetween(Window.unboundedPreceding, 0)
    return grouped.select(
        time_label("bucket", granularity).alias("time"), "active_posts", "active_users", "new_users", "new_user_posts"
    ).withColumn("cumulative_users", F.sum("new_users").over(running))


def participant_sets(posts: DataFrame, granularity: str = "hour") -> DataFrame:
    """(bucket, user_id, posts): the different users of each time with their posts.

    Sets merge over any times without error, so they can be stored once and asked for any range.
    """
    timed = posts.filter(F.col("user_id").isNotNull() & F.col("publish_time").isNotNull())
    bucket = F.date_trunc(granularity, "publish_time").cast("timestamp_ntz").alias("bucket")
    return timed.groupBy(bucket, "user_id").agg(F.count(F.lit(1)).alias("posts"))


def participant_trend_of_sets(sets: DataFrame, granularity: str = "day") -> DataFrame:
    """``participant_trend`` from stored sets of users; times may be coarser than those of the sets."""
    active = sets.groupBy("user_id", time_bucket("bucket", granularity).alias("bucket")).agg(F.sum("posts").alias("n"))
    return _trend_of(active, granularity).drop("new_user_posts")


def users_of_ranges_of_sets(sets: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, users): how many different users each half open range (range_id, start, end) has; 0 without posts."""
    inside = (F.col("bucket") >= F.col("start")) & (F.col("bucket") < F.col("end"))
    met = ranges.join(sets.select("bucket", "user_id"), inside, "left").select("range_id", "user_id").distinct()
    return met.groupBy("range_id").agg(F.count("user_id").alias("users"))


def participant_sketches(posts: DataFrame, granularity: str = "hour", lg: int = 14) -> DataFrame:
    """(bucket, posts, users): the number of posts and a sketch of the distinct users of each time.

    Sketches are combined on the map side and merge over any times, so they can be
    stored once and asked for any range. With ``lg`` 14 one has at most 16 KB and
    an error of about 0.8 %; up to a few hundred users it is all but exact.
    """
    timed = posts.filter(F.col("user_id").isNotNull() & F.col("publish_time").isNotNull())
    return timed.groupBy(F.date_trunc(granularity, "publish_time").cast("timestamp_ntz").alias("bucket")).agg(
        F.count(F.lit(1)).alias("posts"), F.hll_sketch_agg("user_id", F.lit(lg)).alias("users")
    )


def participant_trend_approx(sketches: DataFrame, granularity: str = "day") -> DataFrame:
    """``participant_trend`` from stored sketches: posts, users, new and cumulative users per time.

    New users are the rise of the cumulative ones. Times may be coarser than those of the sketches.
    """
    series = sketches.groupBy(time_bucket("bucket", granularity).alias("bucket")).agg(
        F.sum("posts").alias("active_posts"), F.hll_union_agg("users").alias("users")
    )
    # One row per time, so all earlier ones are a short list of sketches.
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    merged = series.select("bucket", "active_posts", "users", F.collect_list("users").over(running).alias("earlier"))
    union = F.aggregate(
        F.slice("earlier", F.lit(2), F.size("earlier")), F.get("earlier", F.lit(0)), lambda a, x: F.hll_union(a, x)
    )
    counted = merged.select(
        "bucket",
        "active_posts",
        F.hll_sketch_estimate("users").alias("active_users"),
        F.hll_sketch_estimate(union).alias("cumulative_users"),
    )
    before = F.lag("cumulative_users", 1, 0).over(Window.orderBy("bucket"))
    return counted.select(
        time_label("bucket", granularity).alias("time"),
        "active_posts",
        "active_users",
        F.greatest(F.col("cumulative_users") - before, F.lit(0)).alias("new_users"),
        "cumulative_users",
    )


def users_of_ranges(sketches: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, users): about how many different users each half open range (range_id, start, end) has.

    The posts aren't read again, however many ranges are asked; a range without posts has 0 users.
    """
    inside = (F.col("bucket") >= F.col("start")) & (F.col("bucket") < F.col("end"))
    met = ranges.join(sketches.select("bucket", F.col("users").alias("_users")), inside, "left")
    return met.groupBy("range_id").agg(
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("_users")), F.lit(0)).alias("users")
    )
