"""Views of the star-schema tables as posts, topic mentions and log tables.

A view joins only what the asked columns need: a query without user names or
locations never touches the customer table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose rows take much work each, on at least one task per core.

    A small file is a single input split. Only then are the rows spread; a
    table with enough splits is read as it is, without a shuffle.
    """
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def _belief_signals() -> Column:
    subs = F.slice(
        F.array(
            F.concat(F.lit("S_"), F.substring("o_orderpriority", 1, 1)),
            F.concat(F.lit("M_"), F.month("o_orderdate").cast("string")),
            F.concat(F.lit("Q_"), F.quarter("o_orderdate").cast("string")),
        ),
        1,
        (F.col("o_orderkey") % 4).cast("int"),
    )
    category = F.concat(F.lit("C_"), F.col("o_orderstatus"))
    signal = F.array(F.struct(category.alias("category"), subs.alias("subcategories")))
    return F.when(F.col("o_orderkey") % 12 != 4, signal)


_ORDER_COLUMNS = {
    "user_id": lambda: F.col("o_custkey").cast("string"),
    "content": lambda: F.concat(F.col("o_orderpriority"), F.lit(" "), F.col("o_orderstatus")),
    "publish_time": lambda: F.col("o_orderdate").cast("timestamp_ntz"),
    "repost_count": lambda: F.col("o_orderkey") % 7,
    "comment_count": lambda: F.col("o_orderkey") % 5,
    "like_count": lambda: F.col("o_orderkey") % 11,
    "followers_count": lambda: F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 1000),
    "image_urls": lambda: F.slice(
        F.array(*[F.lit(f"img{i}.jpg") for i in range(1, 5)]), 1, (F.col("o_orderkey") % 5).cast("int")
    ),
    "sentiment_polarity": lambda: F.when(
        F.col("o_orderkey") % 50 != 0, F.substring("o_orderpriority", 1, 1).cast("int")
    ),
    "sentiment_attribute": lambda: F.when(
        F.col("o_orderkey") % 29 != 0, F.array(F.expr("substring(o_orderpriority, 3)"), F.col("o_orderstatus"))
    ),
    "belief_signals": _belief_signals,
    "publisher_decision": lambda: F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")),
}
_CUSTOMER_COLUMNS = {
    "username": lambda: F.col("c_name"),
    "publisher": lambda: F.when(F.col("o_orderkey") % 41 != 0, F.col("c_mktsegment")),
    "location": lambda: F.when(F.col("o_orderkey") % 37 == 0, "").when(
        F.col("o_orderkey") % 53 != 0, F.col("n_name")
    ),
}
POST_COLUMNS = ("post_id", *_ORDER_COLUMNS, *_CUSTOMER_COLUMNS)


def order_posts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One post per order; the priority digit is the polarity."""
    wanted = [c for c in POST_COLUMNS if not columns or c in columns or c == "post_id"]
    rows = table(spark, sf_dir, "orders")
    if any(c in _CUSTOMER_COLUMNS for c in wanted):
        customer = table(spark, sf_dir, "customer")
        rows = rows.join(customer, rows.o_custkey == customer.c_custkey, "left")
    if "location" in wanted:
        nation = table(spark, sf_dir, "nation")
        rows = rows.join(nation, F.col("c_nationkey") == nation.n_nationkey, "left")
    made = {"post_id": lambda: F.col("o_orderkey"), **_ORDER_COLUMNS, **_CUSTOMER_COLUMNS}
    return rows.select(*[made[c]().alias(c) for c in wanted])


def topic_mentions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One topic mention per line item: the part's brand and type.

    Post columns are joined on only when asked for.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    mentions = line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("post_id"),
        F.col("l_linenumber").alias("position"),
        F.col("p_brand").alias("parent_topic"),
        F.col("p_type").alias("sub_topic"),
    )
    if columns:
        mentions = mentions.join(order_posts(spark, sf_dir, *columns), "post_id")
    return mentions


def posts_with_first_topic(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Order posts whose topic list holds their first topic only.

    The first topic is a per-order minimum, which is combined before the
    shuffle; a full topic list of an order is never collected.
    """
    first = (
        topic_mentions(spark, sf_dir)
        .groupBy("post_id")
        .agg(F.min(F.struct("position", "parent_topic", "sub_topic")).alias("t"))
        .select("post_id", F.array(F.struct("t.parent_topic", "t.sub_topic")).alias("topics"))
    )
    return order_posts(spark, sf_dir, *columns).join(first, "post_id", "left")


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per event, for hourly series."""
    return event_posts_of(table(spark, sf_dir, "events"))


def event_posts_of(events: DataFrame) -> DataFrame:
    """Events, stored or streamed, as posts."""
    value = F.col("value")
    return events.select(
        F.col("event_id").alias("post_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").cast("timestamp_ntz").alias("publish_time"),
        F.col("event_type").alias("publisher"),
        F.least(F.lit(5), F.lit(1) + F.floor(value / 100)).cast("int").alias("sentiment_polarity"),
        F.floor(value).cast("bigint").alias("like_count"),
        F.lit(0).cast("bigint").alias("repost_count"),
        F.lit(0).cast("bigint").alias("comment_count"),
    )


def document_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per document; documents come one per hour over 30 days."""
    hours = (F.col("doc_id") % 720).cast("int")
    time = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), hours)
    return text_table(spark, sf_dir, "documents", "doc_id").select(
        F.col("doc_id").alias("post_id"),
        F.col("source").alias("username"),
        F.col("lang").alias("location"),
        F.col("source").alias("publisher"),
        F.col("text").alias("content"),
        time.alias("publish_time"),
    )


def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search result rows made of the web pages: two results per page.

    The second result has no url, so it is known by title and snippet only.
    """
    pages = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    host = F.regexp_extract("url", "^https?://([^/]+)/", 1)

    def result(url: Column, snippet: Column) -> Column:
        return F.struct(
            F.concat(F.lit(" "), title).alias("title"),
            url.alias("url"),
            snippet.alias("snippet"),
            F.lit("").alias("date"),
            host.alias("source"),
        )

    by_url = result(F.regexp_replace("url", r"[?#].*$", ""), F.substring(title, 1, 20))
    by_text = result(F.lit("  "), host)
    return pages.select(
        F.col("page_id").alias("row_id"),
        F.concat(F.lit(" "), lang, F.lit(" ")).alias("query"),
        F.array(by_url, by_text).alias("results"),
    )


def tool_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tool execution per supplier."""
    key = F.col("s_suppkey")
    tool = (
        F.when(key % 5 == 0, "sentiment_trend_tion")
        .when(key % 5 == 1, "geographic_the_chart")
        .when(key % 5 == 2, "keyword_wordcloud")
        .when(key % 5 == 3, "belief_and_network")
        .otherwise("participant_zzz")
    )
    failed = key % 7 == 0
    charts = F.when(failed, 0).otherwise(key % 3)
    return table(spark, sf_dir, "supplier").select(
        key.alias("execution_no"),
        F.concat(F.lit("e_"), F.lpad(key.cast("string"), 9, "0")).alias("id"),
        tool.alias("tool_name"),
        F.when(key % 5 == 4, "").otherwise("图表").alias("category"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.col("s_name").alias("summary"),
        charts.cast("bigint").alias("charts"),
        F.when(failed, 0).otherwise(key % 2).cast("bigint").alias("data"),
        failed.alias("error"),
        (key % 5 != 2).alias("generates_chart"),
    )


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insight texts: the benchmark passages, a quarter of them naming a supplier, a quarter in capitals."""
    item = F.col("item_id")
    name = F.concat(F.lit(" supplier#"), F.lpad((item % 90).cast("string"), 9, "0"))
    text = F.when(item % 4 == 0, F.concat("text", name)).when(item % 4 == 1, F.upper("text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("insight_"), item.cast("string")).alias("insight_id"), text.alias("text")
    )


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status log made of the event table: one run per event type."""
    return status_events_of(table(spark, sf_dir, "events"))


def status_events_of(events: DataFrame) -> DataFrame:
    """Events, stored or streamed, as a status log."""
    kind = F.col("event_type")
    leaves = F.col("event_id") % 3 == 0
    return events.select(
        F.concat(F.lit(" run_"), kind).alias("run_id"),
        (F.col("event_id") - F.col("event_id") % 2).alias("seq"),
        F.col("ts").cast("timestamp_ntz").cast("string").alias("ts"),
        F.when(leaves, "exit").otherwise("enter").alias("event"),
        F.concat(F.lit("stage"), (F.col("user_id") % 3).cast("string")).alias("stage"),
        F.concat(F.lit("node"), (F.col("user_id") % 10).cast("string")).alias("node"),
        F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("b"), (F.col("user_id") % 20).cast("string"))).alias(
            "branch_id"
        ),
        F.when(leaves & (F.col("value") > 200), "failed").when(leaves, "completed").otherwise("").alias("status"),
        F.lit("").alias("error"),
    )
