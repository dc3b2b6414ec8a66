"""Schemas of the post, label, document and log tables."""

from __future__ import annotations

from pyspark.sql import types as T

TOPIC = T.StructType([T.StructField("parent_topic", T.StringType()), T.StructField("sub_topic", T.StringType())])
BELIEF = T.StructType(
    [T.StructField("category", T.StringType()), T.StructField("subcategories", T.ArrayType(T.StringType()))]
)
LEXICON = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("positive", T.IntegerType()),
        T.StructField("negative", T.IntegerType()),
    ]
)

# Raw fields arrive as text or loose numbers; ``normalize_posts`` types them.
RAW_POST = T.StructType(
    [
        T.StructField("post_id", T.LongType()),
        T.StructField("username", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("publish_time", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("repost_count", T.StringType()),
        T.StructField("comment_count", T.StringType()),
        T.StructField("like_count", T.StringType()),
        T.StructField("image_urls", T.ArrayType(T.StringType())),
        T.StructField("followers_count", T.StringType()),
        T.StructField("sentiment_polarity", T.StringType()),
        T.StructField("sentiment_attribute", T.ArrayType(T.StringType())),
        T.StructField("topics", T.ArrayType(TOPIC)),
        T.StructField("publisher", T.StringType()),
        T.StructField("belief_signals", T.ArrayType(BELIEF)),
        T.StructField("publisher_decision", T.StringType()),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("entities", T.ArrayType(T.StringType())),
        T.StructField("lexicon_sentiment", LEXICON),
        T.StructField("text_similarity_group", T.LongType()),
    ]
)

# Fields that files give as lists, single values or objects; they are read as
# their JSON text and brought into one shape by ``shaped``.
VARIED = ("image_urls", "sentiment_attribute", "topics", "belief_signals", "keywords", "entities")
FILE_POST = T.StructType([T.StructField(f.name, T.StringType()) if f.name in VARIED else f for f in RAW_POST.fields])

SEARCH_RESULT = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)
EVENT = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("branch_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

ENRICHED_FIELDS = ("sentiment_polarity", "sentiment_attribute", "topics", "publisher")
POST_KEY = ("content", "publish_time", "user_id", "username")
