"""Applying validated label replies to posts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L

#: From the column of a post's text to the column of a model's reply to one task: built-in functions, or a function on
#: Arrow batches such as a pandas UDF that calls a model for a whole batch.
Labeler = Callable[[Column], Column]


def label_column(task: str, reply: Column, vocab: Column | None = None) -> Column:
    """The clean value of a reply to one labelling task."""
    if task == "sentiment_polarity":
        return L.parse_polarity(reply)
    parsers = {
        "sentiment_attribute": L.parse_attributes,
        "topics": L.parse_topics,
        "publisher": L.parse_publisher,
        "belief_signals": L.parse_beliefs,
        "publisher_decision": L.parse_decision,
    }
    return parsers[task](reply, vocab)


def apply_labels(posts: DataFrame, replies: DataFrame, vocabularies: dict[str, Column]) -> DataFrame:
    """Fill missing labels of posts from a reply table (post_id, task, response[, reply_no]).

    Replies are pivoted to one row per post, so a single join serves all
    tasks. Of several replies to a task the one with the highest ``reply_no``
    counts, or without that column the greatest text. A label that exists is
    kept, and one without a reply stays null, so the post can be resumed.
    """
    latest = F.col("reply_no" if "reply_no" in replies.columns else "response")
    tasks = ["sentiment_polarity", *vocabularies]
    wide = replies.groupBy("post_id").agg(
        *[F.max_by("response", F.when(F.col("task") == t, latest)).alias(f"_{t}") for t in tasks]
    )
    # A vocabulary may be a scalar subquery, so it becomes a column before it
    # is used inside lambdas.
    joined = posts.join(wide, "post_id", "left").withColumns({f"_vocab_{t}": v for t, v in vocabularies.items()})
    filled = {
        t: F.coalesce(F.col(t), F.when(F.col(f"_{t}").isNotNull(), label_column(t, F.col(f"_{t}"), F.col(f"_vocab_{t}"))))
        for t in vocabularies
    }
    level = label_column("sentiment_polarity", F.col("_sentiment_polarity"))
    filled["sentiment_polarity"] = F.coalesce(
        "sentiment_polarity", F.when(F.col("_sentiment_polarity").isNotNull(), level)
    )
    return joined.withColumns(filled).drop(*[f"_{t}" for t in tasks], *[f"_vocab_{t}" for t in vocabularies])


def label_posts(posts: DataFrame, labelers: dict[str, Labeler], vocabularies: dict[str, Column]) -> DataFrame:
    """Fill missing labels of posts with the validated replies of a labeler for each task.

    Replies are validated as ``apply_labels`` does. A labeler only gets the texts
    of posts without a label for its task (null for the others); a null reply
    leaves the label null.
    """
    replies = {f"_{t}": label(F.when(F.col(t).isNull(), F.col("content"))) for t, label in labelers.items()}
    vocab = {f"_vocab_{t}": vocabularies[t] for t in labelers if t in vocabularies}
    joined = posts.withColumns(replies).withColumns(vocab)
    filled = {
        t: F.coalesce(
            F.col(t),
            F.when(
                F.col(f"_{t}").isNotNull(),
                label_column(t, F.col(f"_{t}"), F.col(f"_vocab_{t}") if t in vocabularies else None),
            ),
        )
        for t in labelers
    }
    return joined.withColumns(filled).drop(*replies, *vocab)
