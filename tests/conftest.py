from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


def post(post_id, content="", time=None, location="", user="u1", r=0, c=0, l=0, **more):  # noqa: E741
    row = {
        "post_id": post_id,
        "username": f"name-{user}",
        "user_id": user,
        "content": content,
        "publish_time": time,
        "location": location,
        "repost_count": str(r),
        "comment_count": str(c),
        "like_count": str(l),
    }
    return row | more


@pytest.fixture(scope="session")
def make_posts(spark):
    """Normalised posts from dicts with the raw post fields."""
    from opinionspark.sources.posts import normalize_posts
    from opinionspark.sources.schema import RAW_POST

    def make(rows):
        full = [tuple(row.get(f.name) for f in RAW_POST.fields) for row in rows]
        return normalize_posts(spark.createDataFrame(full, RAW_POST))

    return make


@pytest.fixture(scope="session")
def sample_posts(make_posts):
    """Three labelled posts with hand-computed totals, plus edge rows."""
    return make_posts(SAMPLE)


SAMPLE = [
    post(
        0, "sunny walk today, good mood", "2024-11-09 10:00:00", "Beijing", "1001", 5, 3, 10,
        image_urls=["a.jpg"], sentiment_polarity="5", sentiment_attribute=["joy", "calm"],
        topics=[("life", "home")], publisher="person", belief_signals=[("risk", ["public safety"])],
        publisher_decision="bystander",
    ),
    post(
        1, "something worrying happened", "2024-11-09 12:30:00", "Shanghai", "1002", 0, 1, 0,
        image_urls=[], sentiment_polarity="2", sentiment_attribute=["worry"],
        topics=[("reaction", "mood")], publisher="person", belief_signals=[], publisher_decision="bystander",
    ),
    post(
        2, "official notice published", "2024-11-10 08:00:00", "Beijing", "1003", 100, 50, 200,
        image_urls=["b.jpg", "c.jpg"], sentiment_polarity="3", sentiment_attribute=["neutral"],
        topics=[("government", "policy"), ("life", "home")], publisher="agency",
        belief_signals=[("risk", ["public safety", "risk grows"]), ("action", [])], publisher_decision="authority",
    ),
]
