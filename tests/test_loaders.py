"""Loaders as data sources, batch and stream, against the public reader."""

from __future__ import annotations

import json
import os

import pytest

from opinionspark.sources import posts as P
from opinionspark.sources.loaders import JsonFiles, load_posts, register_loader

ROWS = [
    {"post_id": i, "username": f"n{i}", "content": f"post {i}", "publish_time": "2024-01-01 10:00:00", "like_count": i,
     "topics": [{"parent_topic": "p", "sub_topic": "s"}], "sentiment_attribute": "hope", "image_urls": ["a", "b"],
     "lexicon_sentiment": {"label": "neutral", "score": 0, "positive": 0, "negative": 0}, "belief_signals": ["x"]}
    for i in range(12)
]


def plain(frame):
    return sorted(str(sorted(r.asDict(recursive=True).items())) for r in frame.collect())


def test_files_as_a_source(spark, tmp_path):
    for k in range(3):
        part = ROWS[4 * k : 4 * k + 4]
        text = json.dumps(part) if k else "\n".join(map(json.dumps, part))
        (tmp_path / f"f{k}.json").write_text(text, encoding="utf-8")
    register_loader(spark, "posts_of_files", JsonFiles)
    pattern = str(tmp_path / "f*.json")
    posts = load_posts(spark, "posts_of_files", path=pattern)
    expected = plain(P.read_posts(spark, pattern))
    assert posts.columns == P.read_posts(spark, pattern).columns and plain(posts) == expected
    assert posts.rdd.getNumPartitions() == 3

    def run():
        stream = load_posts(spark, "posts_of_files", stream=True, path=pattern)
        query = (
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    assert plain(run()) == expected
    (tmp_path / "f9.json").write_text(json.dumps([{"post_id": 99, "content": "late"}]), encoding="utf-8")
    later = run()
    assert later.count() == 13 and later.filter("post_id = 99").count() == 1


def test_own_loaders(spark, tmp_path):
    class Numbers:
        """A loader without files: ``n`` posts in parts of three, without ids."""

        def __init__(self, options):
            self.n = int(options["n"])

        def parts(self):
            return list(range(0, self.n, 3))

        def load(self, part):
            for i in range(part, min(part + 3, self.n)):
                yield {"content": f"c{i}", "like_count": "many" if i == 1 else i}

    register_loader(spark, "posts_of_numbers", Numbers)
    rows = load_posts(spark, "posts_of_numbers", n="8").orderBy("post_id").collect()
    assert [(r.content, r.like_count) for r in rows] == [(f"c{i}", 0 if i == 1 else i) for i in range(8)]
    assert len({r.post_id for r in rows}) == 8
    assert load_posts(spark, "posts_of_numbers", n="0").count() == 0
    (tmp_path / "bad.json").write_text("[1]", encoding="utf-8")
    register_loader(spark, "posts_of_files", JsonFiles)
    with pytest.raises(Exception):
        load_posts(spark, "posts_of_files", path=os.path.join(tmp_path, "bad.json")).collect()
