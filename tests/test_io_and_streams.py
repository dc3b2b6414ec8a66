"""Files in and out, label replies, and streams."""

from __future__ import annotations

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import post
from opinionspark.functions import labels as L
from opinionspark.operators import graphs, keywords, labels
from opinionspark.sources import posts as P
from opinionspark.sources.schema import EVENT
from opinionspark.sources.snapshots import version_folder
from opinionspark.streaming.enrich import incremental_enrich, post_stream
from opinionspark.streaming.location import branch_state_stream, latest_states, locate, store_changes
from opinionspark.streaming.series import UNTIL_END, needed_lateness, participants_stream, run_to_end, sentiment_series_stream


def write_json(path, value):
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False)


def test_json_posts_round_trip(spark, tmp_path):
    raw = [
        {"username": "甲", "user_id": "1", "content": "好", "publish_time": "2024-11-09 10:00:00", "location": "北京",
         "repost_count": 5, "comment_count": 3, "like_count": 10, "image_urls": ["a", "b", "c", "d"],
         "topics": [{"parent_topic": "p", "sub_topic": "s"}], "sentiment_polarity": 5, "sentiment_attribute": ["x"],
         "publisher": "q"},
        {"username": "乙", "user_id": "2", "content": "", "publish_time": "soon", "location": ""},
    ]
    write_json(tmp_path / "posts.json", raw)
    posts = P.read_posts(spark, str(tmp_path / "posts.json")).orderBy("post_id")
    first, second = posts.collect()
    assert (first.username, first.repost_count, str(first.publish_time)) == ("甲", 5, "2024-11-09 10:00:00")
    assert (second.repost_count, second.publish_time, second.topics) == (0, None, None)
    assert P.cap_images(posts).first().image_urls == ["a", "b", "c"]
    P.write_enriched(posts, str(tmp_path / "out"))
    stored, rate = P.read_enriched(spark, str(tmp_path / "out"))
    assert stored.count() == 2
    assert tuple(rate.first()) == (2, 1, 50.0)


def test_vocabularies(spark, tmp_path):
    write_json(tmp_path / "topics.json", [{"parent_topic": "p", "sub_topics": ["a", "b"]}])
    write_json(tmp_path / "beliefs.json", [{"category": "c", "subcategories": ["x"]}])
    write_json(tmp_path / "values.json", ["one", "two"])
    write_json(tmp_path / "decisions.json", [{"category": "k2"}, {"category": "k1"}])
    at = lambda name: str(tmp_path / f"{name}.json")
    assert [tuple(r) for r in P.read_taxonomy(spark, at("topics")).collect()] == [("p", "a"), ("p", "b")]
    assert [tuple(r) for r in P.read_beliefs(spark, at("beliefs")).collect()] == [("c", "x")]
    assert [tuple(r) for r in P.read_values(spark, at("values")).collect()] == [(0, "one"), (1, "two")]
    decisions = P.read_decisions(spark, at("decisions"))
    one = spark.range(1).withColumn("v", L.ordered_vocabulary(decisions))
    assert one.first().v == ["k2", "k1"]


def test_graph_files_have_headers(sample_posts, tmp_path):
    P.write_graph(graphs.belief_nodes(sample_posts), graphs.belief_edges(sample_posts), str(tmp_path / "g"))
    folder = os.path.join(version_folder(sample_posts.sparkSession, str(tmp_path / "g")), "nodes")
    name = next(n for n in os.listdir(folder) if n.endswith(".csv"))
    with open(os.path.join(folder, name), encoding="utf-8") as f:
        assert f.readline().strip() == "signal,category,co_occurrence_weight"


def test_label_replies(spark):
    def parsed(column, replies):
        rows = spark.createDataFrame(list(enumerate(replies)), "i INT, reply STRING")
        return [r.v for r in rows.select("i", column.alias("v")).orderBy("i").collect()]

    reply = F.col("reply")
    assert parsed(L.parse_polarity(reply), [" 4 ", "six", "0", "6", "12345678901", "-1"]) == [4, 3, 3, 3, 3, 3]
    vocab = F.array(F.lit("a"), F.lit("b"))
    assert parsed(L.parse_attributes(reply, vocab), ['["b","z","a"]', "[]", "oops", '{"a":1}', '["a"] and so on', '["a"],["b"]']) == [
        ["b", "a"], [], *[["中立"]] * 4]
    assert parsed(L.parse_publisher(reply, vocab, "b"), [" a ", "z"]) == ["a", "b"]
    assert parsed(L.parse_publisher(reply, vocab, "q"), ["z"]) == [None]
    assert parsed(L.parse_decision(reply, vocab), ['"b or a"', "b", "none"]) == ["a", "b", "a"]
    taxonomy = F.array(F.struct(F.lit("p").alias("parent_topic"), F.lit("s").alias("sub_topic")))
    out = parsed(L.parse_topics(reply, taxonomy),
                 ['[{"parent_topic":"p","sub_topic":"s"},{"parent_topic":"p","sub_topic":"t"}]', "no"])
    assert [[tuple(t) for t in x] for x in out] == [[("p", "s")], []]
    beliefs = F.array(F.struct(F.lit("c").alias("category"), F.array(F.lit("x"), F.lit("y")).alias("subcategories")))
    body = '[{"category":"c","subcategories":["y","q"]},{"category":"d","subcategories":["x"]},{"category":"c"}]'
    out = parsed(L.parse_beliefs(reply, beliefs), [body, f"```json\n{body}\n```", f"sure: {body} ok", "nope", "[]"])
    want = [("c", ["y"]), ("c", [])]
    assert [[(b.category, b.subcategories) for b in x] for x in out] == [want, want, want, [], []]


def test_labels_fill_only_gaps(spark, make_posts):
    posts = make_posts([post(0, sentiment_polarity="1"), post(1), post(2)])
    replies = spark.createDataFrame(
        [(0, "sentiment_polarity", "5"), (1, "sentiment_polarity", "5"), (1, "publisher", "b")],
        "post_id LONG, task STRING, response STRING")
    out = labels.apply_labels(posts, replies, {"publisher": F.array(F.lit("a"), F.lit("b"))})
    assert [(r.sentiment_polarity, r.publisher) for r in out.orderBy("post_id").collect()] == [
        (1, None), (5, "b"), (None, None)]
    numbered = spark.createDataFrame(
        [(1, "sentiment_polarity", "5", 1), (1, "sentiment_polarity", "2", 2)],
        "post_id LONG, task STRING, response STRING, reply_no INT")
    assert labels.apply_labels(posts, numbered, {}).filter("post_id = 1").first().sentiment_polarity == 2


def test_files_lose_nothing(spark, tmp_path):
    """Scalars where lists belong, all spellings of beliefs, and broken files."""
    rows = [
        {"content": "a", "sentiment_attribute": "hope", "topics": [{"parent_topic": "p", "sub_topic": "s"}],
         "belief_signals": [{"Category": "c", "subcategory": "s1"}, "bare", {"category": "d", "Subcategories": ["x", "y"]}]},
        {"content": "b", "sentiment_attribute": ["u", "v"], "belief_signals": "one", "image_urls": [], "like_count": 7},
        {"content": "c", "sentiment_attribute": None, "belief_signals": {"category": "e"}},
    ]
    path = tmp_path / "posts.json"
    path.write_text(json.dumps(rows), encoding="utf-8")
    (tmp_path / "posts.jsonl").write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    for name, fmt in (("posts.json", "json"), ("posts.jsonl", "jsonl")):
        got = {r.content: r for r in P.read_posts(spark, str(tmp_path / name), fmt).collect()}
        assert [got[k].sentiment_attribute for k in "abc"] == [["hope"], ["u", "v"], None]
        assert [(b.category, b.subcategories) for b in got["a"].belief_signals] == [
            ("c", ["s1"]), ("bare", None), ("d", ["x", "y"])]
        assert [(b.category, b.subcategories) for b in got["b"].belief_signals] == [("one", None)]
        assert [(b.category, b.subcategories) for b in got["c"].belief_signals] == [("e", None)]
        assert got["a"].topics[0].sub_topic == "s" and got["b"].like_count == 7 and got["b"].image_urls == []
    path.write_text(json.dumps(rows)[:-30], encoding="utf-8")
    with pytest.raises(Exception):
        P.read_posts(spark, str(path)).collect()
    (tmp_path / "bad.jsonl").write_text(json.dumps(rows[0]) + "\n{broken\n[1]\n", encoding="utf-8")
    with pytest.raises(Exception):
        P.read_posts(spark, str(tmp_path / "bad.jsonl"), "jsonl").collect()
    assert sorted(r.line for r in P.json_rejects(spark, str(tmp_path / "bad.jsonl")).collect()) == ["[1]", "{broken"]


def test_parquet_ids_are_stable(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10, 1, 1).selectExpr("cast(id as string) as content").write.parquet(str(tmp_path / f"p{k}"))
        os.rename(glob.glob(str(tmp_path / f"p{k}" / "*.parquet"))[0], tmp_path / f"part-{k}.parquet")
    path = str(tmp_path / "part-*.parquet")
    assert {(r.post_id, r.content) for r in P.read_posts(spark, path, "parquet").collect()} == {(i, str(i)) for i in range(30)}


def _files(spark, make_posts, path, batches):
    """One Parquet file per batch; files of later batches are newer."""
    for i, rows in enumerate(batches):
        make_posts(rows).coalesce(1).write.mode("append").parquet(str(path))
        for name in os.listdir(path):
            full = os.path.join(path, name)
            if name.endswith(".parquet") and os.path.getmtime(full) > 2_000_000:
                os.utime(full, (1_000_000 + i, 1_000_000 + i))


def test_incremental_enrichment_continues(spark, make_posts, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    _files(spark, make_posts, source, [[post(0, "good day")], [post(1, "bad day")]])
    schema = spark.read.parquet(source).schema

    def run():
        stream = post_stream(spark, source, schema, files_per_batch=1)
        query = incremental_enrich(stream, out, state)
        query.awaitTermination()
        return len(query.recentProgress)

    assert run() >= 2
    assert spark.read.parquet(out).count() == 2
    make_posts([post(2, "new day")]).coalesce(1).write.mode("append").parquet(source)
    run()
    done = spark.read.parquet(out)
    assert sorted((r.post_id, r.lexicon_sentiment.label) for r in done.collect()) == [
        (0, "positive"), (1, "negative"), (2, "neutral")]
    assert done.columns == keywords.nlp_enrich(spark.read.parquet(source)).columns


def test_late_posts_are_dropped_and_counted(spark, make_posts, tmp_path):
    """One batch lies between the watermark's advance and the late post."""
    source = str(tmp_path / "in")
    hour = lambda i, h: post(i, time=f"2024-01-01 {h:02d}:10:00", sentiment_polarity="4")
    _files(spark, make_posts, source, [[hour(0, 1), hour(1, 1)], [hour(2, 8)], [hour(3, 9)], [hour(4, 1)], [hour(5, 20)]])
    stream = post_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    query = (
        sentiment_series_stream(stream).writeStream.format("memory").queryName("series")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    out = {r.time: r["count"] for r in spark.table("series").collect()}
    assert dropped == 1
    assert out == {"2024-01-01 01:00": 2, "2024-01-01 08:00": 1, "2024-01-01 09:00": 1}


@pytest.mark.parametrize("hours", [range(6), [5, 0, 4, 1, 3, 2]])
def test_finished_streams_show_all_windows(spark, make_posts, tmp_path, hours):
    """One file per batch and more files than two batches take, in order of time or not."""
    source = str(tmp_path / "in")
    hour = lambda h: [post(10 * h + i, time=f"2024-01-01 {h:02d}:{i}0:00", user=f"u{i % 3}", sentiment_polarity="4") for i in range(5)]
    _files(spark, make_posts, source, [hour(h) for h in hours])
    for series, column, n in ((sentiment_series_stream, "count", 5), (participants_stream, "active_users", 3)):
        path = str(tmp_path / column)
        stream = post_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
        schema = run_to_end(stream, lambda p: series(p, late=UNTIL_END), path)  # noqa: B023
        rows = spark.read.schema(schema).parquet(f"{path}/out").collect()
        assert sorted((r.time, r[column]) for r in rows) == [(f"2024-01-01 {h:02d}:00", n) for h in range(6)]


def test_windows_close_as_the_files_allow(spark, make_posts, tmp_path):
    """With the lateness that the files need no row is lost, and state stays small in a long input."""
    source, path = str(tmp_path / "in"), str(tmp_path / "w")
    # Each file has a post of two hours before.
    row = lambda h, i: post(10 * h + i, time=f"2024-01-{1 + h // 24:02d} {h % 24:02d}:{i}0:00", user=f"u{i}")
    _files(spark, make_posts, source, [[row(h, 0), row(h, 1), row(max(h - 2, 0), 2)] for h in range(30)])
    files = ("file_path", "file_modification_time")
    stored = spark.read.parquet(source).select("publish_time", *[F.col(f"_metadata.{c}").alias(c) for c in files])
    late = needed_lateness(stored)
    assert late == f"{50 * 60 + 1} seconds"  # 03:10 stands ahead of 02:20
    stream = post_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    for series, column in ((sentiment_series_stream, "count"), (participants_stream, "active_users")):
        progress = []
        schema = run_to_end(stream, lambda p: series(p, late=late), f"{path}/{column}", progress)  # noqa: B023
        rows = spark.read.schema(schema).parquet(f"{path}/{column}/out").collect()
        # The last two hours have no third post.
        assert len(rows) == 30 and sum(r[column] for r in rows) == (90 if column == "count" else 88)
        assert sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) == 0
        most = max(s["numRowsTotal"] for p in progress for s in p["stateOperators"])
        assert most <= 15  # of 90 rows in 30 windows


def test_needed_lateness(spark):
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    rows = [(at(5), "a", 2), (at(9), "a", 2), (at(4), "b", 1), (at(7), "c", 3), (at(8), "d", 3)]
    stored = spark.createDataFrame(rows, "t string, file_path string, file_modification_time int").withColumn(
        "publish_time", F.col("t").cast("timestamp_ntz")
    )
    assert needed_lateness(stored) == f"{2 * 3600 + 1} seconds"
    assert needed_lateness(stored.filter("file_path in ('b', 'a')")) == "1 seconds"
    assert needed_lateness(stored.limit(0)) == "1 seconds"


def test_streamed_location(spark, tmp_path):
    events = [
        ("r", 1, "t", "enter", "s1", "n1", "main", "", ""),
        ("r", 2, "t", "enter", "s2", "n2", "b", "", ""),
        ("r", 3, "t", "exit", "s2", "n2", "b", "completed", ""),
        ("q", 1, "t", "exit", "s1", "n1", None, "completed", ""),
    ]
    for i, part in enumerate((events[2:], events[:2])):
        spark.createDataFrame(part, EVENT).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in" / "*"))
    store_changes(branch_state_stream(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    states = latest_states(spark.read.parquet(str(tmp_path / "out")))
    assert sorted(tuple(r) for r in locate(states).collect()) == [("q", "", "", 0), ("r", "s1", "n1", 1)]


def test_vocabularies_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_ENTRIES", 3)
    values = spark.range(9).select(
        F.col("id").alias("ord"), F.concat(F.lit("v"), "id").alias("value"), F.lit("c").alias("category"), F.col("id").cast("string").alias("subcategory")
    )
    one = spark.range(1)
    for make in (lambda v: L.vocabulary(v, "value"), L.ordered_vocabulary, L.belief_vocabulary):
        assert one.withColumn("v", make(values.limit(3))).first().v
        with pytest.raises(Exception):
            one.withColumn("v", make(values)).collect()
