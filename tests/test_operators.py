"""Hand-computed results on small posts, with edge rows."""

from __future__ import annotations

import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SAMPLE, post
from opinionspark import TOOLS, execute, registry
from opinionspark.operators import geo, graphs, profile, publishers, sentiment, timeline, topics, traces
from opinionspark.sources import posts as P
from opinionspark.sources.schema import EVENT


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_overview(sample_posts):
    one = profile.overview_totals(sample_posts).first()
    assert (one.total_posts, one.processed_posts, one.total_reposts, one.total_likes) == (3, 3, 105, 210)
    assert (one.unique_users, one.total_images, one.posts_with_images) == (3, 3, 2)
    assert rows(profile.overview_geo(sample_posts), "location") == [("Beijing", 2), ("Shanghai", 1)]
    empty = profile.overview_empty_fields(sample_posts).first()
    assert (empty.sentiment_polarity_empty, empty.topics_empty, empty.belief_system_empty) == (0, 0, 1)


def test_overview_of_raw_posts(make_posts):
    keep = ("post_id", "username", "user_id", "content", "publish_time", "location")
    raw = make_posts([{k: r[k] for k in keep} for r in SAMPLE])
    empty = profile.overview_empty_fields(raw).first()
    assert set(empty) == {3}
    assert profile.overview_totals(raw).first().processed_posts == 0


def test_normalize_edges(make_posts):
    out = make_posts(
        [
            post(0, time="bad", sentiment_polarity="0"),
            post(1, time="2024-01-01", sentiment_polarity="6"),
            post(2, time="2024-01-01 05:00:00", sentiment_polarity="4.0", location=None),
            post(3, time=None, sentiment_polarity=None, location="  x "),
        ]
    )
    got = [(str(r.publish_time) if r.publish_time else None, r.sentiment_polarity, r.location) for r in
           out.orderBy("post_id").collect()]
    assert got == [
        (None, None, ""), ("2024-01-01 00:00:00", None, ""), ("2024-01-01 05:00:00", 4, ""), (None, None, "x"),
    ]


def test_focus_window_spans_gaps_and_takes_the_first_maximum(make_posts):
    days = ["2024-01-01"] * 2 + ["2024-01-20"] * 2 + ["2024-01-05"]
    posts = make_posts([post(i, time=f"{d} 10:00:00") for i, d in enumerate(days)])
    assert rows(timeline.focus_window(posts)) == [("2023-12-23", "2024-01-05", 3)]
    assert rows(timeline.focus_window(posts, 1)) == [("2024-01-01", "2024-01-01", 2)]
    assert rows(timeline.focus_window(make_posts([post(0, time=None)]))) == []


def test_distribution_of_nothing_rated(make_posts):
    out = sentiment.sentiment_distribution(make_posts([post(0), post(1)])).collect()
    assert len(out) == 5
    assert {(r["count"], r.percentage, r.total_count, r.valid_count, r.avg_polarity) for r in out} == {(0, 0.0, 2, 0, 3.0)}


def test_series_counts_missing_as_neither(make_posts):
    posts = make_posts(
        [post(i, time="2024-01-01 10:20:00", sentiment_polarity=p) for i, p in enumerate(["5", "1", None, "4"])]
        + [post(9, time=None, sentiment_polarity="5")]
    )
    assert rows(sentiment.sentiment_time_series(posts)) == [("2024-01-01 10:00", 4, 3.33, 50.0, 25.0)]


@pytest.mark.parametrize("n, expected", [(1, []), (2, [])])
def test_short_series_have_no_turning_points(make_posts, n, expected):
    posts = make_posts([post(i, time=f"2024-01-0{i + 1} 00:00:00", sentiment_polarity=str(1 + 4 * (i % 2))) for i in range(n)])
    assert rows(sentiment.turning_points(posts, "day")) == expected


def test_turning_point(make_posts):
    levels = [1, 5, 1, 1, 1]
    posts = make_posts(
        [post(i, time=f"2024-01-0{i + 1} 00:00:00", sentiment_polarity=str(v)) for i, v in enumerate(levels)]
    )
    # Smoothed 1, 3, 2.333, 2.333, 1: slopes +2, -0.667, 0, -1.333.
    assert rows(sentiment.turning_points(posts, "day"), "time") == [
        ("2024-01-03", 1.0, "up_to_down", -2.667),
        ("2024-01-04", 1.0, "down_to_up", 0.667),
        ("2024-01-05", 1.0, "down_to_up", -1.333),
    ]


def test_growth_and_labels(make_posts):
    posts = make_posts(
        [post(i, time=f"2024-01-0{d} 00:00:00", sentiment_polarity=p) for i, (d, p) in
         enumerate([(1, "1"), (1, "1"), (3, "5")])]
    )
    assert rows(sentiment.growth_rate(posts, "day"), "time") == [("2024-01-01", 2, None), ("2024-01-03", 1, -0.5)]
    assert sentiment.sentiment_trend_label(posts, "day").first().trend == "上升"
    assert sentiment.sentiment_trend_label(posts.limit(1), "day").first().trend == "数据不足"


def test_topics(sample_posts, make_posts):
    m = topics.explode_topics(sample_posts, "publish_time")
    assert rows(topics.topic_ranking(m, sample_posts)) == [
        ("life", 2, 66.67), ("government", 1, 33.33), ("reaction", 1, 33.33)]
    assert rows(topics.topic_cooccurrence(m, sample_posts, 1)) == [("government", "life", 1, 33.33, 1)]
    odd = make_posts(
        [post(0, topics=None), post(1, topics=[]), post(2, topics=[("", "s"), ("p", "s")]), post(3, topics=[("p", "s"), ("p", "t")])]
    )
    m = topics.explode_topics(odd, "publish_time")
    assert rows(topics.topic_ranking(m, odd)) == [("p", 3, 75.0)]
    assert rows(topics.topic_pairs_top(m, odd)) == [("p > s", 2, 50.0), ("p > t", 1, 25.0)]
    assert rows(topics.topic_coverage(m, odd)) == [(2, 4, 50.0)]
    assert rows(topics.topic_cooccurrence(m, odd, 1)) == []


def test_trends_of_two_and_three_times(make_posts):
    def trend(days):
        posts = make_posts([post(i, time=f"2024-01-0{d} 00:00:00", topics=[("p", "s")]) for i, d in enumerate(days)])
        return rows(topics.topic_trends(topics.explode_topics(posts, "publish_time")))

    assert trend([1]) == []
    assert trend([1, 2, 2]) == [("p", 1.0, 2.0, 100.0, "上升")]
    assert trend([1, 2, 3]) == [("p", 1.0, 1.0, 0.0, "平稳")]
    # Four times: the first one against the last two.
    assert trend([1, 1, 2, 3, 4]) == [("p", 2.0, 1.0, -50.0, "下降")]


def test_geography(make_posts):
    posts = make_posts(
        [post(i, location=loc, sentiment_polarity=p) for i, (loc, p) in enumerate(
            [("a", "5")] * 5 + [(" a ", "4")] + [("b", "1")] * 5 + [("c", "3")] * 2 + [("", "3"), (None, None), ("  ", "2")])]
    )
    assert rows(geo.geo_coverage(posts)) == [(16, 13, 3, 81.25)]
    assert [(r.location, r.post_count, r.sentiment_label, r.most_positive, r.most_negative) for r in
            geo.geo_sentiment(posts).orderBy("location").collect()] == [
        ("a", 6, "正面主导", True, False), ("b", 5, "负面主导", False, True)]
    assert [r.sentiment_label for r in geo.geo_ranking(posts).collect()] == ["正面主导", "负面主导", "未知"]
    assert geo.geo_metric_matrix(posts.filter("location = 'a'")).count() == 0


def test_publishers(sample_posts, make_posts):
    first = publishers.top_publishers(sample_posts).first()
    assert (first.publisher, first["count"], first.percentage, first.avg_sentiment) == ("person", 2, 66.67, 3.5)
    unknown = make_posts([post(0, publisher=None), post(1, publisher="")])
    assert publishers.publisher_bar(unknown).first().asDict() == {
        "publisher": "未知", "count": 2, "avg_sentiment": None, "sentiment_class": "未知"}
    assert publishers.correlation_matrix(publishers.post_features(sample_posts)).count() == 0
    top = publishers.influence_summary(sample_posts, 1).first()
    assert (top.total_engagement, top.influence_concentration) == (31 + 2 + 600, round(600 / 633 * 100, 2))


def test_cross_matrix_of_first_topics(sample_posts):
    out = publishers.cross_matrix(sample_posts, "publisher", "topic")
    assert out.count() == 6
    assert {(r.value1, r.value2): r["count"] for r in out.collect() if r["count"]} == {
        ("person", "life"): 1, ("person", "reaction"): 1, ("agency", "government"): 1}


def test_participants(make_posts):
    days = [("a", 1), ("a", 1), ("b", 1), ("a", 2), ("c", 3)]
    posts = make_posts([post(i, user=u, time=f"2024-01-0{d} 00:00:00") for i, (u, d) in enumerate(days)])
    assert rows(publishers.participant_trend(posts), "time") == [
        ("2024-01-01", 3, 2, 2, 3, 2), ("2024-01-02", 1, 1, 0, 0, 2), ("2024-01-03", 1, 1, 1, 1, 3)]


def test_belief_network(sample_posts):
    w0, w2 = math.log1p(25 + 9 + 10), math.log1p(500 + 150 + 200)
    edges = {(r.source, r.target): (r.weight, r.type) for r in graphs.belief_edges(sample_posts).collect()}
    assert edges == {
        ("public safety", "public safety"): (round(w0, 6), "Loop"),
        ("public safety", "risk grows"): (round(w2, 6), "Regular"),
        ("action", "public safety"): (round(w2, 6), "Regular"),
        ("action", "risk grows"): (round(w2, 6), "Regular"),
    }
    nodes = {r.signal: (r.category, r.co_occurrence_weight) for r in graphs.belief_nodes(sample_posts).collect()}
    assert nodes == {s: (c, round(2 * w2, 6)) for s, c in
                     [("public safety", "risk"), ("risk grows", "risk"), ("action", "action")]}


def test_weightless_posts_still_make_edges(make_posts):
    posts = make_posts([post(0, belief_signals=[("c", ["x", "y", "", "x"])])])
    assert rows(graphs.belief_edges(posts)) == [("x", "y", 0.0, "Regular")]


def test_samples(make_posts):
    posts = make_posts([post(i, r=i, sentiment_polarity=str(1 + i % 2)) for i in range(40)])
    assert profile.sample_posts(posts, 10).count() == 10
    assert rows(profile.sample_posts(posts, 5, seed=3)) == rows(profile.sample_posts(posts, 5, seed=3))
    assert [r.post_id for r in profile.sample_posts(posts, 3, "influential").collect()] == [39, 38, 37]
    diverse = profile.sample_posts(posts, 10, "diverse")
    assert diverse.count() == 10 and diverse.select("post_id").distinct().count() == 10
    levels = {r.sentiment_polarity: r["count"] for r in diverse.groupBy("sentiment_polarity").count().collect()}
    assert min(levels.values()) >= 2
    assert profile.sample_posts(posts.limit(4), 10, "diverse").count() == 4


def test_resume(make_posts):
    todo = make_posts([post(0, "a", "2024-01-01"), post(1, "b", None), post(2, "c", "2024-01-01")])
    done = make_posts([post(7, "b", None, sentiment_polarity="4"), post(8, "c", "2024-01-02", sentiment_polarity="1")])
    out = {r.post_id: (r.sentiment_polarity, r.resumed) for r in P.resume_enrichment(todo, done).collect()}
    assert out == {0: (None, False), 1: (4, True), 2: (None, False)}
    assert [r.post_id for r in P.remaining_posts(todo, done).orderBy("post_id").collect()] == [0, 2]


@pytest.mark.parametrize("numbers", [[5, 1, 1, 300, 12, 7], [None] * 6])
def test_event_log_numbers(spark, numbers):
    events = [("r", s, "t", "enter", "s", "n", None, "", "") for s in numbers] + [
        ("q", 3, "t", "exit", "s", "n", " ", "failed", "")]
    from opinionspark.sources.schema import EVENT

    frame = spark.createDataFrame(events, EVENT)
    out = traces.event_log_normalize(frame.repartition(4))
    assert sorted(r.seq for r in out.filter("run_id = 'r'").collect()) == [1, 2, 3, 4, 5, 6]
    assert [r.seq for r in out.filter("run_id = 'q'").collect()] == [1]
    assert {r.branch_id for r in out.collect()} == {"main"}
    assert [(r.run_id, r.current_node) for r in traces.current_location(out).orderBy("run_id").collect()] == [
        ("q", ""), ("r", "n")]


def test_insight_matches_short_and_long_summaries(spark):
    insights = spark.createDataFrame(
        [("i1", "we saw ABC in it"), ("i2", "the long summary text here"), ("i3", "nothing"), ("i4", "a Trend rises")],
        "insight_id STRING, text STRING")
    runs = spark.createDataFrame(
        [(1, "e1", "success", "xy_trend", "abc"), (2, "e2", "failed", "", "Long Summary Text"),
         (3, "e3", "success", "zz_qq", ""), (4, "e4", "success", "aa", "no such thing")],
        "execution_no LONG, id STRING, status STRING, tool_name STRING, summary STRING")
    out = traces.insight_evidence(insights, runs)
    assert sorted((r.insight_id, r.id, r.matched) for r in out.collect()) == [
        ("i1", "e1", True), ("i2", "e2", True), ("i3", "e3", False), ("i3", "e4", False), ("i4", "e1", True)]


def test_insights_meet_executions_of_their_run_only(spark):
    insights = spark.createDataFrame(
        [("r1", "i1", "we saw abc"), ("r2", "i1", "we saw abc"), ("r2", "i2", "a trend"), ("r3", "i1", "abc")],
        "run_id STRING, insight_id STRING, text STRING")
    runs = spark.createDataFrame(
        [("r1", 1, "e1", "success", "xy_trend", "abc"), ("r2", 1, "e2", "success", "qq_trend", "zz zz"),
         ("r2", 2, "e3", "failed", "", "other")],
        "run_id STRING, execution_no LONG, id STRING, status STRING, tool_name STRING, summary STRING")
    found = traces.insight_evidence(insights, runs)
    assert sorted((r.run_id, r.insight_id, r.id, r.matched) for r in found.collect()) == [
        ("r1", "i1", "e1", True), ("r2", "i1", "e2", False), ("r2", "i2", "e2", True)]
    levels = traces.evidence_confidence(insights, found).collect()
    assert sorted((r.run_id, r.insight_id, r.confidence) for r in levels) == [
        ("r1", "i1", "medium"), ("r2", "i1", "medium"), ("r2", "i2", "medium"), ("r3", "i1", "low")]


def test_topic_lists_and_single_mentions_agree(make_posts):
    def topic(parent):
        return {"parent_topic": parent, "sub_topic": "s"}

    lists = [["a", "b", "a"], ["b", "a"], ["c"], [], None, ["a", "", "c", "b"], ["c", "b"], ["a", None]]
    posts = make_posts([post(i, topics=None if t is None else [topic(p) for p in t]) for i, t in enumerate(lists)])
    flat = topics.explode_topics(posts)
    rows = lambda df: sorted(map(tuple, df.collect()))
    for found in (
        lambda m: topics.topic_coverage(m, posts),
        lambda m: topics.topic_cooccurrence(m, posts),
        lambda m: topics.topic_association_matrix(m, 1),
        lambda m: topics.topic_network_nodes(m, 1),
        lambda m: topics.topic_network_edges(m, 1),
    ):
        assert rows(found(posts)) == rows(found(flat))
    assert topics.topic_coverage(posts, posts).first().posts_with_topics == 6
    plan = topics.topic_cooccurrence(posts, posts)._jdf.queryExecution().toString()
    assert "hashpartitioning(post_id" not in plan


def test_registry(sample_posts):
    assert len(TOOLS) == 42
    assert set(registry.chart_tools()) | set(registry.data_tools()) == set(TOOLS)
    assert sum(len(registry.by_category(c)) for c in {t.category for t in TOOLS.values()}) == len(TOOLS)
    assert TOOLS["topic_time_evolution"].parameters == {"granularity": "day", "top_n": 5}
    with pytest.raises(KeyError):
        execute("nothing", sample_posts)


@pytest.mark.parametrize("name", list(TOOLS))
def test_every_tool_runs_on_nested_posts(sample_posts, name):
    for frame in execute(name, sample_posts, output_dir="ignored").values():
        frame.collect()


def test_entity_network_keeps_leading_entities(make_posts):
    from opinionspark.operators import keywords

    texts = ["#aa# @bb @cc", "@bb #aa#", "@cc @dd", "@aa @aa"]
    posts = make_posts([post(i, t) for i, t in enumerate(texts)])
    assert rows(keywords.entity_nodes(posts, 3)) == [("aa", 3), ("bb", 2), ("cc", 2)]
    assert rows(keywords.entity_cooccurrence(posts, 3), "source", "target") == [
        ("aa", "bb", 2), ("aa", "cc", 1), ("bb", "cc", 1)]
    stored = make_posts([post(0, "@zz @yy", entities=["p", "q", "", "p"])])
    assert rows(keywords.entity_cooccurrence(stored)) == [("p", "q", 1)]


def test_log_queries_number_as_the_whole_log(spark, monkeypatch):
    """Numbers of single events against those of the renumbered log, with repeats and missing numbers."""
    rng = random.Random(4)
    rows = [
        (f" r{rng.choice([0, 0, 0, 1, 2])}", rng.choice([None, 1, 2, 5, 9]), f"t{rng.randint(0, 3)}", rng.choice(["enter", "exit"]),
         "s", f"n{rng.randint(0, 2)}", rng.choice([None, " ", "b", "c "]), rng.choice(["failed", "completed"]), "")
        for _ in range(200)
    ]
    events = spark.createDataFrame(rows, EVENT).repartition(5)
    plain = lambda frame: sorted(tuple(r) for r in frame.select(*[f.name for f in EVENT.fields]).collect())
    logs = []
    for most in (1_000_000, 10):
        monkeypatch.setattr(traces, "_RUN_ROWS", most)
        logs.append(plain(traces.event_log_normalize(events)))
    assert logs[0] == logs[1]
    by_number = sorted(logs[0], key=lambda r: (-r[1], [-ord(c) for c in r[0]]))
    assert plain(traces.recent_events(events, 7)) == sorted(by_number[:7])
    failed = [r for r in by_number if r[3] == "exit" and r[7] == "failed"]
    for k in (1, 5, 60):
        assert plain(traces.failed_exits(events, k)) == sorted(failed[:k])
    log = spark.createDataFrame(logs[0], EVENT)
    assert sorted(map(tuple, traces.current_location(events).collect())) == sorted(map(tuple, traces.current_location(log).collect()))
    for name in ("failed_exits", "recent_events", "current_location"):
        plan = getattr(traces, name)(events)._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan.replace("rangepartitioning(seq", "")


def test_sketches_merge(spark, make_posts):
    rng = random.Random(1)
    rows = [post(i, time=f"2024-01-{1 + i % 9:02d} {i % 24:02d}:00:00", user=f"u{rng.randint(0, 30_000)}") for i in range(30_000)]
    posts = make_posts([*rows, post(99_999, time=None), post(99_998, time="2024-01-01 00:00:00", user=None)])
    exact = {r.time: r for r in publishers.participant_trend(posts).collect()}
    sketches = publishers.participant_sketches(posts, "hour")
    about = {r.time: r for r in publishers.participant_trend_approx(sketches, "day").collect()}
    assert set(exact) == set(about)
    for time, r in exact.items():
        assert about[time].active_posts == r.active_posts
        for column in ("active_users", "cumulative_users"):
            assert abs(about[time][column] - r[column]) <= 0.02 * r[column]
    ranges = spark.createDataFrame([(1, "2024-01-02", "2024-01-04"), (2, "2030-01-01", "2030-01-02")], "range_id long, s string, e string")
    ranges = ranges.select("range_id", F.col("s").cast("timestamp_ntz").alias("start"), F.col("e").cast("timestamp_ntz").alias("end"))
    got = {r.range_id: r.users for r in publishers.users_of_ranges(sketches, ranges).collect()}
    users = {r["user_id"] for r in rows if "2024-01-02" <= r["publish_time"][:10] < "2024-01-04"}
    assert got[2] == 0 and abs(got[1] - len(users)) <= 0.02 * len(users)


def test_participant_queries_are_exact_with_many_users(spark, tmp_path):
    """More users than a sketch tells apart."""
    import duckdb

    from opinionspark.plans.oracles import ORACLES
    from opinionspark.plans.queries import QUERIES

    events = spark.range(60_000).selectExpr(
        "id as event_id", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(id * 7919 % 400 as int)) as ts",
        "id * 31 % 40009 as user_id", "'view' as event_type", "cast(id % 500 as double) as value",
    )
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("participant_ranges", "participant_trend_approx"):
        got = sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(duck.execute(ORACLES[name]).fetchall())


def test_evidence_of_one_execution_counts_once_without_a_distinct_over_pairs(spark):
    insights = spark.createDataFrame([("i1", "Alpha beta"), ("i1", "tool gamma s1"), ("i2", "s1 alone"), ("i3", "nothing")], "insight_id string, text string")
    rows = [(1, "e1", "success", t, s) for t in ("alpha_x", "gamma_y") for s in ("s1", "beta")] + [(2, "e2", "failed", "zzz", "s1"), (2, "e2", "failed", "zzz", "s1")]
    runs = spark.createDataFrame(rows, "execution_no long, id string, status string, tool_name string, summary string")
    out = traces.insight_evidence(insights, runs)
    got = sorted((r.insight_id, r.id, r.matched) for r in out.collect())
    assert [g for g in got if g[0] != "i3"] == [("i1", "e1", True), ("i1", "e2", True), ("i2", "e1", True), ("i2", "e2", True)]
    assert {g for g in got if g[0] == "i3"} == {("i3", "e1", False)}
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "Union" in plan[0] and not any("Aggregate" in line for line in plan[1:3])


def test_tfidf_tokens_are_made_once(spark, make_posts, monkeypatch):
    """Ranks equal brute force over several bundles, and the tokenizer sees each post once."""
    from opinionspark.operators import keywords as K

    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<string>")
    def spaces(texts: pd.Series) -> pd.Series:
        seen.add(len(texts))
        return texts.str.split()

    monkeypatch.setattr(K, "_ROOM", 6, raising=False)
    docs = ["b a b c", "", "a a d", "中文 a", " ".join(f"x{i % 7}" for i in range(20)), "c b", None, "a"]
    out = K.keywords_tfidf(make_posts([post(i, d) for i, d in enumerate(docs)]).repartition(2), 3, spaces).collect()
    bags = [(d or "").split() for d in docs]
    df = Counter(t for b in bags for t in set(b))
    expected = {}
    for i, b in enumerate(bags):
        scores = {t: round(n * (math.log((1 + len(docs)) / (1 + df[t])) + 1), 6) for t, n in Counter(b).items()}
        ranked = sorted(scores, key=lambda t: (-scores[t], b.index(t)))[:3]
        expected |= {(i, k): (t, scores[t]) for k, t in enumerate(ranked, 1)}
    found = {(r.post_id, r["rank"]): (r.keyword, r.score) for r in out}
    assert found.keys() == expected.keys() and {k: t for k, (t, _) in found.items()} == {k: t for k, (t, _) in expected.items()}
    assert all(abs(found[k][1] - expected[k][1]) <= 1e-6 for k in found)
    assert seen.value == len(docs)


def test_enriched_tokens_are_made_once(spark, make_posts):
    """Keywords and lexicon sentiment share the tokens of a post."""
    from opinionspark.operators import keywords as K

    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<string>")
    def spaces(texts: pd.Series) -> pd.Series:
        seen.add(len(texts))
        return texts.str.split()

    docs = ["good a good bad", "", None, "hate it"]
    out = K.nlp_enrich(make_posts([post(i, d) for i, d in enumerate(docs)]), tokenizer=spaces)
    assert "_tokens" not in out.columns
    assert [(r.keywords, r.lexicon_sentiment.score) for r in sorted(out.collect(), key=lambda r: r.post_id)] == [
        (["good", "a", "bad"], 1), ([], 0), ([], 0), (["hate", "it"], -1)
    ]
    assert seen.value == len(docs)
