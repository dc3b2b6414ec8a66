"""The analysis tools by name, with their parameters and defaults.

``execute(name, posts, **params)`` gives the tool's result frames by name.
Chart tools give the data behind the chart. Nothing runs until a frame is
used, and parameters a tool does not know are ignored.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import geo, graphs, keywords, publishers, sentiment, similarity, timeline, topics

# The tool categories.
SENTIMENT, FOCUS, TOPIC, GEO = "情感趋势分析", "焦点窗口分析", "主题演化分析", "地理分布分析"
INTERACTION, BELIEF, NLP = "多维交互分析", "信念系统分析", "NLP增强分析"

Frames = dict[str, DataFrame]


@dataclass(frozen=True)
class Tool:
    name: str
    category: str
    run: Callable[..., Frames]
    generates_chart: bool

    @property
    def parameters(self) -> dict:
        """Optional parameters with their defaults."""
        return {k: p.default for k, p in list(inspect.signature(self.run).parameters.items())[1:]}


def _mentions(posts: DataFrame) -> DataFrame:
    return topics.explode_topics(posts, "publish_time", "location", "publisher")


def _sentiment_series(posts, granularity="hour"):
    return {
        "time_series": sentiment.sentiment_time_series(posts, granularity),
        "growth_rate": sentiment.growth_rate(posts, granularity),
        "bucket_trend": sentiment.sentiment_bucket_trend(posts, granularity),
        "focus_window": timeline.focus_window(posts),
        "focus_bucket_trend": sentiment.sentiment_focus_buckets(posts),
        "focus_numeric_polarity": sentiment.sentiment_focus_daily(posts),
        "focus_publisher": sentiment.sentiment_focus_publisher(posts),
        "attribute_trend": sentiment.attribute_trend(posts, granularity),
        "attribute_turning_points": sentiment.attribute_turning_points(posts, granularity),
        "trend": sentiment.sentiment_trend_label(posts, granularity),
        "peak_periods": sentiment.peak_periods(posts, granularity),
        "volume_spikes": sentiment.volume_spikes(posts, granularity),
        "turning_points": sentiment.turning_points(posts, granularity),
        "hourly_distribution": sentiment.hourly_distribution(posts),
        "peak_hours": sentiment.peak_hours(posts),
    }


def _topic_frequency(posts):
    m = _mentions(posts)
    return {
        "topics": topics.topic_frequency(m, posts),
        "top_topic_pairs": topics.topic_pairs_top(m, posts),
        "coverage": topics.topic_coverage(posts, posts),
    }


def _topic_evolution(posts, granularity="day", top_n=5):
    m = _mentions(posts)
    return {
        "time_series": topics.topic_time_evolution(m, granularity, top_n),
        "trends": topics.topic_trends(m, granularity, top_n),
        "focus_window": timeline.focus_window(posts),
        "focus_trend": topics.topic_focus_trend(m, posts, 14, top_n),
        "focus_keywords": topics.topic_focus_keywords(posts),
    }


def _topic_pairs(posts, min_support=2):
    return {
        "cooccurrence_pairs": topics.topic_cooccurrence(posts, posts, min_support),
        "association_matrix": topics.topic_association_matrix(posts, min_support),
    }


def _topic_network(posts, min_support=3):
    return {
        "nodes": topics.topic_network_nodes(posts, min_support),
        "edges": topics.topic_network_edges(posts, min_support),
    }


def _publishers(posts):
    return {
        "distribution": publishers.publisher_distribution(posts),
        "top_publishers": publishers.top_publishers(posts),
        "top_accounts": publishers.top_accounts(posts),
        "representative_posts": publishers.representative_posts(posts),
    }


def _influence(posts, top_n=20):
    return {
        "top_influential_posts": publishers.influence_top(posts, top_n),
        "summary": publishers.influence_summary(posts, top_n),
        "publisher_influence": publishers.publisher_influence(posts),
    }


def _correlation(posts):
    features = publishers.post_features(posts)
    return {
        "correlation_matrix": publishers.correlation_matrix(features),
        "significant_correlations": publishers.correlation_significant(features),
    }


def _cross(posts, dim1="publisher", dim2="sentiment_polarity"):
    return {"matrix": publishers.cross_matrix(posts, dim1, dim2)}


def _beliefs(posts, event_name="belief_network"):
    named = F.lit(event_name)
    return {
        "nodes": graphs.belief_network_nodes(posts).withColumn("event_name", named),
        "edges": graphs.belief_edges(posts).withColumn("event_name", named),
        "edge_strength": graphs.belief_network_edges(posts).withColumn("event_name", named),
    }


def _geo(posts):
    return {
        "distribution": geo.geo_distribution(posts),
        "coverage": geo.geo_coverage(posts),
        "top_locations": geo.geo_top(posts),
    }


_TOOLS = (
    Tool("sentiment_distribution_stats", SENTIMENT,
         lambda posts: {"distribution": sentiment.sentiment_distribution(posts)}, False),
    Tool("sentiment_time_series", SENTIMENT, _sentiment_series, False),
    Tool("sentiment_anomaly_detection", SENTIMENT,
         lambda posts, threshold=2.0: {
             "anomalies": sentiment.sentiment_anomalies(posts, threshold),
             "volume_spikes": sentiment.volume_spikes(posts)}, False),
    Tool("sentiment_trend_chart", SENTIMENT,
         lambda posts, granularity="hour": {"series": sentiment.sentiment_trend_series(posts, granularity)}, True),
    Tool("sentiment_pie_chart", SENTIMENT, lambda posts: {"slices": sentiment.sentiment_share(posts)}, True),
    Tool("sentiment_bucket_trend_chart", SENTIMENT,
         lambda posts, granularity="hour": {"series": sentiment.sentiment_bucket_trend(posts, granularity)}, True),
    Tool("sentiment_attribute_trend_chart", SENTIMENT,
         lambda posts, granularity="day", top_n=6: {
             "series": sentiment.attribute_trend(posts, granularity, top_n),
             "focus_window": timeline.focus_window(posts)}, True),
    Tool("sentiment_focus_window_chart", FOCUS,
         lambda posts, window_days=14: {
             "focus_window": timeline.focus_window(posts, window_days),
             "daily_avg": sentiment.sentiment_focus_daily(posts, window_days),
             "bucket_trend": sentiment.sentiment_focus_buckets(posts, window_days)}, True),
    Tool("sentiment_focus_publisher_chart", FOCUS,
         lambda posts, window_days=14, top_n=5: {
             "focus_window": timeline.focus_window(posts, window_days),
             "publisher_mean": sentiment.sentiment_focus_publisher(posts, window_days, top_n)}, True),
    Tool("topic_frequency_stats", TOPIC, _topic_frequency, False),
    Tool("topic_time_evolution", TOPIC, _topic_evolution, False),
    Tool("topic_cooccurrence_analysis", TOPIC, _topic_pairs, False),
    Tool("topic_ranking_chart", TOPIC,
         lambda posts, top_n=10: {"ranking": topics.topic_ranking(_mentions(posts), posts, top_n)}, True),
    Tool("topic_evolution_chart", TOPIC,
         lambda posts, granularity="day", top_n=5: {
             "series": topics.topic_evolution_dense(_mentions(posts), granularity, top_n)}, True),
    Tool("topic_focus_evolution_chart", TOPIC,
         lambda posts, granularity="day", top_n=5: {
             "series": topics.topic_focus_evolution(_mentions(posts), posts, granularity, top_n)}, True),
    Tool("topic_focus_distribution_chart", FOCUS,
         lambda posts, window_days=14, top_n=5: {
             "focus_window": timeline.focus_window(posts, window_days),
             "series": topics.topic_focus_distribution(_mentions(posts), posts, window_days, top_n)}, True),
    Tool("topic_keyword_trend_chart", TOPIC,
         lambda posts, granularity="day", top_n=8: {
             "series": topics.topic_keyword_trend(posts, granularity, top_n)}, True),
    Tool("topic_network_chart", TOPIC, _topic_network, True),
    Tool("geographic_distribution_stats", GEO, _geo, False),
    Tool("geographic_hotspot_detection", GEO,
         lambda posts, threshold_percentile=90: {"hotspots": geo.geo_hotspots(posts, threshold_percentile)}, False),
    Tool("geographic_sentiment_analysis", GEO,
         lambda posts, min_posts=5: {"regional_analysis": geo.geo_sentiment(posts, min_posts)}, False),
    Tool("geographic_heatmap", GEO, lambda posts: {"matrix": geo.geo_metric_matrix(posts)}, True),
    Tool("geographic_bar_chart", GEO, lambda posts, top_n=15: {"ranking": geo.geo_ranking(posts, top_n)}, True),
    Tool("geographic_sentiment_bar_chart", GEO,
         lambda posts, top_n=12: {"comparison": geo.geo_sentiment_compare(posts, top_n)}, True),
    Tool("geographic_topic_heatmap", GEO,
         lambda posts, top_regions=10, top_topics=8: {
             "matrix": geo.geo_topic_matrix(_mentions(posts), top_regions, top_topics)}, True),
    Tool("geographic_temporal_heatmap", GEO,
         lambda posts, granularity="day", top_regions=8: {
             "matrix": geo.geo_time_matrix(posts, granularity, top_regions)}, True),
    Tool("publisher_distribution_stats", INTERACTION, _publishers, False),
    Tool("cross_dimension_matrix", INTERACTION, _cross, False),
    Tool("influence_analysis", INTERACTION, _influence, False),
    Tool("correlation_analysis", INTERACTION, _correlation, False),
    Tool("interaction_heatmap", INTERACTION, _cross, True),
    Tool("publisher_bar_chart", INTERACTION, lambda posts: {"bars": publishers.publisher_bar(posts)}, True),
    Tool("publisher_sentiment_bucket_chart", INTERACTION,
         lambda posts, top_n=10: {"buckets": publishers.publisher_buckets(posts, top_n)}, True),
    Tool("publisher_topic_distribution_chart", INTERACTION,
         lambda posts, top_publishers=8, top_topics=8: {
             "matrix": publishers.publisher_topics(_mentions(posts), top_publishers, top_topics)}, True),
    Tool("participant_trend_chart", INTERACTION,
         lambda posts, granularity="day": {"series": publishers.participant_trend(posts, granularity)}, True),
    Tool("publisher_focus_distribution_chart", FOCUS,
         lambda posts, window_days=14, top_n=5: {
             "focus_window": timeline.focus_window(posts, window_days),
             "series": publishers.publisher_focus(posts, window_days, top_n)}, True),
    Tool("belief_network_chart", BELIEF, _beliefs, True),
    Tool("keyword_wordcloud", NLP,
         lambda posts, top_n=30, tokenizer=T.word_tokens: {
             "keywords": keywords.keyword_frequency(posts, top_n, tokenizer)}, True),
    Tool("entity_cooccurrence_network", NLP,
         lambda posts, top_n=15: {
             "nodes": keywords.entity_nodes(posts, top_n), "edges": keywords.entity_cooccurrence(posts, top_n)}, True),
    Tool("text_cluster_analysis", NLP,
         lambda posts, threshold=0.85, min_cluster_size=2, tokenizer=T.word_tokens: {
             "clusters": similarity.text_cluster_sizes(posts, threshold, min_cluster_size, tokenizer=tokenizer)}, True),
    Tool("sentiment_lexicon_comparison", NLP,
         lambda posts, tokenizer=T.word_tokens: {
             "distribution": keywords.lexicon_distribution(posts, tokenizer)}, True),
    Tool("temporal_keyword_heatmap", NLP,
         lambda posts, top_n=10, granularity="day", tokenizer=T.word_tokens: {
             "matrix": keywords.keyword_time_matrix(posts, top_n, granularity, tokenizer)}, True),
)

TOOLS: dict[str, Tool] = {t.name: t for t in _TOOLS}


def by_category(category: str) -> list[Tool]:
    return [t for t in _TOOLS if t.category == category]


def chart_tools() -> list[str]:
    return [t.name for t in _TOOLS if t.generates_chart]


def data_tools() -> list[str]:
    return [t.name for t in _TOOLS if not t.generates_chart]


def execute(name: str, posts: DataFrame, **params) -> Frames:
    """The result frames of a tool over normalised posts."""
    if name not in TOOLS:
        raise KeyError(f"unknown tool {name!r}; known: {', '.join(TOOLS)}")
    tool = TOOLS[name]
    return tool.run(posts, **{k: v for k, v in params.items() if k in tool.parameters})
