"""Times the headline queries and prints one JSON line.

Every query is forced with the noop sink: one warm-up run, then the median of
three. The similarity jobs run once after a warm session.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from opinionspark.plans.queries import QUERIES  # noqa: E402

REPEATED = (
    "geo_sentiment",
    "geo_topic_matrix",
    "sentiment_distribution",
    "sentiment_time_series",
    "sentiment_trend_series",
    "sentiment_anomalies",
    "focus_window",
    "sentiment_focus_publisher",
    "attribute_trend",
    "topic_frequency",
    "topic_trends",
    "topic_cooccurrence",
    "topic_keyword_trend",
    "cross_matrix",
    "publisher_distribution",
    "influence_summary",
    "correlation_matrix",
    "participant_trend",
    "belief_edges",
    "clean_text",
    "keyword_frequency",
    "keyword_time_matrix",
    "keywords_tfidf",
    "lexicon_distribution",
    "overview_totals",
    "dedup_documents",
    "event_log_normalize",
)
ONCE = ("similar_pairs", "text_clusters")


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def timed(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in REPEATED:
        timed(spark, name, sf_dir)
        seconds[name] = round(statistics.median(timed(spark, name, sf_dir) for _ in range(3)), 3)
    for name in ONCE:
        seconds[name] = round(timed(spark, name, sf_dir), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
