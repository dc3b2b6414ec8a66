"""Search queries and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIELDS = ("title", "url", "snippet", "date", "source")


def normalize_queries(queries: Column, limit: int = 5) -> Column:
    """Trimmed, non-empty, distinct queries in order, at most ``limit``."""
    trimmed = F.filter(F.transform(queries, lambda q: F.trim(q)), lambda q: q != "")
    return F.slice(F.array_distinct(trimmed), 1, limit)


def flatten_documents(rows: DataFrame) -> DataFrame:
    """One trimmed document per search result."""
    flat = rows.select("row_id", F.trim("query").alias("query"), F.posexplode("results").alias("pos", "r"))
    return flat.select(
        "row_id", "pos", "query", *[F.trim(F.coalesce(f"r.{f}", F.lit(""))).alias(f) for f in _FIELDS]
    )


def dedup_documents(rows: DataFrame) -> DataFrame:
    """The first document per url, or per title and snippet without a url.

    The first is a minimum over (row, position), combined before the shuffle,
    so a document repeated in a third of all results is no hot spot.
    """
    docs = flatten_documents(rows)
    key = F.coalesce(F.nullif("url", F.lit("")), F.concat("title", F.lit("|"), "snippet"))
    first = F.min(F.struct("row_id", "pos", "query", *_FIELDS)).alias("d")
    return docs.groupBy(key.alias("key")).agg(first).select("d.*")


def search_totals(rows: DataFrame) -> DataFrame:
    """Results per query and, with a null query, in total."""
    hits = F.coalesce(F.size("results"), F.lit(0))
    return rows.select(F.trim("query").alias("query"), hits.alias("n")).rollup("query").agg(
        F.sum("n").alias("results")
    )


def search_sufficiency(documents: DataFrame, max_rounds: int = 2, enough: int = 4) -> DataFrame:
    """Per search round, whether its documents suffice."""
    grouped = documents.groupBy("round").agg(F.count(F.lit(1)).alias("documents_count"))
    return grouped.withColumn(
        "is_sufficient", (F.col("documents_count") >= enough) | (F.col("round") >= max(1, max_rounds))
    )
