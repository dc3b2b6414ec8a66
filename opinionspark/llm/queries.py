"""One registered query per operator, over its whole table, and SQL oracles where SQL can tell the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat,
    language,
    lexical,
    merkle,
    minhash,
    mixing,
    packing,
    quality,
    rules,
    suffixes,
    topk,
    toxicity,
    warc,
)
from .common import table, tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_chat_formatting": lambda spark, d: chat.chat_digests(table(spark, d, "conversations")),
    "op2_minhash_dedup": lambda spark, d: minhash.near_duplicates(table(spark, d, "documents")),
    "op3_suffix_array_dedup": lambda spark, d: suffixes.substring_digests(table(spark, d, "documents")),
    "op4_exact_top_k": lambda spark, d: topk.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0),
    "op5_quality_classifier": lambda spark, d: quality.quality_scores(
        table(spark, d, "documents"), table(spark, d, "labels")
    ),
    "op6_source_mixing": lambda spark, d: mixing.mix_sources(table(spark, d, "documents")),
    "op9_toxicity": lambda spark, d: toxicity.toxicity_scores(
        table(spark, d, "documents"), table(spark, d, "labels")
    ),
    "op10_best_fit_packing": lambda spark, d: packing.pack_documents(
        table(spark, d, "documents"), tokenizer_path("word_bpe_49k.json")
    ),
    "op7_warc": lambda spark, d: warc.archive_pages(table(spark, d, "pages")),
    "op8_quality_rules": lambda spark, d: rules.quality_rules(table(spark, d, "documents")),
    "op11_ranked_search": lambda spark, d: lexical.ranked_search(
        table(spark, d, "documents"), table(spark, d, "benchmark")
    ),
    "op12_merkle_manifest": lambda spark, d: merkle.manifest_proofs(table(spark, d, "documents")),
    "op13_language_id": lambda spark, d: language.languages(table(spark, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op4_exact_top_k": topk.TOP_K_SQL,
    "op7_warc": warc.PAGES_SQL,
    "op1_chat_formatting": chat.DIGESTS_SQL,
    "op11_ranked_search": lexical.SEARCH_SQL,
    "op12_merkle_manifest": merkle.PROOFS_SQL,
}
