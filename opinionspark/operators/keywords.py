"""Keyword, entity and lexicon operators over post texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import time_label
from ..plans.checkpoints import stored
from ..plans.shapes import bucketed, top, top_keys, zero_filled
from .bundles import PART, cut, grown, in_parts, named_tokens, shrunk, tokens_of
from .topics import unordered_pairs

_ROOM = 1 << 19  # tokens of a bundle
_TOKENS = "_tokens"  # no column of posts


def _stored_or(posts: DataFrame, name: str, computed):
    """The stored list when a post has one, else the computed list."""
    if name not in posts.columns:
        return computed
    return F.when(F.size(F.col(name)) > 0, F.col(name)).otherwise(computed)


def clean_posts(posts: DataFrame) -> DataFrame:
    return posts.select("post_id", T.clean_text("content").alias("clean"))


def post_tokens(posts: DataFrame, tokenizer: T.Tokenizer = T.word_tokens) -> DataFrame:
    return posts.select("post_id", T.tokenize("content", tokenizer).alias("tokens"))


def content_word_counts(posts: DataFrame) -> DataFrame:
    """Content words per post with their counts, all within the row."""
    counted = posts.select("post_id", F.inline(T.token_counts(T.content_words("content"))))
    return counted.select("post_id", F.col("token").alias("word"), F.col("n").cast("bigint").alias("n"))


def keywords_topn(posts: DataFrame, top_n: int = 10, tokenizer: T.Tokenizer = T.word_tokens) -> DataFrame:
    """A post's most frequent tokens; earlier first on equal counts."""
    ranked = posts.select("post_id", F.posexplode(T.ranked_tokens(T.tokenize("content", tokenizer), top_n)).alias("i", "k"))
    return ranked.select(
        "post_id",
        (F.col("i") + 1).cast("bigint").alias("rank"),
        F.col("k.token").alias("keyword"),
        (-F.col("k.rank")).cast("bigint").alias("n"),
    )


def keywords_tfidf(posts: DataFrame, top_n: int = 10, tokenizer: T.Tokenizer = T.word_tokens) -> DataFrame:
    """A post's tokens ranked by count × smoothed inverse document frequency.

    Tokens are made once. Posts are bundled where they lie (see ``bundles``), each bundle gets the document
    frequencies of its distinct tokens, a row for each part of them, and ranks the tokens of its posts. So
    neither a row for each token of each post nor a post's tokens are shuffled.
    """
    spark, kind = posts.sparkSession, posts.schema["post_id"].dataType.simpleString()
    parts, total = int(spark.conf.get("spark.sql.shuffle.partitions")), posts.count()
    rows = posts.select("post_id", T.tokenize("content", tokenizer).alias("tokens"))
    bundles = stored(
        rows.mapInArrow(
            _postings(parts, _ROOM),
            f"block long, posts array<{kind}>, parts array<{PART}>, sizes binary, words binary, counts binary, places binary",
        )
    )
    names = named_tokens(bundles, parts).groupBy("block").agg(F.collect_list(F.struct("part", "df")).alias("names"))
    return bundles.join(names, "block").mapInArrow(
        _ranked(total, top_n), f"post_id {kind}, rank long, keyword string, score double"
    )


def _postings(parts: int, room: int):
    """The function that bundles the posts of each partition, about ``room`` tokens in one row."""

    def bundle(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for rows in cut(batches, room):
            tokens = rows.column("tokens").combine_chunks()
            words = tokens.flatten().dictionary_encode()
            sizes, codes, known = np.asarray(tokens.value_lengths()), words.indices.to_numpy(), len(words.dictionary)
            text = np.repeat(np.arange(len(rows)), sizes)
            key = text * known + codes
            order = np.argsort(key, kind="stable")
            key = key[order]
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            at = order[begin]  # where a post has a token first
            place, made = in_parts(words.dictionary, np.bincount(codes[at], minlength=known), parts)
            values = [
                np.bincount(text[at], minlength=len(rows)), place[codes[at]], np.diff(np.r_[begin, len(key)]),
                at - (np.cumsum(sizes) - sizes)[text[at]],
            ]
            held = pa.ListArray.from_arrays([0, len(rows)], rows.column("post_id").combine_chunks())
            columns = [pa.array([shrunk(v.astype(np.int32))], pa.binary()) for v in values]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), held, made, *columns],
                names=["block", "posts", "parts", "sizes", "words", "counts", "places"],
            )
            block += 1

    return bundle


def _ranked(total: int, top_n: int):
    """The function from bundles with document frequencies to each post's leading tokens."""

    def rank(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                sizes, words, counts, places = (
                    grown(batch.column(c)[row].as_py(), "int32") for c in ("sizes", "words", "counts", "places")
                )
                held = batch.column("parts")[row].as_py()
                tokens = pa.concat_arrays([tokens_of(p["sizes"], p["bytes"]) for p in held])
                told = sorted((n["part"], n["df"]) for n in batch.column("names")[row].as_py())
                df = np.concatenate([grown(n, "int32") for _, n in told])
                value = counts * (np.log((total + 1.0) / (df + 1.0)) + 1.0)[words]
                # As values.rnd does: half up at the twelfth place, then at the sixth.
                score = np.floor((np.floor(value * 1e12 + 0.5) + 500_000) / 1_000_000) / 1e6
                text = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((places, -score, text))
                # Sorted by post, so the posts stand as before.
                ranks = np.arange(len(order)) - (np.cumsum(sizes) - sizes)[text]
                best, kept = order[ranks < top_n], ranks < top_n
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("posts")[row].values.take(pa.array(text[kept])), pa.array(ranks[kept] + 1, pa.int64()),
                        tokens.take(pa.array(words[best])).cast(pa.string()), pa.array(score[best]),
                    ],
                    names=["post_id", "rank", "keyword", "score"],
                )

    return rank


def post_entities(posts: DataFrame) -> DataFrame:
    return posts.select("post_id", F.posexplode(T.entities("content")).alias("pos", "entity"))


def post_lexicon(posts: DataFrame, tokenizer: T.Tokenizer = T.word_tokens) -> DataFrame:
    return posts.select("post_id", T.lexicon_sentiment("content", tokenizer).alias("s")).select("post_id", "s.*")


def nlp_enrich(
    posts: DataFrame, groups: DataFrame | None = None, keyword_top_n: int = 8, tokenizer: T.Tokenizer = T.word_tokens
) -> DataFrame:
    """Posts with keywords, entities and lexicon sentiment, and with the
    similarity group when cluster ids (post_id, text_similarity_group) are given."""
    base = posts.drop("text_similarity_group") if groups is not None else posts
    # Tokens are made once: the generator evaluates them before anything reads them.
    tokens = T.tokenize("content", tokenizer)
    made = base.select("*", F.inline(F.array(F.struct(tokens.alias(_TOKENS)))))
    ranked = T.ranked_tokens(F.col(_TOKENS), keyword_top_n)
    enriched = made.withColumns(
        {
            "keywords": F.transform(ranked, lambda x: x["token"]),
            "entities": T.entities("content"),
            "lexicon_sentiment": T.lexicon_sentiment("content", tokens=F.col(_TOKENS)),
        }
    ).drop(_TOKENS)
    return enriched if groups is None else enriched.join(groups, "post_id", "left")


def _keyword_rows(posts: DataFrame, top_n: int, tokenizer: T.Tokenizer) -> DataFrame:
    words = _stored_or(posts, "keywords", T.keywords("content", top_n, tokenizer))
    return posts.select("publish_time", F.explode(words).alias("keyword")).filter(
        F.nullif(F.col("keyword"), F.lit("")).isNotNull()
    )


def keyword_frequency(posts: DataFrame, top_n: int = 30, tokenizer: T.Tokenizer = T.word_tokens) -> DataFrame:
    """Keywords by the number of posts that have them in their keyword list."""
    counts = _keyword_rows(posts, top_n, tokenizer).groupBy("keyword").agg(F.count(F.lit(1)).alias("count"))
    return top(counts, top_n, "count", "keyword")


def keyword_time_matrix(
    posts: DataFrame, top_n: int = 10, granularity: str = "day", tokenizer: T.Tokenizer = T.word_tokens
) -> DataFrame:
    """Leading keywords × times that have any of them, zero-filled."""
    counts = bucketed(_keyword_rows(posts, top_n, tokenizer), granularity).groupBy("bucket", "keyword").agg(
        F.count(F.lit(1)).alias("n")
    )
    keep = top_keys(counts, "keyword", top_n)
    return zero_filled(counts, ["bucket"], "keyword", keep, only_kept=True).select(
        time_label("bucket", granularity).alias("time"), "keyword", F.col("n").alias("count")
    )


def _entity_lists(posts: DataFrame) -> DataFrame:
    """How many posts have each list of entities."""
    found = _stored_or(posts, "entities", T.entities("content"))
    named = F.sort_array(F.array_distinct(F.filter(found, lambda e: F.nullif(e, F.lit("")).isNotNull())))
    return (
        posts.select(named.alias("entities")).filter(F.size("entities") > 0).groupBy("entities").agg(
            F.count(F.lit(1)).alias("n"))
    )


def entity_nodes(posts: DataFrame, top_n: int = 15) -> DataFrame:
    counts = _entity_lists(posts).select("n", F.explode("entities").alias("entity")).groupBy("entity").agg(
        F.sum("n").alias("count")
    )
    return top(counts, top_n, "count", "entity")


def entity_cooccurrence(posts: DataFrame, top_n: int = 15) -> DataFrame:
    """Pairs of leading entities in one post.

    Lists are cut to the few leading entities first, so a post yields at most
    ``top_n`` squared over two pairs.
    """
    lists = _entity_lists(posts)
    counts = lists.select("n", F.explode("entities").alias("entity"))
    keep = top_keys(counts, "entity", top_n)
    kept = lists.withColumn("_keep", keep).select(
        F.sort_array(F.array_intersect("entities", "_keep")).alias("entities"), "n"
    )
    kept = kept.groupBy("entities").agg(F.sum("n").alias("n"))
    return (
        kept.select("n", F.inline(unordered_pairs("entities")))
        .groupBy(F.col("a").alias("source"), F.col("b").alias("target"))
        .agg(F.sum("n").alias("weight"))
    )


def lexicon_distribution(posts: DataFrame, tokenizer: T.Tokenizer = T.word_tokens) -> DataFrame:
    """Posts per lexicon label; a stored label wins."""
    label = T.lexicon_sentiment("content", tokenizer)["label"]
    if "lexicon_sentiment" in posts.columns:
        label = F.coalesce(F.col("lexicon_sentiment.label"), label)
    return posts.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("count"))
