"""Reading, normalising, writing and resuming post tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import percent
from .json_records import read_objects
from .snapshots import read_snapshot, version_folder, write_snapshot, write_version
from .schema import BELIEF, ENRICHED_FIELDS, FILE_POST, POST_KEY, RAW_POST, TOPIC, VARIED


def normalize_posts(raw: DataFrame) -> DataFrame:
    """Type a raw post table: bad times and numbers become null, counts at least 0.

    Wall-clock times carry no zone, hence TIMESTAMP_NTZ. Missing columns of the
    post schema are added as nulls, so later steps can rely on all of them.
    """
    have = set(raw.columns)
    full = raw.withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in RAW_POST.fields if f.name not in have}
    )

    def number(name: str, kind: str) -> Column:
        return F.expr(f"try_cast(try_cast({name} AS DOUBLE) AS {kind})")

    def count(name: str) -> Column:
        return F.greatest(F.coalesce(number(name, "BIGINT"), F.lit(0)), F.lit(0)).cast("bigint")

    level = number("sentiment_polarity", "INT")
    return full.withColumns(
        {
            "publish_time": F.expr("try_cast(publish_time AS TIMESTAMP_NTZ)"),
            "repost_count": count("repost_count"),
            "comment_count": count("comment_count"),
            "like_count": count("like_count"),
            "followers_count": number("followers_count", "BIGINT"),
            "sentiment_polarity": F.when(level.between(1, 5), level),
            "location": F.coalesce(F.trim("location"), F.lit("")),
        }
    )


def _listed(text: Column) -> Column:
    """The elements of a JSON list, objects as JSON text; a single value is a list of one; null stays null."""
    value = F.trim(text)
    return F.when(F.startswith(value, F.lit("[")), F.from_json(value, "array<string>")).when(
        value != "", F.array(value)
    ).when(text.isNotNull(), F.array().cast("array<string>"))


def _text(item: Column, *names: str) -> Column:
    """The first non-empty of some fields of a JSON object."""
    return F.coalesce(*[F.nullif(F.get_json_object(item, f"$.{n}"), F.lit("")) for n in names])


def _belief(item: Column) -> Column:
    """A belief entry in one shape, whichever of its known spellings it has; a bare string is a category."""
    subs = _listed(_text(item, "subcategories", "Subcategories"))
    own = F.filter(F.array(_text(item, "subcategory", "Subcategory")), lambda x: x.isNotNull())
    listed = F.concat(own, F.coalesce(subs, F.array().cast("array<string>")))
    given = F.struct(
        _text(item, "category", "Category").alias("category"), F.when(F.size(listed) > 0, listed).alias("subcategories")
    )
    bare = F.struct(item.alias("category"), F.lit(None).cast("array<string>").alias("subcategories"))
    return F.when(F.startswith(item, F.lit("{")), given).otherwise(bare).cast(BELIEF)


def _topic(item: Column) -> Column:
    """A topic entry; a bare string is a parent topic."""
    given = F.struct(
        F.get_json_object(item, "$.parent_topic").alias("parent_topic"), F.get_json_object(item, "$.sub_topic").alias("sub_topic")
    )
    bare = F.struct(item.alias("parent_topic"), F.lit(None).cast("string").alias("sub_topic"))
    return F.when(F.startswith(item, F.lit("{")), given).otherwise(bare).cast(TOPIC)


def shaped(raw: DataFrame) -> DataFrame:
    """Posts of a file, with lists where the file has a list, a single value or an object."""
    made = {"belief_signals": _belief, "topics": _topic}
    return raw.withColumns(
        {c: F.transform(_listed(F.col(c)), made[c]) if c in made else _listed(F.col(c)) for c in VARIED if c in raw.columns}
    )


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Parquet posts; those without an id get their place in the files, taken in order of their names.

    The place doesn't depend on how files are split into tasks.
    """
    rows = read_snapshot(spark, path)
    if "post_id" not in rows.columns:
        rows = rows.withColumn("post_id", F.lit(None).cast("long"))
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = placed.groupBy("_file").agg(F.max("_row").alias("_last"))
    before = F.sum(F.col("_last") + 1).over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_file", F.coalesce(before, F.lit(0)).alias("_start"))
    made = F.coalesce("post_id", F.col("_start") + F.col("_row"))
    return placed.join(starts, "_file").withColumn("post_id", made).drop("_file", "_row", "_start")


def read_posts(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Posts from JSON array files (``json``), JSON lines (``jsonl``), or Parquet.

    A broken record is an error: no post is lost in silence. ``json_rejects``
    lists the broken lines of JSON lines. Scalars where lists belong, and all
    spellings of belief entries, are read alike.

    Arrays are read by many tasks, wherever their lines end, see
    ``json_records``; JSON posts are stored as Parquet below the shared folder
    once. Posts without an id get their place: the bytes, or for Parquet the rows,
    ahead of them, files in order of their names, whatever the splits.
    """
    if fmt == "parquet":
        return normalize_posts(_numbered(spark, path))
    found = read_objects(spark, path, FILE_POST).select("object.*", "place")
    return normalize_posts(shaped(found.withColumn("post_id", F.coalesce("post_id", "place")).drop("place")))


def _array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mark = "["
    for batch in batches:
        lines = []
        for value in batch["value"].to_pylist():
            lines.append(mark + value)
            mark = ","
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"])], ["value"])


def write_json_arrays(rows: DataFrame, path: str) -> None:
    """Rows as JSON arrays, one file for each partition, with an object on each line; nulls are left out."""
    objects = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    objects.mapInArrow(_array_lines, "value string").write.text(path)


def json_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(line): the lines of JSON lines that aren't JSON objects."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    bad = F.try_parse_json("value").isNull() | ~F.startswith(F.trim("value"), F.lit("{"))
    return lines.filter(bad).select(F.col("value").alias("line"))


def enhancement_rate(posts: DataFrame) -> DataFrame:
    """Share of posts on which all four label fields are present."""
    complete = F.lit(True)
    for name in ENRICHED_FIELDS:
        complete = complete & F.col(name).isNotNull()
    return posts.agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(complete).alias("valid_count")
    ).select("total_count", "valid_count", percent(F.col("valid_count"), F.col("total_count")).alias("enhancement_rate"))


def read_enriched(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Enriched posts and their enhancement rate."""
    posts = read_posts(spark, path, fmt)
    return posts, enhancement_rate(posts)


def read_taxonomy(spark: SparkSession, path: str, parent: str = "parent_topic", subs: str = "sub_topics",
                  sub: str = "sub_topic") -> DataFrame:
    """A two-level vocabulary file, one JSON array, as (parent, sub) rows."""
    schema = f"{parent} STRING, {subs} ARRAY<STRING>"
    nested = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return nested.select(parent, F.explode(subs).alias(sub))


def read_beliefs(spark: SparkSession, path: str) -> DataFrame:
    return read_taxonomy(spark, path, "category", "subcategories", "subcategory")


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of strings as (ord, value) rows."""
    text = spark.read.text(path, wholetext=True)
    values = F.from_json("value", "array<string>")
    return text.select(F.posexplode(values).alias("ord", "value"))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """The ordered decision categories as (ord, value) rows."""
    text = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "array<struct<category:string>>")
    return text.select(F.posexplode(items).alias("ord", "item")).select("ord", F.col("item.category").alias("value"))


def write_enriched(posts: DataFrame, path: str) -> int:
    """Save the whole table by publish date as its new version; the one before stays until this one is complete.

    The rebalance hint clusters rows by date before the write: adaptive
    execution joins small days into one task, and splits a day that holds a
    third of all posts over several tasks and files. Returns the version.
    """
    dated = posts.withColumn("publish_date", F.to_date("publish_time")).hint("rebalance", "publish_date")
    return write_snapshot(dated, path, ("publish_date",))


def write_result(result: DataFrame, path: str) -> int:
    """Save a result as the new version of its table."""
    return write_snapshot(result, path)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """The last version of a table, or a plain Parquet folder."""
    return read_snapshot(spark, path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> int:
    """Node and edge tables as CSV with a header, both in one new version; see ``read_graph``."""

    def write(target: str) -> None:
        nodes.write.option("header", True).csv(f"{target}/nodes")
        edges.write.option("header", True).csv(f"{target}/edges")

    return write_version(nodes.sparkSession, path, write)


def read_graph(spark: SparkSession, path: str, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the last version, with the given schemas."""
    at = version_folder(spark, path)
    found = [spark.read.schema(s).option("header", True).csv(f"{at}/{n}") for n, s in (("nodes", nodes), ("edges", edges))]
    return found[0], found[1]


def _digest() -> Column:
    """128 bits that stand for a post's key, nulls included, so that no text is a shuffle key."""
    return F.md5(F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in POST_KEY])))


def _same_key() -> Column:
    same = F.lit(True)
    for k in POST_KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"_key.{k}"))
    return same


def _first_per_key(done: DataFrame, fields: list[str]) -> DataFrame:
    first = F.min_by(F.struct(F.struct(*fields).alias("old"), F.struct(*POST_KEY).alias("key")), F.col("post_id"))
    return done.groupBy(_digest().alias("_digest")).agg(first.alias("f")).select(
        "_digest", F.col("f.old").alias("_old"), F.col("f.key").alias("_key")
    )


def resume_enrichment(posts: DataFrame, done: DataFrame) -> DataFrame:
    """Posts with the labels an earlier run already gave them.

    A post is the same when content, time, user id and name agree (nulls
    agree with nulls); of several earlier copies the first one counts.
    """
    fields = [c for c in done.columns if c in posts.columns and c not in POST_KEY and c != "post_id"]
    old = _first_per_key(done, fields)
    joined = posts.withColumn("_own", _digest()).join(old, (F.col("_own") == F.col("_digest")) & _same_key(), "left")
    merged = [F.coalesce(F.col(f"_old.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in posts.columns]
    return joined.select(*merged, F.col("_old").isNotNull().alias("resumed"))


def remaining_posts(posts: DataFrame, done: DataFrame) -> DataFrame:
    """Posts an earlier run has not finished."""
    keys = done.select(_digest().alias("_digest"), F.struct(*POST_KEY).alias("_key"))
    own = posts.withColumn("_own", _digest())
    return own.join(keys, (F.col("_own") == F.col("_digest")) & _same_key(), "left_anti").drop("_own")


def head_sample(posts: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` posts."""
    return posts.orderBy("post_id").limit(n)


def head_sample_stats(posts: DataFrame, n: int = 20) -> DataFrame:
    images = F.coalesce(F.size("image_urls"), F.lit(0))
    return head_sample(posts, n).agg(
        F.count(F.lit(1)).alias("posts"),
        F.count_if(images > 0).alias("posts_with_images"),
        F.coalesce(F.sum(images), F.lit(0)).alias("total_images"),
    )


def cap_images(posts: DataFrame, limit: int = 3) -> DataFrame:
    """Keep at most ``limit`` images per post."""
    return posts.withColumn("image_urls", F.slice("image_urls", 1, limit))


def cap_images_stats(posts: DataFrame, limit: int = 3) -> DataFrame:
    images = F.when(F.col("image_urls").isNotNull(), F.size("image_urls")).otherwise(0)
    over = images > limit
    return posts.agg(
        F.count(F.lit(1)).alias("total_posts"),
        F.count_if(images > 0).alias("posts_with_images"),
        F.count_if(over).alias("posts_with_too_many_images"),
        F.coalesce(F.sum(F.when(over, images - limit)), F.lit(0)).alias("total_images_removed"),
        F.count_if(over).alias("posts_modified"),
    )
