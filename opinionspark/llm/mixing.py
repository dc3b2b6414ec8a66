"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. A target of ``f`` times the source's size
gives every document of the source ``floor(f)`` whole copies for certain; what
is left is a sample in which each document has the same inclusion probability
``p = f - floor(f)``, which differs from source to source. The sample is drawn
in Pareto order: documents are ranked by the odds of a fixed random number
over the odds of ``p``, and taken until their words fill the rest of the
target. The last place goes to the document whose size closes the gap best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stored

#: Weights of the sources in order, repeated.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Ranks of a source are cut into so many bins; only one bin of a source is ever sorted.
BINS = 4096


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _random(doc_id: Column, seed: int) -> Column:
    """In (0, 1), from the id alone, so reruns and retried tasks agree."""
    return (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(2.0**53)


def _odds(p: Column) -> Column:
    return p / (1 - p)


def weighted_sources(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(key, source, source_size, weight): weights are dealt by code point, null last.

    The numbering is distributed: rows are range-partitioned and a partition
    adds the counts of those before it.
    """
    order = F.col("source").asc_nulls_last()
    sorted_ = sizes.repartitionByRange(order).sortWithinPartitions(order)
    placed = stored(sorted_.withColumn("_id", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)
    dealt = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights)).cast("int") + 1)
    return placed.withColumn("_part", part).join(offsets, "_part").select("key", "source", "source_size", dealt.alias("weight"))


def source_targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` with target: ``share`` of all words by weight, at most ``most`` times a source's size.

    Each round reshapes what capped sources leave over the others; only two
    sums per round reach the driver.
    """
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        full = F.col("source_size") * most <= F.col("weight") * level
        found = sources.agg(
            F.sum(F.when(full, F.col("source_size") * most)).alias("taken"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.count_if(full).alias("n"),
        ).first()
        if found.n == capped or not found.open:
            break
        capped, level = found.n, max(level, (total - (found.taken or 0)) / found.open)
    return sources.withColumn("target", F.least(F.col("source_size") * most, F.col("weight") * level))


def mix_plan(sized: DataFrame, seed: int = 11) -> DataFrame:
    """One row per source: what decides the copies of a document.

    sized: (doc_id, source, size), stored, as it is read several times. See
    ``with_copies`` for the use of the columns.
    """
    docs = sized.select("doc_id", "source", "size", _key(F.col("source")).alias("key"), _random(F.col("doc_id"), seed).alias("u"))
    sizes = docs.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    sources = stored(weighted_sources(sizes), "weights")
    factor = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    whole = F.coalesce(F.floor(factor), F.lit(0))
    plan = stored(
        source_targets(sources)
        .withColumn("whole", whole)
        .withColumn("p", F.coalesce(factor - whole, F.lit(0.0)))
        .withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))),
        "targets",
    )
    bin_ = F.floor(F.col("u") * BINS).alias("bin")
    bins = docs.groupBy("key", bin_).agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        bins.withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
        .join(plan.select("key", "rest", "p"), "key")
        .filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
        .select("key", "bin", "before", "rest", "p")
    )
    # Within a source p is one number, so Pareto order is the order of u and a bin of u is a range of ranks.
    pareto = (_odds(F.col("u")) / _odds(F.col("p"))).alias("q")
    inside = docs.withColumn("bin", F.floor(F.col("u") * BINS)).join(edge, ["key", "bin"]).filter(F.col("p") > 0)
    rank = F.struct(pareto, "u", "doc_id", "size")
    upto = Window.partitionBy("key").orderBy("rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    stop = (
        inside.withColumn("rank", rank)
        .withColumn("sum", F.col("before") + F.sum("size").over(upto))
        .filter(F.col("sum") > F.col("rest"))
        .groupBy("key")
        .agg(F.min(F.struct("rank", "sum", "size")).alias("s"))
        .select(
            "key",
            F.struct("s.rank.u", "s.rank.doc_id", "s.rank.size").alias("stop"),
            (F.col("s.sum") - F.col("s.size")).alias("filled"),
        )
    )
    stops = stored(plan.join(stop, "key", "left"), "stops")
    mark = F.struct("u", "doc_id", "size")
    gap = F.col("rest") - F.col("filled")
    last = (
        docs.join(stops.select("key", "stop", "filled", "rest"), "key")
        .filter((mark >= F.col("stop")) & (F.abs(gap - F.col("size")) < gap))
        .groupBy("key")
        .agg(F.min(F.struct(F.abs(gap - F.col("size")).alias("miss"), mark.alias("mark"))).alias("l"))
        .select("key", F.col("l.mark").alias("last"))
    )
    return stored(stops.join(last, "key", "left").select("key", "source_size", "target", "whole", "p", "stop", "last"), "mix")


def with_copies(docs: DataFrame, plan: DataFrame, seed: int = 11) -> DataFrame:
    """``docs`` (doc_id, source, size and any others) with source_size, target and copies."""
    mark = F.struct(_random(F.col("d.doc_id"), seed).alias("u"), "d.doc_id", "d.size")
    chosen = F.when(F.col("m.p") <= 0, F.lit(False)).otherwise(
        F.col("m.stop").isNull() | (mark < F.col("m.stop")) | F.coalesce(mark == F.col("m.last"), F.lit(False))
    )
    return docs.alias("d").join(plan.alias("m"), _key(F.col("d.source")) == F.col("m.key")).select(
        "d.*", "m.source_size", "m.target", (F.col("m.whole") + chosen.cast("long")).alias("copies")
    )


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words_in(F.col("text")).alias("size"))


def mix_sources(docs: DataFrame, seed: int = 11) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of documents (doc_id, text, source).

    A null text has size 0 and is taken for 0 words, a null source is a source
    of its own, the last in order, and a null doc_id is an id like others.
    Rows that agree in doc_id, size and source share one fate. A source
    without words has target 0. Without documents there are no rows. Other
    columns are ignored.
    """
    sized = stored(sized_documents(docs), "sizes")
    plan = mix_plan(sized, seed)
    return with_copies(sized, plan, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed_documents(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken."""
    plan = mix_plan(stored(sized_documents(docs), "sizes"), seed)
    sized = docs.select(F.struct("*").alias("row"), "doc_id", "source", words_in(F.col("text")).alias("size"))
    taken = with_copies(sized, plan, seed)
    return (
        taken.filter(F.col("copies") > 0)
        .select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"))
        .select("row.*")
    )
