"""Quality rules with thresholds that follow the data, in Spark expressions only.

Every document is measured. Mergeable KLL sketches of the measures are kept
per language and source; sketches of small groups are replaced by those merged
over their language, or over all. A document passes if each measure lies
inside its group's fence: the quartiles, widened by a multiple of their
distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stored

#: Measure -> (does a low value fail too, the least width of the fence's step).
MEASURES = {
    "chars_per_word": (True, 1.0),
    "symbols_per_word": (False, 0.05),
    "dup_line_share": (False, 0.1),
    "repeat_share": (False, 0.1),
}
#: Size parameter of a sketch; groups up to about this size are exact.
SKETCH_K = 2048
#: Groups of fewer documents take the thresholds of their language, then of all.
LEAST = 200
#: Steps (quartile distances) from a quartile to the fence.
REACH = 4.0


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array.

    Windows are compared by 64-bit hashes, sorted with their places within the
    row, so the work is n log n however often a window repeats.
    """
    windows = F.when(
        F.size(words) >= 3,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - 2),
            lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(places: Column) -> Column:
        """Each repeated window adds the words up to the next one, three at most."""
        steps = F.transform(places, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        twin = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda k: F.coalesce(F.get(s, k)["h"] == F.get(s, k - 1)["h"], F.lit(False))
            | F.coalesce(F.get(s, k)["h"] == F.get(s, k + 1)["h"], F.lit(False)),
        )
        return _let(F.sort_array(F.transform(twin, lambda k: F.get(s, k)["i"])), covered)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(pairs, repeated))

    return _let(windows, count).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the five counts and base_failed, from the whole text of each row."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    base = docs.select("doc_id", "lang", "source", text.alias("text")).select(
        "doc_id",
        "lang",
        "source",
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"))).alias("w"),
    )
    n, repeats = F.col("w.n"), F.col("w.r")
    return base.select(
        "doc_id",
        "lang",
        "source",
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeats.alias("n_repeat_words"),
        ((n < 50) | (100 * repeats > 50 * n)).alias("base_failed"),
        (F.col("word_chars") / F.nullif(n, F.lit(0))).alias("chars_per_word"),
        (F.col("n_symbols") / F.nullif(n, F.lit(0))).alias("symbols_per_word"),
        (F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0))).alias("dup_line_share"),
        (repeats / F.nullif(n, F.lit(0))).alias("repeat_share"),
    )


def _merge(groups: DataFrame, *by: str) -> DataFrame:
    return groups.groupBy(*by).agg(
        F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in MEASURES]
    )


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, n, one sketch per measure), combined on the map side; documents without words are left out."""
    return (
        rows.filter(F.col("n_words") > 0)
        .groupBy("lang", "source")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in MEASURES],
        )
    )


def thresholds(groups: DataFrame, least: int = LEAST, reach: float = REACH) -> DataFrame:
    """(lang, source, low and high of each measure) from the sketches of the groups."""
    langs = _merge(groups, "lang").select(
        F.col("lang").alias("l_lang"), F.col("n").alias("l_n"), *[F.col(m).alias(f"l_{m}") for m in MEASURES]
    )
    every = _merge(groups).select(F.struct(*MEASURES)).scalar()
    chosen = groups.join(langs, F.col("lang").eqNullSafe(F.col("l_lang")))
    out = [F.col("lang"), F.col("source")]
    for m, (two_sided, step) in MEASURES.items():
        sketch = F.when(F.col("n") >= least, F.col(m)).when(F.col("l_n") >= least, F.col(f"l_{m}")).otherwise(every[m])
        q1, q3 = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        width = reach * F.greatest(q3 - q1, F.lit(step))
        out.append((q1 - width if two_sided else F.lit(float("-inf"))).alias(f"low_{m}"))
        out.append((q3 + width).alias(f"high_{m}"))
    return chosen.select(*out)


def quality_rules(docs: DataFrame, least: int = LEAST, reach: float = REACH) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    ``docs`` has doc_id, text, lang and source; other columns are ignored. A
    null text has no words, and a text without words fails. Null languages and
    sources are groups of their own. Repeated rows are judged row by row. A
    table without rows gives none.
    """
    rows = stored(measured(docs), "measures")
    limits = stored(thresholds(stored(sketches(rows), "sketches"), least, reach), "thresholds")
    inside = F.lit(True)
    for m in MEASURES:
        value = F.coalesce(F.col(f"r.{m}"), F.lit(0.0))
        inside = inside & (value >= F.col(f"t.low_{m}")) & (value <= F.col(f"t.high_{m}"))
    same = F.col("r.lang").eqNullSafe(F.col("t.lang")) & F.col("r.source").eqNullSafe(F.col("t.source"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.alias("r").join(limits.alias("t"), same, "left").select(
        "doc_id", *counts, "base_failed", kept.alias("kept")
    )
