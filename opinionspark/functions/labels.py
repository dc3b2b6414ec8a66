"""Label replies to clean label columns.

A vocabulary is a closed list, of a few hundred entries as a rule and of at most
``MOST_ENTRIES``, beyond which reading it is an error. It is passed as an
array column: a literal, or a column holding a scalar subquery over its
table (add it with ``withColumn`` first, as Spark allows no subquery inside a
lambda). Validating a reply is then work within the row, with no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a failed reply falls back to.
NEUTRAL_POLARITY = 3
NEUTRAL_ATTRIBUTE = "中立"
DEFAULT_PUBLISHER = "个人用户"

_TOPICS = "array<struct<parent_topic:string,sub_topic:string>>"
_BELIEFS = "array<struct<category:string,subcategories:array<string>>>"


#: Entries of a vocabulary at most; it is a literal in the plan and looked through for every reply.
MOST_ENTRIES = 10_000


def _bounded(distinct: DataFrame) -> DataFrame:
    """The rows of a vocabulary, one more than is allowed at most, so that none of any size is ever collected."""
    return distinct.limit(MOST_ENTRIES + 1)


def _checked(entries: Column) -> Column:
    too_many = F.raise_error(F.lit(f"a vocabulary has at most {MOST_ENTRIES} entries"))
    return F.when(F.size(entries) <= MOST_ENTRIES, entries).otherwise(too_many)


def vocabulary(values: DataFrame, *columns: str) -> Column:
    """A vocabulary table as a scalar array, in the order of its rows' values."""
    item = F.struct(*columns) if len(columns) > 1 else F.col(columns[0])
    rows = _bounded(values.select(item.alias("item")).distinct())
    return rows.agg(_checked(F.sort_array(F.collect_list("item")))).scalar()


def ordered_vocabulary(values: DataFrame, column: str = "value", order: str = "ord") -> Column:
    """A vocabulary table as a scalar array in its stated order."""
    pairs = F.sort_array(F.collect_list(F.struct(order, column)))
    return _bounded(values).agg(_checked(F.transform(pairs, lambda x: x[column]))).scalar()


def belief_vocabulary(values: DataFrame) -> Column:
    """(category, subcategory) rows as a scalar array of categories with their subs."""
    few = _bounded(values.select("category", "subcategory").distinct())
    per_category = few.groupBy("category").agg(F.collect_set("subcategory").alias("subcategories"))
    total = F.aggregate(F.collect_list(F.size("subcategories")), F.lit(0), lambda a, x: a + x)
    too_many = F.raise_error(F.lit(f"a vocabulary has at most {MOST_ENTRIES} entries"))
    entries = F.collect_list(F.struct("category", "subcategories"))
    return per_category.agg(F.when(total <= MOST_ENTRIES, entries).otherwise(too_many)).scalar()


def parse_polarity(reply: Column) -> Column:
    digits = F.trim(reply)
    level = F.when(digits.rlike("^[0-9]+$"), digits.try_cast("int"))
    return F.when(level.between(1, 5), level).otherwise(NEUTRAL_POLARITY)


def parse_attributes(reply: Column, vocab: Column) -> Column:
    # Within brackets, text before or after the array makes the reply invalid.
    whole = F.from_json(F.concat(F.lit("["), F.trim(reply), F.lit("]")), "array<array<string>>")
    parsed = F.when(F.size(whole) == 1, F.get(whole, F.lit(0)))
    kept = F.filter(parsed, lambda a: F.array_contains(vocab, a))
    return F.coalesce(kept, F.array(F.lit(NEUTRAL_ATTRIBUTE)))


def parse_topics(reply: Column, taxonomy: Column) -> Column:
    """Keep pairs that exist in the taxonomy ``array<struct<parent_topic, sub_topic>>``."""
    parsed = F.from_json(F.trim(reply), _TOPICS)
    kept = F.filter(parsed, lambda t: F.array_contains(taxonomy, t))
    return F.coalesce(kept, F.array().cast(_TOPICS))


def parse_publisher(reply: Column, vocab: Column, default: str = DEFAULT_PUBLISHER) -> Column:
    name = F.trim(reply)
    return F.when(F.array_contains(vocab, name), name).when(F.array_contains(vocab, F.lit(default)), F.lit(default))


def parse_beliefs(reply: Column, vocab: Column) -> Column:
    """Known categories of a reply, each with its known sub categories.

    The JSON may sit in a code fence or between other text.
    """
    text = F.trim(reply)
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit(""))
    cut = F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))
    candidate = F.coalesce(fenced, cut, text)
    inner = F.nullif(F.regexp_extract(candidate, r"(?s)\[\s*\{.*\}\s*\]", 0), F.lit(""))
    parsed = F.coalesce(F.from_json(candidate, _BELIEFS), F.from_json(inner, _BELIEFS))

    def checked(item: Column) -> Column:
        known = F.get(F.filter(vocab, lambda v: v["category"] == item["category"]), F.lit(0))
        subs = F.filter(
            F.coalesce(item["subcategories"], F.array().cast("array<string>")),
            lambda s: F.array_contains(known["subcategories"], s),
        )
        return F.when(known.isNotNull(), F.struct(item["category"].alias("category"), subs.alias("subcategories")))

    kept = F.filter(F.transform(parsed, checked), lambda x: x.isNotNull())
    return F.coalesce(kept, F.array().cast(_BELIEFS))


def parse_decision(reply: Column, vocab: Column) -> Column:
    """The first category, in vocabulary order, that the reply contains; else the first of all."""
    text = F.replace(F.trim(reply), F.lit('"'), F.lit(""))
    found = F.filter(vocab, lambda v: (v != "") & F.contains(text, v))
    return F.coalesce(F.get(found, F.lit(0)), F.get(vocab, F.lit(0)))
