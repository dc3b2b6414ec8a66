"""Tool traces, evidence and the status event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import rnd
from ..plans.checkpoints import checkpoint

# What tells the dimension of a tool, in order of precedence.
CATEGORY_HINTS = (
    ("情感", "sentiment"),
    ("主题", "topic"),
    ("地理", "geographic"),
    ("交互", "interaction"),
    ("NLP", "nlp"),
)
NAME_HINTS = (
    ("sentiment", ("sentiment",)),
    ("topic", ("topic",)),
    ("geographic", ("geographic", "geo")),
    ("interaction", ("publisher", "interaction", "cross", "influence", "correlation", "participant")),
    ("nlp", ("keyword", "entity", "lexicon", "cluster")),
    ("topic", ("belief",)),
)
DIMENSIONS = ("sentiment", "topic", "geographic", "interaction", "nlp")


def tool_dimension(tool: str = "tool_name", category: str = "category") -> Column:
    """The analysis dimension of a tool: by category hint, else by name."""
    out = F.when(F.lit(False), "")
    for hint, dimension in CATEGORY_HINTS:
        out = out.when(F.contains(F.col(category), F.lit(hint)), dimension)
    name = F.lower(tool)
    for dimension, words in NAME_HINTS:
        out = out.when(name.rlike("|".join(words)), dimension)
    return out


def dimension_counts(charts: DataFrame) -> DataFrame:
    """Charts per dimension, all five dimensions present."""
    dim = tool_dimension()
    one = charts.agg(*[F.count_if(dim == d).alias(d) for d in DIMENSIONS])
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("charts")) for d in DIMENSIONS])
    return one.select(F.inline(cells))


def dimension_coverage(charts: DataFrame, minimum: int = 1) -> DataFrame:
    """Coverage flags, whether below a minimum, and the coverage ratio."""
    counts = dimension_counts(charts).withColumn("covered", F.col("charts") > 0)
    share = F.count_if("covered").over(Window.partitionBy()) / float(len(DIMENSIONS))
    return counts.select(
        "dimension", "charts", "covered", (F.col("charts") < minimum).alias("below_minimum"),
        rnd(share, 3).alias("coverage_ratio"),
    )


def tool_run_stats(executions: DataFrame) -> DataFrame:
    """Per tool the runs and the outcome of its last one.

    A chart tool that ran without error but drew nothing counts as an error.
    """
    empty = F.col("generates_chart") & ~F.col("error") & (F.col("charts") == 0)
    last = F.max_by(
        F.struct("charts", "data", (F.col("error") | empty).alias("error"), empty.alias("empty_chart")),
        F.col("execution_no"),
    )
    return executions.groupBy("tool_name").agg(F.count(F.lit(1)).alias("runs"), last.alias("l")).select(
        "tool_name", "runs", "l.charts", "l.data", "l.error", "l.empty_chart"
    )


_GRAM = 8


def _grams(text: Column, size: Column) -> Column:
    """The distinct substrings of a length."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def _told(texts: DataFrame, summaries: DataFrame) -> DataFrame:
    """(run_id, insight_id, summary) for every summary of a run that occurs in one of its texts.

    A summary in a text has all its substrings there too. Each summary is
    looked up by its rarest substring of a fixed length, so a phrase that most
    summaries share is not a meeting point, and verified where it is found.
    The substrings travel without the text; it is fetched for those that meet.
    """
    sized = summaries.withColumn("_size", F.least(F.length("summary"), F.lit(_GRAM)))
    parts = sized.select("run_id", "summary", "_size", F.explode(_grams(F.col("summary"), F.col("_size"))).alias("_gram"))
    spread = parts.groupBy("run_id", "_size", "_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (
        parts.join(spread, ["run_id", "_size", "_gram"])
        .groupBy("run_id", "summary", "_size")
        .agg(F.min(F.struct("_n", "_gram"))["_gram"].alias("_gram"))
    )
    sizes = sized.agg(F.collect_set("_size")).scalar()
    wanted = texts.withColumn("_sizes", sizes).select("run_id", "insight_id", "text", F.explode("_sizes").alias("_size"))
    grams = F.explode(_grams(F.col("text"), F.col("_size"))).alias("_gram")
    met = wanted.select("run_id", "insight_id", "_size", grams).join(rarest, ["run_id", "_size", "_gram"])
    told = met.select("run_id", "insight_id", "summary").join(texts, ["run_id", "insight_id"])
    return told.filter(F.contains("text", "summary")).select("run_id", "insight_id", "summary").distinct()


def _of_run(frame: DataFrame) -> Column:
    """The run a row belongs to; a table of one run needs no such column."""
    return F.coalesce("run_id", F.lit("")) if "run_id" in frame.columns else F.lit("")


def insight_evidence(insights: DataFrame, executions: DataFrame) -> DataFrame:
    """Executions of an insight's own run that its text names.

    A match is a text that contains the tool name, a part of it longer than
    two characters, or the execution's summary. Each insight is checked
    against the distinct tool names of its run, a closed list, in its own row,
    then joined by run and name. Distinct summaries are found by their
    substrings. Insights without a match get the run's last two successful
    executions. Runs are told apart by ``run_id`` where the tables have it.
    """
    texts = insights.select(_of_run(insights).alias("run_id"), "insight_id", F.lower("text").alias("text"))
    runs = executions.select(
        _of_run(executions).alias("run_id"),
        "execution_no",
        "id",
        "status",
        F.lower("tool_name").alias("tool"),
        F.lower("summary").alias("summary"),
    )
    shown = ("run_id", "insight_id", "execution_no", "id", "status")

    def named(text: Column, tool: Column) -> Column:
        parts = F.filter(F.split(tool, "_"), lambda p: F.length(p) > 2)
        return F.contains(text, tool) | F.exists(parts, lambda p: F.contains(text, p))

    names = runs.filter(F.col("tool") != "").groupBy("run_id").agg(F.collect_set("tool").alias("_names"))
    insight, execution = ["run_id", "insight_id"], ["run_id", "execution_no", "id", "status"]
    own = F.filter("_names", lambda t: named(F.col("text"), t))
    told_names = texts.join(names, "run_id").select(*insight, own.alias("_own"))
    # One row per insight, with the names in its texts, and one per execution, so that their pairs need no distinct.
    wanted = told_names.groupBy(*insight).agg(F.array_distinct(F.flatten(F.collect_list("_own"))).alias("_own"))
    tools = runs.groupBy(*execution).agg(F.sort_array(F.collect_set("tool")).alias("_tools"))
    by_tool = tools.select(*execution, "_tools", F.explode("_tools").alias("tool"))
    pairs = wanted.select(*insight, "_own", F.explode("_own").alias("tool")).join(by_tool, ["run_id", "tool"])
    # An execution with several names in a text meets it at the first one.
    first = F.get(F.filter("_tools", lambda t: F.array_contains("_own", t)), F.lit(0))
    by_name = pairs.filter(F.col("tool") == first).select(*shown)
    summaries = runs.filter(F.col("summary") != "").select("run_id", "summary").distinct()
    told = _told(texts, summaries).join(runs, ["run_id", "summary"]).select(*shown).distinct()
    same = F.lit(True)
    for c in execution:
        same = same & F.col(f"t.{c}").eqNullSafe(F.col(f"x.{c}"))
    met = told.alias("t").join(tools.alias("x"), same).select("t.*", "x._tools").join(wanted, insight, "left")
    by_summary = met.filter(~F.coalesce(F.arrays_overlap("_tools", "_own"), F.lit(False))).select(*shown)
    matched = by_name.unionByName(by_summary).withColumn("matched", F.lit(True))
    # The last two of each run; the rank's limit is applied ahead of the shuffle too.
    latest = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("execution_no"), "id"))
    two = runs.filter(F.col("status") == "success").withColumn("_rank", latest).filter("_rank <= 2")
    recent = two.groupBy("run_id").agg(F.collect_list(F.struct("execution_no", "id", "status")).alias("_recent"))
    # Each distinct name is one of an execution, so an insight that has one is matched.
    some = wanted.filter(F.size("_own") > 0).select(*insight).unionByName(told.select(*insight))
    alone = texts.select(*insight).join(some, insight, "left_anti")
    fallback = alone.join(recent, "run_id").select("run_id", "insight_id", F.inline("_recent"), F.lit(False).alias("matched"))
    return matched.unionByName(fallback)


def evidence_confidence(insights: DataFrame, evidence: DataFrame) -> DataFrame:
    """Confidence of each insight by its number of evidence records."""
    counts = evidence.groupBy("run_id", "insight_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    level = F.when(n >= 2, "high").when(n == 1, "medium").otherwise("low")
    own = insights.select(_of_run(insights).alias("run_id"), "insight_id")
    return own.join(counts, ["run_id", "insight_id"], "left").select(
        "run_id", "insight_id", n.alias("evidence"), level.alias("confidence")
    )


def merge_branches(charts: list[DataFrame], tables: list[DataFrame]) -> DataFrame:
    """The charts and tables of all branches as one table of outputs."""
    parts = [df.withColumn("kind", F.lit("chart")) for df in charts]
    parts += [df.withColumn("kind", F.lit("table")) for df in tables]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def merge_totals(merged: DataFrame, rounds: DataFrame) -> DataFrame:
    """Totals of the merged outputs with the number of forum rounds."""
    last = rounds.agg(F.max("round")).scalar()
    return merged.agg(
        F.count_if(F.col("kind") == "chart").alias("total_charts"),
        F.count_if(F.col("kind") == "table").alias("total_tables"),
    ).withColumn("forum_rounds", F.coalesce(last, F.lit(0)))


def latest_conclusions(rounds: DataFrame) -> DataFrame:
    """The non-empty conclusions of each discussion's latest round."""
    latest = rounds.groupBy("discussion").agg(F.max("round").alias("round"), F.max_by("conclusion", "round").alias("c"))
    return latest.select("discussion", "round", F.trim("c").alias("conclusion")).filter(F.col("conclusion") != "")


_WORDS = ("ts", "event", "stage", "node", "status", "error")
#: What orders the events of a run.
_ORDER = ("old_seq", "ts", "event", "branch_id", "stage", "node", "status")
#: Runs of so many events at most are numbered by one task each.
_RUN_ROWS = 1_000_000


def cleaned_log(events: DataFrame) -> DataFrame:
    """Trimmed events, branch ``main`` by default, with their number as ``old_seq``."""
    return events.select(
        F.trim("run_id").alias("run_id"),
        F.coalesce("seq", F.lit(0)).cast("bigint").alias("old_seq"),
        *[F.trim(F.coalesce(w, F.lit(""))).alias(w) for w in _WORDS],
        F.coalesce(F.nullif(F.trim("branch_id"), F.lit("")), F.lit("main")).alias("branch_id"),
    )


def _run_sizes(clean: DataFrame) -> DataFrame:
    return clean.groupBy(F.col("run_id").alias("_run")).agg(F.count(F.lit(1)).alias("_n"))


def _same_run() -> Column:
    return F.col("run_id").eqNullSafe(F.col("_run"))


def event_log_normalize(events: DataFrame) -> DataFrame:
    """Trimmed events, branch ``main`` by default, renumbered from 1 per run.

    Where the largest run is of a measured small size, a run is a window. A run
    may also hold a third of all events, and its numbers may be missing or
    repeat, so then its numbering is neither one window nor cut by old numbers:
    all events are sorted over range partitions, each partition adds the sizes of
    those before it, and each run subtracts the place of its first event.
    """
    clean = cleaned_log(events)
    largest = _run_sizes(clean).agg(F.max("_n")).first()[0] or 0
    if largest <= _RUN_ROWS:
        place = F.row_number().over(Window.partitionBy("run_id").orderBy(*_ORDER))
        return clean.select("run_id", place.cast("bigint").alias("seq"), *_WORDS, "branch_id")
    order = ("run_id", *_ORDER)
    ranged = clean.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpoint(ranged.withColumn("_id", F.monotonically_increasing_id())).select(
        "*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_row")
    )
    # One row per partition.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    firsts = (
        placed.groupBy("run_id", "_part").agg(F.min("_row").alias("_row"))
        .join(starts, "_part")
        .groupBy(F.col("run_id").alias("_run"))
        .agg(F.min(F.col("_before") + F.col("_row")).alias("_first"))
    )
    return (
        placed.join(starts, "_part")
        .join(firsts, F.col("run_id").eqNullSafe(F.col("_run")))
        .select("run_id", (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("seq"), *_WORDS, "branch_id")
    )


def open_branches(events: DataFrame) -> DataFrame:
    """Per run and branch the last event, if it is an enter."""
    last = events.groupBy("run_id", "branch_id").agg(
        F.max(F.struct("seq", "event", "stage", "node")).alias("l")
    )
    return last.filter(F.col("l.event") == "enter").select("run_id", "branch_id", "l.seq", "l.stage", "l.node")


def current_location(events: DataFrame) -> DataFrame:
    """Stage and node of each run's latest open event; empty when none is open.

    The log needs no new numbers for it: a branch's last event is its greatest in the order that would number it.
    """
    last = cleaned_log(events).groupBy("run_id", "branch_id").agg(F.max(F.struct(*[c for c in _ORDER if c != "branch_id"])).alias("l"))
    is_open = F.col("l.event") == "enter"
    place = F.struct("l.old_seq", "l.ts", "l.event", "branch_id", "l.stage", "l.node")
    latest = last.groupBy("run_id").agg(
        F.count_if(is_open).alias("open_branches"), F.max(F.when(is_open, place)).alias("o")
    )
    return latest.select(
        "run_id",
        F.coalesce("o.stage", F.lit("")).alias("current_stage"),
        F.coalesce("o.node", F.lit("")).alias("current_node"),
        "open_branches",
    )


def _last_of_runs(clean: DataFrame, k: int) -> DataFrame:
    """The last ``k`` events of each run with ``_back``, their place from the end; tasks drop all others before the shuffle."""
    back = Window.partitionBy("run_id").orderBy(*[F.desc(c) for c in _ORDER])
    return clean.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= k)


def failed_exits(events: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` failed exits with the highest numbers, numbered as ``event_log_normalize`` does.

    Only candidates get numbers: the last ``k`` of each run. An event counts
    for the candidates that it comes after, and a candidate's number is the run's
    size less those.
    """
    clean = cleaned_log(events)
    failed = _last_of_runs(clean.filter((F.col("event") == "exit") & (F.col("status") == "failed")), k)
    place = F.struct(*_ORDER)
    chosen = failed.withColumn("_place", place)
    # At most k places of each run, the last first.
    places = chosen.groupBy(F.col("run_id").alias("_run")).agg(F.sort_array(F.collect_list("_place"), asc=False).alias("_places"))
    # The first candidate, from the end, that an event comes after.
    index = F.size(F.filter("_places", lambda p: p >= F.struct(*_ORDER)))
    met = clean.join(places, _same_run()).groupBy("_run", index.alias("_index")).agg(F.count(F.lit(1)).alias("_events"))
    upto = Window.partitionBy("_run").orderBy("_index").rowsBetween(Window.unboundedPreceding, 0)
    counted = met.withColumn("_after", F.sum("_events").over(upto)).groupBy("_run").agg(
        F.sort_array(F.collect_list(F.struct("_index", "_after"))).alias("_counts")
    )
    sized = _run_sizes(clean).join(counted.withColumnRenamed("_run", "_same"), F.col("_run").eqNullSafe(F.col("_same")))
    equal = Window.partitionBy("run_id", "_place").orderBy("_back")
    joined = chosen.withColumn("_equal", F.row_number().over(equal) - 1).join(sized, _same_run())
    # Of equal exits the ones before count as well; they stand in front of this one among the candidates.
    own = F.col("_back") - F.col("_equal") - 1
    after = F.coalesce(F.get(F.filter("_counts", lambda c: c["_index"] <= own), F.size(F.filter("_counts", lambda c: c["_index"] <= own)) - 1)["_after"], F.lit(0))
    numbered = joined.select("run_id", (F.col("_n") - after - F.col("_equal")).alias("seq"), *_WORDS, "branch_id")
    return numbered.orderBy(F.desc("seq"), F.desc("run_id")).limit(k)


def recent_events(events: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` events with the highest numbers, numbered as ``event_log_normalize`` does, from the end of each run."""
    clean = cleaned_log(events)
    sized = _last_of_runs(clean, k).join(_run_sizes(clean), _same_run())
    numbered = sized.select("run_id", (F.col("_n") - F.col("_back") + 1).alias("seq"), *_WORDS, "branch_id")
    return numbered.orderBy(F.desc("seq"), F.desc("run_id")).limit(k)
