"""Current location of runs from a stream of status events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def branch_state_stream(events: DataFrame) -> DataFrame:
    """The last event of each run and branch: one row of state per branch.

    Run it in update or complete mode; an enter as last event means the
    branch is open. A maximum by sequence number does not depend on the
    order in which events arrive.
    """
    last = F.max(F.struct("seq", "event", "stage", "node"))
    branch = F.coalesce(F.nullif(F.trim("branch_id"), F.lit("")), F.lit("main"))
    grouped = events.groupBy(F.trim("run_id").alias("run_id"), branch.alias("branch_id")).agg(last.alias("l"))
    return grouped.select("run_id", "branch_id", "l.seq", "l.event", "l.stage", "l.node")


def store_changes(states: DataFrame, path: str, state: str) -> StreamingQuery:
    """Writes the branches that a batch changed, and only those, to a folder of that batch.

    A batch that is run again after a failure overwrites its own folder.
    """
    return (
        states.writeStream.outputMode("update")
        .foreachBatch(lambda changed, batch: changed.write.mode("overwrite").parquet(f"{path}/batch={batch}"))
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )


def latest_states(stored: DataFrame) -> DataFrame:
    """One row per branch of all stored changes; a branch's states only grow, so the greatest is the last."""
    last = F.max(F.struct("seq", "event", "stage", "node"))
    return stored.groupBy("run_id", "branch_id").agg(last.alias("l")).select(
        "run_id", "branch_id", "l.seq", "l.event", "l.stage", "l.node"
    )


def locate(branches: DataFrame) -> DataFrame:
    """Stage and node of each run's latest open branch, from the branch states."""
    is_open = F.col("event") == "enter"
    latest = branches.groupBy("run_id").agg(
        F.count_if(is_open).alias("open_branches"), F.max(F.when(is_open, F.struct("seq", "stage", "node"))).alias("o")
    )
    return latest.select(
        "run_id",
        F.coalesce("o.stage", F.lit("")).alias("current_stage"),
        F.coalesce("o.node", F.lit("")).alias("current_node"),
        "open_branches",
    )
