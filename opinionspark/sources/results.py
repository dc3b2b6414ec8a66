"""Results of operators, kept by run and read back by name.

Frames are stored as Parquet, one folder each. The catalogue is a table with a
row for each: run, operator, frame, schema, place and time. A run's rows are
appended when all its frames are stored, so a run is either there or not.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .snapshots import Folder

CATALOGUE = "run_id string, operator string, frame string, schema string, place string, saved_at double"
_FOLDER = "catalogue"


def save_results(spark: SparkSession, path: str, run_id: str, frames: dict[str, dict[str, DataFrame]]) -> None:
    """Stores the frames of several operators, by operator and name of the frame, as one run."""
    rows = []
    for operator, own in frames.items():
        for name, frame in own.items():
            place = f"frames/{uuid.uuid4().hex}"
            frame.write.parquet(f"{path.rstrip('/')}/{place}")
            rows.append((run_id, operator, name, frame.schema.json(), place))
    now = time.time()
    saved = [(*r, now) for r in rows]
    spark.createDataFrame(saved, CATALOGUE).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/{_FOLDER}")


def results_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, operator, frame, schema, place, saved_at) of all stored frames; none before the first run."""
    if not Folder(spark, path).exists(_FOLDER):
        return spark.createDataFrame([], CATALOGUE)
    return spark.read.schema(CATALOGUE).parquet(f"{path.rstrip('/')}/{_FOLDER}")


def read_results(spark: SparkSession, path: str, operator: str, run_id: str | None = None) -> dict[str, DataFrame]:
    """All frames of an operator by name, of the named run or else of the last one that has it.

    If a run was saved several times, its last saving counts. An operator that
    isn't there is an error.
    """
    own = results_catalogue(spark, path).filter(F.col("operator") == operator)
    if run_id is not None:
        own = own.filter(F.col("run_id") == run_id)
    last = own.agg(F.max_by(F.struct("run_id", "saved_at"), F.struct("saved_at", "run_id"))).first()[0]
    if last is None:
        raise KeyError(f"no result of {operator}" + (f" in run {run_id}" if run_id else ""))
    # A run's frames of one operator: a handful of rows.
    rows = own.filter((F.col("run_id") == last.run_id) & (F.col("saved_at") == last.saved_at)).collect()
    return {
        r.frame: spark.read.schema(StructType.fromJson(json.loads(r.schema))).parquet(
            f"{path.rstrip('/')}/{r.place}"
        )
        for r in rows
    }
