"""Cutting lineage with reliable checkpoints."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables that all executors see.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where
    that is unset and Spark runs on one machine, a temporary one is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder: survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder as Parquet, for rows that columns compress well."""
    return stored_at(df)[0]


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """What ``stored`` gives, and its folder, for ``drop_stored``."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_stored(spark: SparkSession, path: str) -> None:
    """Deletes stored rows that nothing is left to read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release_shuffles(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of frames that nothing refers to any more.

    Spark does so once the driver's JVM collects them, which a short job may not see. The JVM hears a second
    late what Python has let go.
    """
    gc.collect()
    for _ in range(2):
        time.sleep(1.1)
        spark._jvm.System.gc()
