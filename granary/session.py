"""Session helpers shared by all queries."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; where it is installed or shipped otherwise, that changes nothing."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: what spark.checkpoint.dir names, else what setCheckpointDir has set; one of our own only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not named and not already.isEmpty():
        named = already.get().rsplit("/", 1)[0]  # Spark adds a folder for each application
        spark.conf.set("spark.checkpoint.dir", named)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="granary-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", named)
    if already.isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Spark's own setting: shuffle files go once the query that wrote them has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy that survives the loss of executors. The shuffle files behind it go at once.

    A checkpoint also hands on the size and the constraints that Spark infers for its plan. In loops over joins these
    multiply from round to round (the size of a join is the product of its sides) until planning outgrows the driver,
    so the rows are taken over under a plan that says nothing about them."""
    spark = df.sparkSession
    importable(spark)
    shared_dir(spark)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        kept = df.select("*").checkpoint(eager=True)._jdf
    finally:
        spark.conf.set(CLEAN_UP, before) if before is not None else spark.conf.unset(CLEAN_UP)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)
