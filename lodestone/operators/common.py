"""Helpers that several operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where that is unset and Spark is one machine's (tests) a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.getConf().get("spark.checkpoint.dir") and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, so that lost executors don't force earlier stages to run again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
