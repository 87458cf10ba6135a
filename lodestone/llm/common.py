"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where that is unset and Spark is one machine's (tests) a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.getConf().get("spark.checkpoint.dir") and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir()


_SCRATCH: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for rows on their way, in the shared folder."""
    _SCRATCH.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def scratches() -> int:
    """How many folders scratch() has given out that weren't removed."""
    return len(_SCRATCH)


def clear_scratch(spark: SparkSession, since: int, keep: str) -> None:
    """Removes all but one of the folders that scratch() gave out since then. For the end of a run, when nothing that reads them is left to compute."""
    sc = spark.sparkContext
    for folder in _SCRATCH[since:]:
        if folder != keep:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
            _SCRATCH.remove(folder)
            spark.sql(f"DROP TABLE IF EXISTS lodestone_{folder.rsplit('-', 1)[-1]}")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that lost executors don't force earlier stages to run again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_HELD: dict = {}


def held(make: Callable, *args):
    """make(*args), kept for later tasks of this Python worker. Only the last thing made is kept, so that stages don't add up in memory."""
    if (make, args) not in _HELD:
        _HELD.clear()
        _HELD[make, args] = make(*args)
    return _HELD[make, args]


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
