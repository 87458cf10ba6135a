"""Structured Streaming forms of the stateful steps. Each takes and gives streaming frames; run_once drains one to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame, at: str, kind: str, late: str = "15 minutes") -> DataFrame:
    """Counts by hour and kind, final once an hour and the allowed lateness are over."""
    counts = events.withWatermark(at, late).groupBy(F.window(at, "1 hour").alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("hour"), kind, "n")


def first_seen(events: DataFrame, key: str, at: str, within: str = "14 days") -> DataFrame:
    """The first event of each key; state of a key is kept for `within`."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def latest(events: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The running last row of each key (output mode complete or update)."""
    return events.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("last")).select(key, "last.*")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drains what there is into Parquet and reads it. Replays of a batch replace it, so each batch counts once."""
    spark: SparkSession = stream.sparkSession

    def put(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/whole" if mode == "complete" else f"{path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(stream.schema).parquet(f"{path}/*")
    return found.select(stream.columns)
