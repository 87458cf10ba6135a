"""Newline-delimited JSON logs, plain or gzipped: lines end at a line feed only, and bad lines are counted, not fatal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_lines(spark: SparkSession, path: str, contains: list[str] | None = None) -> DataFrame:
    """value: lines without byte order mark and carriage return; with `contains`, only lines that hold one of the strings.

    The cheap filter runs before any JSON is parsed.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "^\\x{FEFF}|\\r$", "").alias("value")).where(F.trim("value") != "")
    if contains:
        lines = lines.where(reduce(lambda a, b: a | b, [F.contains("value", F.lit(c)) for c in contains]))
    return lines


def parsed(lines: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns and bad: the line where it isn't such JSON, else null."""
    wide = StructType([*schema.fields]).add("__bad", "string")
    rows = lines.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"), "value")
    return rows.select(*[F.col("r").getField(f.name).alias(f.name) for f in schema.fields], F.coalesce(F.col("r").getField("__bad"), F.when(F.col("r").isNull(), F.col("value"))).alias("bad"))


def write_log(rows: DataFrame, path: str, by: str | None = None, gz: bool = False) -> None:
    """Appends rows as JSON lines, in a folder for each value of `by`."""
    writer = rows.write.mode("append").option("compression", "gzip" if gz else "none")
    (writer.partitionBy(by) if by else writer).json(path)


def rewrite_days(rows: DataFrame, path: str, day: str) -> None:
    """Replaces only the days that rows hold."""
    rows.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
