"""Planning of scans: days and hours to fetch, equal parts of a window, random walks over ids, load in a rolling window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_hours(now: Column, n: int, wait_minutes: int = 15) -> Column:
    """The newest n hours, newest first, whose end lies at least wait_minutes back."""
    newest = F.date_trunc("hour", now - F.expr(f"INTERVAL {60 + wait_minutes} MINUTES"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: newest - F.make_dt_interval(hours=k))


def hour_name(at: Column) -> Column:
    """Such as 2026-09-10-5: the hour has no leading zero."""
    return F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit("-"), F.hour(at).cast("string"))


def planned_days(today: Column, lag: int = 3, backfill: int = 0) -> Column:
    """The day `lag` days back and `backfill` days before it, newest first."""
    return F.transform(F.sequence(F.lit(lag), F.lit(lag + backfill)), lambda k: F.date_sub(today, k))


def rotated_hours(day: Column, start: Column) -> Column:
    """The day's 24 hours from start on, wrapping round; any other start than 0 to 23 counts as 0."""
    first = F.when(start.between(0, 23), start).otherwise(0)
    return F.transform(F.sequence(F.lit(0), F.lit(23)), lambda k: day.cast("timestamp") + F.make_dt_interval(hours=F.pmod(first + k, F.lit(24)).cast("int")))


def equal_parts(low: Column, width: Column, parts: Column) -> Column:
    """struct(low, width) of whole-second parts of a window; no more parts than seconds."""
    n = F.greatest(F.lit(1), F.least(parts, width)).cast("long")
    cut = lambda k: F.floor(k * width / n)
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.struct((low + cut(k)).cast("long").alias("low"), (cut(k + 1) - cut(k)).cast("long").alias("width")))


def id_walk(rows: DataFrame, key: str, passes: Column, draw: Column, draws: int, span: int, most: int = 2) -> DataFrame:
    """Rows of a random walk: from each of `draws` random ids the first `most` passing rows of the next `span` ids, each row once.

    draw: an expression of `draw_no`, even in [0, 1). The few draws meet rows by blocks of ids, not by a cross join.
    """
    top = rows.agg(F.max(key)).first()[0] or 0
    starts = rows.sparkSession.range(draws).select(F.col("id").alias("draw_no")).withColumn("start", F.floor(draw * F.lit(float(top + 1))).cast("long"))
    blocks = starts.withColumn("block", F.explode(F.array_distinct(F.array(F.expr(f"start div {span}"), F.expr(f"(start + {span - 1}) div {span}")))))
    met = rows.where(passes).withColumn("block", F.expr(f"`{key}` div {span}")).join(blocks, "block").where((F.col(key) >= F.col("start")) & (F.col(key) < F.col("start") + span))
    kept = met.withColumn("n", F.row_number().over(Window.partitionBy("draw_no").orderBy(key))).where(F.col("n") <= most)
    return kept.select(rows.columns).dropDuplicates([key])


def rolling_load(calls: DataFrame, group: list[str], at: str, cost: str, seconds: int = 60) -> DataFrame:
    """calls with load: the cost of all calls of the group within the `seconds` up to and with each."""
    ms = F.unix_millis(F.col(at).cast("timestamp"))
    w = Window.partitionBy(*group).orderBy("__ms").rangeBetween(-(seconds * 1000 - 1), 0)
    return calls.withColumn("__ms", ms).withColumn("load", F.sum(cost).over(w)).drop("__ms")
