"""Joins of state, time and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """Each left row with the right side's last value at or before it.

    Both sides are one stream in order of time, and the value is carried forward: a sort by key, not a pairing of rows.
    """
    from pyspark.sql import Window

    own = [F.col(c) for c in left.columns]
    l = left.select(F.struct(*own).alias("__row"), F.col(key).alias("__key"), F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    r = right.select(F.lit(None).cast(l.schema["__row"].dataType).alias("__row"), F.col(key).alias("__key"), F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    w = Window.partitionBy("__key").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = l.unionByName(r).withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return carried.select("__row.*", value)


def cohort(rows: DataFrame, key: str, week: str, now: str, days: int = 28) -> DataFrame:
    """key, week, then and now: each row of a week with its own row of four weeks before."""
    before = rows.select(F.col(key), F.date_add(F.col(week), days).alias(week), F.col(now).alias("then"))
    return rows.select(key, week, F.col(now).alias("now")).join(before, [key, week])


def missing(ids: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """ids with gone: whether the live table lacks them."""
    return ids.join(live.select(key).distinct().withColumn("__live", F.lit(True)), key, "left").withColumn("gone", F.col("__live").isNull()).drop("__live")


def merged_feedback(stored: DataFrame, imported: DataFrame, identity: list[str], valid: Column) -> DataFrame:
    """Stored rows and valid imported ones that are new by their identity (null-safe), each once."""
    new = imported.where(F.coalesce(valid, F.lit(False))).dropDuplicates(identity)
    s, n = stored.select(*identity).distinct().alias("s"), new.alias("n")
    same = F.lit(True)
    for c in identity:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}"))
    return stored.unionByName(n.join(s, same, "left_anti"))
