"""Explainable scoring: signals to points, coverage, confidence, attention and rank. Bands and lanes are in catalogue.

Signals are rows (id, signal, ord, kind, status, hit, weight, grp): status is ok, unknown or na, and hit counts only where ok.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import sat, sigmoid, tidy


@dataclass(frozen=True)
class Signal:
    """One rule of a checklist: a condition (null: unknown), a weight and, for penalties that don't add up, a group."""

    name: str
    weight: float
    rule: Column
    group: str | None = None
    applies: Column | None = None


def signal_rows(rows: DataFrame, id_col: str, signals: list[Signal]) -> DataFrame:
    """One row for each row and signal, without a shuffle."""
    structs = []
    for k, s in enumerate(signals):
        status = F.when(F.coalesce(~s.applies, F.lit(False)) if s.applies is not None else F.lit(False), "na").when(s.rule.isNull(), "unknown").otherwise("ok")
        structs.append(F.struct(F.lit(s.name).alias("signal"), F.lit(k).alias("ord"), status.alias("status"), F.when(status == "ok", s.rule).alias("hit"), F.lit(float(s.weight)).alias("weight"), F.lit(s.group).cast("string").alias("grp")))
    return rows.select(F.col(id_col), F.inline(F.array(*structs)))


def points(signals: DataFrame, id_col: str) -> DataFrame:
    """id, points, points_max and coverage. Of the penalties of one group only the worst counts. Rows of an id are brought together once; both aggregations use that."""
    counted = F.coalesce("grp", F.concat(F.lit("="), "signal"))
    ok = F.col("status") == "ok"
    by_group = signals.repartition(id_col).groupBy(id_col, counted.alias("counted")).agg(
        F.min(F.when(ok & F.col("hit"), F.col("weight"))).alias("own"),
        F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)).alias("most"),
        F.sum(F.when(ok, F.abs("weight")).otherwise(0.0)).alias("known"),
        F.sum(F.when(F.col("status") != "na", F.abs("weight")).otherwise(0.0)).alias("possible"),
    )
    total = by_group.groupBy(id_col).agg(F.sum("own").alias("own"), F.sum("most").alias("points_max"), F.sum("known").alias("known"), F.sum("possible").alias("possible"))
    return total.select(id_col, tidy(F.coalesce("own", F.lit(0.0))).alias("points"), "points_max", tidy(F.coalesce(F.try_divide("known", "possible"), F.lit(0.0))).alias("coverage"))


def points_in_row(signals: list[Signal]) -> Column:
    """The same sum as an expression over the row itself: no shuffle. Groups are small, so each is one least()."""
    groups: dict[str, list[Signal]] = {}
    for s in signals:
        groups.setdefault(s.group or "=" + s.name, []).append(s)
    own = [F.when(s.rule & (s.applies if s.applies is not None else F.lit(True)), float(s.weight)) for s in signals]
    at = {s.name: x for s, x in zip(signals, own, strict=True)}
    parts = [F.coalesce(F.least(*[at[s.name] for s in g]) if len(g) > 1 else at[g[0].name], F.lit(0.0)) for g in groups.values()]
    return tidy(sum(parts[1:], parts[0]))


def confidence(items: DataFrame, id_col: str) -> DataFrame:
    """items: id, grp, strength in [0, 1]. 1 less the product of what each group's strongest item leaves open."""
    strongest = items.groupBy(id_col, "grp").agg(F.max("strength").alias("m"))
    return strongest.groupBy(id_col).agg(F.product(1 - F.col("m")).alias("open")).select(id_col, tidy(1 - F.col("open")).alias("confidence"))


def attention(stars: Column, forks: Column, top: float = 25.0) -> Column:
    return sat(stars + forks, top)


def quality(score: Column, a: float = -6.403, b: float = 1.113) -> Column:
    """Calibrated: sigmoid of a + b times the points."""
    return sigmoid(F.lit(a) + F.lit(b) * score)


def gem(score: Column, conf: Column, att: Column) -> Column:
    """The rank: points, moved by confidence and attention by 1.5 at most each."""
    return tidy(score + 1.5 * conf - 1.5 * att)


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows of a total order: a bounded heap in each task, then one merge."""
    return rows.orderBy(*order).limit(k)
