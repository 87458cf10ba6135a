"""Rule cascades: the first rule that fits decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prior(*signs: Column) -> Column:
    """How many of the cheap signs hold; unknown ones don't."""
    total = F.lit(0)
    for s in signs:
        total = total + F.coalesce(s, F.lit(False)).cast("int")
    return total


def cascade(rules: list[tuple[Column, str, str | None]], otherwise: str) -> Column:
    """struct(state, reason) of the first rule (condition, state, reason) that fits."""
    out = None
    for condition, state, reason in rules:
        value = F.struct(F.lit(state).alias("state"), F.lit(reason).cast("string").alias("reason"))
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(F.struct(F.lit(otherwise).alias("state"), F.lit(None).cast("string").alias("reason")))


def problems(checks: list[tuple[Column, str]]) -> Column:
    """An array of what is wrong with a row; empty if all checks hold. A check that is unknown counts as failed."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), what) for ok, what in checks]))


def hidden(last_action: Column, snooze_until: Column, now: Column) -> Column:
    """Dismissed, or snoozed into the future."""
    return F.coalesce((last_action == "dismissed") | (snooze_until > now), F.lit(False))
