"""Folds of append-only logs into current state. Logs have a key and an order (a sequence number), so any replay gives the same state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def latest(log: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The last row of each key. An aggregation, so tasks fold their own rows before the shuffle and no key fills a task."""
    last = F.max_by(F.struct(*fields), F.struct(*order))
    return log.groupBy(key).agg(last.alias("last")).select(key, "last.*")


def latest_fields(log: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """For each field its last value that isn't null."""
    return log.groupBy(key).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f) for f in fields])


def patched(log: DataFrame, key: str, order: list[str], patch: str, fields: list[str]) -> DataFrame:
    """patch is a map; a field that it names is set, to null too; a field that it doesn't name stays."""
    named = lambda f: F.when(F.map_contains_key(F.col(patch), f), F.struct(*order))
    return log.groupBy(key).agg(*[F.max_by(F.col(patch)[f], named(f)).alias(f) for f in fields])


def ledger(log: DataFrame, key: str, order: list[str], state: str, at: str, most_attempts: int = 5, base_minutes: int = 10) -> DataFrame:
    """key, state, at, attempts (starts) and next_at: after a failure, base * 2^attempts minutes on; null once attempts run out."""
    folded = log.groupBy(key).agg(F.max_by(F.struct(F.col(state).alias("state"), F.col(at).alias("at")), F.struct(*order)).alias("last"), F.count_if(F.col(state) == "start").alias("attempts"))
    wait = F.make_dt_interval(mins=(F.lit(base_minutes) * F.pow(F.lit(2.0), F.least("attempts", F.lit(most_attempts)))).cast("int"))
    failed = (F.col("last.state") == "failed") & (F.col("attempts") < most_attempts)
    return folded.select(key, "last.state", "last.at", "attempts", F.when(failed, F.col("last.at") + wait).alias("next_at"))


def history(log: DataFrame, key: str, order: list[str], watched: list[str], keep: int = 50) -> DataFrame:
    """Rows at which a watched field differs from the row before; the newest `keep` of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(F.struct(*watched)).over(w)
    changed = log.withColumn("__before", before).where(F.col("__before").isNull() | ~F.col("__before").eqNullSafe(F.struct(*watched))).drop("__before")
    newest = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) for o in order]))
    return changed.withColumn("__n", newest).where(F.col("__n") <= keep).drop("__n")


def without_undone(log: DataFrame, at: str, undoes: str, key: str | None = None, seq: str | None = None, undoes_seq: str | None = None) -> DataFrame:
    """Events but undos and what they name: whosever it is (fold A), or of the undo's own key (fold B, with key).

    An undo names a time, or (undoes_seq) a place in the log (seq).
    """
    own = [key] if key else []
    is_undo = F.col(undoes).isNotNull() | (F.col(undoes_seq).isNotNull() if undoes_seq else F.lit(False))
    left = log.where(~is_undo)
    for named, by in ((undoes, at), (undoes_seq, seq)):
        if named:
            left = left.join(log.where(F.col(named).isNotNull()).select(*own, F.col(named).alias(by)).distinct(), [*own, by], "left_anti")
    return left.select(log.columns)


def feedback_state(active: DataFrame, key: str, order: list[str], action: str, snooze: str, switches: tuple[str, str] = ("publish", "unpublish")) -> DataFrame:
    """key, last_action, snooze_until (that of the last action) and published, of events that weren't undone. One aggregation."""
    switch = F.col(action).isin(*switches)
    at = F.struct(*order)
    last = F.max_by(F.struct(F.col(action).alias("a"), F.col(snooze).alias("s")), F.when(~switch, at))
    shown = F.max_by(F.col(action), F.when(switch, at)) == switches[0]
    return active.groupBy(key).agg(last.alias("l"), F.coalesce(shown, F.lit(False)).alias("published")).select(key, F.col("l.a").alias("last_action"), F.col("l.s").alias("snooze_until"), "published")


#: Actions that set the queue's state, those of them that keep a snooze, and the switches of publishing. Others change nothing.
QUEUE_ACTIONS, SNOOZING, SWITCHES = ["gem", "notgood", "notmine", "wip", "snooze"], ["wip", "snooze"], ("publish", "unpublish")


def queue_state(active: DataFrame, key: str, order: list[str], action: str, snooze: str, sets: list[str] | None = None, snoozing: list[str] | None = None, switches: tuple[str, str] = SWITCHES) -> DataFrame:
    """key, last_action, snooze_until and published, of events that weren't undone: the state of the queue (fold B). One aggregation.

    Only actions of `sets` count as the last one (a label doesn't); the snooze is that of the last of these, if it is one of
    `snoozing`, so that a later judgement clears it. A key with other actions only is there, with nulls.
    """
    at, name = F.struct(*order), F.col(action)
    last = F.max_by(F.struct(name.alias("a"), F.when(name.isin(SNOOZING if snoozing is None else snoozing), F.col(snooze)).alias("s")), F.when(name.isin(QUEUE_ACTIONS if sets is None else sets), at))
    shown = F.max_by(name, F.when(name.isin(*switches), at)) == switches[0]
    return active.groupBy(key).agg(last.alias("l"), F.coalesce(shown, F.lit(False)).alias("published")).select(key, F.col("l.a").alias("last_action"), F.col("l.s").alias("snooze_until"), "published")


#: Which actions make up the last state of each class.
CLASSES = {"triage": ["gem", "wip", "notgood", "notmine"], "publishing": ["publish", "unpublish"], "gem": ["gem"]}


def stacked_actions(log: DataFrame, key: str, seq: str, at: str, action: str, undoes: str, classes: dict[str, list[str]] | None = None) -> DataFrame:
    """Fold C: a stack for each key; an undo takes off the last event at that time, else the last one. key, the last action left, events_left, and the last action of each class.

    Events are streamed in order through the task of their key, which holds the live stack of the key at hand only: four words an
    event. Undos depend on all that is live, so the events of one key can't be folded in parts.
    """
    classes = classes or {}
    kinds = log.select(key, action).schema
    names = [key, "action", "events_left", *classes]
    rows = log.select(key, seq, at, undoes, action).repartition(key).sortWithinPartitions(key, seq)
    schema = StructType([kinds[0], StructField("action", kinds[1].dataType), StructField("events_left", LongType()), *[StructField(k, kinds[1].dataType) for k in classes]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, stack, by_time, live, started = None, {}, {}, 0, False

        def ended() -> tuple:
            left = list(reversed(stack.values()))
            return here, left[0][1] if left else None, len(stack), *[next((a for _, a in left if a in of), None) for of in classes.values()]

        def made(rows: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [like.schema.types[0], like.schema.types[4], pa.int64(), *[like.schema.types[4]] * len(classes)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        batch = None
        for batch in (b.slice(k, 4_096) for b in batches for k in range(0, b.num_rows, 4_096)):
            out = []
            for k, time, undo, what in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if not started or k != here:
                    if started:
                        out.append(ended())
                    here, stack, by_time, live, started = k, {}, {}, 0, True
                if undo is None:
                    stack[live] = (time, what)
                    by_time.setdefault(time, []).append(live)
                    live += 1
                elif stack:
                    place = by_time[undo][-1] if by_time.get(undo) else next(reversed(stack))
                    of = by_time[stack.pop(place)[0]]
                    of.remove(place)
            yield made(out, batch)
        if started:
            yield made([ended()], batch)

    return rows.mapInArrow(run, schema)


def owner_memory(log: DataFrame, key: str, flag: str, order: list[str], fields: list[str]) -> DataFrame:
    """The union of all flags ever set, and each field's last value that isn't null."""
    flags = F.array_sort(F.collect_set(flag))
    return log.groupBy(key).agg(flags.alias("flags"), *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f) for f in fields])


def upsert(stored: DataFrame, seeds: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Stored rows updated by seeds and seeds that are new, with change: insert, update, same or keep."""
    s, n = stored.alias("s"), seeds.alias("n")
    joined = s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"s.{f}").eqNullSafe(F.coalesce(F.col(f"n.{f}"), F.col(f"s.{f}")))
    change = F.when(F.col(f"s.{key}").isNull(), "insert").when(F.col(f"n.{key}").isNull(), "keep").when(differs, "update").otherwise("same")
    return joined.select(F.coalesce(f"s.{key}", f"n.{key}").alias(key), *[F.coalesce(f"n.{f}", f"s.{f}").alias(f) for f in fields], change.alias("change"))


def retained(log: DataFrame, at: str, now: Column, days: Column) -> DataFrame:
    """Rows not older than their days; rows without a limit stay."""
    return log.where(days.isNull() | (F.col(at) >= now - F.make_dt_interval(days=days)))
