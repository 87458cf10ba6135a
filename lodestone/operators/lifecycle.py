"""The life of a candidate and its record: seeds merged, results settled, records kept, looked at again, deepened, reviewed and published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import clipped, days_between

#: Reasons for which a prefilter drops a seed; a candidate dropped for one of them is opened again when it is seen again.
PREFILTER_REASONS = ["excluded-kind", "attention", "too-small", "profile-or-site", "lure-name", "spam-words", "farm-owner", "no-language-yet", "no-language", "owner-cap"]
#: Lanes that are worth a deep look.
DEEP_LANES = ["promising", "proven", "look", "doubted"]


def merged_seed(now: Column, requeue_days: int = 7) -> Column:
    """struct(state, reason, prior, next_at, reopened) of a known candidate (state, reason, prior, pushed_at, looked_at) that a seed (seed_pushed_at) with its prefilter result (pre_state, pre_reason, pre_prior, pre_next_at) meets again.

    Deferred, expired, gone and prefiltered ones are judged anew; a queued one keeps the higher prior; an enriched one is queued
    again if it was pushed to since and its last look is old.
    """
    c = F.col
    anew = c("state").isin("deferred", "expired", "gone") | ((c("state") == "dropped") & F.coalesce(c("reason").isin(PREFILTER_REASONS), F.lit(False)))
    again = (c("state") == "enriched") & F.coalesce(c("seed_pushed_at") > c("pushed_at"), F.lit(False)) & F.coalesce(days_between(c("looked_at"), now) >= requeue_days, F.lit(False))
    value = lambda state, reason, prior, at, opened: F.struct(state.alias("state"), reason.alias("reason"), prior.cast("int").alias("prior"), at.alias("next_at"), F.lit(opened).alias("reopened"))
    none = F.lit(None).cast("timestamp")
    return (
        F.when(anew, value(c("pre_state"), c("pre_reason"), c("pre_prior"), F.when(c("pre_state") == "deferred", c("pre_next_at")), True))
        .when(c("state") == "queued", value(c("state"), c("reason"), F.greatest("prior", "pre_prior"), none, False))
        .when(again, value(F.lit("queued"), F.lit("pushed"), c("pre_prior") + 2, none, True))
        .otherwise(value(c("state"), c("reason"), c("prior"), none, False))
    )


def merged_candidates(stored: DataFrame, seeds: DataFrame, key: str, now: Column, live: list[str], requeue_days: int = 7) -> DataFrame:
    """stored candidates and the seeds that meet them, whole: live values, sources, state and times; with change: new, reopened, merged or kept.

    stored: key, the live fields (pushed_at among them), sources, state, reason, prior, next_at, seen_at, looked_at (null: never looked
    at). seeds: key, the live fields, source, and the prefilter's pre_state, pre_reason, pre_prior and pre_next_at; unique by key. A live
    value that a seed lacks stays; a source is added once, at the end. One join by key.
    """
    c, n = stored.alias("c"), seeds.alias("n")
    joined = c.join(n, F.col(f"c.{key}") == F.col(f"n.{key}"), "full")
    known, met = F.col(f"c.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    pre = [f"pre_{x}" for x in ("state", "reason", "prior", "next_at")]
    rows = joined.select(
        F.coalesce(f"c.{key}", f"n.{key}").alias(key), known.alias("__known"), met.alias("__met"), *[F.coalesce(f"n.{f}", f"c.{f}").alias(f"__{f}") for f in live], F.col("n.source").alias("__source"), F.coalesce("c.sources", F.array().cast("array<string>")).alias("sources"),
        "c.state", "c.reason", "c.prior", F.col("c.next_at").alias("__next_at"), F.col("c.seen_at").alias("__seen_at"), F.coalesce("c.looked_at", "c.seen_at").alias("looked_at"), F.col("c.looked_at").alias("__looked_at"), F.col("c.pushed_at").alias("pushed_at"), F.col("n.pushed_at").alias("seed_pushed_at"), *[f"n.{x}" for x in pre],
    )
    merged = merged_seed(now, requeue_days)
    first = F.struct(F.col("pre_state").alias("state"), F.col("pre_reason").alias("reason"), F.col("pre_prior").cast("int").alias("prior"), F.when(F.col("pre_state") == "deferred", F.col("pre_next_at")).alias("next_at"), F.lit(False).alias("reopened"))
    same = F.struct(F.col("state").alias("state"), F.col("reason").alias("reason"), F.col("prior").cast("int").alias("prior"), F.col("__next_at").alias("next_at"), F.lit(False).alias("reopened"))
    # What isn't opened again keeps its own time.
    own = F.when(merged["reopened"], merged).otherwise(merged.withField("next_at", F.col("__next_at")))
    rows = rows.withColumn("__m", F.when(~F.col("__known"), first).when(F.col("__met"), own).otherwise(same))
    change = F.when(~F.col("__known"), "new").when(F.col("__m.reopened"), "reopened").when(F.col("__met"), "merged").otherwise("kept")
    listed = F.when(F.col("__source").isNull() | F.array_contains("sources", F.col("__source")), F.col("sources")).otherwise(F.concat("sources", F.array("__source")))
    seen = F.when(~F.col("__known") | F.col("__m.reopened"), now).otherwise(F.col("__seen_at"))
    return rows.select(key, *[F.col(f"__{f}").alias(f) for f in live], listed.alias("sources"), "__m.state", "__m.reason", "__m.prior", "__m.next_at", seen.alias("seen_at"), F.col("__looked_at").alias("looked_at"), change.alias("change"))


def settled_state(gates: Column, actions: Column) -> Column:
    """struct(state, reason) after enrichment: dropped by the first gate that drops, quarantined by the first that does, else enriched."""
    named = F.arrays_zip(gates.alias("gate"), actions.alias("action"))
    first = lambda what: F.get(F.filter(named, lambda x: x["action"] == what), F.lit(0))["gate"]
    return F.struct(F.when(F.array_contains(actions, "drop"), "dropped").when(F.array_contains(actions, "quarantine"), "quarantined").otherwise("enriched").alias("state"), F.coalesce(first("drop"), first("quarantine")).alias("reason"))


def kept(actions: Column, lane: Column, feedback: Column, verdict: Column, sources: Column) -> Column:
    """Whether a scored record stays: never if a gate drops it; always with feedback, a verdict or a wish; else if it isn't low."""
    asked = F.arrays_overlap(sources, F.array(F.lit("add"), F.lit("sample")))
    return lane.isNotNull() & ~F.array_contains(actions, "drop") & (feedback | verdict | F.coalesce(asked, F.lit(False)) | (lane != "low"))


def ever_quarantined(lane: Column, actions: Column, history_lanes: Column, state: Column) -> Column:
    yes = lambda x: F.coalesce(x, F.lit(False))
    return yes(lane == "quarantine") | yes(F.array_contains(actions, "quarantine")) | yes(F.array_contains(history_lanes, "quarantine")) | yes(state == "quarantined")


def opted_out(rows: DataFrame, wishes: DataFrame, key: str, name: str) -> DataFrame:
    """rows with opted_out: whether wishes (value) name the row's id, its owner/name or its owner, in either case."""
    wish = wishes.select(F.lower(F.trim("value")).alias("__wish")).where("__wish <> ''").distinct()
    keys = F.array_distinct(F.array(F.lower(F.col(key).cast("string")), F.lower(name), F.lower(F.substring_index(name, "/", 1))))
    named = rows.select(F.col(key), F.explode(keys).alias("__wish")).join(wish, "__wish", "left_semi").select(key).distinct().withColumn("opted_out", F.lit(True))
    return rows.join(named, key, "left").withColumn("opted_out", F.coalesce("opted_out", F.lit(False)))


def skip_reason(published: Column, triage: Column, has_record: Column, name: Column, out: Column, age: Column, quarantined: Column, blocked: Column, least_days: int = 7) -> Column:
    """Why a published pick isn't shown: the first rule that fits, null if it is; unpublished rows say so."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    return (
        F.when(~yes(published), "not published")
        .when(~yes(triage == "gem"), "no longer saved as a gem")
        .when(~yes(has_record), "no stored record")
        .when(~yes(name.rlike("^[A-Za-z0-9-]+/[A-Za-z0-9._-]+$")), "not a valid owner/name")
        .when(yes(out), "opted out")
        .when(~yes(age >= least_days), f"younger than {least_days} days")
        .when(yes(quarantined), "was quarantined")
        .when(yes(blocked), "its review asked not to promote it")
    )


def minimal_patches(stored: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key and patch (a map of the changed fields to their new values as text, null for emptied ones) of rows that differ."""
    s, n = stored.alias("s"), new.alias("n")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"s.{f}").eqNullSafe(F.col(f"n.{f}")), F.struct(F.lit(f), F.col(f"n.{f}").cast("string"))) for f in fields]))
    return s.join(n, key).select(F.col(key), F.map_from_entries(changed).alias("patch")).where(F.size("patch") > 0)


def recovered(units: DataFrame, state: str, run: str, current: Column) -> DataFrame:
    """Units that another run left running are planned again."""
    return units.withColumn(state, F.when((F.col(state) == "running") & ~F.col(run).eqNullSafe(current), "planned").otherwise(F.col(state)))


def collapsed(log: DataFrame, key: str, at: str, order: list[str], before: Column) -> DataFrame:
    """The log with only the last event of each key and month in months before `before`; later months stay whole."""
    month = F.date_trunc("month", at)
    last = F.row_number().over(Window.partitionBy(key, "__month").orderBy(*[F.desc(o) for o in order])) == 1
    marked = log.withColumn("__month", month)
    old = marked.where(F.col("__month") < before).withColumn("__last", last).where("__last").drop("__last")
    return old.unionByName(marked.where(F.col("__month") >= before)).drop("__month")


def latest_verdict(verdicts: DataFrame, parts: list[str], head: str, order: list[str]) -> DataFrame:
    """The last verdict of each key of parts; a missing head counts as HEAD."""
    own = verdicts.withColumn(head, F.when(F.coalesce(head, F.lit("")) == "", "HEAD").otherwise(F.col(head)))
    return own.groupBy(*parts).agg(F.max_by(F.struct(*[c for c in own.columns if c not in parts]), F.struct(*order)).alias("v")).select(*parts, "v.*")


def needs_deep(head: Column, stages: Column, deep_head: Column) -> Column:
    """Whether a record with a known head wasn't looked at in depth, or was at another head."""
    return F.coalesce((head != "") & (~F.coalesce(F.array_contains(stages, "deep"), F.lit(False)) | F.coalesce(deep_head != head, F.lit(False))), F.lit(False))


def bounded_verdict(v: Column) -> Column:
    """A verdict's output within its bounds: texts and claims clipped, scores whole from 1 to 4, confidence from 0 to 1, 12 claims at most, flags once."""
    clamp = lambda x, low, high: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    return F.struct(
        clipped(v["pitch"], 140).alias("pitch"), clipped(v["audience"], 80).alias("audience"), clipped(v["summary"], 400).alias("summary"),
        F.transform(v["scores"], lambda x: clamp(F.floor(x + 0.5), 1, 4).cast("int")).alias("scores"), clamp(v["confidence"], 0.0, 1.0).alias("confidence"), F.array_distinct(v["flags"]).alias("flags"),
        F.transform(F.slice(v["claims"], 1, 12), lambda x: F.struct(clipped(x["text"], 240).alias("text"), clipped(x["quote"], 200).alias("quote"))).alias("claims"), F.greatest(F.size(v["claims"]) - 12, F.lit(0)).alias("extra"),
    )


def within_budget(rows: DataFrame, group: list[str], order: list[Column], cost: str, budget: float) -> DataFrame:
    """The rows of each group whose costs, in order, still fit the budget; the first that doesn't ends the group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def releases_since(picks: DataFrame, releases: DataFrame, key: str, published: str, released: str) -> DataFrame:
    """picks with releases: how many of their releases came after they were published."""
    after = picks.join(releases, key).where(F.col(released) > F.col(published)).groupBy(key).agg(F.count(F.lit(1)).alias("releases"))
    return picks.join(after, key, "left").withColumn("releases", F.coalesce("releases", F.lit(0)))


def by_name_or_id(nodes: DataFrame, records: DataFrame, name: str, key: str) -> DataFrame:
    """nodes with known and renamed: their record by name (in either case), else by id, which tells of a new name."""
    r = records.select(F.lower(name).alias("__name"), F.col(key).alias("__id"))
    by_name = nodes.join(r.select("__name", F.col("__id").alias("__n")), F.lower(nodes[name]) == F.col("__name"), "left").drop("__name")
    both = by_name.join(r.select(F.col("__id").alias("__i")).distinct(), by_name[key] == F.col("__i"), "left")
    return both.withColumn("known", F.coalesce("__n", "__i")).withColumn("renamed", F.col("__n").isNull() & F.col("__i").isNotNull()).drop("__n", "__i")


def expectation_problems(lane: Column, band: Column, points: Column, gates: Column, actions: Column, expect: Column) -> Column:
    """What a scored row does otherwise than expected. expect: struct(lanes, not_lanes, bands, min_points, max_points, gates, outcome), null for what isn't said."""
    dropped = F.array_contains(actions, "drop")
    blocking = F.exists(actions, lambda a: a != "institutional")
    say = lambda cond, what: F.when(F.coalesce(cond, F.lit(False)), what)
    return F.array_compact(F.array(
        say(~F.array_contains(expect["lanes"], lane) & ~(dropped & expect["outcome"].eqNullSafe("dropped")), "lane"),
        say(F.array_contains(expect["not_lanes"], lane), "forbidden lane"), say(~F.array_contains(expect["bands"], band), "band"), say(points < expect["min_points"], "too few points"), say(points > expect["max_points"], "too many points"),
        say((F.size(expect["gates"]) == 0) & blocking, "gated"), say((F.size(expect["gates"]) > 0) & ~F.arrays_overlap(gates, expect["gates"]), "not gated"),
        say((expect["outcome"] == "quarantined") & (lane != "quarantine"), "not quarantined"), say((expect["outcome"] == "dropped") & ~dropped, "not dropped"),
    ))
