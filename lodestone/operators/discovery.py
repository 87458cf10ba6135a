"""Discovery: caps and queues over candidates, duplicate events, windows of time and the spans already covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.common import settled


def capped(rows: DataFrame, group: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first `cap` rows of each group; Spark limits each task's groups before the shuffle."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__n") <= cap).drop("__n")


def capped_with_incumbents(stored: DataFrame, new: DataFrame, group: list[str], prior: str, order: list[Column], cap: int) -> DataFrame:
    """Rows of both, each with kept: a higher prior evicts, ties keep the stored row."""
    both = stored.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(prior), "is_new", *order))
    return both.withColumn("kept", n <= cap)


def first_by_rank(events: DataFrame, key: Column, rank: Column, order: list[str]) -> DataFrame:
    """One event a key: the best rank, the first among equals. Folded in each task before the shuffle."""
    best = F.min_by(F.struct(*events.columns), F.struct(rank.alias("r"), *order))
    return events.groupBy(key.alias("__key")).agg(best.alias("e")).select("e.*")


def numbered(rows: DataFrame, order: list[Column], name: str, limit: int) -> DataFrame:
    """The first `limit` rows with their place from 0: the top-k merge comes first, so the window sees `limit` rows only."""
    return rows.orderBy(*order).limit(limit).withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


#: At most this many drawn rows are broadcast; more are joined by shuffle.
BROADCAST_DRAWN = 10_000


def explored_queue(rows: DataFrame, key: str, head: list[Column], explore: Column, draw: Column, m: int, share: float) -> DataFrame:
    """Up to m rows best first, with a seeded draw from the explorable ones at every (m / drawn)-th place; place and explored are added.

    Slots: round(share * m), m / 20 at least, of the rows there are. What the draw can't fill, the head does. key is unique and not null.
    """
    explorable = F.coalesce(explore, F.lit(False))
    there, pool = rows.agg(F.count(F.lit(1)), F.count_if(explorable)).first()
    m = min(m, there)
    slots = min(m, max(int(share * m + 0.5), m // 20)) if share > 0 else 0
    picks = min(slots, pool)
    every = max(1, m // picks) if picks else m + 1
    drawn = numbered(rows.where(explorable).withColumn("__draw", draw), [F.col("__draw"), F.col(key)], "__k", picks).drop("__draw")
    taken = drawn.select(key)
    rest = numbered(rows.join(F.broadcast(taken) if picks <= BROADCAST_DRAWN else taken, key, "left_anti").select(rows.columns), head, "__k", m - picks)
    # The k-th drawn row stands at place every * (k + 1) - 1; head rows fill the others, every - 1 to each drawn one.
    at_drawn = F.col("__k") * every + (every - 1)
    at_head = F.col("__k") + F.least(F.floor(F.col("__k") / (every - 1)), F.lit(picks)) if every > 1 else F.col("__k") + picks
    return drawn.withColumn("place", at_drawn.cast("long")).withColumn("explored", F.lit(True)).unionByName(rest.withColumn("place", at_head.cast("long")).withColumn("explored", F.lit(False))).drop("__k")


def merged_spans(spans: DataFrame, start: str, end: str, group: list[str] | None = None, slack: int = 1) -> DataFrame:
    """Unions of spans (whole seconds) that overlap or lie within slack of each other.

    Give a group that bounds what a task sorts; without one, the input should be a digest (distinct spans).
    """
    by = Window.partitionBy(*(group or [F.lit(0)])).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__reach", reach).withColumn("__new", (F.col("__reach").isNull() | (F.col(start) > F.col("__reach") + slack)).cast("int"))
    marked = marked.withColumn("__island", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*(group or []), "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def covered(windows: DataFrame, spans: DataFrame, low: str, high: str, start: str, end: str, key: list[str], bucket: int = 86_400) -> DataFrame:
    """Windows (of at most a bucket) with covered: whether one merged span holds the window. An equi-join on buckets, not a cross join."""
    wide = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    placed = windows.withColumn("__bucket", F.floor(F.col(low) / bucket))
    held = placed.join(wide, [*key, "__bucket"]).where((F.col(start) <= F.col(low)) & (F.col(end) >= F.col(high))).select(*key, low, high).distinct()
    return windows.join(held.withColumn("covered", F.lit(True)), [*key, low, high], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def split_windows(events: DataFrame, at: str, seconds: int, leaf: int) -> DataFrame:
    """Windows of `seconds` with their counts; fuller ones are split into equal parts of whole seconds, as many as hold leaf rows each on average."""
    second = F.unix_seconds(F.col(at).cast("timestamp"))
    start = (F.floor(second / seconds) * seconds).cast("long")
    per_second = events.groupBy(second.alias("second"), start.alias("start")).agg(F.count(F.lit(1)).alias("n"))
    parts = per_second.groupBy("start").agg(F.sum("n").alias("n")).select("start", F.greatest(F.lit(1), F.least(F.ceil(F.col("n") / leaf), F.lit(seconds))).cast("long").alias("parts"))
    width = F.ceil(F.lit(seconds) / F.col("parts")).cast("long")
    own = per_second.join(parts, "start").withColumn("width", width).withColumn("low", F.col("start") + F.floor((F.col("second") - F.col("start")) / F.col("width")) * F.col("width"))
    return own.groupBy("start", "low", "width").agg(F.sum("n").alias("n"))


def split_until(events: DataFrame, at: str, seconds: int, leaf: int, least: int = 1) -> DataFrame:
    """Windows as by split_windows, but each part is counted again and split on until it holds at most leaf rows or is at most `least` seconds wide.

    A window of w seconds and n rows is cut into p = min(ceil(n / leaf), w) parts, the i-th from i * w // p. Windows without rows aren't listed. Rounds are over distinct seconds and each is written; windows only get
    narrower, so the loop ends.
    """
    second = F.unix_seconds(F.col(at).cast("timestamp"))
    start = (F.floor(second / seconds) * seconds).cast("long")
    counted = events.groupBy(second.alias("second"), start.alias("start")).agg(F.count(F.lit(1)).alias("n"))
    left = settled(counted.withColumns({"low": F.col("start"), "width": F.lit(seconds).cast("long")}))
    done = []
    while True:
        windows = settled(left.groupBy("start", "low", "width").agg(F.sum("n").alias("n")))
        full = (F.col("n") > leaf) & (F.col("width") > least)
        done.append(windows.where(~full))
        if windows.where(full).isEmpty():
            break
        cuts = windows.where(full).select("low", F.least(F.ceil(F.col("n") / leaf), F.col("width")).cast("long").alias("parts"))
        i = "(((second - low + 1) * parts - 1) div width)"
        left = settled(left.join(cuts, "low").selectExpr("second", "start", "n", f"low + {i} * width div parts AS low", f"({i} + 1) * width div parts - {i} * width div parts AS width"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def value_parts(low: int, high: int) -> list[tuple[str, int, int]]:
    """Name, least and most value of the parts that a crowded window is split into: the lowest value, the next one, and the rest."""
    if high <= low:
        return [(f"{low}", low, low)]
    if high == low + 1:
        return [(f"{low}", low, low), (f"{high}", high, high)]
    return [(f"{low}", low, low), (f"{low + 1}", low + 1, low + 1), (f"{low + 2}..{high}", low + 2, high)]


def scan_windows(events: DataFrame, at: str, value: str, seconds: int, leaf: int, least: int, cap: int, low: int, high: int) -> DataFrame:
    """Windows to scan, of events whose value lies in low to high: low, width, part (null for the whole window), n and saturated.

    Split in time as by split_until; a window of the least width with more than cap rows is split once more, by value, and all parts
    are listed, empty ones too. What still has more than cap rows can't be split and is saturated.
    """
    fitting = events.where(F.col(value).between(low, high))
    windows = settled(split_until(fitting, at, seconds, leaf, least).select("low", "width", "n"))
    parts = value_parts(low, high)
    crowded = (F.col("n") > cap) & (F.col("width") <= least) if len(parts) > 1 else F.lit(False)
    whole = windows.where(~crowded).select("low", "width", F.lit(None).cast("string").alias("part"), "n")
    name = F.coalesce(*[F.when(F.col(value).between(a, b), F.lit(k)) for k, a, b in parts])
    counted = fitting.groupBy(F.unix_seconds(F.col(at).cast("timestamp")).alias("second"), name.alias("part")).agg(F.count(F.lit(1)).alias("m"))
    # A crowded window has at most `least` seconds, so it meets the counts by seconds.
    by_second = windows.where(crowded).select("low", "width", F.explode(F.sequence(F.col("low"), F.col("low") + F.col("width") - 1)).alias("second"), F.array(*[F.lit(k) for k, _, _ in parts]).alias("names"))
    asked = by_second.select("low", "width", "second", F.explode("names").alias("part"))
    split = asked.join(counted, ["second", "part"], "left").groupBy("low", "width", "part").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"))
    return whole.unionByName(split).withColumn("saturated", F.col("n") > cap)


def done_spans(units: DataFrame, parts: list[str], group: list[str]) -> DataFrame:
    """group, start and end (whole seconds, inclusive) of what is scanned: units (low, width, part) that are done; a window split by value counts once all of its parts are."""
    whole = units.groupBy(*group, "low", "width").agg(F.count_if(F.col("part").isNull()).alias("w"), F.size(F.array_intersect(F.collect_set("part"), F.array(*map(F.lit, parts)))).alias("p"))
    done = whole.where((F.col("w") > 0) | (F.col("p") == len(parts))).select(*group, F.col("low").alias("start"), (F.col("low") + F.col("width") - 1).alias("end"))
    return merged_spans(done, "start", "end", group)
