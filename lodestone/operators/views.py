"""Interactive views over an index: filters, facet counts, shelves, personal order, samples and plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import mulberry32
from lodestone.operators.common import settled


def all_terms(hay: Column, query: str) -> Column:
    """Whether every term of the query stands in the text, in either case."""
    terms = query.lower().split()
    return reduce(lambda a, b: a & b, [F.contains(F.lower(hay), F.lit(t)) for t in terms], F.lit(True))


def facet_counts(rows: DataFrame, facets: dict[str, tuple[Column, Column]]) -> DataFrame:
    """facet, value and n: each facet counted under the filters of all others. facets: name to (value, filter).

    One pass: a row counts for a facet if no other facet's filter drops it.
    """
    holds = {k: F.coalesce(f, F.lit(False)) for k, (_, f) in facets.items()}
    entries = []
    for k, (value, _) in facets.items():
        others = reduce(lambda a, b: a & b, [h for j, h in holds.items() if j != k], F.lit(True))
        entries.append(F.when(others, F.struct(F.lit(k).alias("facet"), value.cast("string").alias("value"))))
    return rows.select(F.inline(F.array_compact(F.array(*entries)))).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def matching(text: Column | None = None, query: str = "", equal: dict[str, tuple[Column, list]] | None = None, at_most: dict[str, tuple[Column, float]] | None = None, evidence: tuple[Column, list[str]] | None = None, skip: str = "") -> Column:
    """The conjunction of a view's filters: all terms of a query, values among lists, upper bounds, and chips that must all be hit; skip names one group to leave out."""
    parts = []
    if text is not None and skip != "query":
        parts.append(all_terms(text, query))
    parts += [x.isin(values) for k, (x, values) in (equal or {}).items() if k != skip and values]
    parts += [x <= top for k, (x, top) in (at_most or {}).items() if k != skip]
    if evidence and skip != "evidence":
        parts += [has_evidence(evidence[0], name) for name in evidence[1]]
    return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), parts, F.lit(True))


def has_evidence(chips: Column, name: str) -> Column:
    """Whether a chip (struct(id, status, hit)) of this name is known and hit."""
    return F.coalesce(F.exists(chips, lambda c: (c["id"] == name) & (c["status"] == "ok") & c["hit"]), F.lit(False))


def step_counts(rows: DataFrame, x: Column, steps: list[float], others: Column) -> DataFrame:
    """step and n: rows at or under each step that pass the other filters; steps hold what lower ones hold."""
    return shelf_counts(rows.where(F.coalesce(others, F.lit(False))), {f"{s:g}": x <= s for s in steps})


def shelf_counts(rows: DataFrame, shelves: dict[str, Column]) -> DataFrame:
    """shelf and n, zero for empty shelves: one aggregation, then a row a shelf."""
    counts = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in shelves.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("shelf"), F.col(k).alias("n")) for k in shelves])))


def counted_lanes(rows: DataFrame, lane: str, lanes: list[str]) -> DataFrame:
    """lane and n for a fixed list of lanes, zero for those without rows."""
    return shelf_counts(rows, {x: F.col(lane) == x for x in lanes})


def affinity(liked: Column, disliked: Column, pin: Column | None = None) -> Column:
    """ln((liked + 1) / (disliked + 1)); a pin adds or takes 0.7."""
    own = F.ln((liked + 1) / (disliked + 1))
    return own if pin is None else own + F.coalesce(pin, F.lit(0)) * 0.7


def taste(events: DataFrame, facets: DataFrame, key: str, liked: Column, disliked: Column) -> DataFrame:
    """facet, liked, disliked and affinity, from events joined with the facets of what they name."""
    joined = events.join(facets, key)
    counts = joined.groupBy("facet").agg(F.count_if(liked).alias("liked"), F.count_if(disliked).alias("disliked"))
    return counts.withColumn("affinity", affinity(F.col("liked"), F.col("disliked")))


def taste_terms(facets: DataFrame, tastes: DataFrame, key: str) -> DataFrame:
    """key and taste: the mean affinity of its facets, within -1 and 1; 0 without known facets."""
    joined = facets.join(tastes.select("facet", "affinity"), "facet", "left")
    return joined.groupBy(key).agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.avg("affinity"), F.lit(0.0)))).alias("taste"))


def _running(rows: DataFrame, band: str, order: list[Column], sums: dict[str, Column], low: tuple[str, Column] | None = None) -> DataFrame:
    """rows with running sums within each band in the order, and (low) the running minimum over the rows before.

    No band is one task's: rows are dealt by ranges of band and order, added up within each range, and the ranges' sums set end
    to end. The order must be unique, or equal rows share a range.
    """
    dealt = settled(rows.repartitionByRange(F.col(band), *order).withColumn("__part", F.spark_partition_id()))
    here = Window.partitionBy("__part", band).orderBy(*order)
    upto, before = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    least = {low[0]: low[1]} if low else {}
    parts = dealt.groupBy("__part", band).agg(*[F.sum(e).alias(f"__{k}") for k, e in sums.items()], *[F.min(e).alias(f"__{k}") for k, e in least.items()])
    ahead = Window.partitionBy(band).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.select(F.col("__part").alias("__p"), F.col(band).alias("__b"), *[F.coalesce(F.sum(f"__{k}").over(ahead), F.lit(0)).alias(f"__{k}") for k in sums], *[F.min(f"__{k}").over(ahead).alias(f"__{k}") for k in least])
    local = dealt.withColumns({k: F.sum(e).over(upto) for k, e in sums.items()} | {k: F.min(e).over(before) for k, e in least.items()})
    joined = local.join(ends, (F.col("__part") == F.col("__p")) & F.col(band).eqNullSafe(F.col("__b")))
    return joined.withColumns({k: F.col(k) + F.col(f"__{k}") for k in sums} | {k: F.least(k, f"__{k}") for k in least}).drop("__part", "__p", "__b", *[f"__{k}" for k in [*sums, *least]])


def for_you(rows: DataFrame, band: str, order: list[Column], taste_col: str, every: int = 10, bands: list[str] | None = None) -> DataFrame:
    """Adds place, over all bands (in the order of `bands`, else of their names): within each band the order, but every tenth place of the whole output holds the best row of negative taste still left in its band.

    A row of negative taste that its own rank has placed before its turn is not moved. The order should be unique.

    A band begins after the rows of the bands before it; let its ranks count from there up to the next tenth place (so the first one
    comes sooner). The rows of negative taste that are placed are always the first ones, so the j-th, of rank w(j), stands at the
    lesser of w(j) and the next tenth place after the (j-1)-th. That unrolls to min(w(j), every * (j + min(0, w(i) // every - i over
    i < j))), a running minimum; the others fill what is left, so one more count in the merged order gives all places.
    """
    wild = F.coalesce(F.col(taste_col) < 0, F.lit(False))
    names = rows.columns
    sizes = rows.groupBy(band).agg(F.count(F.lit(1)).alias("__size"))
    in_order = F.array_position(F.array(*map(F.lit, bands)), F.col(band)) if bands else F.col(band)
    ahead = Window.orderBy(in_order).rowsBetween(Window.unboundedPreceding, -1)  # one row a band
    ahead = settled(sizes.select(F.col(band).alias("__band"), F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__ahead")))
    ranked = _running(rows, band, order, {"__rank": F.lit(1), "__wilds": wild.cast("int")})
    ranked = ranked.join(ahead, F.col(band).eqNullSafe(F.col("__band"))).withColumn("__shift", F.col("__ahead") % every)
    ranked = ranked.withColumn("__from", F.col("__rank") + F.col("__shift")).drop("__band")
    lead = F.when(wild, F.floor(F.col("__from") / every) - F.col("__wilds"))
    turned = _running(ranked, band, [F.col("__rank")], {}, ("__low", lead))
    slot = F.least(F.col("__from"), every * (F.col("__wilds") + F.least(F.lit(0), F.coalesce("__low", F.lit(0))))) - F.col("__shift")
    # Others before it: of a row of negative taste its slot less those of its kind up to it, of another one its own count less one.
    others = F.when(wild, slot - F.col("__wilds")).otherwise(F.col("__rank") - F.col("__wilds") - 1)
    merged = turned.withColumns({"__others": others, "__plain": (~wild).cast("int")})
    placed = _running(merged, band, [F.col("__others"), F.col("__plain"), F.col("__rank")], {"place": F.lit(1)})
    return placed.select(*names, (F.col("place") + F.col("__ahead")).cast("long").alias("place"))


def sampled(rows: DataFrame, group: str, draw: Column, most: int) -> DataFrame:
    """Of each group the `most` rows of the least draws."""
    n = F.row_number().over(Window.partitionBy(group).orderBy("__draw"))
    return rows.withColumn("__draw", draw).withColumn("__n", n).where(F.col("__n") <= most).drop("__draw", "__n")


def drawn_places(draws: list[float], total: int) -> list[int]:
    """Places (from 0) of a partial Fisher-Yates shuffle of `total` rows, in order of drawing, by one draw in [0, 1) a place. Only places that were swapped are held."""
    moved: dict[int, int] = {}
    out = []
    for i, x in enumerate(draws[:total]):
        j = i + int(x * (total - i))
        out.append(moved.get(j, j))
        moved[j] = moved.get(i, i)
    return out


def drawn(rows: DataFrame, order: list[Column], n: int, seed: int) -> DataFrame:
    """n rows drawn without replacement, and `draw` (their place in the drawing, from 1): a partial Fisher-Yates of the rows in order, by Mulberry32.

    The order must be unique. The n draws are made in Spark and resolved in the driver, which holds n numbers. Rows are dealt by
    ranges of the order and numbered within them, so none but the drawn ones moves further.
    """
    spark = rows.sparkSession
    draws = [r["x"] for r in spark.range(1, n + 1).select("id", mulberry32(F.lit(seed), F.col("id")).alias("x")).orderBy("id").collect()]
    numbered = _running(rows.withColumn("__all", F.lit(0)), "__all", order, {"__place": F.lit(1)})
    places = [(p + 1, k) for k, p in enumerate(drawn_places(draws, rows.count()), 1)]
    taken = spark.createDataFrame(places, "__place long, draw long")
    return numbered.join(taken, "__place").select(*rows.columns, "draw")


def review_plan(rows: DataFrame, uncertain: Column, audit: Column, gem: Column, draw: Column, key: str, n: int, share: float = 0.1) -> DataFrame:
    """key and why: the uncertain ones first, best first, n in all; and a seeded audit draw of share * n more from the rest."""
    first = rows.orderBy(F.desc(F.coalesce(uncertain, F.lit(False))), gem.desc(), key).limit(n)
    more = rows.where(audit).join(F.broadcast(first.select(key)), key, "left_anti").orderBy(draw).limit(-int(-share * n // 1))
    return first.select(key, F.lit("plan").alias("why")).unionByName(more.select(key, F.lit("audit").alias("why")))


def tree_summary(paths: DataFrame, path: str, size: str, most: int = 40) -> DataFrame:
    """segment, is_dir, files and bytes by first path segment: directories first, then most files, then name."""
    parts = F.split(path, "/")
    by = paths.groupBy(parts[0].alias("segment")).agg(F.max(F.size(parts) > 1).alias("is_dir"), F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))
    return by.orderBy(F.desc("is_dir"), F.desc("files"), "segment").limit(most)
