"""Statistics of scores against labels. All fold rows to distinct scores (or a few sums) before anything ordered happens."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import log_likelihood


def auc(rows: DataFrame, score: str, positive: Column, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """The Mann-Whitney statistic, ties one half; null when a class is empty. weight counts a row so many times.

    Rows are folded to distinct scores first. Scores are then ranked in ranges, whose sums are set end to end, so that no task holds
    them all, unless groups (by) do that already.
    """
    by, weight = by or [], F.lit(1) if weight is None else weight
    counts = rows.where(F.col(score).isNotNull() & positive.isNotNull()).groupBy(*by, score).agg(F.sum(F.when(positive, weight).otherwise(0)).alias("p"), F.sum(F.when(~positive, weight).otherwise(0)).alias("n"))
    area = lambda below: F.sum(F.col("p") * (below + F.col("n") / 2))
    inner = lambda part: F.coalesce(F.sum("n").over(Window.partitionBy(*part).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if by:
        return counts.withColumn("below", inner(by)).groupBy(*by).agg(F.try_divide(area(F.col("below")), F.sum("p") * F.sum("n")).alias("auc"))
    parts = counts.repartitionByRange(score).withColumn("part", F.spark_partition_id()).withColumn("below", inner(["part"])).groupBy("part").agg(area(F.col("below")).alias("area"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    return parts.withColumn("ahead", ahead).agg(F.try_divide(F.sum(F.col("area") + F.col("p") * F.col("ahead")), F.sum("p") * F.sum("n")).alias("auc"))


def precision_at(rows: DataFrame, order: list[Column], positive: Column, k: int) -> DataFrame:
    return rows.orderBy(*order).limit(k).agg(F.avg(positive.cast("double")).alias("precision"), F.count(F.lit(1)).alias("taken"))


def brier(rows: DataFrame, p: Column, positive: Column) -> DataFrame:
    return rows.agg(F.avg(F.pow(p - positive.cast("double"), 2)).alias("brier"), F.count(F.lit(1)).alias("n"))


def reliability(rows: DataFrame, p: Column, positive: Column, bins: int = 10) -> DataFrame:
    """bin, n, mean_p and share of equal bins; the last one holds 1; empty ones have nulls."""
    counts = rows.groupBy(F.least(F.lit(bins - 1), F.floor(p * bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(positive.cast("double")).alias("share"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "share")


def quantiles(rows: DataFrame, x: str, qs: list[float]) -> DataFrame:
    """Exact, with linear interpolation at (n - 1) q.

    Distinct values are counted and numbered in ranges that are set end to end, so no task holds all of them.
    """
    counts = rows.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    dealt = counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()).withColumn("upto", F.sum("n").over(within))
    sums = dealt.groupBy("part").agg(F.sum("n").alias("sum"))
    ahead = sums.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row a range
    total = sums.agg(F.sum("sum").alias("total"))
    wanted = F.array(*[F.struct(F.lit(float(q)).alias("q"), ((F.col("total") - 1) * q).alias("at")) for q in qs])
    placed = dealt.join(F.broadcast(ahead), "part").select("v", (F.col("ahead") + F.col("upto") - F.col("n")).alias("low"), (F.col("ahead") + F.col("upto") - 1).alias("high"))
    asked = placed.join(F.broadcast(total)).select("v", "low", "high", F.inline(wanted))  # one row of totals
    near = asked.where((F.col("low") <= F.ceil("at")) & (F.col("high") >= F.floor("at")))
    share = F.col("at") - F.floor("at")
    return near.groupBy("q", "at").agg(F.min("v").alias("a"), F.max("v").alias("b")).select("q", (F.col("a") + (F.col("b") - F.col("a")) * share).alias("v"))


def likelihood_ratio(rows: DataFrame, hit: Column, positive: Column) -> DataFrame:
    """tp, fp, fn, tn and LR+; rows of unknown hit don't count; all cells gain 0.5 if one is 0; null without a class or a hit."""
    known = rows.where(hit.isNotNull() & positive.isNotNull())
    cells = known.agg(F.count_if(hit & positive).alias("tp"), F.count_if(hit & ~positive).alias("fp"), F.count_if(~hit & positive).alias("fn"), F.count_if(~hit & ~positive).alias("tn"))
    add = F.when(F.least("tp", "fp", "fn", "tn") == 0, 0.5).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) + add for c in ("tp", "fp", "fn", "tn"))
    fine = (F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0) & (F.col("tp") + F.col("fp") > 0)
    return cells.withColumn("lr_plus", F.when(fine, F.try_divide(tp / (tp + fn), fp / (fp + tn))))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two labellers; 1 where chance alone agrees always."""
    cells = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    agree = cells.agg(F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("agree"), total.alias("n"))
    left, right = cells.groupBy(F.col(a).alias("x")).agg(F.sum("n").alias("l")), cells.groupBy(F.col(b).alias("x")).agg(F.sum("n").alias("r"))
    chance = left.join(right, "x").agg(F.sum(F.col("l").cast("double") * F.col("r")).alias("chance"))
    both = agree.join(F.broadcast(chance))  # one row each
    po, pe = F.col("agree") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return both.select(F.when(pe >= 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe)).alias("kappa"), "n")


def poisson_steps() -> list[float]:
    """The distribution function of Poisson(1) at 0, 1, 2 and on."""
    steps, term, total = [], math.exp(-1), math.exp(-1)
    for k in range(1, 12):
        steps.append(total)
        term /= k
        total += term
    return steps


def poisson(u: Column) -> Column:
    """A Poisson(1) number from a draw that is even in [0, 1)."""
    steps = poisson_steps()
    return sum(((u >= s).cast("int") for s in steps[1:]), (u >= steps[0]).cast("int"))


def bootstrap(rows: DataFrame, replicates: int, draw: Column, metric) -> DataFrame:
    """metric(rows with rep and weight) over replicates: each row has a seeded Poisson(1) weight in each, so nothing is collected or resampled.

    draw: a column of `rep` and a key, even in [0, 1). With the key of a cluster its rows are drawn together; with the same draw for
    two metrics they are paired.
    """
    spread = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return metric(spread.withColumn("weight", poisson(draw)).where("weight > 0"))


def interval(values: DataFrame, x: str, replicates: int, share: float = 0.95) -> DataFrame:
    """low, high (percentiles) and n of the finite values, and how many replicates have none."""
    fine = F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ok = F.when(fine, F.col(x))
    tail = (1 - share) / 2
    return values.agg(F.percentile(ok, F.lit(tail)).alias("low"), F.percentile(ok, F.lit(1 - tail)).alias("high"), F.count(ok).alias("n"), (F.lit(replicates).cast("long") - F.count(ok)).alias("skipped"))


def base_rate_shift(uniform: DataFrame, score: str, positive: Column, b: float, rounds: int = 200, most: float = 20.0) -> float:
    """The a in [-most, most] at which the mean of sigmoid(a + b * score) over a uniform stratum is (positives + 1) / (rows + 2).

    Halving intervals needs one number a round: each round is one aggregation over the distinct scores, 64 points of a at once.
    """
    counts = uniform.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(positive).alias("p"), F.count(F.lit(1)).alias("n")).cache()
    p, n = counts.agg(F.sum("p"), F.sum("n")).first()
    low, high = -most, most
    if not n:
        return 0.0
    goal = (p + 1) / (n + 2)
    for _ in range(-(-rounds // 6)):
        grid = [low + (high - low) * k / 64 for k in range(65)]
        means = counts.agg(*[(F.sum(F.col("n") / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("s"))))) / n).alias(f"m{k}") for k, a in enumerate(grid)]).first()
        k = next((i for i in range(65) if means[i] >= goal), 64)
        low, high = grid[max(k - 1, 0)], grid[k]
        if high - low < 1e-12:
            break
    counts.unpersist()
    return (low + high) / 2


def platt(rows: DataFrame, score: str, positive: Column, rounds: int = 50, halvings: int = 30) -> tuple[float, float]:
    """a and b of sigmoid(a + b * score) by Newton steps from (0, 0.5) with a small ridge; a step is halved until the fit gets no worse.

    Each round is two aggregations over distinct scores: five sums, and the likelihoods at all halved steps at once.
    """
    counts = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(positive).alias("p"), F.count(F.lit(1)).alias("n")).cache()
    a, b, ridge = 0.0, 0.5, 1e-6

    def fit(x: float, y: float) -> Column:
        z = F.lit(x) + F.lit(y) * F.col("s")
        return F.sum(F.col("p") * log_likelihood(z, F.lit(True)) + (F.col("n") - F.col("p")) * log_likelihood(z, F.lit(False))) - ridge / 2 * (x * x + y * y)

    for _ in range(rounds):
        q = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("s"))))
        g = F.col("p") - F.col("n") * q
        w = F.col("n") * q * (1 - q)
        r = counts.agg(F.sum(g).alias("g0"), F.sum(g * F.col("s")).alias("g1"), F.sum(w).alias("h0"), F.sum(w * F.col("s")).alias("h1"), F.sum(w * F.col("s") * F.col("s")).alias("h2")).first()
        if r["g0"] is None:
            break
        g0, g1, h0, h1, h2 = r["g0"] - ridge * a, r["g1"] - ridge * b, r["h0"] + ridge, r["h1"], r["h2"] + ridge
        det = h0 * h2 - h1 * h1
        da, db = (h2 * g0 - h1 * g1) / det, (h0 * g1 - h1 * g0) / det
        sizes = [0.5**k for k in range(halvings)]
        fits = counts.agg(fit(a, b).alias("now"), *[fit(a + da * t, b + db * t).alias(f"f{k}") for k, t in enumerate(sizes)]).first()
        step = next((t for k, t in enumerate(sizes) if fits[f"f{k}"] >= fits["now"] - 1e-12), 0.0)
        a, b = a + da * step, b + db * step
        if max(abs(da), abs(db)) * step < 1e-10:
            break
    counts.unpersist()
    return a, b
