"""Mixing sources to target weights by temperature.

A source's weight is its token share raised to an exponent between 0 (all alike) and 1 (as they are), normalised. The
exponent is bisected (64 ways a round, one aggregation over the sources each) to the flattest one that reaches a target
evenness (entropy over its maximum) without any source being repeated more often than a limit. The budget is given, or is
the least that takes every document at least once. Weights become budgets of tokens, and a source fills its budget with
epochs: in each, its documents stand in a new permutation (a keyed hash), and the last epoch ends where the budget does.
A document's position is its place in its source's stream over the source's budget, so that any stretch of the mixture
(a block) holds each source at its weight.

No source is ever gathered: its permutation is cut into cells of about `cell_docs` documents; cells are summed, the sums
set end to end, and only within its cell is a document's own place counted.

Shares and budgets are of tokens as the tokenizer gives them: words are counted by bpe_codec's tables, each distinct one encoded
once a task, and ids aren't kept.

Defined cases: a null source is a source of its own. A null text counts as empty; a text without tokens is
never beyond a budget and appears once an epoch. Repeated rows of one id and text share a key and are placed in any order.
Very long texts are never cut: the last document of a budget may overrun it. An empty table gives an empty mixture. Other
columns don't matter to realise() and are kept by repeat_rows().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe_codec import counts
from lodestone.llm.common import cut, whole_text

SPAN = 1 << 60
#: At most this many sources are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def key(epoch: Column, seed: int, id_col: str) -> Column:
    """A document's place in the permutation of an epoch, from 0 to SPAN."""
    return F.pmod(F.xxhash64(F.lit(seed), epoch, F.col(id_col)), F.lit(SPAN))


def light(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, source, n_tokens: all that mixing needs to know."""
    source = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return counts(source, tokenizer_path, "text", ["id", "source"])


def exponent(sources: DataFrame, evenness: float, max_repeats: float, rounds: int = 4) -> float:
    """The flattest exponent with entropy at most evenness * ln(sources) and repeats at most max_repeats; sources has share > 0."""
    n, most = sources.agg(F.count(F.lit(1)), F.max("share")).first()
    if n < 2:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * k / 64 for k in range(65)]
        power = F.pow("share", F.col("a"))
        at = sources.select("share", F.explode(F.array(*map(F.lit, grid))).alias("a")).groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.ln("share")).alias("s"), F.max(F.pow(F.lit(most) / F.col("share"), 1 - F.col("a"))).alias("repeats"))
        good = [r["a"] for r in at.collect() if math.log(r["z"]) - r["a"] * r["s"] / r["z"] <= evenness * math.log(n) + 1e-12 and r["repeats"] <= max_repeats + 1e-12]
        high = min(good, default=1.0)
        low = max((a for a in grid if a < high), default=high)
    return high


def plan(rows: DataFrame, evenness: float = 0.98, max_repeats: float = 2.0, budget_tokens: int | None = None) -> DataFrame:
    """source, docs, tokens, share, weight, budget and repeats (budget over tokens); one row a source, materialised."""
    sums = cut(rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = sums.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    a = exponent(shares.where("tokens > 0"), evenness, max_repeats)
    powers = shares.withColumn("power", F.when(F.col("tokens") > 0, F.pow("share", F.lit(a))).otherwise(0.0))
    z, cover = powers.agg(F.sum("power"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("power")))).first()
    budget = float(budget_tokens) if budget_tokens is not None else (cover or 0.0) * (z or 0.0)
    weighed = powers.withColumn("weight", F.col("power") / F.lit(z or 1.0)).withColumn("budget", F.col("weight") * F.lit(budget))
    return weighed.withColumn("repeats", F.coalesce(F.try_divide("budget", "tokens"), F.lit(1.0))).drop("power")


def _with_plan(rows: DataFrame, planned: DataFrame) -> DataFrame:
    planned = planned.withColumnRenamed("source", "plan_source")
    small = planned.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(planned) if small else planned, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")


def realise(rows: DataFrame, planned: DataFrame, seed: int = 0, block_tokens: int = 1_000_000, cell_docs: int = 2_000) -> DataFrame:
    """id, source, n_tokens, weight, epoch, start (tokens of the source's stream before it), position (0 to 1) and block."""
    epochs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("repeats") - 1e-9).cast("int") - 1))
    dealt = _with_plan(rows, planned).withColumn("epoch", F.explode(epochs)).withColumn("key", key(F.col("epoch"), seed, "id"))
    dealt = dealt.withColumn("cell", F.floor(F.col("key") / F.lit(float(SPAN)) * F.ceil(F.col("docs") / cell_docs)).cast("int"))
    by = ["source", "epoch", "cell"]
    cells = dealt.groupBy(*by).agg(F.sum("n_tokens").alias("sum"))
    ahead = cells.select(*by, (F.sum("sum").over(Window.partitionBy("source").orderBy("epoch", "cell")) - F.col("sum")).alias("ahead"))
    inner = F.sum("n_tokens").over(Window.partitionBy(*by).orderBy("key", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    placed = dealt.withColumn("inner", inner).join(ahead.withColumnRenamed("source", "cell_source"), [F.col("source").eqNullSafe(F.col("cell_source")), dealt["epoch"] == ahead["epoch"], dealt["cell"] == ahead["cell"]]).drop(ahead["epoch"]).drop(ahead["cell"])
    placed = placed.withColumn("start", F.col("ahead") + F.col("inner")).where((F.col("start") < F.col("budget") - 1e-6) | (F.col("n_tokens") == 0) & (F.col("epoch") == 0))
    position = F.coalesce(F.try_divide(F.col("start").cast("double"), F.col("budget")), F.lit(0.0))
    total = planned.agg(F.sum("budget")).first()[0] or 0.0
    return placed.withColumn("position", position).withColumn("block", F.floor(F.col("position") * F.lit(total / block_tokens)).cast("long")).select("id", "source", "n_tokens", "weight", "epoch", "key", "start", "position", "block")


def repeat_rows(docs: DataFrame, tokenizer_path: str, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **targets) -> DataFrame:
    """docs with each row as often as the mixture holds it, at least once. Texts aren't shuffled: of the last, partial epoch, a row needs only the key where it ends."""
    rows = cut(light(docs, tokenizer_path, id_col, source_col, text_col))
    planned = cut(plan(rows, **targets))
    mixed = realise(rows, planned, seed)
    last = _with_plan(mixed.where("position < 1").select("source", "epoch", "key"), planned.select("source", "repeats")).where(F.col("epoch") == F.ceil(F.col("repeats") - 1e-9) - 1)
    ends = last.groupBy("source").agg(F.max("key").alias("end"))
    cutoffs = cut(planned.select("source", "repeats").join(ends.withColumnRenamed("source", "end_source"), F.col("source").eqNullSafe(F.col("end_source")), "left").select("source", F.greatest(F.lit(0), F.ceil(F.col("repeats") - 1e-9).cast("int") - 1).alias("whole_epochs"), F.coalesce("end", F.lit(-1)).alias("end")))
    own = {c: f"__{i}" for i, c in enumerate(docs.columns)}  # free of clashes with the plan's columns
    inner = docs.select([F.col(f"`{c}`").alias(n) for c, n in own.items()]).withColumns({"source": F.col(own[source_col]), "id": F.col(own[id_col])})
    in_last = key(F.col("whole_epochs"), seed, "id") <= F.col("end")
    copies = F.col("whole_epochs") + F.when(in_last, 1).otherwise(0)
    copies = F.when((F.octet_length(whole_text(own[text_col])) == 0) & (copies == 0), 1).otherwise(copies)  # as realise() keeps rows without tokens
    return _repeat(_with_plan(inner, cutoffs), copies).select([F.col(n).alias(c) for c, n in own.items()])


def _repeat(rows: DataFrame, copies: Column) -> DataFrame:
    """Each row so many times; rows of no copies go."""
    counted = rows.withColumn("copies", copies).where("copies > 0")
    return counted.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
