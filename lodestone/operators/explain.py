"""Why a row stands where it stands: which signals count, the best reasons, the worst, and what would help; and the orders of lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order in which reasons are told.
TOP_ORDER = ["q.release", "p.testsRun", "p.shipped", "q.tests", "q.examples", "p.coherent", "q.usage", "q.ci", "q.manifest", "q.deps", "q.code", "q.licence", "q.readme"]


def counted(signals: Column) -> Column:
    """signals (array of struct(id, status, hit, weight, grp)) with counted: false for a hit that another one of its group outweighs; the first of equals counts."""
    hits = F.filter(F.transform(signals, lambda s, i: F.struct(s["grp"].alias("g"), s["weight"].alias("w"), i.alias("i"), s["hit"].alias("h"))), lambda x: F.coalesce(x["h"], F.lit(False)))
    return F.transform(signals, lambda s, i: F.struct(s["id"].alias("id"), s["status"].alias("status"), s["hit"].alias("hit"), s["weight"].alias("weight"), (F.coalesce(s["hit"], F.lit(False)) & ~F.exists(hits, lambda x: F.coalesce(x["g"] == s["grp"], F.lit(False)) & ((x["w"] < s["weight"]) | ((x["w"] == s["weight"]) & (x["i"] < i))))).alias("counted")))


def _named(signals: Column, test) -> Column:
    """The names among TOP_ORDER whose signal passes the test, in that order."""
    return F.filter(F.array(*map(F.lit, TOP_ORDER)), lambda n: F.exists(signals, lambda s: (s["id"] == n) & test(s)))


def top_reasons(signals: Column, most: int = 3) -> Column:
    return F.slice(_named(signals, lambda s: F.coalesce(s["hit"], F.lit(False)) & (s["weight"] > 0)), 1, most)


def negatives(signals: Column, most: int = 2) -> Column:
    """The heaviest penalties that count (counted() adds that), in the signals' order among equals."""
    bad = F.filter(F.transform(signals, lambda s, i: F.struct(s["weight"].alias("w"), i.alias("i"), s["id"].alias("id"), s["counted"].alias("c"))), lambda x: x["c"] & (x["w"] < 0))
    return F.slice(F.transform(F.array_sort(bad), lambda x: x["id"]), 1, most)


def why_not_higher(signals: Column) -> Column:
    """Signals that would give points but are missed or unknown."""
    return _named(signals, lambda s: (s["weight"] > 0) & ((s["status"] == "unknown") | ((s["status"] == "ok") & ~F.coalesce(s["hit"], F.lit(False)))))


def index_order(gem: str = "gem", stars: str = "stars", created: str = "created_at", name: str = "nwo") -> list[Column]:
    """Best first, rows without a rank last; then fewer stars, newer (by the text of the time), name."""
    return [F.desc_nulls_last(gem), F.asc(stars), F.col(created).cast("string").desc_nulls_last(), F.asc(name)]


def entry_order(gem: str = "gem", stars: str = "stars", created: str = "created_at", name: str = "nwo") -> list[Column]:
    """The same, but rows without a rank stand at 0."""
    return [F.coalesce(gem, F.lit(0)).desc(), *index_order(gem, stars, created, name)[1:]]


def workflow_choice(names: Column, most: int = 3) -> Column:
    """File names that speak of tests or builds first, then by name."""
    keyed = F.transform(names, lambda n: F.struct((~F.lower(n).rlike("test|ci|build|check")).alias("later"), n.alias("name")))
    return F.slice(F.transform(F.array_sort(keyed), lambda x: x["name"]), 1, most)
