"""Source divergence audit: how far the sources of each language lie apart, and which terms set a source apart from its language.

Terms are runs of ASCII letters (A-Z lower-cased) and of characters beyond ASCII. Tasks count a language's terms by source, in
tables that are handed on when they grow; Spark sums them. The terms that are kept are dealt, by a hash, to tiles of about TERMS
terms. A tile is a dense int64 matrix of groups by terms: it holds each group's smoothed share of each term, in parts of a
billion. All pairs of groups are taken over the tile by broadcasting a row against the others, which gives a partial matrix of
pairs; Spark sums these, first within a task. A tile also gives the `top` terms of each group (a heap); these are merged by rank.
Where a language has over GROUPS sources, tiles are made for pairs of blocks of sources, so that a tile's size has a bound.

All arithmetic is exact in 64 bits: shares are divided in three steps of a thousand, for up to 9 * 10 ** 15 terms a language.

Defined cases: null text, language and source count as ''. A group occurs with its first row, even one without terms, and then
has the least share of each term. A language without kept terms has pairs of value 0 and no terms. Repeated rows are documents of
their own. Very long texts are counted whole, in pieces. An empty table gives none; other columns are unread.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut

#: Terms and groups in a tile.
TERMS, GROUPS = 2_048, 256
#: Entries of a task's tables before they are handed on, and bytes of a text that are split at once.
HELD, AT_ONCE = 400_000, 1 << 20
#: At most this many languages are broadcast; more are joined by shuffle.
BROADCAST_LANGS = 10_000

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of about AT_ONCE bytes each."""
    data, at = data.translate(_LETTERS), 0
    while len(data) - at > AT_ONCE:
        end = data.find(b" ", at + AT_ONCE)
        if end < 0:
            break
        yield data[at:end].split()
        at = end
    yield data[at:].split()


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it), in parts that are to be summed."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in tables.items():
                names = list(n)
                for at in range(0, len(names), 50_000):
                    part = names[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part]), pa.array([in_docs[t] for t in part])],
                        ["lang", "source", "term", "n", "docs"],
                    )

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                n, in_docs = tables.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for words in terms(text.as_py()):
                    n.update(words)
                    seen.update(words)
                in_docs.update(seen)
                held += len(n) - before
                if held > HELD:
                    yield from handed_on()
                    tables.clear()
                    held = 0
        yield from handed_on()

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_cells(parts: DataFrame, least_docs: int) -> DataFrame:
    """lang, term, source, n, lang_n and first (true in one row of a term), for terms in at least so many documents of a language. Sources without the term have no row."""
    cells = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    summed = cells.select("lang", "term", "source", "n", F.sum("n").over(whole).alias("lang_n"), F.sum("docs").over(whole).alias("in_docs"), (F.row_number().over(whole.orderBy("source")) == 1).alias("first"))
    return summed.where(F.col("in_docs") >= least_docs).drop("in_docs")


def share(count: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10 ** 9 * (count + 2) / (total + 2 * kept)), by long division."""
    whole = np.asarray(total, dtype=np.int64) + 2 * kept
    if np.any(whole > 9 * 10**15):
        raise OverflowError("over 9 * 10 ** 15 terms in a language")
    rest, out = np.asarray(count, dtype=np.int64) + 2, np.int64(0)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1_000, whole)
        out = out * 1_000 + digit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / (p + q)); shares are at most 10 ** 9 + 1, so squares fit."""
    gap = p - q
    return gap * gap // (p + q)


def tile_of(top: int):
    """A function of a tile's rows: groups (without a term) and cells, to rows of lang, source, part, item, value."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lang, _, low, high = (k.as_py() for k in key)
        is_group = np.asarray(rows.column("term").is_null())
        groups, cells = rows.filter(pa.array(is_group)), rows.filter(pa.array(~is_group))
        names, sides = groups.column("source").to_pylist(), np.asarray(groups.column("side"))
        kept, lang_total = groups.column("kept")[0].as_py(), groups.column("lang_total")[0].as_py()
        out: list[tuple[str, str, str, int]] = []
        values = np.zeros((len(names), len(names)), dtype=np.int64)
        if cells.num_rows:
            totals, place = np.asarray(groups.column("total")), {s: i for i, s in enumerate(names)}
            group = np.fromiter((place[s] for s in cells.column("source").to_pylist()), dtype=np.int64, count=cells.num_rows)
            coded = cells.column("term").combine_chunks().dictionary_encode()
            term, n = np.asarray(coded.indices), np.asarray(cells.column("n"))
            p = share(n, totals[group], kept)
            shares = np.repeat(share(np.zeros_like(totals), totals, kept)[:, None], len(coded.dictionary), axis=1)
            shares[group, term] = p
            for i in range(len(names)):
                others = np.flatnonzero(sides != sides[i]) if low != high else np.arange(i + 1, len(names))
                if low == high or sides[i] == 0:
                    values[i, others] = values[others, i] = apart(shares[i], shares[others]).sum(axis=1)
            if low == high:
                q = share(np.asarray(cells.column("lang_n")), lang_total, kept)
                f, words = apart(p, q), coded.dictionary.to_pylist()
                above = np.flatnonzero(p > q)
                above = above[np.argsort(group[above], kind="stable")]
                for i, own in enumerate(np.split(above, np.searchsorted(group[above], np.arange(1, len(names))))):
                    best = heapq.nsmallest(top, zip((-f[own]).tolist(), [words[t] for t in term[own].tolist()], strict=True))
                    out += [(names[i], "term", word, -value) for value, word in best]
        first, second = np.nonzero(sides[:, None] != sides[None, :] if low != high else ~np.eye(len(names), dtype=bool))
        out += [(names[i], "pair", names[j], int(values[i, j])) for i, j in zip(first.tolist(), second.tolist(), strict=True)]
        source, part, item, value = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table([pa.array([lang] * len(out), pa.string()), pa.array(source, pa.string()), pa.array(part, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])

    return run


def _with_langs(rows: DataFrame, langs: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(langs) if few else langs, "lang")


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part (pair or term), item, value and rank: all other sources of the language, farthest first, and the `top` terms."""
    kept = cut(kept_cells(counted(docs, text_col, lang_col, source_col), least_docs))
    occurring = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    groups = cut(occurring.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0))))
    whole = kept.where("first").groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    langs = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / GROUPS).cast("int").alias("blocks")).join(whole, "lang", "left")
    langs = cut(langs.select("lang", "blocks", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")).withColumn("tiles", F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS)).cast("int")))
    few = langs.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS
    block = F.pmod(F.xxhash64(F.lit("group"), "source"), F.col("blocks")).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("low"), F.greatest(k, F.col("own")).alias("high"))))

    def dealt(rows: DataFrame) -> DataFrame:
        found = rows.withColumn("own", block).withColumn("pair", pairs)
        side = (F.col("own") > F.col("pair.low")).cast("int")
        return found.select("lang", "tile", "pair.low", "pair.high", side.alias("side"), "source", "term", "n", "lang_n", "total", "kept", "lang_total")

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    head = _with_langs(groups, langs, few).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    head = dealt(head.select("*", none("string", "term"), none("long", "n"), none("long", "lang_n")))
    body = _with_langs(kept.drop("first"), langs, few).withColumn("tile", F.pmod(F.xxhash64(F.lit("term"), "term"), F.col("tiles")).cast("int")).withColumn("total", F.lit(None).cast("long"))
    found = head.unionByName(dealt(body)).groupBy("lang", "tile", "low", "high").applyInArrow(tile_of(top), "lang string, source string, part string, item string, value long")
    summed = cut(found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda part: summed.where(F.col("part") == part).withColumn("rank", rank)
    return ranked("pair").unionByName(ranked("term").where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
