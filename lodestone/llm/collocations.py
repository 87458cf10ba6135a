"""Collocations: phrases whose words stand together more often than their parts would have it, by language.

Texts are lower-cased (A-Z), cut at punctuation and line breaks into pieces, and these into words. A shard (up to SHARD_WORDS words
of a task) is counted in tries of limited depth, one a language: level k holds the phrases of k words as sorted (parent, word)
pairs with counts. A trie is serialised in order and cut at the borders of prefix ranges. Spark brings the slices of one range
together, where sorted runs of all shards are merged level by level (a stable sort of runs) and their counts added. Borders are
phrases themselves, so that a very common first word is spread over many ranges; a range whose border lies within a word's
subtree gets the nodes above its border from every shard, so that a walk to the parents finds the counts of all left parts.
Right parts are nodes of other ranges: links to them are a join by phrase, which adaptive execution splits where a link is common.

Borders are set by every STEP-th phrase of the corpus, sorted by Spark; they decide which task does what, never a result.

Defined cases: a null text counts as empty, a null language as 'und'. Repeated rows count again. Very long texts are whole, read in
slices. Control characters other than tab, line feed, vertical tab, form feed and carriage return belong to words. An empty table
gives none; other columns are unread.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, tasks

#: Words of a shard, words of a range, and words from one mark to the next.
SHARD_WORDS, RANGE_WORDS, STEP = 1_500_000, 1_000_000, 1_024
#: Ranges; beyond that (65 billion words) they grow.
MOST_RANGES = 65_536
#: Bytes of a text that are split at once.
AT_ONCE = 1 << 20

#: The byte for all piece borders; no UTF-8 text holds it.
BORDER = b"\xff"
_BYTES = bytes(c + 32 if 65 <= c <= 90 else 255 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def split(data: bytes) -> Iterator[list[bytes]]:
    """Words and borders of a UTF-8 text, in lists of about AT_ONCE bytes."""
    data, at = data.translate(_BYTES).replace(b"\t", b" "), 0
    while len(data) - at > AT_ONCE:
        end = data.find(b" ", at + AT_ONCE)
        if end < 0:
            break
        yield data[at:end].replace(BORDER, b" \xff ").split()
        at = end
    yield data[at:].replace(BORDER, b" \xff ").split()


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
        yield lang, text.as_py()


def marks(docs: DataFrame, depth: int, step: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang and words of every step-th phrase; and rows with words null and n, the words of a language in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = {}
        ahead = step // 2
        for batch in batches:
            langs, found = [], []
            for lang, text in _texts(batch):
                for words in split(text):
                    n[lang] = n.get(lang, 0) + len(words) - words.count(BORDER)
                    while ahead < len(words):
                        phrase = words[ahead : ahead + depth]
                        phrase = phrase[: phrase.index(BORDER)] if BORDER in phrase else phrase
                        if phrase:
                            langs.append(lang)
                            found.append(phrase)
                        ahead += step
                    ahead -= len(words)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.list_(pa.binary())), pa.nulls(len(langs), pa.int64())], ["lang", "words", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.nulls(len(n), pa.list_(pa.binary())), pa.array(list(n.values()), pa.int64())], ["lang", "words", "n"])

    return _rows(docs, text_col, lang_col).mapInArrow(run, "lang string, words array<binary>, n long")


def borders(marked: DataFrame, total: int, step: int, ranges: int) -> list[tuple[str, tuple[bytes, ...]]]:
    """Where ranges of about equally many words begin, in order; at most twice as many as asked for."""
    every = max(1, total // max(1, step * ranges))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    chosen = marked.where("words IS NOT NULL").select("lang", "words").orderBy("lang", "words").withColumn("place", place).where(F.col("place") % every == every - 1)
    return sorted({(r["lang"], tuple(bytes(w) for w in r["words"])) for r in chosen.collect()})


Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def summed(parent: np.ndarray, word: np.ndarray, n: np.ndarray | None, width: int) -> tuple[Level, np.ndarray]:
    """The distinct (parent, word) pairs in order with the sum of n (or their number), and the place of each given pair among them."""
    key = parent * np.int64(width) + word
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    first = np.flatnonzero(new)
    place = np.empty(len(key), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    count = np.diff(np.append(first, len(key))) if n is None else np.add.reduceat(n[order], first) if len(first) else n
    return (key[first] // width, key[first] % width, count), place


def trie(words: np.ndarray, width: int, depth: int) -> list[Level]:
    """Levels of the count trie of a sequence of word numbers, where -1 is a border."""
    at = np.flatnonzero(words >= 0)
    node, levels = np.zeros(len(at), dtype=np.int64), []
    for k in range(depth):
        level, node = summed(node, words[at + k], None, width)
        levels.append(level)
        inside = at + k + 1 < len(words)
        inside[inside] = words[at[inside] + k + 1] >= 0
        at, node = at[inside], node[inside]
    return levels


def cuts(levels: list[Level], names: list[bytes], border: tuple[bytes, ...]) -> tuple[list[int], list[bool]]:
    """How many nodes of each level come before a border, and whether the last of them lies on the way to it."""
    before, on_way, at, follows = [], [], 0, True
    for k, (parent, word, _) in enumerate(levels):
        low, high = np.searchsorted(parent, (at, at + 1)) if follows and k < len(border) else (np.searchsorted(parent, at),) * 2
        at, follows = int(low), follows and k < len(border)
        if follows:
            number = bisect_left(names, border[k])
            at += int(np.searchsorted(word[low:high], number))
            follows = at < high and word[at] == number and names[number] == border[k]
        passes = follows and k + 1 < len(border)
        before.append(at + passes)
        on_way.append(passes)
    return before, on_way


def packed(names: list[bytes], levels: list[Level], since: list[int], to: list[int], on_way: list[bool]) -> bytes:
    """A slice of a trie, with the nodes on the way to its first border, as bytes of its own."""
    low = [s - o for s, o in zip(since, on_way, strict=True)]
    cut_out = [tuple(x[a:b] for x in level) for level, a, b in zip(levels, low, to, strict=True)]
    used = np.unique(np.concatenate([word for _, word, _ in cut_out]))
    text = b" ".join([names[i] for i in used.tolist()])
    columns = []
    for k, (parent, word, n) in enumerate(cut_out):
        columns += [np.diff(parent - (low[k - 1] if k else 0), prepend=0), np.searchsorted(used, word), n]
    head = np.array([len(text), *[len(w) for _, w, _ in cut_out], *on_way], dtype=np.int32)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + text + b"".join(c.astype(np.int32).tobytes() for c in columns))


def unpacked(data: bytes, depth: int) -> tuple[list[bytes], list[Level], list[bool]]:
    data = zstandard.ZstdDecompressor().decompress(data)
    head = np.frombuffer(data, dtype=np.int32, count=1 + 2 * depth)
    at = head.nbytes + int(head[0])
    text, levels = data[head.nbytes : at], []
    for size in head[1 : 1 + depth].tolist():
        parent, word, n = np.frombuffer(data, dtype=np.int32, count=3 * size, offset=at).reshape(3, size)
        levels.append((np.cumsum(parent, dtype=np.int32), word, n))
        at += 12 * size
    return text.split(b" ") if text else [], levels, head[1 + depth :].astype(bool).tolist()


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def slices(docs: DataFrame, depth: int, limits: list[tuple[str, tuple[bytes, ...]]], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """range, lang and trie: the slices of the tries of all shards, by prefix range."""

    def handed_on(lang: str, numbers: _Numbers, parts: list[np.ndarray]) -> Iterator[tuple[int, str, bytes]]:
        names = sorted(w for w in numbers if w != BORDER)
        rank = np.full(len(numbers), -1, dtype=np.int64)
        rank[[numbers[w] for w in names]] = np.arange(len(names))
        levels = trie(rank[np.concatenate(parts)], max(1, len(names)), depth)
        base, end = bisect_left(limits, (lang,)), bisect_left(limits, (lang + "\0",))
        since, on_way = [0] * depth, [False] * depth
        for place in range(base, end + 1):
            to, ahead = cuts(levels, names, limits[place][1]) if place < end else ([len(w) for _, w, _ in levels], [False] * depth)
            if any(on_way) or since != to:
                yield place, lang, packed(names, levels, since, to, on_way)
            since, on_way = to, ahead

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        held = 0

        def batches_of(shards: dict) -> Iterator[pa.RecordBatch]:
            for lang, (numbers, parts) in shards.items():
                rows = list(handed_on(lang, numbers, parts))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], ["range", "lang", "trie"])

        for batch in batches:
            for lang, text in _texts(batch):
                if lang not in shards:
                    shards[lang] = _Numbers({BORDER: 0}), []
                numbers, parts = shards[lang]
                for words in split(text):
                    parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
                    held += len(words)
                parts.append(np.zeros(1, dtype=np.int32))
                if held > SHARD_WORDS:
                    yield from batches_of(shards)
                    shards.clear()
                    held = 0
        yield from batches_of(shards)

    return _rows(docs, text_col, lang_col).mapInArrow(run, "range int, lang string, trie binary")


def merged(tries: list[bytes], depth: int) -> tuple[list[bytes], list[Level], list[np.ndarray]]:
    """The words, levels and own nodes (those not on the way to the range's border) of the sum of slices of one range and language."""
    opened = [unpacked(t, depth) for t in tries]
    names = pa.concat_arrays([pa.array(n, pa.binary()) for n, _, _ in opened])
    distinct = names.unique()
    distinct = distinct.take(pc.sort_indices(distinct))
    number = np.asarray(pc.index_in(names, distinct))
    starts = np.cumsum([0, *[len(n) for n, _, _ in opened]])[:-1].tolist()
    levels, own, above, heads = [], [], np.zeros(0, dtype=np.int64), None
    for k in range(depth):
        parts = [levels_[k] for _, levels_, _ in opened]
        word = np.concatenate([number[w + s] for (_, w, _), s in zip(parts, starts, strict=True)])
        parent = np.concatenate([p + s for (p, _, _), s in zip(parts, heads, strict=True)]) if k else np.zeros(len(word), dtype=np.int64)
        level, place = summed(above[parent] if k else parent, word, np.concatenate([n for _, _, n in parts]).astype(np.int64), len(distinct))
        heads = np.cumsum([0, *[len(w) for _, w, _ in parts]])[:-1].tolist()
        on_way = np.ones(len(level[0]), dtype=bool)
        on_way[place[[h for h, (_, _, o) in zip(heads, opened, strict=True) if o[k]]]] = False
        for _, levels_, _ in opened:
            levels_[k] = None  # the sums hold it now
        levels.append(level)
        own.append(on_way)
        above, parts = place, None
    return distinct.to_pylist(), levels, own


def frequent_of(depth: int, least: int):
    """A function of the slices of a range and language to their phrases of at least `least` occurrences, with the counts of their left parts."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        names, levels, own = merged(rows.column("trie").to_pylist(), depth)
        phrases, counts, lefts = [], [], []
        for k in range(depth):
            chosen = np.flatnonzero(own[k] & (levels[k][2] >= least))
            node, words, left = chosen, [], []
            for j in range(k, -1, -1):
                parent, word, n = levels[j]
                words.insert(0, [names[w] for w in word[node].tolist()])
                left.insert(0, n[node].tolist())
                node = parent[node]
            phrases += [b" ".join(w) for w in zip(*words, strict=True)]
            lefts += list(zip(*left[:-1], strict=True)) if k else [()] * len(chosen)
            counts += left[-1]
        return pa.table(
            [pa.array([key[1].as_py()] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array([list(x) for x in lefts], pa.list_(pa.int64()))],
            ["lang", "phrase", "a", "lefts"],
        )

    return run


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(10 ** 6 * a * a / (left * right)) in decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", (F.lit(1_000_000).cast("decimal(7,0)") * wide(a) * wide(a)).cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def part(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def mine(docs: DataFrame, max_words: int = 3, least: int = 10, covered_percent: int = 50, top: int = 2_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` phrases of 2 to max_words words.

    l and r are the counts of the two parts at the cut that scores least. A phrase within a longer one that has at least
    covered_percent of its occurrences is left out.
    """
    spark = docs.sparkSession
    marked = cut(marks(docs, max_words, STEP, text_col, lang_col))
    sizes = marked.where("words IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    limits = borders(marked, total, STEP, min(MOST_RANGES, max(tasks(spark), -(-total // RANGE_WORDS))))
    found = slices(docs, max_words, limits, text_col, lang_col).groupBy("range", "lang").applyInArrow(frequent_of(max_words, least), "lang string, phrase string, a long, lefts array<long>")
    nodes = cut(found)
    longer = nodes.where(F.size("lefts") > 0).withColumn("words", F.split("phrase", " "))
    links = longer.select("lang", "phrase", "a", "words", F.posexplode("lefts").alias("at", "l"))
    links = links.select("lang", "phrase", "a", "l", (F.col("at") + 1).alias("k"), part(F.col("words"), F.col("at") + 2, F.size("words") - F.col("at") - 1).alias("rest"))
    right = nodes.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    scored = links.join(right, ["lang", "rest"]).withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    least_cut = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: part(F.col("words"), i, m))))
    covers = longer.where(F.size("words") > 2).select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = least_cut.join(covers, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < covered_percent * F.col("a"))).drop("most")
    # A language may hold most phrases: parts of it are ranked first.
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", rank("salt")).where(F.col("rank") <= top).drop("salt")
    best = first.withColumn("rank", rank().cast("long")).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
