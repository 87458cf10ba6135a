"""Sharding by a k-d tree: recursive splits at weighted medians along the widest metadata dimension, until leaves reach the target bytes.

The metadata of a row are functions of its text alone (length, mean word length, share of line feeds, share of letters beyond
ASCII), so equal texts have equal metadata and share a shard. A dimension's width in a node is its byte-weighted standard
deviation there, against that of the whole table. Each level takes one aggregation for the widths and one for each round of
the medians' search: rows find their node and bin on their own (the tree is a few arrays), bins are summed over all tasks, and a
window over a node's bins gives the one that holds its median, so one row a node comes back. Rounds narrow the interval
4096-fold until it holds one value. Ties of a dimension are broken by a digest of the text, which is the value's low bits. Where a node
holds so few texts that its median misses the goal by over 0.5 % of its bytes, the next widest dimension that does better is taken.

Defined cases: a null text has size 1 (0 bytes plus 1), as an empty one has, and goes where empty texts go, as one group.
Repeated rows of one text stay together, so shards are as near equal as the largest group of equal texts allows, and a leaf of
one value isn't split on. Very long texts count whole. An empty table gives an empty result. Other columns are carried or
dropped as the caller selects.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from lodestone.llm.common import cut

DIMENSIONS = ("d_word", "d_lines", "d_wide", "d_length")
TIE_BITS = 24
VALUE_BITS = 24
BIN_BITS = 12
#: The share of a node's bytes that a median may miss its goal by before the next widest dimension is tried too.
UNEVEN = 0.005


@dataclass
class Tree:
    """Nodes in arrays: dimension (-1: a leaf), the split value (rows at or below it go down to below), children, and bytes."""

    dimension: list[int] = field(default_factory=lambda: [-1])
    value: list[int] = field(default_factory=lambda: [0])
    below: list[int] = field(default_factory=lambda: [0])
    above: list[int] = field(default_factory=lambda: [0])
    goal: list[int] = field(default_factory=lambda: [1])

    def split(self, node: int, dimension: int, value: int, goals: tuple[int, int]) -> tuple[int, int]:
        first = len(self.dimension)
        self.dimension[node], self.value[node], self.below[node], self.above[node] = dimension, value, first, first + 1
        for goal in goals:
            for column, x in ((self.dimension, -1), (self.value, 0), (self.below, 0), (self.above, 0), (self.goal, goal)):
                column.append(x)
        return first, first + 1

    def leaves(self) -> list[int]:
        """Leaves in the order of the tree."""
        out, stack = [], [0]
        while stack:
            node = stack.pop()
            if self.dimension[node] < 0:
                out.append(node)
            else:
                stack += [self.above[node], self.below[node]]
        return out

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, dtype=np.int64) for x in (self.dimension, self.value, self.below, self.above))


def descend(arrays: tuple[np.ndarray, ...], dims: np.ndarray) -> np.ndarray:
    """The leaf of each row; dims has a row for each dimension."""
    dimension, value, below, above = arrays
    node, at = np.zeros(dims.shape[1], dtype=np.int64), np.arange(dims.shape[1])
    while True:
        open_ = dimension[node] >= 0
        if not open_.any():
            return node
        down = dims[np.maximum(dimension[node], 0), at] <= value[node]
        node = np.where(open_, np.where(down, below[node], above[node]), node)


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, and the dimensions as whole numbers of VALUE_BITS bits with TIE_BITS of the text's digest below."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, chars = F.octet_length(text), F.char_length(text)
    spaces, lines = chars - F.char_length(F.translate(text, " ", "")), chars - F.char_length(F.translate(text, "\n", ""))
    top = float((1 << VALUE_BITS) - 1)
    scaled = lambda x: F.least(F.lit(top), F.greatest(F.lit(0.0), x * top))
    tie = F.conv(F.substring(F.md5(text.cast("binary")), 1, TIE_BITS // 4), 16, 10).cast("long")
    raw = {
        "d_length": scaled(F.log2(size + F.lit(1.0)) / 40),
        "d_word": scaled(F.log2(size / (spaces + 1.0) + 1) / 20),
        "d_lines": scaled(F.sqrt((lines + 1.0) / (size + 2.0))),
        "d_wide": scaled(F.sqrt((size - chars) / (size + 1.0))),
    }
    return docs.select(F.col(id_col), (size + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[(F.floor(x).cast("long") * (1 << TIE_BITS) + tie).alias(k) for k, x in raw.items()])


def with_node(rows: DataFrame, tree: Tree) -> DataFrame:
    """rows with node, the leaf that each one lies in."""
    arrays, where = tree.arrays(), [rows.columns.index(d) for d in DIMENSIONS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = descend(arrays, np.stack([batch.column(k).to_numpy() for k in where]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node)], [*batch.schema.names, "node"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("node", LongType()))


def _widest(rows: DataFrame, tree: Tree, nodes: set[int], whole: list[float]) -> dict[int, tuple[int, list[int]]]:
    """bytes and dimensions, widest first, of each node that holds rows of more than one value; whole: deviations in the table."""
    scale = float(1 << (VALUE_BITS + TIE_BITS))
    moments = [m for d in DIMENSIONS for x in [F.col(d) / scale] for m in (F.sum(x * F.col("size")), F.sum(x * x * F.col("size")), F.max(d) - F.min(d))]
    sums = with_node(rows, tree).groupBy("node").agg(F.sum("size").alias("w"), *[m.alias(f"m{i}") for i, m in enumerate(moments)])
    found = {}
    for r in sums.collect():  # a row a node
        spread = [max(0.0, r[f"m{3 * k + 1}"] / r["w"] - (r[f"m{3 * k}"] / r["w"]) ** 2) ** 0.5 if r[f"m{3 * k + 2}"] else -1.0 for k in range(len(DIMENSIONS))]
        if not whole:
            whole += [max(x, 1e-12) for x in spread]
        if r["node"] in nodes and max(spread) >= 0:
            found[r["node"]] = r["w"], sorted((k for k, x in enumerate(spread) if x >= 0), key=lambda k: -spread[k] / whole[k])
    return found


def _medians(rows: DataFrame, tree: Tree, dims: dict[int, int], goals: dict[int, float], totals: dict[int, int]) -> dict[int, tuple[float, int]]:
    """The value of each node at which the bytes at or below it come nearest to its goal, with rows on both sides, and by how much it misses."""
    arrays, size = tree.arrays(), len(tree.dimension)
    dim, low, below = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64), dict.fromkeys(dims, 0)
    for n, d in dims.items():
        dim[n] = d
    wanted = rows.sparkSession.createDataFrame([(n, float(g)) for n, g in goals.items()], "node long, goal double")
    cuts: dict[int, tuple[float, int]] = {}
    for shift in range(VALUE_BITS + TIE_BITS - BIN_BITS, -1, -BIN_BITS):

        def binned(batches: Iterator[pa.RecordBatch], shift=shift, low=low.copy()) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = np.stack([batch.column(k).to_numpy() for k in range(1, 1 + len(DIMENSIONS))])
                node = descend(arrays, values)
                at = values[np.maximum(dim[node], 0), np.arange(len(node))] - low[node]
                inside = (dim[node] >= 0) & (at >= 0) & (at >> (shift + BIN_BITS) == 0)
                keys, own = np.unique((node[inside] << BIN_BITS) | (at[inside] >> shift), return_inverse=True)
                sums = np.zeros(len(keys), dtype=np.int64)
                np.add.at(sums, own, batch.column(0).to_numpy()[inside])
                yield pa.RecordBatch.from_arrays([pa.array(keys >> BIN_BITS), pa.array(keys & ((1 << BIN_BITS) - 1)), pa.array(sums)], ["node", "bin", "w"])

        bins = rows.select("size", *DIMENSIONS).mapInArrow(binned, "node long, bin long, w long").groupBy("node", "bin").agg(F.sum("w").alias("w"))
        here = Window.partitionBy("node").orderBy("bin")  # at most 2 ** BIN_BITS rows a node
        start = rows.sparkSession.createDataFrame([(n, int(b)) for n, b in below.items()], "node long, base long")
        upto = bins.join(wanted, "node").join(start, "node").withColumns({"upto": F.col("base") + F.sum("w").over(here), "last": F.lead("bin").over(here).isNull()})
        hit = upto.where((F.col("upto") >= F.col("goal")) | F.col("last")).groupBy("node").agg(F.min(F.struct("bin", "w", "upto", "goal")).alias("at"))
        for r in hit.collect():  # a row a node
            n, at = r["node"], r["at"]
            low[n] += at["bin"] << shift
            below[n] = at["upto"] - at["w"]
            if not shift:  # one value is left: it goes to the side that this leaves nearer to the goal
                stay = at["upto"] < totals[n] and at["upto"] - at["goal"] <= at["goal"] - below[n]
                keep = stay or not below[n]
                cuts[n] = abs((at["upto"] if keep else below[n]) - at["goal"]), int(low[n]) - (not keep)
    return cuts


def grow(rows: DataFrame, leaves: int | None = None, target_bytes: int | None = None) -> Tree:
    """The tree over rows with size and the dimensions: split until there are so many leaves, or until a leaf has target_bytes at most."""
    tree, whole = Tree(), []
    tree.goal[0] = leaves or 2
    level = {0}
    while level:
        found = _widest(rows, tree, level, whole)
        if target_bytes:
            for n, (w, _) in found.items():
                tree.goal[n] = -(-w // int(target_bytes))
        open_ = {n: (w, order) for n, (w, order) in found.items() if tree.goal[n] > 1}
        if not open_:
            break
        goals, totals = {n: w * (tree.goal[n] // 2) / tree.goal[n] for n, (w, _) in open_.items()}, {n: w for n, (w, _) in open_.items()}
        best: dict[int, tuple[float, int, int]] = {}
        for k in range(1 if target_bytes else len(DIMENSIONS)):
            # The widest dimension, and the next ones only where single texts are so large that its median misses the goal.
            dims = {n: order[k] for n, (w, order) in open_.items() if k < len(order) and (n not in best or best[n][0] > UNEVEN * w)}
            for n, (miss, value) in (_medians(rows, tree, dims, goals, totals) if dims else {}).items():
                best[n] = min(best.get(n, (miss, dims[n], value)), (miss, dims[n], value), key=lambda x: x[0])
        level = set()
        for n, (_, dimension, value) in sorted(best.items()):
            half = tree.goal[n] // 2
            level |= set(tree.split(n, dimension, value, (half, tree.goal[n] - half)))
        if not target_bytes:
            level = {n for n in level if tree.goal[n] > 1}
    return tree


def number_slots(rows: DataFrame, by: str, order: list[str], per_block: int = 20_000) -> DataFrame:
    """Adds slot: gapless from 0 within each value of by. Blocks of rows are numbered in their own tasks and set end to end."""
    blocks = max(1, rows.count() // per_block)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    sizes = dealt.groupBy(by, "block").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.withColumn("start", F.sum("n").over(Window.partitionBy(by).orderBy("block")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy(by, "block").orderBy(*order)) - 1
    return dealt.withColumn("within", within).join(starts, [by, "block"]).withColumn("slot", (F.col("start") + F.col("within")).cast("long")).drop("block", "start", "within")


def shard(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot of each row; give the number of leaves, or the bytes that a leaf should reach.

    With `leaves`, shards go from 0 to leaves - 1 in the order of the tree; splits share bytes out in proportion to the leaves below.
    """
    if (leaves is None) == (target_bytes is None):
        raise ValueError("give leaves or target_bytes")
    rows = cut(metadata(docs, id_col, text_col))
    tree = grow(rows, leaves, target_bytes)
    number = np.zeros(len(tree.dimension), dtype=np.int64)
    # A node that couldn't be split any further takes the first of its numbers.
    at = 0
    for n in tree.leaves():
        number[n] = at
        at += tree.goal[n] if leaves else 1
    numbers = rows.sparkSession.createDataFrame([(n, int(number[n])) for n in tree.leaves()], "node long, shard int")
    placed = with_node(rows, tree).join(numbers, "node").select(id_col, "size", "text_crc32", "shard")
    return number_slots(placed, "shard", [id_col, "size", "text_crc32"])
