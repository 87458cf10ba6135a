"""N-gram Jaccard join: which documents share at least `threshold` of their word shingles.

Candidates come from a MinHash LSH forest: `trees` prefix tries over `depth` MinHash values each. A trie's nodes of one depth are
the groups of sets with equal prefixes, which Spark sorts together; a pair meets where it shares a node that is compared. Prefixes
are shortened by what the nodes hold: where a short prefix still has few sets, its node is compared as it is; where it has many,
the prefix stays as long as the set's recall allows, and is shortened in the trees where that brings the fewest sets more, until a
pair at the threshold meets in some tree with probability `recall` (see `compared_nodes`). Pairs that meet are compared by their
whole signatures; what passes is joined to clusters, and within a cluster every pair is verified by the exact Jaccard similarity of
its shingle sets. All work is on distinct shingle sets; copies are counted, not paired.

Nothing grows with the square of a group except the comparisons that the answer asks for: a trie node gives a spanning forest
of its pairs (fewer edges than rows), and verification gives one row for each set and block. Nodes and clusters beyond a
block's size are cut into blocks, and pairs of blocks are tasks of their own, so no task holds more than two blocks.

Defined cases: a null text counts as empty. Texts without words are linked if they are equal as texts, ignoring letter case.
Texts of fewer words than a shingle have one shingle, of all words. Repeated rows are copies and count as documents. Rows
without an id are returned with a null class and no links, and take part in nothing. Very long texts are whole. An empty table
gives none; other columns are unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut
from lodestone.llm.components import components
from lodestone.llm.shingles import mix, set_digest, shingle_batches

TREES, DEPTH = 32, 8
#: Sets in a node that is compared at its shortest prefix, whatever the recall.
LIGHT = 64
#: Rows of a trie node, and sets and shingles of a cluster, in one block.
NODE_BLOCK, SET_BLOCK, SHINGLE_BLOCK = 4_000, 1_500, 1_000_000
#: Small nodes and clusters share tasks' groups of about so many rows.
CELL_ROWS, CELL_SHINGLES = 5_000, 250_000
#: Shingles in more sets of a block pair than this are counted by matrix products, others pair by pair.
COMMON = 32


def collision(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that a pair shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def matched_depth(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which pairs at the threshold meet with the target probability, if all trees are alike."""
    while depth > 1 and collision(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def sketch_cut(threshold: float, hashes: int) -> float:
    """Share of equal signature bytes that a pair at the threshold misses by four standard deviations only."""
    return max(0.0, threshold - 4 * (threshold * (1 - threshold) / hashes) ** 0.5)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, matched: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """id, digest (of the shingle set), size, sketch (a byte for each MinHash value) and nodes (a prefix's hash for each tree)."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    factors = mix(np.arange(1, trees * depth + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, hashes, bounds in shingle_batches(batch.column(1), width):
                n = len(bounds) - 1
                least = np.empty((len(factors), n), dtype=np.uint64)
                for low in range(0, n, 64):  # a few texts at a time, which stay in a core's cache
                    to = min(n, low + 64)
                    part, starts = hashes[bounds[low] : bounds[to]], bounds[low:to] - bounds[low]
                    for k, f in enumerate(factors):
                        least[k, low:to] = np.minimum.reduceat(part * f, starts)
                sketch = np.ascontiguousarray((mix(least) & np.uint64(255)).astype(np.uint8).T)
                nodes = np.zeros((n, trees), dtype=np.uint64)
                for t in range(trees):
                    node = np.full(n, t + 1, dtype=np.uint64)
                    for k in range(matched):
                        node = mix(node * np.uint64(0x9E3779B97F4A7C15) + least[t * depth + k])
                    nodes[:, t] = node
                sets = [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(n)]
                flat = pa.array(nodes.view(np.int64).reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n),
                        pa.array(map(set_digest, sets), pa.binary()),
                        pa.array(map(len, sets), pa.int64()),
                        pa.array([r.tobytes() for r in sketch], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * trees, trees), pa.int32()), flat),
                    ],
                    ["id", "digest", "size", "sketch", "nodes"],
                )

    return source.mapInArrow(run, "id long, digest binary, size long, sketch binary, nodes array<long>")


def in_blocks(rows: DataFrame, group: str, blocks: Column, salt: str, cells: int) -> DataFrame:
    """Adds cell, low and high, and side (0 in block low, 1 in block high) to rows.

    A group of one block goes to a cell with others; of a larger one each row goes to all pairs of blocks that hold its own.
    """
    own = F.pmod(F.xxhash64(F.lit("block"), F.col(salt)), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("low"), F.greatest(k, F.col("own")).alias("high")))
    placed = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", own)
    placed = placed.withColumn("pair", F.explode(F.when(F.col("blocks") > 1, pairs).otherwise(F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"))))))
    cell = F.when(F.col("blocks") > 1, F.col(group)).otherwise(F.pmod(F.xxhash64(F.lit("cell"), F.col(group)), F.lit(cells)))
    return placed.withColumns({"cell": cell, "low": F.col("pair.low"), "high": F.col("pair.high"), "side": (F.col("own") > F.col("pair.low")).cast("int")}).drop("pair")


def spanning(n: int, near, sides: np.ndarray | None) -> list[tuple[int, int]]:
    """A spanning forest of the graph where near(i, places) tells which of the places are i's neighbours; with sides, across them only."""
    waiting, edges = np.arange(n), []
    while len(waiting):
        front, waiting = [int(waiting[0])], waiting[1:]
        while front and len(waiting):
            i = front.pop()
            open_ = waiting if sides is None else waiting[sides[waiting] != sides[i]]
            if len(open_) and len(found := open_[near(i, open_)]):
                edges += [(i, int(j)) for j in found]
                front += found.tolist()
                waiting = np.setdiff1d(waiting, found, assume_unique=True)
    return edges


def compared_nodes(classes: DataFrame, threshold: float, recall: float, shortest: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """rep, node, in_node: the trie nodes in which each set is compared.

    A set starts with the shortest prefix in trees where that node is light, else with the next one, if that is light, else with the
    longest. What such prefixes miss of pairs at the threshold is the product over the trees of 1 - threshold ** length; where it is
    too much, the set's prefixes are shortened by one value, those first whose next node has the fewest sets. A node that one of its
    sets needs is compared whole, and takes the place of the longer prefixes below it.
    """
    lengths = [min(shortest + k, depth) for k in range(3)]
    miss = [float(np.log(max(1e-12, 1 - threshold**d))) for d in lengths]
    step = lambda k: F.substring("sketch", F.col("tree") * depth + F.lit(lengths[k]), F.lit(1)) if lengths[k] > lengths[k - 1] else F.lit(b"")
    count = lambda rows, node, name: rows.groupBy(node).agg(F.count(F.lit(1)).alias(name))
    own = classes.select("rep", F.posexplode("nodes").alias("tree", "n0"), "sketch").select("rep", "n0", step(1).alias("b1"), step(2).alias("b2"))
    shared = cut(count(own, "n0", "c0").where("c0 > 1"))
    rows = cut(own.join(shared, "n0").withColumn("n1", F.xxhash64("n0", "b1")).withColumn("n2", F.xxhash64("n1", "b2")).drop("b1", "b2"))
    light, heavy = rows.where(F.col("c0") <= LIGHT), rows.where(F.col("c0") > LIGHT)
    if heavy.isEmpty():
        return light.select("rep", F.col("n0").alias("node"), F.col("c0").alias("in_node"))
    counted = heavy.join(count(heavy, "n1", "c1"), "n1").join(count(heavy, "n2", "c2"), "n2").withColumn("at", F.when(F.col("c1") <= LIGHT, 1).otherwise(2))
    need = counted.groupBy("rep").agg(F.count_if(F.col("at") == 1).alias("h1"), F.count_if(F.col("at") == 2).alias("h2"))
    short = (trees - F.col("h1") - F.col("h2")) * miss[0] + F.col("h1") * miss[1] + F.col("h2") * miss[2] - float(np.log(1 - recall))
    steps = lambda lack, k: F.ceil(F.greatest(lack, F.lit(0.0)) / (miss[k + 1] - miss[k]) - 1e-9) if miss[k + 1] > miss[k] else F.lit(0)
    need = need.withColumn("lack", short).withColumn("k1", F.least(F.col("h2"), steps(F.col("lack"), 1))).withColumn("k0", steps(F.col("lack") - F.col("k1") * (miss[2] - miss[1]), 0)).select("rep", "k0", "k1")
    by_rep = lambda at, order: F.row_number().over(Window.partitionBy("rep", "at").orderBy(order, "n0"))
    placed = counted.join(need, "rep").withColumn("r", by_rep("at", "c1")).withColumn("at", F.when((F.col("at") == 2) & (F.col("r") <= F.col("k1")), 1).otherwise(F.col("at")))
    placed = placed.withColumn("r", by_rep("at", "c0")).withColumn("at", F.when((F.col("at") == 1) & (F.col("r") <= F.col("k0")), 0).otherwise(F.col("at")))
    placed = cut(placed.select("rep", "n0", "n1", "n2", "c0", "c1", "c2", "at"))
    for k in (0, 1):
        chosen = placed.where(F.col("at") == k).select(f"n{k}").distinct().withColumn(f"in{k}", F.lit(True))
        placed = placed.join(chosen, f"n{k}", "left")
    level = lambda name: F.when(F.col("in0"), F.col(f"{name}0")).when(F.col("in1"), F.col(f"{name}1")).otherwise(F.col(f"{name}2"))
    dense = placed.select("rep", level("n").alias("node"), level("c").alias("in_node")).where("in_node > 1")
    return light.select("rep", F.col("n0").alias("node"), F.col("c0").alias("in_node")).unionByName(dense)


def candidate_edges(classes: DataFrame, threshold: float, hashes: int, recall: float, shortest: int) -> DataFrame:
    """a, b: pairs of set ids that share a compared node and have like sketches; of each node a spanning forest of them."""
    members = cut(compared_nodes(classes, threshold, recall, shortest))
    total = members.count()
    rows = members.join(classes.select("rep", "size", "sketch"), "rep")
    dealt = in_blocks(rows, "node", F.ceil(F.col("in_node") / NODE_BLOCK), "rep", max(1, total // CELL_ROWS))
    least = int(np.ceil(sketch_cut(threshold, hashes) * hashes))

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["node", "size", "rep"], ignore_index=True)
        sketch = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint8).reshape(len(rows), -1)
        reps, sizes, sides = rows["rep"].to_numpy(), rows["size"].to_numpy(), rows["side"].to_numpy()
        borders = np.flatnonzero(np.diff(rows["node"].to_numpy(), prepend=0)) if len(rows) else []
        borders = np.unique(np.append(borders, [0, len(rows)])).astype(np.int64)
        a, b = [], []
        for low, to in zip(borders[:-1], borders[1:], strict=True):
            own, size = sketch[low:to], sizes[low:to]

            def near(i: int, places: np.ndarray, own=own, size=size) -> np.ndarray:
                fits = np.minimum(size[places], size[i]) >= threshold * np.maximum(size[places], size[i]) - 1e-9
                fits[fits] = (own[places[fits]] == own[i]).sum(axis=1) >= least
                return fits

            for i, j in spanning(to - low, near, sides[low:to] if key[1] != key[2] else None):
                a.append(reps[low + i])
                b.append(reps[low + j])
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    found = dealt.select("cell", "low", "high", "side", "node", "rep", "size", "sketch").groupBy("cell", "low", "high").applyInPandas(compare, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets."""
    n = len(sets)
    out = np.zeros((n, n), dtype=np.int64)
    flat, of = np.concatenate(sets), np.repeat(np.arange(n), list(map(len, sets)))
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    counts = np.diff(np.append(starts, len(flat)))
    for c in np.unique(counts[(counts > 1) & (counts <= COMMON)]).tolist():
        members = of[starts[counts == c][:, None] + np.arange(c)]
        for i in range(c):
            for j in range(i + 1, c):  # members stand in ascending order of sets
                out += np.bincount(members[:, i] * n + members[:, j], minlength=n * n).reshape(n, n) if n <= 256 else 0
                if n > 256:
                    np.add.at(out, (members[:, i], members[:, j]), 1)
    common = np.flatnonzero(counts > COMMON)
    for k in range(0, len(common), 4_096):
        part = common[k : k + 4_096]
        incidence = np.zeros((n, len(part)), dtype=np.float32)
        incidence[np.concatenate([of[s : s + c] for s, c in zip(starts[part], counts[part], strict=True)]), np.repeat(np.arange(len(part)), counts[part])] = 1
        out += np.triu(incidence @ incidence.T, 1).astype(np.int64)
    return out + out.T


def least_members(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place in the component of each place, of a graph with edges a, b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        label = label[label]
        if (label == before).all():
            return label


def verified(docs: DataFrame, clusters: DataFrame, id_col: str, text_col: str, width: int, threshold: float) -> DataFrame:
    """rep, links (weighted by copies, to other sets) and other (a linked set, or the least of the component) of sets in clusters.

    clusters: rep, text_id, digest, size, copies, label. Whole clusters yield a row a set; block pairs also yield a spanning forest.
    """
    weights = clusters.groupBy("label").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("sets") / SET_BLOCK), F.ceil(F.col("shingles") / SHINGLE_BLOCK))
    total = clusters.agg(F.sum("size")).first()[0] or 0
    dealt = in_blocks(clusters.join(weights, "label"), "label", blocks, "rep", max(1, int(total) // CELL_SHINGLES))
    texts = docs.select(F.col(id_col).cast("long").alias("text_id"), F.col(text_col).alias("text"))
    rows = texts.join(dealt, "text_id").select("cell", "low", "high", "side", "blocks", "label", "rep", "digest", "copies", "text")

    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sets: list[np.ndarray] = []
        for _, hashes, bounds in shingle_batches(pa.array(rows["text"], pa.string(), from_pandas=True), width):
            sets += [np.unique(hashes[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        # Rows that share an id with another text, or are repeated, are not the set's own row.
        rows = rows.assign(at=np.arange(len(rows)), own=[set_digest(s) == d for s, d in zip(sets, rows["digest"], strict=True)])
        rows = rows[rows["own"]].drop_duplicates(["rep", "side"]).sort_values(["label", "rep"])
        out: list[pd.DataFrame] = []
        across = key[1] != key[2]
        for _, cluster in rows.groupby("label", sort=False):
            own, reps, copies, side = [sets[i] for i in cluster["at"]], cluster["rep"].to_numpy(), cluster["copies"].to_numpy(), cluster["side"].to_numpy()
            n, size = len(own), np.array(list(map(len, own)))
            both = overlaps(own)
            linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            if across:
                linked &= side[:, None] != side[None, :]
            links = linked @ copies
            if cluster["blocks"].iat[0] == 1:
                a, b = np.nonzero(np.triu(linked))
                out.append(pd.DataFrame({"rep": reps, "links": links, "other": reps[least_members(n, a, b)], "forest": False}))
            else:
                edges = spanning(n, lambda i, places, linked=linked: linked[i, places], None)
                out.append(pd.DataFrame({"rep": reps, "links": links, "other": reps, "forest": False}))
                out.append(pd.DataFrame({"rep": reps[[i for i, _ in edges]], "links": 0, "other": reps[[j for _, j in edges]], "forest": True}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"rep": [], "links": [], "other": [], "forest": []})

    return rows.groupBy("cell", "low", "high").applyInPandas(verify, "rep long, links long, other long, forest boolean")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """id, class_id (the least id among the documents linked to it, directly or through others), n_links and set_id (the least id with an equal set).

    n_links counts the other documents whose shingle sets have at least this similarity, copies among them.
    """
    shortest = max(1, matched_depth(threshold, recall) - 1)
    sketched = cut(sketches(docs, id_col, text_col, width, shortest))
    known = sketched.where("id IS NOT NULL")
    classes = cut(known.groupBy("digest").agg(F.min("id").alias("text_id"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes")).withColumn("rep", F.col("text_id")))
    # Two sets may have the same least id, where a table repeats an id with different texts; only then sets go by a hash instead.
    id_repeats = not classes.groupBy("rep").count().where("count > 1").isEmpty()
    if id_repeats:
        classes = classes.withColumn("rep", F.xxhash64("digest"))
    edges = cut(candidate_edges(classes, threshold, TREES * DEPTH, recall, shortest))
    clusters = classes.select("rep", "text_id", "digest", "size", "copies").join(components(edges).withColumnRenamed("node", "rep"), "rep")
    found = cut(verified(docs, cut(clusters), id_col, text_col, width, threshold))
    links = found.where("NOT forest").groupBy("rep").agg(F.sum("links").alias("links"), F.min("other").alias("least"))
    forest = found.where("forest")
    if not forest.isEmpty():
        chained = components(forest.select(F.col("rep").alias("a"), F.col("other").alias("b")))
        links = links.join(chained.withColumnRenamed("node", "rep"), "rep", "left").withColumn("least", F.least("least", "label")).drop("label")
    of_set = classes.select("digest", "rep", "text_id", "copies").join(links, "rep", "left").withColumn("least", F.coalesce("least", "rep"))
    if id_repeats:
        of_set = of_set.join(of_set.groupBy("least").agg(F.min("text_id").alias("class_id")), "least")
    else:
        of_set = of_set.withColumn("class_id", F.col("least"))
    of_set = of_set.select("digest", "class_id", F.col("text_id").alias("set_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = sketched.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(of_set, "digest", "left")
    return joined.select(F.col("id").alias(id_col), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "set_id")
