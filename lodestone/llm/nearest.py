"""Approximate nearest neighbours by inner product, with collision-counting hashing that is aware of the query.

Each of m hashes is one random projection, kept as a sorted array. A query opens a window around its own projection in
every array; a vector collides in an array where its place lies in the window. Virtual rehashing widens all windows by a factor
until enough vectors have collided in `share` of the arrays; then the query spends its budget (`budget` of the block, `least`
vectors at least) on them, most collisions first: each is verified once, by its exact inner product in double precision. At each
radius the places of all vectors are compared with the windows' bounds, as small integers a cache line at a time: that takes 3 ms
for 224 arrays of 12,800 vectors, where walking only what the windows gain took 12 to 21. Largest inner product is made nearest
distance by one more coordinate, which lifts all vectors of a block to its largest norm.

Vectors are indexed in blocks (by a hash of their ids), every one of them, and queries are dealt in blocks too; each pair of
blocks is a group, so memory is bounded by the block sizes, and each query brings at most k rows from each block.

Defined cases: vectors that are null or zero, or hold null or non-finite components, take no part, nor do rows without an id.
Vectors are compared with vectors of equal length only. Rows that repeat an id are separate candidates; a query passes over one
row of its own id and vector, itself. As queries, rows of equal id and vector are one, and rows that share an id but not the
vector have ranks of their own. With at most k candidates all are returned. Equal vectors have equal scores to the last bit,
and ties go to the smaller id. An empty table gives none; other columns are unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Vectors whose places are compared at a time, so that they stay in a core's cache.
CACHED = 2_048


class CollisionIndex:
    """The sorted arrays of one block. ranks holds each vector's place in every array: it lies in a window if its place does."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, hashes: int = 240, share: float = 0.57, budget: float = 0.15, least: int = 400, widen: float = 1.15, seed: int = 11):
        if not 0 < hashes < 256 or len(ids) > 65_535:
            raise ValueError("at most 255 arrays of at most 65,535 vectors")  # counts and places are small integers
        in_order = np.lexsort((*vectors.T[::-1], ids))  # so that results don't depend on how rows arrive
        self.ids, self.vectors, self.widen = ids[in_order], vectors[in_order], widen
        n, squares = len(ids), np.einsum("ij,ij->i", self.vectors, self.vectors)
        lift = np.sqrt(np.maximum(squares.max() - squares, 0.0))
        self.norm = float(np.sqrt(squares.max()))
        self.need, self.enough = int(np.ceil(share * hashes)), max(least, int(np.ceil(budget * n)))
        self.directions = np.random.default_rng(seed).normal(size=(vectors.shape[1] + 1, hashes))
        projected = np.column_stack([self.vectors, lift]) @ self.directions
        order = projected.argsort(axis=0, kind="stable").T
        self.sorted = np.ascontiguousarray(np.sort(projected, axis=0).T)
        ranks = np.empty((hashes, n), dtype=np.uint16)
        np.put_along_axis(ranks, order, np.arange(n, dtype=np.uint16)[None, :], axis=1)
        self.ranks = [np.ascontiguousarray(ranks[:, i : i + CACHED]) for i in range(0, n, CACHED)]
        # The first radius is the least at which a sampled vector has enough neighbours, so that few rounds follow.
        self.start = 0.02 * self.norm
        if self.enough < n:
            self.start = min(self.candidates(v, self.enough)[1] for v in self.vectors[:: max(1, n // 8)])

    def candidates(self, query: np.ndarray, enough: int) -> tuple[np.ndarray, float]:
        """Places of the `enough` vectors that collide most often with the query, by the time so many collide often enough; the radius."""
        at = (query * (self.norm / np.linalg.norm(query))) @ self.directions[:-1]
        radius, n = self.start, len(self.ids)
        while True:
            low = np.array([s.searchsorted(x, "left") for s, x in zip(self.sorted, at - radius, strict=True)])
            high = np.array([s.searchsorted(x, "right") for s, x in zip(self.sorted, at + radius, strict=True)])
            first, width = low.astype(np.uint16)[:, None], (high - low).astype(np.uint16)[:, None]
            # Places below a window wrap round to large numbers, as they are unsigned.
            counts = np.concatenate([np.add.reduce((r - first < width).view(np.uint8), axis=0, dtype=np.uint8) for r in self.ranks])
            found = np.flatnonzero(counts >= self.need)
            if len(found) >= enough or (low.max() == 0 and high.min() == n):
                return found[np.argsort(255 - counts[found], kind="stable")[:enough]], radius
            radius *= self.widen

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(ids, scores, how many were verified) of the k best of each query's candidates."""
        enough = max(k + 1, self.enough)
        for query, id_ in zip(queries, own.tolist(), strict=True):
            places = np.arange(len(self.ids)) if enough >= len(self.ids) else self.candidates(query, enough)[0]
            itself = places[(self.ids[places] == id_) & (self.vectors[places] == query).all(axis=1)]
            places = places[places != itself[0]] if len(itself) else places
            scores = (self.vectors[places] * query).sum(axis=1)
            verified = len(places)
            if len(places) > 4 * k:
                near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                places, scores = places[near], scores[near]
            best = np.lexsort((self.ids[places], -scores))[:k]
            yield self.ids[places[best]], scores[best], verified


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 16_384, query_block: int = 2_048, **index) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found, and verified: the candidates of its that were scored, of all."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("length", F.size("v"))
    n, queries = rows.agg(F.count(F.lit(1)), F.count_if("query")).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-queries // query_block))
    place = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    data = rows.select("id", "v", "length", place("data", blocks).alias("block")).withColumn("query_block", every(query_blocks))
    asked = rows.where("query").dropDuplicates(["id", "v"]).select("id", "v", "length", F.xxhash64("v").alias("twin"), place("query", query_blocks).alias("query_block")).withColumn("block", every(blocks))

    def pair(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if here.empty or there.empty:
            return pd.DataFrame({"query_id": [], "twin": [], "vec_id": [], "score": [], "verified": []})
        made = CollisionIndex(here["id"].to_numpy(), np.stack(here["v"].to_numpy()), **index)
        own = there["id"].to_numpy()
        ids, scores, verified = zip(*made.search(np.stack(there["v"].to_numpy()), own, k), strict=True)
        of = np.repeat(np.arange(len(own)), list(map(len, ids)))
        return pd.DataFrame({"query_id": own[of], "twin": there["twin"].to_numpy()[of], "vec_id": np.concatenate(ids), "score": np.concatenate(scores), "verified": np.array(verified)[of]})

    key = ["block", "query_block", "length"]
    found = data.groupBy(key).cogroup(asked.groupBy(key)).applyInPandas(pair, "query_id long, twin long, vec_id long, score double, verified long")
    # All columns are in the order: if one went unused, Spark would prune the cogroup's second side by the first side's columns.
    rank = F.row_number().over(Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id", "verified"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "verified")
