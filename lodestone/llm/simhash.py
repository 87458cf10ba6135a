"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has a bit set where over half of the XXH64 hashes (seed 42) of its word shingles have it set. Texts whose
fingerprints differ in few bits are linked.

The 64 bits are cut into partitions, correlated bits together. Each partition has a threshold of its own, -1 (it isn't probed) and
up, and the thresholds plus one add up to one more than the allowed difference: if two fingerprints exceeded the threshold in every
partition, they would differ in more bits than allowed. Probing a partition at threshold t takes each t of its bits away in turn and looks
for equal rests. Thresholds are set by dynamic programming over the partitions on estimated candidate counts; so is the number of
partitions. Correlations and estimates are sums over all distinct fingerprints (64 x 64 co-occurrences, and signed counters
whose squares add up to the number of equal pairs).

Candidates of one probe are verified in a join, which gives links only. Where a probe's rest is shared by more than CROWD
fingerprints, pairs would grow with its square: such fingerprints meet through the points at a distance of half the allowed
difference instead (at most 65 fingerprints lie around a point, for 2 bits), which finds all their links too, as a spanning star
of each point. Components follow from all links. All work is on distinct fingerprints; copies are never paired.

Defined cases: a null text counts as empty; texts without words have fingerprint zero, and are linked like others. Repeated rows
are linked. Rows without an id are fingerprinted and get the least id of their component, which is null if none of it has one.
Very long texts are whole, hashed in slices. An empty table gives none; other columns are unread.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestone.llm.common import cut
from lodestone.llm.components import components
from lodestone.llm.shingles import mix

BITS, SEED = 64, 42
#: Fingerprints that share a probe's rest and are still compared pair by pair.
CROWD = 500
#: Counters for the number of equal pairs of a probe.
COUNTERS = 128
#: What a probe's row costs, in comparisons of a pair.
ROW_COST = 40.0
#: Shingles hashed at a time.
AT_ONCE = 16_384

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, least bit first."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, width: int = 3) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    # Shingles are slices of the words set end to end.
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    most = max(1, len(words) - width + 1)
    starts, stops = np.append(0, ends[:-1] + 1)[:most], ends[min(width, len(words)) - 1 :]
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, most, AT_ONCE):
        part = zip(starts[at : at + AT_ONCE].tolist(), stops[at : at + AT_ONCE].tolist(), strict=True)
        counts += set_bits(np.array([xxh64_intdigest(line[a:b], SEED) for a, b in part], dtype=np.uint64))
    return int(np.packbits(2 * counts > most, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """id and fp (the fingerprint as a signed number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1).cast(pa.binary())), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(run, "id long, fp long")


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(0)).view(np.uint64)


def together(classes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many of them each pair of bits is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                own = np.unpackbits(_numbers(batch)[at : at + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += own.T @ own
                n += len(own)
        cells = np.append(total.reshape(-1), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    sums = {r["cell"]: r["n"] for r in classes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    return sums.get(BITS * BITS, 0), np.array([sums.get(i, 0) for i in range(BITS * BITS)], dtype=float).reshape(BITS, BITS)


def correlations(n: int, both: np.ndarray) -> np.ndarray:
    """Absolute correlations of the bits; 0 for a bit that is always the same."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(p * (1 - p))
    apart = np.outer(spread, spread)
    return np.abs(np.divide(both / max(n, 1) - np.outer(p, p), apart, out=np.zeros_like(both), where=apart > 1e-9))


def partitioned(near: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in so many partitions of about equal size: each takes, one after the other, the free bit nearest to those it has."""
    free, out = set(range(BITS)), []
    for k in range(parts):
        own = [max(sorted(free), key=lambda b: sum(near[b, c] for c in free if c != b))]
        free.discard(own[0])
        while len(own) < BITS // parts + (k < BITS % parts):
            own.append(max(sorted(free), key=lambda b: sum(near[b, c] for c in own)))
            free.discard(own[-1])
        out.append(sorted(own))
    return out


def probes(bits: list[int], threshold: int) -> list[int]:
    """Masks of what a probe compares: the partition without each choice of so many of its bits."""
    whole = sum(1 << b for b in bits)
    return [whole - sum(1 << b for b in taken) for taken in itertools.combinations(bits, threshold)]


def equal_pairs(classes: DataFrame, masks: list[int]) -> dict[int, float]:
    """About how many pairs agree in each mask, by the squares of signed counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(masks), COUNTERS), dtype=np.int64)
        for batch in batches:
            for k, m in enumerate(masks):
                hashed = mix((_numbers(batch) & np.uint64(m)) + np.uint64(0x9E3779B97F4A7C15))
                sign = 1 - 2 * (hashed >> np.uint64(63)).astype(np.int64)
                total[k] += np.bincount((hashed % np.uint64(COUNTERS)).astype(np.int64), weights=sign, minlength=COUNTERS).astype(np.int64)
        mask, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(mask), pa.array(cell), pa.array(total[mask, cell])], ["mask", "cell", "n"])

    sums = classes.select("fp").mapInArrow(run, "mask long, cell long, n long").groupBy("mask", "cell").agg(F.sum("n").alias("n"))
    squares = sums.groupBy("mask").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    return {masks[r["mask"]]: r["squares"] for r in squares.collect()}


def allocated(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """The cheapest thresholds: costs[i][u] is the cost of partition i at threshold u - 1; the u add up to units."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        ahead: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for u in range(min(units - used, len(own) - 1) + 1):
                found = (cost + own[u], [*chosen, u - 1])
                if used + u not in ahead or found < ahead[used + u]:
                    ahead[used + u] = found
        best = ahead
    return best.get(units, (math.inf, []))


def plan(classes: DataFrame, distance: int, shapes: tuple[int, ...] = (2, 3, 4)) -> list[int]:
    """The masks to probe, of the cheapest number of partitions and thresholds. Thresholds up to 1 are weighed."""
    n, both = together(classes)
    near = correlations(n, both)
    cut_up = {parts: partitioned(near, parts) for parts in shapes}
    masks = sorted({m for parts in cut_up.values() for bits in parts for t in (0, 1) for m in probes(bits, t)})
    squares = equal_pairs(classes, masks)
    cost = lambda bits, t: sum(ROW_COST * n + max(0.0, squares.get(m, 0.0) - n) / 2 for m in probes(bits, t))
    found = []
    for parts in cut_up.values():
        total, thresholds = allocated([[0.0, cost(bits, 0), cost(bits, 1)] for bits in parts], distance + 1)
        if thresholds:
            found.append((total, [m for bits, t in zip(parts, thresholds, strict=True) if t >= 0 for m in probes(bits, t)]))
    return min(found)[1]


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def rests(fp: Column, masks: list[int]) -> Column:
    """An array of (mask, rest) for each probe."""
    return F.array(*[F.struct(F.lit(k).cast("short").alias("probe"), fp.bitwiseAND(F.lit(_signed(m)).cast("long")).alias("rest")) for k, m in enumerate(masks)])


def around(fp: Column, radius: int) -> Column:
    """All points at up to so many bits from a fingerprint."""
    flips = [sum(1 << b for b in taken) for r in range(radius + 1) for taken in itertools.combinations(range(BITS), r)]
    return F.transform(F.array(*[F.lit(_signed(x)).cast("long") for x in flips]), lambda x: fp.bitwiseXOR(x))


def links(classes: DataFrame, distance: int) -> DataFrame:
    """a, b: links between distinct fingerprints that join all components of the graph of pairs at this distance or nearer."""
    if classes.isEmpty():
        return classes.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    masks = plan(classes, distance)
    probed = classes.select("fp", F.explode(rests(F.col("fp"), masks)).alias("at")).select("fp", "at.probe", "at.rest")
    shared = probed.groupBy("probe", "rest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(probed.join(shared, ["probe", "rest"]))
    few, crowd = met.where(F.col("n") <= CROWD), met.where(F.col("n") > CROWD).select("fp").distinct()
    one, other = few.select("probe", "rest", F.col("fp").alias("a")), few.select("probe", "rest", F.col("fp").alias("b"))
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    verified = one.join(other, ["probe", "rest"]).where((F.col("a") < F.col("b")) & (differ <= distance)).select("a", "b")
    points = crowd.select("fp", F.explode(around(F.col("fp"), distance // 2)).alias("point"))
    stars = points.groupBy("point").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    starred = stars.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, F.size("fps") - 1)).alias("b"))
    return verified.unionByName(starred).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (the least id reachable by links of at most `distance` differing bits; 0 or 2)."""
    if distance not in (0, 2):
        raise ValueError("crowds are resolved through points half way, which are exact for an even distance; 0 and 2 are planned for")
    rows = cut(fingerprints(docs, id_col, text_col, width))
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    labels = components(cut(links(classes, distance))).withColumnRenamed("node", "fp")
    joined = classes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    component = joined.join(joined.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("fp", "component_id")
    found = rows.join(component, "fp")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
