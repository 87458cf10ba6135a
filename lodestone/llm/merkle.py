"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are runs of words of some tens of characters: paragraphs (lines with their line ends) are cut at sentence ends, and
sentences behind words whose digest says so, so that short texts and long lines have leaves in their unchanged parts. Sections are
runs of leaves that end at a blank line or at a leaf whose digest says so, so that an insertion moves no later border. The
root is the digest of the sections' digests. Equal roots mean equal texts; else equal sections are passed over and the
leaves of the others compared, which locates edits.

A fingerprint is a string: root, then a section each: `digest=leaf+length,leaf+length,...` in text order, split by `|`.

Defined cases: a null text counts as empty and has a root without sections. Very long texts are whole: a fingerprint grows
with its text. Repeated texts have equal fingerprints. Rows without an id come last; rows that share one are ordered by their
text's digest. With one row, the next document is itself. An empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import tasks, whole_text

#: A leaf ends once it has so many characters; longer words are cut within.
LONG = 48
WORD = re.compile(r"\S+[^\S\n]*\n*|[^\S\n]+\n*|\n+")
SENTENCE_END = (".", "!", "?")
#: Texts that are Python strings at a time.
ROWS = 512
#: At most so many ranges of ids, whatever the input.
MOST_RANGES = 8_000


def pieces(word: str) -> list[str]:
    """A word of more than LONG characters, cut behind pairs of characters whose digest says so, and at LONG."""
    out, start = [], 0
    for k in range(2, len(word) + 1):
        if k - start >= LONG or k == len(word) or not zlib.crc32(word[k - 2 : k].encode()) & 15:
            out.append(word[start:k])
            start = k
    return out


def leaves(text: str) -> list[str]:
    """Paragraphs, in sentences, in runs of words that end where a word's digest says so: some tens of characters each."""
    out: list[str] = []
    run, size = [], 0
    for token in WORD.findall(text):
        long = len(token) > LONG
        for word in pieces(token) if long else (token,):
            run.append(word)
            size += len(word)
            if long or size >= LONG or word[-1] == "\n" or word.rstrip().endswith(SENTENCE_END) or not zlib.crc32(word.encode()) & 3:
                out.append("".join(run))
                run, size = [], 0
    if run:
        out.append("".join(run))
    return out


def fingerprint(text: str) -> str:
    sections, row, whole = [], [], hashlib.blake2b(digest_size=16)
    for leaf in leaves(text):
        d = hashlib.blake2b(leaf.encode(), digest_size=6).digest()
        row.append((d.hex(), len(leaf)))
        if leaf.endswith("\n\n") or not d[0] & 15:
            sections.append(row)
            row = []
    if row:
        sections.append(row)
    parts = []
    for row in sections:
        body = ",".join(f"{d}+{n}" for d, n in row)
        d = hashlib.blake2b(body.encode(), digest_size=8).hexdigest()
        whole.update(d.encode())
        parts.append(f"{d}={body}")
    whole.update(hashlib.blake2b(text.encode(), digest_size=16).digest())
    return "|".join([whole.hexdigest(), *parts])


def sections_of(mark: str) -> tuple[str, list[tuple[str, str]]]:
    root, *parts = mark.split("|")
    return root, [tuple(p.split("=", 1)) for p in parts]


def leaves_of(body: str) -> list[tuple[str, int]]:
    return [(d, int(n)) for d, _, n in (x.partition("+") for x in body.split(","))]


def _open(a: str, b: str) -> tuple[int, list[tuple[str, int]], list[tuple[str, int]]]:
    """Characters in sections that both have, and the leaves of each one's other sections."""
    (_, own), (_, other) = sections_of(a), sections_of(b)
    same = Counter(d for d, _ in own) & Counter(d for d, _ in other)
    shared = 0
    rest: list[list[tuple[str, int]]] = [[], []]
    for k, sections in enumerate((own, other)):
        left = same.copy()
        for d, body in sections:
            found = leaves_of(body)
            if left[d] > 0:
                left[d] -= 1
                shared += sum(n for _, n in found) * (k == 0)
            else:
                rest[k] += found
    return shared, *rest


def likeness(a: str, b: str) -> float:
    """Twice the characters in common leaves over those of both texts: 1 for equal roots, 0 with nothing in common."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return 1.0
    shared, own, other = _open(a, b)
    common = sum(n * k for (_, n), k in (Counter(own) & Counter(other)).items())
    total = 2 * shared + sum(n for _, n in own) + sum(n for _, n in other)
    return 2 * (shared + common) / total if total else 0.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Spans (from, to) of a's characters whose leaves b lacks."""
    theirs = Counter(x for _, body in sections_of(b)[1] for x in leaves_of(body))
    spans, at = [], 0
    for _, body in sections_of(a)[1]:
        for leaf in leaves_of(body):
            if theirs[leaf] > 0:
                theirs[leaf] -= 1
            elif spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + leaf[1])
            else:
                spans.append((at, at + leaf[1]))
            at += leaf[1]
    return spans


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars and fingerprint of each row; no shuffle."""
    source = docs.select(F.col(id_col), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(fingerprint, texts), pa.string())], [id_col, "n_chars", "fingerprint"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, n_chars long, fingerprint string")


def passed(bounds: list[int]) -> Column:
    """How many of the bounds (descending) are at or over the id: first among every so many of them, then among those between."""
    if not bounds:
        return F.lit(0)
    wide = max(1, math.isqrt(len(bounds)))
    rows = [bounds[k : k + wide] for k in range(0, len(bounds), wide)]
    heads = F.array(*[F.lit(r[0]) for r in rows]).cast("array<bigint>")
    inner = F.array(*[F.array(*[F.lit(b) for b in r]).cast("array<bigint>") for r in rows])
    at_least = lambda xs: F.size(F.filter(xs, lambda b: b >= F.col("id")))
    over = at_least(heads)
    return F.when(over == 0, 0).otherwise((over - 1) * wide + at_least(F.element_at(inner, F.greatest(over, F.lit(1)))))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 16 << 20) -> DataFrame:
    """Rows (id, text, range, halo) dealt by ranges of descending id, a range a task, and sorted within them.

    There are as many ranges as the session has shuffle partitions, or more where they would pass range_bytes. The first row of the
    range that follows is a halo row at the end of each range, so every row's next one is behind it in its own partition. Rows
    without an id come last, in ranges by their text's digest. Texts are shuffled once.
    """
    digest = F.md5(F.col("text").cast("binary"))
    source = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    size, idless = source.agg(F.sum(F.octet_length("text")), F.sum(F.when(F.col("id").isNull(), F.octet_length("text") + 1))).first()
    n = min(MOST_RANGES, max(tasks(docs.sparkSession), 1, -(-(size or 0) // range_bytes)))
    bounds = sorted({int(x) for x in source.approxQuantile("id", [k / n for k in range(1, n)], 0.1 / n)}, reverse=True) if n > 1 else []
    tail = max(1, min(n, -(-n * (idless or 0) // ((size or 0) + 1))))
    by_digest = F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * tail / F.lit(1 << 32)).cast("int")
    ranged = source.withColumn("range", F.when(F.col("id").isNull(), F.lit(len(bounds) + 1) + by_digest).otherwise(passed(bounds)).cast("int"))
    # One row a range: its first row, by its id and its text's digest.
    firsts = ranged.groupBy("range").agg(F.min(F.struct(F.bitwise_not("id").alias("down"), digest.alias("digest"))).alias("first")).orderBy("range").collect()
    halo = [(None if (at := r["first"]["down"]) is None else ~at, r["first"]["digest"], firsts[k - 1]["range"]) for k, r in enumerate(firsts)]
    copies = F.broadcast(docs.sparkSession.createDataFrame(halo, "halo_id long, halo_digest string, halo_range int"))
    doubled = ranged.join(copies, F.col("id").eqNullSafe(F.col("halo_id")) & (digest == F.col("halo_digest")), "left")
    doubled = doubled.withColumn("at", F.explode(F.array_compact(F.array(F.struct(F.col("range"), F.lit(False).alias("halo")), F.when(F.col("halo_range").isNotNull(), F.struct(F.col("halo_range").alias("range"), F.lit(True).alias("halo")))))))
    order = ["range", "halo", F.col("id").desc_nulls_last(), digest]
    return doubled.select("id", "text", "at.range", "at.halo").repartitionById(len(bounds) + 1 + tail, "range").sortWithinPartitions(*order)


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: its fingerprint, that of the text with its last half replaced by the next document's start, and likenesses."""
    rows = with_next(docs, id_col, text_col)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), *[(x, pa.string()) for x in names[2:5]], ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def judged(row: tuple, follower: tuple) -> tuple:
        id_, text, _, mark = row
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[1][:half]
        other = fingerprint(edited)
        return id_, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark, other, likeness(mark, other), likeness(mark, follower[3])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            out = []
            for id_, text, range_, halo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = (id_, text, range_, None)
                if halo and (waiting is None or waiting[2] != range_):
                    continue
                row = (*row[:3], fingerprint(text))
                if waiting is not None and waiting[2] == range_:
                    out.append(judged(waiting, row))
                waiting = None if halo else row
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(walk, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
