"""Token ids as files: fixed-size blocks of ids, turned into bit or byte planes, each plane compressed with zstandard.

The stream of all ids runs through the documents in ascending id order. It is cut into shards (ranges of document ids), each
shard into chunks of `chunk_ids` ids (the last one shorter). A dataset is a folder of Parquet files with two parts:

- part=chunk: shard, chunk, first (place in the shard), n_ids, planes (compressed; trailing planes of zeros are left out);
  all columns but planes are the chunk index, which a reader scans alone to find the chunks it needs;
- part=document: the id, shard, first, n_ids of each document's own ids.

Both are written by Spark's writer, so they may lie in any store that Spark writes to, and a lost task is written again.

Defined cases: a null text counts as empty and has the end id alone. Documents without an id come first. Rows that repeat an
id stay separate, in the order of their ids' bytes. Special strings in a text become their special ids, as the library does
by default. Very long texts are whole; one may fill many chunks. An empty table gives an empty dataset.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.bpe_codec import ROWS, word_tables
from lodestone.llm.byte_words import white_dropped_words
from lodestone.llm.common import cut, shared_folder, whole_text

#: More text than this many shards of the wanted size makes larger shards; they are streamed through, chunk by chunk.
MOST_SHARDS = 4_096
#: Chunks that are read back together.
TOGETHER = 8

LAYOUT = "id long, shard int, chunk int, first long, n_ids int, planes array<binary>, part string"


def to_planes(ids: np.ndarray, planes: str = "byte", level: int = 3) -> list[bytes]:
    """Transpose a block of ids: plane k holds byte (or bit) k of every id. Compressed; trailing zero planes are dropped."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == "bit":
        rows = np.unpackbits(rows, axis=1, bitorder="little")
    used = int(np.flatnonzero(rows.any(axis=0))[-1]) + 1 if rows.any() else 0
    pack = (lambda x: np.packbits(x, bitorder="little")) if planes == "bit" else np.ascontiguousarray
    compress = zstandard.ZstdCompressor(level=level).compress
    return [compress(pack(rows[:, k]).tobytes()) for k in range(used)]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    expand = zstandard.ZstdDecompressor().decompress
    rows = np.zeros((n, 32 if kind == "bit" else 4), dtype=np.uint8)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(expand(plane), dtype=np.uint8)
        rows[:, k] = np.unpackbits(raw, count=n, bitorder="little") if kind == "bit" else raw
    return (np.packbits(rows, axis=1, bitorder="little") if kind == "bit" else rows).reshape(-1).view("<u4")


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", planes: str = "byte", chunk_ids: int = 65_536, shard_bytes: int = 8 << 20) -> None:
    """Encode every text, append end_id to each, and write the dataset to path."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, -(-size // shard_bytes)))
    bounds = sorted(set(source.approxQuantile("id", [k / shards for k in range(1, shards)], 0.1 / shards))) if shards > 1 else []
    edges = np.array(bounds, dtype=np.float64)
    narrow = "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_tables(tokenizer_path, white_dropped_words)
        if max(table.n_ids, end_id + 1) > 1 << 8 * np.dtype(narrow).itemsize:
            raise ValueError("the ids don't fit the shuffled type")
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            id_ = batch.column(0)
            shard = np.searchsorted(edges, id_.to_numpy(zero_copy_only=False).astype(np.float64), side="left")
            shard[np.asarray(id_.is_null())] = 0
            ids = [np.append(x, end_id).astype(narrow).tobytes() for x in table.encode_column(batch.column(1))]
            yield pa.RecordBatch.from_arrays([id_, pa.array(shard, pa.int32()), pa.array(ids, pa.binary())], ["id", "shard", "ids"])
        table.forget()  # an idle worker holds no words

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chunk, first, rest = None, 0, 0, []

        def rows(last: bool) -> list[dict]:
            nonlocal chunk, rest
            have, out = np.concatenate(rest) if rest else np.zeros(0, dtype="<u4"), []
            while len(have) >= chunk_ids or last and len(have):
                block, have = have[:chunk_ids], have[chunk_ids:]
                out.append({"id": None, "shard": shard, "chunk": chunk, "first": chunk * chunk_ids, "n_ids": len(block), "planes": to_planes(block, planes), "part": "chunk"})
                chunk += 1
            rest = [have]
            return out

        schema = pa.schema([("id", pa.int64()), ("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("planes", pa.list_(pa.binary())), ("part", pa.string())])
        for batch in batches:
            out, held = [], 0
            for id_, s, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    out += rows(last=True) if shard is not None else []
                    shard, chunk, first, rest, held = s, 0, 0, [], 0
                rest.append(own := np.frombuffer(ids, dtype=narrow).astype("<u4"))
                out.append({"id": id_, "shard": s, "chunk": None, "first": first, "n_ids": len(own), "planes": None, "part": "document"})
                first, held = first + len(own), held + len(own)
                if held >= chunk_ids:
                    out += rows(last=False)
                    held = 0
            yield pa.RecordBatch.from_pylist(out, schema)
        if shard is not None:
            yield pa.RecordBatch.from_pylist(rows(last=True), schema)

    encoded = source.mapInArrow(encode, "id long, shard int, ids binary")
    dealt = encoded.repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "ids")
    dealt.mapInArrow(lay, LAYOUT).write.partitionBy("part").option("compression", "uncompressed").parquet(path)


def open_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAYOUT).parquet(path)


def offsets(dataset: DataFrame) -> DataFrame:
    """shard and offset: ids in all earlier shards. One row a shard; the running sum is over these rows alone."""
    totals = dataset.where("part = 'document'").groupBy("shard").agg(F.sum("n_ids").alias("total"))
    return totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("offset"))


def read(spark: SparkSession, path: str, planes: str = "byte") -> DataFrame:
    """id, start (ids of all documents before), n_ids and ids (array) of each document, from the files."""
    return _by_document(spark, path, planes, "ids array<long>", lambda ids: ids.astype(np.int64))


def checksums(spark: SparkSession, path: str, planes: str = "byte") -> DataFrame:
    """As read(), with the CRC-32 of each document's ids (little-endian, 32 bits) in place of the ids."""
    return _by_document(spark, path, planes, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _by_document(spark: SparkSession, path: str, planes: str, column: str, value) -> DataFrame:
    """A few chunks at a time meet the documents that lie in them; a document that goes on is put together from its parts."""
    dataset = open_dataset(spark, path)
    name = column.split(" ")[0]
    of_chunk = dataset.where("part = 'chunk'")
    span = (of_chunk.agg(F.max("n_ids")).first()[0] or 1) * TOGETHER  # all chunks but the last of a shard have the most ids
    schema = f"shard int, first long, id long, n_ids long, span long, {column}, ids_part binary"

    def cut_out(documents: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values("chunk")
        stream = np.concatenate([from_planes(list(p), n, planes) for p, n in zip(chunks["planes"], chunks["n_ids"], strict=True)] or [np.zeros(0, dtype="<u4")])
        low = int(documents["span"].iat[0]) * span if len(documents) else 0
        found, parts = [], []
        for a, n in zip((documents["first"] - low).tolist(), documents["n_ids"].tolist(), strict=True):
            whole = a >= 0 and a + n <= span
            own = stream[max(a, 0) : min(a + n, span)]
            found.append(value(own) if whole else None)
            parts.append(None if whole else own.astype("<u4").tobytes())
        found = pd.Series(found, dtype="Int64" if column.endswith(" long") else object, index=documents.index)
        return pd.DataFrame({"shard": documents["shard"], "first": documents["first"], "id": documents["id"].astype("Int64"), "n_ids": documents["n_ids"], "span": documents["span"], name: found, "ids_part": pd.Series(parts, dtype=object, index=documents.index)})

    def put_together(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(rows.sort_values("span")["ids_part"]), dtype="<u4")
        return rows.iloc[:1].assign(id=rows["id"].iloc[:1].astype("Int64"), ids_part=None, **{name: pd.Series([value(ids)], index=rows.index[:1], dtype=None if column.endswith(" long") else object)})

    documents = dataset.where("part = 'document'").select("id", "shard", "first", F.col("n_ids").cast("long").alias("n_ids"))
    documents = documents.withColumn("span", F.explode(F.expr(f"sequence(first div {span}, (first + n_ids - 1) div {span})")))
    chunks = of_chunk.select("shard", "chunk", "n_ids", "planes", F.expr(f"CAST(chunk div {TOGETHER} AS BIGINT)").alias("span"))
    cut_up = cut(documents.groupBy("shard", "span").cogroup(chunks.groupBy("shard", "span")).applyInPandas(cut_out, schema))
    rest = cut_up.where("ids_part IS NOT NULL").groupBy("shard", "first").applyInPandas(put_together, schema)
    found = cut_up.where("ids_part IS NULL").unionByName(rest)
    return found.join(offsets(dataset), "shard").select("id", (F.col("offset") + F.col("first")).alias("start"), "n_ids", name)


def read_range(spark: SparkSession, path: str, start: int, n: int, planes: str = "byte") -> np.ndarray:
    """Ids start to start + n of the stream: the chunk index tells which chunks to read; only these are."""
    dataset = open_dataset(spark, path).where("part = 'chunk'")
    placed = dataset.join(F.broadcast(offsets(open_dataset(spark, path))), "shard").withColumn("at", F.col("offset") + F.col("first"))
    rows = placed.where((F.col("at") < start + n) & (F.col("at") + F.col("n_ids") > start)).orderBy("at").select("at", "n_ids", "planes").collect()
    if not rows:
        return np.zeros(0, dtype="<u4")
    return np.concatenate([from_planes(r["planes"], r["n_ids"], planes) for r in rows])[max(0, start - rows[0]["at"]) :][:n]


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, planes: str = "byte") -> DataFrame:
    """Write docs as a dataset in the shared folder and read back id, start, n_ids and ids_crc32 of each document."""
    path = f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write(docs, path, tokenizer_path, end_id, planes=planes)
    return checksums(docs.sparkSession, path, planes)
