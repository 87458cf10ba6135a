"""BPE encoding and decoding by a table of distinct words.

Texts are split into words in chunks of up to 16 MB. A chunk lists each of its distinct words once, in parts by a hash of the word,
and keeps, for each occurrence, the word's place in the list. Both are packed and written to the shared folder, bucketed by chunk.
A shuffle brings the parts of one hash together, so that each distinct word of the corpus is met by one task, which encodes it
once (unless over KEPT_WORDS of them meet there) and answers every part with its words' ids, in their order. A second shuffle
brings the answers of a chunk together, and they are joined with its occurrences, which stay where they were written: the ids of
its texts are a gather by position. `decode` lists each distinct id of a chunk once, and joins the lists, part by part, with a table
of ids and pieces; texts are gathers of the pieces by place. `digests` holds both directions in one pass: its ids are at hand when a
chunk is put together, so it takes their pieces from the vocabulary's table in the task, which a join would only carry there again
(see the README for figures).

Shuffled are packed lists of the distinct words of each chunk and their ids, never occurrences.

Defined cases: a null text counts as empty and has no ids. Special strings inside a text become their special ids, as the
library does by default, and decode to themselves. Very long texts are whole, in a chunk of their own. Repeated rows give repeated
rows; an empty table gives none; other columns are not read unless named.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType
from tokenizers import Tokenizer

from lodestone.llm.byte_words import COLUMNS, PLAIN, byte_level_words, check_format
from lodestone.llm.common import held, scratch, tasks, whole_text

#: Distinct words that a task keeps from one batch to the next. Bounds memory, never results.
KEPT_WORDS = 250_000
#: Texts that are Python strings at a time.
ROWS = 512
#: Bytes and rows of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES, CHUNK_ROWS = 16 << 20, 20_000
#: How hard packed columns are compressed.
LEVEL = 6


def byte_pieces(path: str) -> list[bytes]:
    """The bytes of each id; the byte-level alphabet maps printable Latin-1 to itself and other bytes to 256 and on."""
    with open(path) as f:
        spec = json.load(f)
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    back = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in own)}
    pieces: dict[int, bytes] = {i: bytes(back[c] for c in w) for w, i in spec["model"]["vocab"].items() if all(c in back for c in w)}
    pieces |= {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
    return [pieces.get(i, b"") for i in range(max(pieces) + 1)]


class Places(dict):
    """The place of each word; a word that is met for the first time gets the next place and waits in fresh."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.fresh.append(word)
        return at


class WordTable:
    """Distinct words and their ids, grown batch by batch."""

    def __init__(self, path: str, split: Callable[[str, dict[str, int]], list[str]] = byte_level_words):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share out the cores
        with open(path) as f:
            check_format(json.load(f), split)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.path, self.split = path, split
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.n_ids = self.tokenizer.get_vocab_size()
        self.forget()

    def forget(self) -> None:
        self.place = Places()
        self.starts = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def ids_of(self, words: list[str], at_once: int = 500) -> list[list[int]]:
        """The library's own ids of each word: plain words go straight to its BPE model, the others through all of it."""
        plain, model = PLAIN[self.split], self.tokenizer.model
        out: list = [None if (form := plain(w)) is None else [t.id for t in model.tokenize(form)] for w in words]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k in range(0, len(rest), at_once):  # a few words at a time, as the results are large
            some = rest[k : k + at_once]
            for at, e in zip(some, self.tokenizer.encode_batch_fast([words[x] for x in some], add_special_tokens=False), strict=True):
                out[at] = e.ids
        return out

    def places(self, words: list[str]) -> np.ndarray:
        """The places of words in the table; new ones are encoded first, each once."""
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        if fresh := self.place.fresh:
            ids = self.ids_of(fresh)
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(list(map(len, ids)))])
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.int32)])
            fresh.clear()
        return at

    def gather(self, at: np.ndarray, n_words: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each text, from the places of all texts' words and how many words each text has."""
        lengths = self.starts[at + 1] - self.starts[at]
        ends = np.append(0, np.cumsum(lengths))
        ids = self.flat[np.repeat(self.starts[at] - ends[:-1], lengths) + np.arange(ends[-1])]
        bounds = ends[np.append(0, np.cumsum(n_words))].tolist()
        return (ids[x:y] for x, y in itertools.pairwise(bounds))

    def encode(self, texts: list[str], rows: int = 256) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), rows):
            if len(self.place) > KEPT_WORDS:
                self.forget()
            words = [self.split(t, self.specials) for t in texts[i : i + rows]]
            yield from self.gather(self.places(list(itertools.chain.from_iterable(words))), np.fromiter(map(len, words), np.int64, len(words)))

    def count(self, texts: list[str]) -> list[int]:
        """How many ids each text has."""
        if len(self.place) > KEPT_WORDS:
            self.forget()
        words = [self.split(t, self.specials) for t in texts]
        at = self.places(list(itertools.chain.from_iterable(words)))
        upto = np.append(0, np.cumsum(self.starts[at + 1] - self.starts[at]))
        ends = np.append(0, np.cumsum(list(map(len, words)))).astype(np.int64)
        return np.diff(upto[ends]).tolist()

    def encode_column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """As encode(), for an Arrow column without nulls; where the split can do columns, only distinct words become strings."""
        words = COLUMNS[self.split](texts) if self.split in COLUMNS else None
        if words is None:
            yield from self.encode(texts.to_pylist())
            return
        if len(self.place) > KEPT_WORDS:
            self.forget()
        coded = words.flatten().dictionary_encode()
        at = self.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(coded) else np.zeros(0, dtype=np.int64)
        yield from self.gather(at, pc.list_value_length(words).to_numpy())


def word_tables(path: str, split: Callable[[str, dict[str, int]], list[str]] = byte_level_words) -> WordTable:
    """One for each Python worker, which serves several tasks."""
    return held(WordTable, path, split)


def _cuts(sizes: np.ndarray, most: int) -> list[int]:
    """Where chunks begin among rows of these sizes, and the end."""
    bounds, room, rows = [0], most, 0
    for k, size in enumerate(sizes.tolist()):
        if rows and (size > room or rows >= CHUNK_ROWS):
            bounds.append(k)
            room, rows = most, 0
        room, rows = room - size, rows + 1
    return [*bounds, len(sizes)] if len(sizes) else [0]


def _packed(columns: list[pa.Array], names: list[str]) -> bytes:
    """Columns as a compressed Arrow stream."""
    sink, batch = pa.BufferOutputStream(), pa.RecordBatch.from_arrays(columns, names)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def n_parts(spark: SparkSession) -> int:
    """How many parts the lists of distinct units are in."""
    return min(65_535, max(16, tasks(spark)))


def _chunks(rows: DataFrame, units: Callable[[pa.Array], tuple[pa.Array, np.ndarray]], key: Callable, name: str) -> DataFrame:
    """chunk, lists (packed parts of its distinct units, by key), kept (its rows, and how many units each has), parts_of and places.

    Places tell of all its rows' units which distinct one they are, by the order in which those come up, so that frequent ones have
    small numbers; as planes of bytes they pack well. parts_of tells which part each distinct unit is in, and so its place in the lists.

    rows: kept columns, then what is cut into units. The table is bucketed by chunk, so that what is joined with it comes to it.
    """
    spark, most = rows.sparkSession, CHUNK_BYTES
    parts = n_parts(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            last = batch.column(batch.num_columns - 1)
            sizes = pc.binary_length(last) if pa.types.is_string(last.type) or pa.types.is_large_string(last.type) else pc.multiply(pc.list_value_length(last), 4)
            for low, to in itertools.pairwise(_cuts(sizes.to_numpy(zero_copy_only=False), most)):
                part = batch.slice(low, to - low)
                coded, lengths = units(part.column(part.num_columns - 1))
                of = np.fromiter(map(key, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary)) % parts
                order = np.argsort(of, kind="stable")
                listed, bounds = coded.dictionary.take(pa.array(order)), np.searchsorted(of[order], np.arange(parts + 1))
                lists = [_packed([listed.slice(x, y - x)], ["units"]) if y > x else None for x, y in itertools.pairwise(bounds.tolist())]
                kept = _packed([*part.columns[:-1], pa.array(lengths, pa.int64())], [str(k) for k in range(part.num_columns)])
                planes = np.ascontiguousarray(coded.indices.to_numpy().astype("<i4").view(np.uint8).reshape(-1, 4).T)
                places = _packed([pa.array(x) for x in planes], ["0", "1", "2", "3"])
                parts_of = _packed([pa.array(of.astype(np.uint16))], ["of"])
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([lists], pa.list_(pa.binary())), *(pa.array([x], pa.binary()) for x in (kept, parts_of, places))], ["chunk", "lists", "kept", "parts_of", "places"])
                at += 1

    folder = scratch(spark, name)
    table = "lodestone_" + folder.rsplit("-", 1)[-1]
    packed = rows.mapInArrow(run, "chunk long, lists array<binary>, kept binary, parts_of binary, places binary")
    packed.write.option("path", folder).option("compression", "none").bucketBy(tasks(spark), "chunk").saveAsTable(table)
    return spark.table(table)


def _split(tokenizer_path: str) -> Callable[[pa.Array], tuple[pa.Array, np.ndarray]]:
    def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        specials = word_tables(tokenizer_path).specials
        place, at, lengths = Places(), [], []
        for text in texts.to_pylist():
            words = byte_level_words(text, specials)
            lengths.append(len(words))
            at.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
        return pa.DictionaryArray.from_arrays(pa.array(np.concatenate(at) if at else [], pa.int32()), pa.array(list(place), pa.string())), np.array(lengths)

    return words_of


def _ids_in(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    lists = pc.fill_null(lists, pa.scalar([], lists.type))
    return lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy()


def _answers(chunks: DataFrame, answer: Callable[[], Callable[[pa.Array], pa.Array]]) -> DataFrame:
    """chunk and answers (part and data, in order): each part of the chunks' lists with what `answer` gives of its units, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = answer()
        for batch in batches:
            for k in range(batch.num_rows):
                found = of(_unpacked(batch.column(2)[k].as_py()).column(0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([_packed([found], ["data"])], pa.binary())], ["chunk", "part", "data"])

    parts = chunks.select("chunk", F.posexplode("lists").alias("part", "data")).where("data IS NOT NULL").repartition("part")
    given = parts.mapInArrow(run, "chunk long, part int, data binary")
    return given.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "data"))).alias("answers"))


def _word_ids(tokenizer_path: str) -> Callable[[], Callable[[pa.Array], pa.Array]]:
    """Lists of ids of words; a task keeps the words that it has encoded."""

    def start() -> Callable[[pa.Array], pa.Array]:
        table = word_tables(tokenizer_path)
        table.forget()

        def answer(words: pa.Array) -> pa.Array:
            if len(table.place) > KEPT_WORDS:
                table.forget()
            at = table.places(words.to_pylist())
            lengths = table.starts[at + 1] - table.starts[at]
            upto = np.append(0, np.cumsum(lengths))
            ids = table.flat[np.repeat(table.starts[at] - upto[:-1], lengths) + np.arange(upto[-1])]
            return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids.astype(np.uint16 if table.n_ids <= 65_536 else np.int32)))

        return answer

    return start


def word_table(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """word, n and ids: each distinct word of the corpus once, with its count. Tasks count their own words before the shuffle."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials = word_tables(tokenizer_path).specials
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            found = pa.array([w for t in batch.column(0).to_pylist() for w in byte_level_words(t, specials)], pa.string()).value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    def with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_tables(tokenizer_path)
        for batch in (b.slice(k, ROWS * 8) for b in batches for k in range(0, b.num_rows, ROWS * 8)):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(table.ids_of(batch.column(0).to_pylist()), pa.list_(pa.int32()))], ["word", "n", "ids"])

    words = docs.select(whole_text(text_col).alias("text")).mapInArrow(split, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.mapInArrow(with_ids, "word string, n long, ids array<int>")


def _gathered(flat: np.ndarray, starts: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Of each row the units' values one behind the other; unit k has flat[starts[k]:starts[k + 1]]. A few rows at a time."""
    ends, first, n = np.append(0, np.cumsum(lengths)), starts[:-1], np.diff(starts)
    for k in range(0, len(lengths), 256):
        stop = min(len(lengths), k + 256)
        at = places[ends[k] : ends[stop]]
        upto = np.append(0, np.cumsum(n[at]))
        out = flat[np.repeat(first[at] - upto[:-1], n[at]) + np.arange(upto[-1])]
        bounds = upto[ends[k : stop + 1] - ends[k]].tolist()
        yield from (out[x:y] for x, y in itertools.pairwise(bounds))


def _by_row(chunks: DataFrame, answers: DataFrame, make: Callable[[pa.Array], Callable], kept: StructType, added: StructType) -> DataFrame:
    """A row for each row of the chunks: its kept columns, and what make gives.

    make(the answers on the chunk's units, in order of place) gives a function of (places, lengths) of some rows that gives arrays.
    """
    joined = chunks.select("chunk", "kept", "parts_of", "places").join(answers, "chunk", "left").select("kept", "parts_of", "places", F.col("answers.data").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own, parts_of, planes = (_unpacked(batch.column(i)[k].as_py()) for i in range(3))
                in_list = np.argsort(parts_of.column(0).to_numpy(), kind="stable")
                listed = np.empty(len(in_list), dtype=np.int32)
                listed[in_list] = np.arange(len(in_list), dtype=np.int32)
                places = listed[np.stack([c.to_numpy() for c in planes.columns], axis=1).reshape(-1).view("<i4")]
                found = [_unpacked(x.as_py()).column(0) for x in batch.column(3)[k].values] if batch.column(3)[k].is_valid else []
                lengths = own.column(own.num_columns - 1).to_numpy()
                made, upto = make(pa.concat_arrays(found) if found else None), np.append(0, np.cumsum(lengths))
                for low in range(0, own.num_rows, ROWS):
                    to = min(own.num_rows, low + ROWS)
                    yield pa.RecordBatch.from_arrays([*[c.slice(low, to - low) for c in own.columns[:-1]], *made(places[upto[low] : upto[to]], lengths[low:to])], [*kept.names, *added.names])

    return joined.mapInArrow(run, StructType([*kept.fields, *added.fields]))


def _flat(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All units' bytes one behind the other, and where each begins."""
    return np.frombuffer(b"".join(units), dtype=np.uint8), np.append(0, np.cumsum(np.fromiter(map(len, units), np.int64, len(units))))


def _ids_of(answers: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
    """All units' ids one behind the other, and where each begins."""
    if answers is None:
        return np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
    return answers.flatten().to_numpy().astype(np.int32), np.append(0, np.cumsum(pc.list_value_length(answers).to_numpy()))


def _kept(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    return docs.select([F.col(f"`{c}`") for c in columns])


def _words(docs: DataFrame, tokenizer_path: str, columns: Sequence[str], text_col: str) -> DataFrame:
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], whole_text(text_col).alias("__text"))
    return _chunks(rows, _split(tokenizer_path), lambda word: zlib.crc32(word.encode()), "words")


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """id, the kept columns, n_tokens and ids (array of int) of each row."""
    names = [id_col, *keep, "n_tokens", "ids"]
    if len(set(names)) < len(names):
        raise ValueError("kept columns must differ from the id, n_tokens and ids")
    kept = _kept(docs, [id_col, *keep]).schema
    chunks = _words(docs, tokenizer_path, kept.names, text_col)

    def make(answers: pa.Array | None) -> Callable:
        flat, starts = _ids_of(answers)

        def rows(places: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
            ids = list(_gathered(flat, starts, places, lengths))
            return [pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))]

        return rows

    added = StructType().add("n_tokens", "long").add("ids", ArrayType(IntegerType()))
    return _by_row(chunks, _answers(chunks, _word_ids(tokenizer_path)), make, kept, added)


def piece_table(spark: SparkSession, tokenizer_path: str, parts: int) -> DataFrame:
    """part and pieces: the bytes of the ids part, part + parts, part + 2 * parts and so on, in order. The vocabulary bounds it."""

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held(byte_pieces, tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([known[i] for i in batch.column(0).to_pylist()], pa.binary())], ["id", "piece"])

    rows = spark.range(len(held(byte_pieces, tokenizer_path))).mapInArrow(spelt, "id long, piece binary")
    listed = rows.groupBy((F.col("id") % parts).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("id", "piece"))).alias("own"))
    return listed.select("part", F.col("own.piece").alias("pieces"))


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of each row of ids, by a join of the chunks' distinct ids with the table of ids and pieces; null ids decode to the empty text, unknown ones to nothing."""
    spark, parts = encoded.sparkSession, n_parts(encoded.sparkSession)
    kept = _kept(encoded, [id_col]).schema
    rows = encoded.select(F.col(f"`{id_col}`"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("__ids"))
    chunks = _chunks(rows, _ids_in, int, "ids")
    asked = chunks.select("chunk", F.posexplode("lists").alias("part", "data")).where("data IS NOT NULL")

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column(3)[k].as_py() or []
                ids = _unpacked(batch.column(2)[k].as_py()).column(0).to_pylist()
                found = pa.array([own[i // parts] if 0 <= i < parts * len(own) else b"" for i in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([_packed([found], ["data"])], pa.binary())], ["chunk", "part", "data"])

    met = asked.join(piece_table(spark, tokenizer_path, parts), "part", "left").select("chunk", "part", "data", "pieces")
    answers = met.mapInArrow(spelt, "chunk long, part int, data binary").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "data"))).alias("answers"))

    def make(found: pa.Array | None) -> Callable:
        flat, starts = _flat(found.to_pylist() if found is not None else [])
        return lambda places, lengths: [pa.array([x.tobytes().decode("utf-8", "replace") for x in _gathered(flat, starts, places, lengths)], pa.string())]

    return _by_row(chunks, answers, make, kept, StructType().add("text", "string"))


def digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, and SHA-256 of the ids (decimal, joined by commas) and of the text decoded from them."""
    kept = _kept(docs, [id_col]).schema
    chunks = _words(docs, tokenizer_path, kept.names, text_col)

    def make(answers: pa.Array | None) -> Callable:
        known = held(byte_pieces, tokenizer_path)
        flat, starts = _ids_of(answers)
        # Of each distinct word once: its ids in digits and its bytes. A text's are theirs, one behind the other.
        of_id = [_flat(x) for x in ([b"%d," % i for i in range(len(known))], known)]
        written, texts = ((table := of_id[k], np.append(0, np.cumsum(np.diff(table[1])[flat]))[starts]) for k in (0, 1))
        spelt = [(np.concatenate(list(_gathered(*table, flat, np.array([len(flat)])))) if len(flat) else np.zeros(0, np.uint8), bounds) for table, bounds in (written, texts)]

        def rows(places: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
            ends = np.append(0, np.cumsum(lengths))
            upto = np.append(0, np.cumsum(np.diff(starts)[places]))
            of_ids = [hashlib.sha256(x.tobytes()[:-1]).hexdigest() for x in _gathered(*spelt[0], places, lengths)]
            of_text = [hashlib.sha256(x.tobytes().decode("utf-8", "replace").encode()).hexdigest() for x in _gathered(*spelt[1], places, lengths)]
            return [pa.array(np.diff(upto[ends]), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]

        return rows

    added = StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return _by_row(chunks, _answers(chunks, _word_ids(tokenizer_path)), make, kept, added)


def counts(docs: DataFrame, tokenizer_path: str, text_col: str, keep: Sequence[str]) -> DataFrame:
    """The kept columns and n_tokens of each row, by each task's own table of words: no shuffle, as counts need no ids to be kept."""
    kept = _kept(docs, keep).schema
    source = docs.select(*[F.col(f"`{c}`") for c in keep], whole_text(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_tables(tokenizer_path)
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(table.count(batch.column(batch.num_columns - 1).to_pylist()), pa.int64())], [*keep, "n_tokens"])
        table.forget()  # an idle worker holds no words

    return source.mapInArrow(run, StructType(list(kept.fields)).add("n_tokens", "long"))
