"""Operators on documents, against brute force, the tokenizers library, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import binary_ids, bpe_codec, byte_words, kd_shards, language_id, merkle, mixing, ngram_join, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, ids string"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
#: Nulls in any column, empty and very long texts, ties, repeated rows, a repeated id, extra columns with clashing names.
ODD = [
    (1, "The same five words and more of them, again.", "en", "a", 1, 0.5, 1, "x"),
    (2, "The same five words and more of them, again.", "en", "a", 1, 0.5, 1, "x"),
    (2, "The same five words and more of them, again.", "en", "a", 1, 0.5, 1, "x"),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "b", 0, None, None, None),
    (5, "", "en", "b", 0, None, None, None),
    (6, " \n\t ", "de", "b", 4, None, None, None),
    (7, LONG, "en", "c", len(LONG), None, None, None),
    (7, "another text under an id that is taken", "en", "c", 3, None, None, None),
    (8, LONG + " x", "en", "c", len(LONG) + 2, None, None, None),
    (9, "Ça va, très bien. <|endoftext|> 3.14!?", "fr", None, 5, None, None, None),
    (10, "!!! ... 123", None, "d", 9, None, None, None),
    (None, "a row without an id", "en", "d", 3, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    words = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {("", (text or "").lower())}


def brute_groups(rows, threshold=0.8):
    """(id, class, links) of each row with an id, by comparing all pairs."""
    rows = [(i, shingle_set(t)) for i, t in rows if i is not None]
    group, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(rows[i][1] & rows[j][1])
            if both >= threshold * (len(rows[i][1]) + len(rows[j][1]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in set(group)}
    return Counter((rows[k][0], least[group[k]], links[k]) for k in range(len(rows)))


def found_groups(df):
    return Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in df.collect() if r["doc_id"] is not None)


def near_copies(n, seed=3):
    draw = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bcdfgh" for b in ("ana", "elo", "iru", "oma", "uti", "esk")]
    bases = [[draw.choice(vocabulary) for _ in range(draw.randint(20, 120))] for _ in range(n // 6)]
    rows = []
    for k in range(n):
        words = list(draw.choice(bases[:2] if k % 3 == 0 else bases))  # a third of all rows in two groups
        for _ in range(draw.randint(0, 4)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        rows.append((k, " ".join(words)))
    return rows


def test_join_equals_brute_force(spark, sf):
    rows = near_copies(240)
    assert found_groups(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_groups(rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found_groups(ngram_join.join(docs)) == brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_join_in_blocks(spark, monkeypatch):
    """Groups beyond a block's size are cut up and put together."""
    rows = near_copies(150, seed=5)
    for name, value in (("NODE_BLOCK", 8), ("SET_BLOCK", 7), ("COMMON", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    assert found_groups(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_groups(rows)


def test_join_of_odd_rows(odd, none):
    found = ngram_join.join(odd).toPandas()
    assert len(found) == len(ODD) and found_groups(ngram_join.join(odd)) == brute_groups([r[:2] for r in ODD])
    assert found[found.doc_id.isna()].class_id.isna().all()
    assert ngram_join.join(none).count() == 0


def test_prefixes_shorten_to_the_recall():
    assert ngram_join.matched_depth(0.8, 0.99) == 8 and ngram_join.matched_depth(0.8, 0.999) == 7
    assert ngram_join.collision(0.8, ngram_join.matched_depth(0.8, 0.99999)) >= 0.99999


def test_words_give_the_library_ids():
    draw = random.Random(1)
    letters = [*"ab'sT ltréßÀ.,;:!?\"-\n\t  12Σ<|>÷\u0301\u3000", "<|endoftext|>", "'ll", "...", "İ"]
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 16))) for _ in range(8_000)]
    for path, split in ((BYTE, byte_words.byte_level_words), (WORD, byte_words.white_dropped_words)):
        library = Tokenizer.from_file(path)
        for t, ids in zip(texts, bpe_codec.WordTable(path, split).encode(texts), strict=True):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t
        plain = [t for t in texts if "<|" not in t]
        for t, ids in zip(plain, bpe_codec.WordTable(path, split).encode_column(pa.array(plain)), strict=True):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_codec_round_trip(odd, none):
    library = Tokenizer.from_file(BYTE)
    texts = Counter((r[1] or "") for r in ODD)
    encoded = bpe_codec.encode(odd, BYTE, keep=["source"])
    assert encoded.columns == ["doc_id", "source", "n_tokens", "ids"]
    assert Counter(r["text"] for r in bpe_codec.decode(encoded, BYTE).collect()) == texts
    want = Counter()
    for r in ODD:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe_codec.digests(odd, BYTE).collect())) == want
    assert bpe_codec.digests(none, BYTE).count() == bpe_codec.word_table(none, BYTE).count() == 0
    table = {r["word"]: r["n"] for r in bpe_codec.word_table(odd, BYTE).collect()}
    assert table[" same"] == 3


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_files_give_back_the_stream(spark, odd, none, tmp_path, planes):
    library = Tokenizer.from_file(WORD)
    binary_ids.write(odd, str(tmp_path / "ds"), WORD, 2, planes=planes, chunk_ids=1_000)
    rows = binary_ids.read(spark, str(tmp_path / "ds"), planes).orderBy("start").collect()
    assert [r["id"] for r in rows] == sorted((r[0] for r in ODD), key=lambda i: (i is not None, i or 0))
    assert rows[0]["start"] == 0 and all(b["start"] == a["start"] + a["n_ids"] for a, b in zip(rows, rows[1:], strict=False))
    want = Counter((r[0], tuple([*library.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in ODD)
    assert Counter((r["id"], tuple(r["ids"])) for r in rows) == want
    sums = {(r["start"], r["ids_crc32"]) for r in binary_ids.checksums(spark, str(tmp_path / "ds"), planes).collect()}
    assert sums == {(r["start"], zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())) for r in rows}
    stream = [i for r in rows for i in r["ids"]]
    assert binary_ids.read_range(spark, str(tmp_path / "ds"), 5, 2_345, planes).tolist() == stream[5:2_350]
    binary_ids.write(none, str(tmp_path / "none"), WORD, 2)
    assert binary_ids.read(spark, str(tmp_path / "none")).count() == 0


def test_planes_round_trip():
    ids = np.random.default_rng(0).integers(0, 70_000, 1_001).astype("<u4")
    for kind in ("byte", "bit"):
        assert (binary_ids.from_planes(binary_ids.to_planes(ids, kind), len(ids), kind) == ids).all()
    assert binary_ids.to_planes(np.zeros(5, dtype="<u4")) == []


def test_counts_of_all_prefixes():
    library, table = Tokenizer.from_file(BYTE), token_counts.PrefixTable(BYTE)
    for text in ["", "a", "It's we'll 'tis  two  spaces\n\n\nand 123 marks!!! naïve ÷ 日本", "x <|endoftext|> y", "   ", "don't.Stop ,, now"]:
        assert table.counts(text).tolist() == [len(library.encode(text[: k + 1], add_special_tokens=False).ids) for k in range(len(text))], text


def test_token_counts(odd, none):
    library = Tokenizer.from_file(BYTE)
    for r in token_counts.count_tokens(odd, BYTE, limit=12).collect():
        texts = [x[1] or "" for x in ODD if x[0] == r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) in {(len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts}
        assert r["over_limit"] == (r["n_tokens"] > 12)
    with_table = token_counts.count_tokens(odd.where("doc_id = 9"), BYTE, with_table=True)
    assert with_table.select(token_counts.longest_prefix("prefix_counts", 3)).first()[0] > 0
    assert token_counts.count_tokens(none, BYTE).count() == 0


def test_language_held_out(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas())
    test = found[found.held_out & found.lang.notna()]
    assert len(test) > 100 and (test.lang_pred == test.lang).mean() > 0.97 and found.score.between(0, 1).all()
    judged = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    assert all(judged[i]["lang_pred"] == "und" and judged[i]["score"] == 0 for i in (3, 4, 5, 6, 10))
    assert judged[1]["lang_pred"] == judged[2]["lang_pred"] and judged[None] is not None
    assert language_id.identify(none).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_mixture(spark, odd, none):
    docs = spark.createDataFrame([(i, "word " * (5 + i % 7), "big" if i % 10 else ("small" if i % 20 else None)) for i in range(2_000)], "doc_id long, text string, source string")
    rows = mixing.light(docs, BYTE).cache()
    planned = {r["source"]: r for r in mixing.plan(rows, evenness=0.9, max_repeats=3.0).collect()}
    assert abs(sum(r["weight"] for r in planned.values()) - 1) < 1e-9 and max(r["repeats"] for r in planned.values()) <= 3 + 1e-6
    assert min(r["repeats"] for r in planned.values()) >= 1 - 1e-9
    mixed = mixing.realise(rows, mixing.plan(rows, evenness=0.9, max_repeats=3.0), cell_docs=50).toPandas()
    assert mixed.id.nunique() == 2_000 and mixed.position.between(0, 1).all()
    for source, part in mixed.groupby("source", dropna=False):
        part = part.sort_values("start")
        assert (part.start.to_numpy() == np.append(0, part.n_tokens.cumsum().to_numpy()[:-1])).all()  # gapless
        want = planned[None if pd.isna(source) else source]
        assert want["budget"] - 1e-6 <= part.n_tokens.sum() < want["budget"] + part.n_tokens.max()
    repeated = mixing.repeat_rows(docs, BYTE, evenness=0.9, max_repeats=3.0)
    assert repeated.columns == docs.columns
    assert Counter(r["doc_id"] for r in repeated.select("doc_id").collect()) == Counter(mixed.id)
    assert Counter(r["doc_id"] for r in mixing.repeat_rows(odd, BYTE).collect()).keys() == Counter(r[0] for r in ODD).keys()
    assert mixing.repeat_rows(none, BYTE).count() == 0 and mixing.repeat_rows(odd, BYTE).columns == odd.columns


def test_merkle(odd, none):
    base = "One line.\nTwo lines are here.\n\n" * 30
    edited = base.replace("Two", "Three", 1)
    a, b = merkle.fingerprint(base), merkle.fingerprint(edited)
    assert merkle.likeness(a, a) == 1 and 0.9 < merkle.likeness(a, b) < 1 and merkle.likeness(a, merkle.fingerprint("zzz")) == 0
    (low, high), *rest = merkle.edits(b, a)
    assert not rest and low <= edited.index("Three") < high
    order = sorted([r for r in ODD if r[0] is not None and r[0] not in (2, 7)], key=lambda r: -r[0])
    table = odd.where("doc_id IS NOT NULL AND doc_id NOT IN (2, 7)")
    found = {r["id"]: r for r in merkle.edit_probe(table).collect()}
    for k, r in enumerate(order):
        text, follower = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + follower[:half]
        got = found[r[0]]
        assert got["n_chars"] == len(text) and got["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert got["fingerprint"] == merkle.fingerprint(text) and got["near_next"] == merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(follower))
    assert merkle.edit_probe(odd).count() == len(ODD) and merkle.edit_probe(none).count() == 0
    assert merkle.edit_probe(odd.where("doc_id = 1")).first()["near_next"] == 1
    assert merkle.fingerprints(odd).count() == len(ODD)


def test_merkle_sees_the_kept_half_of_short_texts():
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 9))) for _ in range(400)]
    mark = merkle.fingerprint
    for size in (150, 300, 700, 3_000):
        for joiner in (" ", ", ", "", ". "):
            found = []
            for _ in range(20):
                a, b = (joiner.join(draw.choices(words, k=size))[:size] for _ in range(2))
                for share in (0.5, 0.8):
                    kept = int(size * share)
                    found.append(merkle.likeness(mark(a), mark(a[:kept] + b[kept:])) - share)
                assert merkle.likeness(mark(a), mark(a)) == 1 and "".join(merkle.leaves(a)) == a
            assert min(found) > -0.4 and abs(sum(found) / len(found)) < 0.15, (size, joiner, sum(found) / len(found), min(found))
    half = "漢字仮名交じり文" * 3 + "東京都千代田区永田町一丁目七番一号" * 3
    assert merkle.likeness(mark(half + "甲" * len(half)), mark(half + "乙" * len(half))) > 0.3


def test_shards(spark, odd, none, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = kd_shards.shard(docs, leaves=8).toPandas()
    sizes = found.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() / sizes.mean() < 1.02
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert (found.groupby("text_crc32").shard.nunique() == 1).all()
    few = kd_shards.shard(odd, leaves=8).toPandas()
    assert len(few) == len(ODD) and few["size"].sum() == sum(len((r[1] or "").encode()) + 1 for r in ODD)
    assert kd_shards.shard(none, leaves=8).count() == 0
    assert kd_shards.shard(docs, target_bytes=500_000).select("shard").distinct().count() >= 5
