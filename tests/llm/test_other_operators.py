"""URL filter, nearest neighbours, the pipeline and the registered queries."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from lodestone.llm import language_id, nearest, url_filter
from tests.llm.test_text_operators import ODD, SCHEMA, brute_groups

RULES = [url_filter.rule("allow", "org/"), url_filter.rule("block", "example.org/es/"), url_filter.rule("block", "com/de/")]


def test_rules(spark):
    urls = ["http://A.example.ORG/es/x", "https://example.org/En", "http://x.com/de/1?q=/fr/", "http://com/de/", "no scheme", None, "http://xorg/es/", "a://b://c.org/z#f", "http://host", ""]
    found = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)), RULES).collect()}
    assert [found[k]["rule"] for k in range(10)] == ["example.org/es/", "org/", "com/de/", "com/de/", None, None, None, None, None, None]
    assert [found[k]["verdict"] for k in range(4)] == ["block", "allow", "block", "block"]
    assert [(found[k]["host"], found[k]["path"]) for k in (0, 4, 5, 7, 8)] == [("a.example.org", "/es/x"), ("", ""), ("", ""), ("b:", "//c.org/z"), ("host", "")]
    assert all(r["verdict"] in ("allow", "block") for r in found.values())
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
    unlabelled = url_filter.judge(spark.createDataFrame([(1, "http://q.net/a")], "page_id long, url string"), RULES)
    assert unlabelled.first()["verdict"] == "allow"


def test_trees_learn():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(4_000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = url_filter.BoostedTrees().fit(x[:3_000], y[:3_000])
    assert ((model.probability(x[3_000:]) > 0.5) == y[3_000:]).mean() > 0.95


def brute_nearest(rows, asked, k):
    return {q: sorted(((-float(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v)))[:k] for q, v in rows if asked(q)}


def test_nearest_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=np.float64)) for r in table.collect()]
    want = brute_nearest(rows, lambda i: i % 20 == 0, 20)
    found = nearest.search(table, F.col("vec_id") % 20 == 0, block=700).toPandas()
    hits = sum(len({i for _, i in want[q]} & set(part.vec_id)) for q, part in found.groupby("query_id"))
    assert hits / (20 * len(want)) >= 0.9
    at = dict(rows)
    assert all(abs(np.dot(at[r.query_id], at[r.vec_id]) - r.score) < 1e-9 for r in found.itertuples())
    for _, part in found.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and part.score.is_monotonic_decreasing


def test_nearest_odd_vectors(spark):
    odd = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, []), (None, [1.0, 1.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0])]
    table = spark.createDataFrame(odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    found = nearest.search(table, F.col("vec_id") % 20 == 0, k=2).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in found} == {(20, 1, 2), (20, 2, 3)}
    assert nearest.search(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    first = corpus_pipeline.known_language(spark, docs, sf)
    assert first.columns == docs.columns
    assert {r["doc_id"] for r in first.collect()} == {i for i, t in rows if any(c.isalpha() for c in t or "")}
    second = corpus_pipeline.one_of_near_copies(spark, docs, sf)
    assert second.columns == docs.columns and sorted(r["doc_id"] for r in second.collect()) == sorted({c for _, c, _ in brute_groups(rows)})
    third = corpus_pipeline.mixed_sources(spark, docs, sf)
    assert third.columns == docs.columns and {r["doc_id"] for r in third.collect()} == {i for i, _ in rows}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = dict(rows)
    assert all(r["ids"] == library.encode(text[r["doc_id"]], add_special_tokens=False).ids for r in corpus_pipeline.token_ids(spark, docs, sf).collect())
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert kept == {c for _, c, _ in brute_groups([(r["doc_id"], r["text"]) for r in first.collect()])}


def test_language_stage_rejects_unlearnt_languages_and_noise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    draw = np.random.default_rng(5)
    alphabets = [[*"абвгдежзийклмнопрстуфхцчшщыьэюя    "], [*"αβγδεζηθικλμνξοπρστυφχψω    "], [chr(c) for c in range(0x4E00, 0x5E00)], [*"abcdefghijklmnopqrstuvwxyz    "]]
    bad = ["".join(draw.choice(letters, n)) for letters in alphabets for n in (100, 300, 1_000, 5_000) for _ in range(5)]
    added = spark.createDataFrame([(10_000_000 + k, t, None, "x", len(t)) for k, t in enumerate(bad)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs.unionByName(added), "").select("doc_id").collect()}
    assert not [k for k in range(len(bad)) if 10_000_000 + k in kept]
    clean = {r["doc_id"]: r["h"] for r in docs.where(F.col("text").rlike(r"\p{L}")).select("doc_id", language_id.held_out().alias("h")).collect()}
    assert sum(i in kept for i in clean) >= 0.99 * len(clean) and sum(i in kept for i, h in clean.items() if h) >= 0.98 * sum(clean.values())


def test_pipeline_stages_on_odd_rows(spark, sf):
    odd, none = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns and stage(spark, odd, sf).count() > 0, name
        assert stage(spark, none, sf).count() == 0, name
    kept = Counter(r["doc_id"] for r in corpus_pipeline.one_of_near_copies(spark, odd, sf).collect())
    assert kept[1] == 1 and kept[2] == 0 and kept[3] == 1 and kept[4] == 0 and kept[8] == 0 and kept[7] == 2 and kept[None] == 1
    assert corpus_pipeline.STAGES[-1][1](spark, none, sf).count() == 0


CONTRACTS = {
    "op1_ngram_join": ["doc_id", "class_id", "n_links"],
    "op2_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op3_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_nearest": ["query_id", "rank", "vec_id", "score"],
    "op6_mixing": ["doc_id", "weight"],
    "op7_merkle": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op8_binary_ids": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op9_bpe_codec": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op10_kd_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_registered_query(spark, sf, name):
    found = __spark_entry__.queries()[name](spark, sf)
    assert set(CONTRACTS[name]) <= set(found.columns)
    assert found.count() >= (200 if name not in ("op2_url_filter", "op5_nearest") else 50)


def test_held_out_is_crc32(spark, sf):
    for r in __spark_entry__.queries()["op4_language_id"](spark, sf).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
