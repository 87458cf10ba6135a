"""Operators against plain versions of their methods."""

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodestone.llm import kd_shards, merkle, nearest, url_filter

ORG_EN = [url_filter.rule("allow", "org/"), url_filter.rule("block", "com/")]


def plain_lexical(u, h, p):
    """The counted features of one URL, one character at a time."""
    segments = [x for x in p.split("/") if x]
    query = u.partition("#")[0].partition("?")[2]
    return [len(u), len(h), len(p), len(segments), sum(c.isdecimal() for c in u) / len(u) if u else 0.0, sum(bool(x) for x in query.split("&")), h.count(".") + bool(h), max(map(len, segments), default=0), u.count("-")]


def test_url_features(spark):
    urls = ["http://A.b-c.org/x//yy/?a=1&&b=2#c?d", "https://q.com", None, "", "none", "http://h/", "a://" + "x-9" * 5_000 + "/" + "é/" * 3_000, "http://h/", "http://h#f?a=1", "x?y#z?&w"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))})
    found = url_filter.lexical(rows).toPandas()
    for r in found.to_dict("records"):
        u = r["url"] or ""
        assert [r[c] for c in url_filter.COUNTED] == plain_lexical(u, r["host"], r["path"]), u
        labels = r["host"].rsplit(".", 2)
        assert (r["s1"], r["s2"]) == ("1" + labels[-1], "2" + ".".join(labels[-2:])) and r["s3"] == "3/" + (r["path"].split("/")[1] if "/" in r["path"] else "")
        n = len(raw := u.encode())
        assert math.isclose(url_filter.entropy(pd.Series([u]))[0], -sum(k / n * math.log2(k / n) for k in Counter(raw).values()) if n else 0.0, abs_tol=1e-9)
    assert url_filter.entropy(pd.Series(["", "aabb", ""])).tolist() == [0, 1, 0]


def test_url_model_on_held_out_urls(spark):
    """Rules label .org and .com; .net addresses of the two kinds are held out, and their kind shows in their shape only."""
    draw = np.random.default_rng(5)
    word = lambda: "".join(draw.choice(list("abcdefgh"), 5))
    good = lambda top: f"https://{word()}.{top}/{word()}/{word()}"
    bad = lambda top: f"http://{word()}{draw.integers(10**6)}-{word()}.{top}/{draw.integers(10**9)}/{draw.integers(10**9)}?id={draw.integers(10**6)}&s={draw.integers(10**6)}"
    rows = [(i, good("org") if i % 2 else bad("com")) for i in range(1_000)] + [(1_000 + i, good("net") if i % 2 else bad("net")) for i in range(300)]
    rows += [(2_000, "http://" + "9" * 100_000 + ".net/1"), (2_001, rows[1_000][1])]
    found = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), ORG_EN).collect()}
    held_out = [(found[1_000 + i]["verdict"] == "allow") == bool(i % 2) for i in range(300)]
    assert np.mean(held_out) > 0.95 and len(found) == len(rows)
    assert all((found[i]["block_score"] is None) == (i < 1_000) for i in found)
    assert found[2_001]["block_score"] == found[1_000]["block_score"]


def plain_tree(rows, goal, whole=None):
    """rows: size and dimensions; a list of leaves, each a set of row numbers."""
    scale = float(1 << 48)
    size, dims = rows[:, 1].astype(float), rows[:, 2:]

    def spread(d):
        x = dims[:, d] / scale
        mean = (x * size).sum() / size.sum()
        return max(0.0, (x * x * size).sum() / size.sum() - mean * mean) ** 0.5 if x.max() > x.min() else -1.0

    spreads = [spread(d) for d in range(dims.shape[1])]
    whole = whole or [max(x, 1e-12) for x in spreads]
    if goal < 2 or max(spreads) < 0:
        return [set(rows[:, 0].tolist())]
    total, aim, best = rows[:, 1].sum(), rows[:, 1].sum() * (goal // 2) / goal, None
    for d in sorted((k for k, x in enumerate(spreads) if x >= 0), key=lambda k: -spreads[k] / whole[k]):
        if best is None or best[0] > kd_shards.UNEVEN * total:
            values = np.unique(dims[:, d])
            upto = np.array([rows[dims[:, d] <= v, 1].sum() for v in values])[:-1]
            k = int(np.argmin(abs(upto - aim)))
            best = min(best or (np.inf, 0, 0), (abs(upto[k] - aim), d, values[k]), key=lambda x: x[0])
    _, d, cut = best
    low = dims[:, d] <= cut
    return plain_tree(rows[low], goal // 2, whole) + plain_tree(rows[~low], goal - goal // 2, whole)


def test_tree_equals_plain_recursion(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    meta = kd_shards.metadata(docs).toPandas()
    rows = np.column_stack([np.arange(len(meta)), meta["size"], *[meta[d] for d in kd_shards.DIMENSIONS]]).astype(np.int64)
    ids = meta["doc_id"].to_numpy()
    for leaves in (1, 5):
        want = [set(ids[sorted(x)].tolist()) for x in plain_tree(rows, leaves)]
        found = kd_shards.shard(docs, leaves=leaves).toPandas()
        assert [set(found[found.shard == k].doc_id.tolist()) for k in range(leaves)] == want


def test_tree_reaches_target_bytes(spark):
    docs = spark.createDataFrame([(i, ("word " * (i % 97) + str(i % 400))) for i in range(800)] + [(9_000 + i, "copies") for i in range(3_000)], "doc_id long, text string")
    found = kd_shards.shard(docs, target_bytes=8_000).toPandas()
    sizes = found.groupby("shard")["size"].sum()
    texts = found.groupby("shard")["text_crc32"].nunique()
    assert ((sizes <= 8_000) | (texts == 1)).all() and len(found) == 3_800
    assert sorted(sizes.index) == list(range(len(sizes)))
    assert kd_shards.shard(spark.createDataFrame([], docs.schema), target_bytes=10).count() == 0


def test_tree_uses_several_dimensions(spark):
    rows = kd_shards.metadata(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    tree = kd_shards.grow(rows, leaves=8)
    assert len({d for d in tree.dimension if d >= 0}) > 1


def test_nearest_passes_over_itself_only(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.9, 0.1]), (20, [1.0, 0.0]), (3, [0.5, 0.5]), (2, [0.5, 0.5])]
    found = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 20, k=9).toPandas()
    of = [g.sort_values("rank")[["vec_id", "score"]].to_numpy().tolist() for _, g in found.groupby(found.groupby("query_id").cumcount().eq(-1))]
    assert sorted(found["rank"].tolist()) == [1, 1, 2, 2, 3, 3, 4, 4] and len(of) == 1
    assert sorted(round(x, 9) for x in found[found["rank"] == 1]["score"]) == [0.9, 1.0]
    assert found.sort_values(["rank", "vec_id"])["vec_id"].tolist()[-4:] == [2, 2, 3, 3]


def test_nearest_recall_and_budget():
    draw = np.random.default_rng(2)
    v = draw.normal(size=(6_000, 64))
    v[3_000:] = v[:3_000] + 0.3 * draw.normal(size=(3_000, 64))  # each has a close neighbour
    index, ids = nearest.CollisionIndex(np.arange(6_000), v), np.arange(6_000)
    asked = ids[::60]
    found = list(index.search(v[asked], asked, 20))
    exact = v[asked] @ v.T
    exact[np.arange(len(asked)), asked] = -np.inf
    recall = np.mean([len(set(got.tolist()) & set(np.argsort(-e)[:20].tolist())) / 20 for (got, _, _), e in zip(found, exact, strict=True)])
    assert recall >= 0.9 and max(n for _, _, n in found) <= 0.15 * 6_000 + 1


def plain_likeness(a, b):
    """Twice the characters in common leaves (as a multiset) over those of both texts, without sections or digests."""
    if a == b:
        return 1.0
    one, two = Counter(merkle.leaves(a)), Counter(merkle.leaves(b))
    total = len(a) + len(b)
    return 2 * sum(len(x) * n for x, n in (one & two).items()) / total if total else 0.0


def test_edit_probe_equals_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "no id, first of all"), (None, "no id, and another one"), (None, None), (5, "taken id"), (10**12, "one line. " * 3)], "doc_id long, text string")
    for table in (docs, docs.unionByName(odd)):
        rows = sorted(((r[0], r[1] or "") for r in table.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
        want = Counter()
        for k, (id_, text) in enumerate(rows):
            follower = rows[(k + 1) % len(rows)][1]
            half = len(text) // 2
            edited = text[: len(text) - half] + follower[:half]
            want[id_, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(plain_likeness(text, edited), 6), round(plain_likeness(text, follower), 6)] += 1
        found = merkle.edit_probe(table).collect()
        assert Counter((r["id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 6), round(r["near_next"], 6)) for r in found) == want
        assert len({r["fingerprint"] for r in found}) == len({t for _, t in rows})


def test_ranges_split_idless_rows(spark):
    rows = [(None, f"text {i} " * 50) for i in range(400)] + [(i, "x") for i in range(50)]
    dealt = merkle.with_next(spark.createDataFrame(rows, "doc_id long, text string"), range_bytes=20_000)
    sizes = dealt.where("NOT halo").groupBy("range").count().toPandas()
    assert sizes["count"].sum() == 450 and sizes["count"].max() < 120


def test_codec_in_small_chunks(spark, monkeypatch):
    """Borders of chunks, rows longer than a chunk, and rows without words among them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodestone.llm import bpe_codec

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["", None, "one two one", "x" * 500, "  ", "naïve 漢字 <|endoftext|> one", "two\n\n", *[f"row {i % 7} of one" for i in range(300)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(bpe_codec, "CHUNK_BYTES", 60)
    chunks = bpe_codec._words(docs, path, ["doc_id"], "text")
    assert chunks.count() > 50 and chunks.select("chunk").distinct().count() == chunks.count()
    for r in chunks.collect():
        units = [u for x in r["lists"] if x for u in bpe_codec._unpacked(bytes(x)).column(0).to_pylist()]
        assert len(set(units)) == len(units)
    encoded = bpe_codec.encode(docs, path)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == want
    assert {r["doc_id"]: r["text"] for r in bpe_codec.decode(encoded, path).collect()} == {i: library.decode(x, skip_special_tokens=False) for i, x in want.items()}


def test_pipeline_keeps_one_row_of_each_group(spark):
    """Ids that repeat across groups, names that need quotes, and columns that can't be ordered."""
    import corpus_pipeline

    x, y = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    rows = [(3, y, {"a": 1}, "p"), (5, x, {"a": 2}, "q"), (5, y, {"a": 3}, "r"), (None, x + " more", {"a": 4}, "s"), (None, "alone", {"a": 5}, "t"), (None, "alone", {"a": 6}, "u")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, `a.b` string")
    found = corpus_pipeline.one_of_near_copies(spark, odd, "")
    assert found.columns == odd.columns
    kept = sorted((r["doc_id"] or 0, r["text"], r["m"]["a"]) for r in found.collect())
    assert [(i, t) for i, t, _ in kept] == sorted([(3, y), (5, x), (0, "alone")])
    plain = spark.createDataFrame(rows[:2], odd.schema)
    assert corpus_pipeline.one_of_near_copies(spark, plain, "").select("`a.b`").count() == 2


def test_forest_shortens_by_what_nodes_hold(spark):
    """A large family of near copies beside many pairs: every set keeps the target recall, crowded nodes get longer prefixes, and all links are found."""
    from lodestone.llm import ngram_join
    from tests.llm.test_text_operators import brute_groups, found_groups

    draw = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    family = [" ".join(w if draw.random() > 0.003 else f"z{draw.integers(10**6)}" for w in base) for _ in range(300)]
    pairs = [" ".join(f"p{k}x{i}" for i in range(80)) + more for k in range(40) for more in ("", " and one more")]
    texts = [*family, *pairs, *family[:30], "", None, "short"]
    rows = [(i, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    classes = ngram_join.sketches(table, "doc_id", "text", 5, 6).dropDuplicates(["digest"]).withColumn("rep", F.col("id"))
    classes = classes.cache()
    nodes = ngram_join.compared_nodes(classes, 0.8, 0.999, 6).toPandas()
    sizes = nodes.groupby("node")["rep"].nunique()
    assert (nodes.groupby("node")["in_node"].max() == sizes).all()
    crowded = classes.select(F.explode("nodes").alias("node")).groupBy("node").count().agg(F.max("count")).first()[0]
    assert crowded > max(ngram_join.LIGHT, sizes.max())  # the shortest prefixes' nodes were too full and split
    assert found_groups(ngram_join.join(table)) == brute_groups(rows)


def plain_profile(text, n=3, seed=7, dimensions=1_024):
    """The bundle of bound letters of a text, one n-gram at a time; None without letters."""
    import re

    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    if not letters.strip():
        return None
    runs = re.sub(" +", " ", letters)
    padded = " " + runs.removeprefix(" ") + " " * max(1, n - len(runs) - 1)
    own = lambda c: np.random.default_rng((seed, 0 if c == " " else ord(c))).integers(0, 2, dimensions, dtype=np.int8).astype(int) * 2 - 1
    total = np.zeros(dimensions)
    for k in range(len(padded) - n + 1):
        bound = np.ones(dimensions, dtype=int)
        for j, c in enumerate(padded[k : k + n]):
            bound = bound * np.roll(own(c), n - 1 - j)
        total += bound
    return total / max(np.linalg.norm(total), 1e-12)


def test_profiles_equal_plain_ones(spark):
    from lodestone.llm import language_id

    texts = ["Hello, world!", "çà et là", "a", "ab", "1 2 3", "", "Schöne   Grüße an alle 42 Leute. Tschüss", "word " * 50, "日本語 テキスト", "x1y"]
    found = dict(language_id.Encoder().encode(texts))
    for i, t in enumerate(texts):
        want = plain_profile(t)
        assert (want is None) == (i not in found), t
        if want is not None:
            assert np.allclose(found[i], want, atol=1e-5), t
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 400").limit(60)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    sums = {}
    for _, t, lang in rows:
        if lang is not None and (v := plain_profile(t or "")) is not None:
            sums[lang] = sums.get(lang, 0) + v
    languages, prototypes = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert languages == sorted(sums) and all(np.allclose(p, sums[x] / np.linalg.norm(sums[x]), atol=1e-5) for x, p in zip(languages, prototypes, strict=True))


def test_mixture_equals_plain_version(spark):
    """The exponent by small steps, budgets, and each source's stream of permuted epochs, one document at a time."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodestone.llm import mixing

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    draw = np.random.default_rng(8)
    texts = [" ".join(f"w{draw.integers(50)}" for _ in range(draw.integers(1, 30))) + ("漢字" * int(draw.integers(3))) for _ in range(300)]
    docs = [(i, t, "a" if i % 3 else "b" if i % 2 else "c") for i, t in enumerate(texts)]
    rows = mixing.light(spark.createDataFrame(docs, "doc_id long, text string, source string"), path).cache()
    n = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t, _ in docs}
    assert {r["id"]: r["n_tokens"] for r in rows.collect()} == n
    planned = mixing.plan(rows, evenness=0.9, max_repeats=2.5).cache()
    tokens = {s: sum(n[i] for i, _, x in docs if x == s) for s in "abc"}
    share = {s: t / sum(tokens.values()) for s, t in tokens.items()}

    def fits(a):
        p = {s: x**a for s, x in share.items()}
        w = {s: x / sum(p.values()) for s, x in p.items()}
        repeats = max(w[s] / share[s] for s in w) / min(w[s] / share[s] for s in w)
        return -sum(x * math.log(x) for x in w.values()) <= 0.9 * math.log(3) and repeats <= 2.5

    a = next(k / 20_000 for k in range(20_001) if fits(k / 20_000))
    weight = {s: x**a / sum(y**a for y in share.values()) for s, x in share.items()}
    got = {r["source"]: r for r in planned.collect()}
    assert all(abs(got[s]["weight"] - weight[s]) < 1e-3 for s in weight)
    keys = {(r["id"], e): r[f"k{e}"] for r in rows.select("id", *[mixing.key(F.lit(e), 0, "id").alias(f"k{e}") for e in range(4)]).collect() for e in range(4)}
    want = []
    for s in "abc":
        start = 0
        for e in range(math.ceil(got[s]["repeats"] - 1e-9)):
            for i in sorted((i for i, _, x in docs if x == s), key=lambda i, e=e: keys[i, e]):
                if start < got[s]["budget"] - 1e-6:
                    want.append((i, e, start))
                start += n[i]
    assert sorted((r["id"], r["epoch"], r["start"]) for r in mixing.realise(rows, planned, cell_docs=20).collect()) == sorted(want)
