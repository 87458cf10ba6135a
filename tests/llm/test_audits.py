"""Source divergence, collocations and SimHash against brute force, on odd rows and with small blocks."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import __spark_entry__
from lodestone.llm import collocations, divergence, simhash

SCHEMA = "doc_id long, text string, lang string, source string, rank int, n string, `a.b` int"
ODD = [None, "", " \t\n", ".,;", "x", "A b C", "\x00nul\x01 \x0b\x0c", "漢字 Ünïcode ÀB", "no-break space", "a" * 5_000, "..end.. of , pieces!\r\nnew\tline"]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of(n, seed=1, words=12):
    draw = random.Random(seed)
    pool = [f"W{chr(97 + i)}" for i in range(words)] + ["é", "漢"]
    texts = [" ".join(draw.choices(pool, weights=range(len(pool), 0, -1), k=draw.randint(0, 30))).replace("Wc", "Wc.", draw.randint(0, 2)) for _ in range(n)]
    texts += ODD + [texts[0]] * 5
    return [(None if i % 50 == 3 else i % (n - 2), t, draw.choice(["en", "en", "en", "fr", None]), draw.choice(["a", "b", "c", "é", None]), 1, "n", 2) for i, t in enumerate(texts)]


def plain_divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        in_docs = Counter(t for x, _, words in docs if x == lang for t in set(words))
        kept = {t for t, n in in_docs.items() if n >= least}
        counts = defaultdict(Counter)
        for x, source, words in docs:
            if x == lang:
                counts[source].update(w for w in words if w in kept)
        v, whole = len(kept), sum(counts.values(), Counter())
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v) for t in kept}
        apart = lambda x, y: (x - y) ** 2 // (x + y)
        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            pairs = sorted(((-sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((-apart(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out += [(lang, s, part, o, -x, k) for part, found in (("pair", pairs), ("term", terms)) for k, (x, o) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(2_048, 256), (3, 2)])
def test_divergence_equals_plain_version(spark, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "TERMS", blocks[0])
    monkeypatch.setattr(divergence, "GROUPS", blocks[1])
    monkeypatch.setattr(divergence, "HELD", 20)
    rows = rows_of(120) + [(7, "lonely words", "xx", s, 1, "n", 2) for s in ("p", "q")]
    found = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), least_docs=10, top=3).collect()
    assert sorted(map(tuple, found)) == plain_divergence(rows, 10, 3)
    assert [tuple(r)[2:] for r in found if r["lang"] == "xx"] == [("pair", "q", 0, 1), ("pair", "p", 0, 1)] or {r["value"] for r in found if r["lang"] == "xx"} == {0}


def test_shares_are_exact():
    draw = random.Random(2)
    for _ in range(300):
        total = draw.choice([0, 9, 10**6, 10**12, 8 * 10**15])
        count, kept = draw.randint(0, total), draw.randint(1, 10**6)
        assert divergence.share(np.array([count]), total, kept)[0] == 1 + 10**9 * (count + 2) // (total + 2 * kept)
    with pytest.raises(OverflowError):
        divergence.share(np.array([1]), 10**16, 1)


def test_long_texts_are_split_whole(monkeypatch):
    text = "Ab cd, ef.gh\nij kl " * 500
    whole_terms, whole_words = sum(divergence.terms(text.encode()), []), sum(collocations.split(text.encode()), [])
    monkeypatch.setattr(divergence, "AT_ONCE", 37)
    monkeypatch.setattr(collocations, "AT_ONCE", 37)
    assert sum(divergence.terms(text.encode()), []) == whole_terms and sum(collocations.split(text.encode()), []) == whole_words
    assert len(list(collocations.split(text.encode()))) > 50


def plain_collocations(rows, depth, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            f[lang or "und"].update(tuple(words[i : i + k]) for k in range(1, depth + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            value, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if not any(len(q) > len(p) and 100 * b >= 50 * a and inside(q) for q, b in candidates.items()):
                found.append((-value, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -value) for k, (value, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("depth,shard,step", [(3, 4_000_000, 2_048), (3, 60, 3), (4, 200, 7), (2, 100, 5)])
def test_collocations_equal_plain_version(spark, monkeypatch, depth, shard, step):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    monkeypatch.setattr(collocations, "STEP", step)
    monkeypatch.setattr(collocations, "RANGE_WORDS", 20)
    rows = rows_of(200, seed=depth)
    found = collocations.mine(spark.createDataFrame(rows, SCHEMA).repartition(4), max_words=depth, least=4, top=40)
    assert sorted(map(tuple, found.collect())) == plain_collocations(rows, depth, 4, 40)


def test_trie_slices_come_back():
    draw = np.random.default_rng(5)
    words = draw.integers(-1, 6, 400)
    names = [bytes([97 + i]) for i in range(6)]
    levels = collocations.trie(words, 6, 3)
    limits = [(b"b",), (b"b", b"c"), (b"b", b"c", b"d"), (b"bb", b"a"), (b"d", b"a", b"a"), (b"z",)]
    since, way, counts, ranges = [0] * 3, [False] * 3, Counter(), []
    for limit in [*limits, None]:
        to, ahead = collocations.cuts(levels, names, limit) if limit else ([len(w) for _, w, _ in levels], [False] * 3)
        slice_names, (one, two, three), own = collocations.merged([collocations.packed(names, levels, since, to, way)] * 2, 3)
        phrases = [[(slice_names[w],) for w in one[1]]]
        phrases.append([(*phrases[0][p], slice_names[w]) for p, w in zip(two[0], two[1], strict=True)])
        phrases.append([(*phrases[1][p], slice_names[w]) for p, w in zip(three[0], three[1], strict=True)])
        mine = [(p, n) for at, (level, mine) in enumerate(zip((one, two, three), own, strict=True)) for p, n, o in zip(phrases[at], level[2].tolist(), mine, strict=True) if o]
        ranges += [(p, limit) for p, _ in mine if limit and p >= limit]
        counts.update(dict(mine))
        since, way = to, ahead
    want = Counter(tuple(names[w] for w in words[i : i + k]) for k in (1, 2, 3) for i in range(401 - k) if (words[i : i + k] >= 0).all())
    assert counts == {p: 2 * n for p, n in want.items()} and not ranges


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """fps: fingerprints; the least place that each reaches."""
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = root(i), root(j)
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_fingerprints_equal_plain_ones(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, "one two three four", "One  TWO\tthree\x0bfour", "a b", "word " * 3_000])]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)))
    assert {r["doc_id"]: r["fingerprint"] for r in found.collect()} == {i: f"{plain_fingerprint(t):016x}" for i, t in rows}


@pytest.mark.parametrize("crowd", [500, 1])
def test_links_join_all_components(spark, monkeypatch, crowd):
    """Chains, dense balls and strangers; crowds meet through the points between them."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    draw = random.Random(crowd)
    centres = [draw.getrandbits(64) for _ in range(60)] + [0]
    fps = set(centres)
    for c in centres[:20]:
        for _ in range(12):
            c ^= sum(1 << draw.randrange(64) for _ in range(draw.choice([1, 2])))
            fps.add(c & (1 << 64) - 1)
        fps.update(centres[0] ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64) for _ in range(10))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2).collect()
    place = {f: i for i, f in enumerate(signed)}
    assert all((fps[place[r["a"]]] ^ fps[place[r["b"]]]).bit_count() <= 2 for r in edges)
    label = list(range(len(fps)))
    for _ in fps:
        for r in edges:
            a, b = place[r["a"]], place[r["b"]]
            label[a] = label[b] = min(label[a], label[b])
    assert label == plain_components(fps)


def test_thresholds_follow_the_estimates():
    assert simhash.allocated([[0, 5, 6], [0, 50, 60], [0, 1, 90]], 3) == (7, [1, -1, 0])
    assert simhash.allocated([[0, 1]], 3)[0] == float("inf")
    near = np.eye(64)
    near[3, 60] = near[60, 3] = 0.9
    parts = simhash.partitioned(near, 3)
    assert sorted(b for p in parts for b in p) == list(range(64)) and any({3, 60} <= set(p) for p in parts)


def test_registered_simhash(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows.sort(key=lambda r: r["doc_id"])
    fps = [plain_fingerprint(r["text"]) for r in rows]
    want = {(r["doc_id"], f"{f:016x}", rows[k]["doc_id"]) for r, f, k in zip(rows, fps, plain_components(fps), strict=True)}
    assert set(map(tuple, __spark_entry__.queries()["op13_simhash"](spark, sf).collect())) == want


def test_odd_ids_and_empty_tables(spark):
    rows = [(None, "same words here"), (4, "same words here"), (4, "same words here"), (2, None), (None, "   "), (None, "alone in all of this")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in found) == [(0, 0), (0, 2), (0, 4), (2, 2), (4, 4), (4, 4)]
    empty = spark.createDataFrame([], SCHEMA)
    assert not divergence.audit(empty).collect() and not collocations.mine(empty).collect() and not simhash.near_duplicates(empty).collect()


@pytest.mark.parametrize("name", ["op11_divergence", "op12_collocations"])
def test_registered_queries_equal_plain_versions(spark, sf, name):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain_divergence(rows, 10, 10) if name == "op11_divergence" else plain_collocations(rows, 3, 10, 2_000)
    assert sorted(map(tuple, __spark_entry__.queries()[name](spark, sf).collect())) == want


def test_decoding_joins_ids_with_pieces(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodestone.llm import bpe_codec

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    table = {i: p for r in bpe_codec.piece_table(spark, path, 16).collect() for i, p in zip(range(r["part"], 10**6, 16), r["pieces"])}
    assert len(table) == 50_257 and all(bytes(table[i]).decode("utf-8", "replace") == library.decode([i], skip_special_tokens=False) for i in (0, 17, 300, 50_255, 50_256))
    rows = [(1, library.encode("naïve 漢字 <|endoftext|>").ids), (2, []), (3, None), (4, [0, -5, 60_000, 1]), (None, [50_256])]
    found = {r["doc_id"]: r["text"] for r in bpe_codec.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), path).collect()}
    assert found == {1: "naïve 漢字 <|endoftext|>", 2: "", 3: "", 4: '!"', None: "<|endoftext|>"}
