"""The corpus operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.ngram_join import join

    return join(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import url_filter as u

    rules = [u.rule("allow", "org/"), u.rule("block", "example.org/es/"), u.rule("block", "example.org/en/1"), u.rule("allow", "com/fr/"), u.rule("block", "com/de/")]
    return u.judge(table(spark, sf_dir, "pages"), rules)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.bpe_codec import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.binary_ids import round_trip

    found = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return found.selectExpr("id AS doc_id", "start", "n_ids AS n_tokens", "ids_crc32")


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.kd_shards import shard

    found = shard(table(spark, sf_dir, "documents"), leaves=8)
    return found.selectExpr("doc_id", "size", "text_crc32", "'bytes' AS law", "shard", "slot", "CAST(NULL AS INT) AS grown_shard")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm import mixing
    from lodestone.llm.common import cut

    rows = cut(mixing.light(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
    found = mixing.realise(rows, cut(mixing.plan(rows)))
    return found.selectExpr("id AS doc_id", "source", "n_tokens", "weight", "epoch", "start", "position", "block")


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.merkle import edit_probe

    return edit_probe(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lodestone.llm.nearest import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.collocations import mine

    return mine(table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


#: Shares by group and term in parts of a billion, as whole numbers of 128 bits.
DIVERGENCE = r"""
WITH docs AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10),
cells AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
sources AS (SELECT d.lang, d.source, coalesce(c.n, 0) AS n, coalesce(l.v, 0) AS v, coalesce(l.n, 0) AS lang_n FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM cells GROUP BY lang, source) c ON c.lang = d.lang AND c.source = d.source LEFT JOIN langs l ON l.lang = d.lang),
shares AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.n + 2 * s.v) AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (k.n + 2)) // (s.lang_n + 2 * s.v) AS BIGINT) AS q FROM sources s JOIN kept k ON k.lang = s.lang LEFT JOIN cells c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

COLLOCATIONS = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs)),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM places, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cuts AS (SELECT c.lang, c.phrase, c.a, c.k, j, array_to_string(w[1:j], ' ') AS lefts, array_to_string(w[j + 1:], ' ') AS rights FROM candidates c, (SELECT unnest([1, 2]) AS j) WHERE j < c.k),
scored AS (SELECT c.lang, c.phrase, c.a, c.j, x.a AS l, y.a AS r, CAST((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lefts JOIN f y ON y.lang = c.lang AND y.phrase = c.rights),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
covers AS (SELECT lang, part, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM candidates WHERE k = 3) GROUP BY lang, part),
kept AS (SELECT b.* FROM best b LEFT JOIN covers c ON c.lang = b.lang AND c.part = b.phrase WHERE c.most IS NULL OR 100 * c.most < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, CAST(t.n AS BIGINT) AS n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op11_divergence": DIVERGENCE, "op12_collocations": COLLOCATIONS}
