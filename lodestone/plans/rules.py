"""Registered queries of the rule catalogue and of the life cycle, over the test tables as stand-ins, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.functions import markdown
from lodestone.functions import scalars as s
from lodestone.operators import catalogue, census, discovery, explain, folds, lifecycle, support, views
from lodestone.plans import rule_cases as cases
from lodestone.plans.tables import QUERIES, SQL, t


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _expected(rows: list[tuple[str, str]]) -> str:
    values = ", ".join(f"({i}, '{rule}', '{outcome}')" for i, (rule, outcome) in enumerate(rows))
    return f"SELECT c_custkey, rule, outcome FROM customer JOIN (VALUES {values}) v(case_no, rule, outcome) ON c_custkey % {len(rows)} = case_no"


def _keys(spark, d, n: int):
    """Each customer's key and the number of its case, dealt to all tasks: a table of keys is one small file, and judging a row is long work."""
    keys = t(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % n).cast("int").alias("at"))
    return keys.repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")


def _facts(spark, d, given: list[tuple[str, dict]]):
    """Each customer with the facts of one case."""
    lines = [(i, rule, json.dumps({"nwo": "me/name", "owner": "me", "name": "name"} | facts)) for i, (rule, facts) in enumerate(given)]
    facts = spark.createDataFrame(lines, "at int, rule string, line string").select("at", "rule", F.from_json("line", catalogue.FACTS).alias("f")).select("at", "rule", "f.*")
    return _keys(spark, d, len(lines)).join(F.broadcast(facts), "at")  # a hundred rows


def _judged(spark, d, given):
    return catalogue.scored(_facts(spark, d, given), F.lit(cases.NOW), allow=["big"], deny=["denied"])


_SAID = {"1": "hit", "0": "miss", "u": "unknown", "n": "na"}


@query(_expected([(rule, _SAID[x]) for rule, _, x in cases.CASES]))
def rule_signals(spark, d):
    """Every signal of the catalogue: hit, miss, unknown or not applicable."""
    own = F.get(F.filter("signals", lambda x: x["id"] == F.col("rule")), F.lit(0))
    said = F.when(own["status"] == "ok", F.when(own["hit"], "hit").otherwise("miss")).otherwise(own["status"])
    return _judged(spark, d, [(r, f) for r, f, _ in cases.CASES]).select("c_custkey", "rule", said.alias("outcome"))


@query(_expected([(rule, "closed" if x else "open") for rule, _, x in cases.GATE_CASES]))
def rule_gates(spark, d):
    return _judged(spark, d, [(r, f) for r, f, _ in cases.GATE_CASES]).select("c_custkey", "rule", F.when(F.array_contains("gates", F.col("rule")), "closed").otherwise("open").alias("outcome"))


@query(_expected([(rule, "unknown" if x is None else f"{x:.2f}") for rule, _, x in cases.ITEM_CASES]))
def rule_confidence(spark, d):
    own = F.get(F.filter("items", lambda x: x["id"] == F.col("rule")), F.lit(0))
    return _judged(spark, d, [(r, f) for r, f, _ in cases.ITEM_CASES]).select("c_custkey", "rule", F.when(own["status"] == "ok", F.format_string("%.2f", own["strength"])).otherwise("unknown").alias("outcome"))


@query(_expected([(rule, "yes" if x else "no") for rule, _, x in cases.REMARKS]))
def rule_descriptors(spark, d):
    return _judged(spark, d, [(r, f) for r, f, _ in cases.REMARKS]).select("c_custkey", "rule", F.when(F.array_contains("descriptors", F.col("rule")), "yes").otherwise("no").alias("outcome"))


def _score_cases(spark, d):
    """Each customer with the facts, verdict and whereabouts of one case, judged."""
    verdict = "struct<status:string,category:string,categoryConfidence:double,scores:array<double>,claims:array<struct<supports:string>>,flags:array<string>,injectionSeen:boolean>"
    lines = [(i, json.dumps({"nwo": "me/name", "owner": "me", "name": "name"} | facts)) for i, (facts, _) in enumerate(cases.SCORE_CASES)]
    facts = spark.createDataFrame(lines, "at int, line string").select("at", F.from_json("line", f"{catalogue.FACTS}, verdict {verdict}, gone boolean").alias("f")).select("at", "f.*")
    return catalogue.scored(_keys(spark, d, len(lines)).join(F.broadcast(facts), "at"), F.lit(cases.NOW), verdict=F.col("verdict"), gone=F.col("gone"), allow=["big"])  # a dozen rows


def _outcome(*columns):
    """Numbers and words in a row of text, numbers without zeros at their ends."""
    shown = lambda c: F.regexp_replace(F.regexp_replace(F.format_string("%.9f", F.col(c).cast("double")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.concat_ws(" ", *[F.col(c) if c in ("band", "lane") else shown(c) for c in columns])


def _by_case(outcomes: list[str]) -> str:
    values = ", ".join(f"({i}, '{x}')" for i, x in enumerate(outcomes))
    return f"SELECT c_custkey, outcome FROM customer JOIN (VALUES {values}) v(case_no, outcome) ON c_custkey % {len(outcomes)} = case_no"


def _trimmed(outcome: str) -> str:
    return " ".join(x.rstrip("0").rstrip(".") if "." in x else x for x in outcome.split())


@query(_by_case([_trimmed(x) for _, x in cases.SCORE_CASES]))
def rule_scores(spark, d):
    """What the rules add up to: points, the most points, coverage, confidence, attention, rank, band and lane."""
    return _score_cases(spark, d).select("c_custkey", _outcome("points", "points_max", "coverage", "k", "attention", "gem", "band", "lane").alias("outcome"))


@query(_by_case([_trimmed(x) for x in cases.RESCORED]))
def rule_rescored(spark, d):
    """Stored scores under the weights of a table of settings."""
    weights = catalogue.weights_of(spark.createDataFrame(cases.SETTINGS, "section string, key string, field string, value string"))
    found = catalogue.rescored(_score_cases(spark, d), weights, F.col("verdict"), F.col("gone"))
    return found.select("c_custkey", _outcome("points", "points_max", "gem", "band", "lane").alias("outcome"))


@query("""SELECT doc_id, (octet_length(encode(text)) >= 1000)::INT::DOUBLE AS points, 12.0::DOUBLE AS points_max, 0.181818182::DOUBLE AS coverage, 'low' AS lane FROM documents WHERE text IS NOT NULL""")
def judged_readmes(spark, d):
    """The whole catalogue over documents as READMEs of repositories of which nothing else is known."""
    kinds = spark.createDataFrame([], catalogue.FACTS).schema
    readme = F.struct(F.lit("README.md").alias("name"), F.octet_length("text").cast("long").alias("bytes"), F.col("text"), F.lit(None).cast("long").alias("fenceLines"))
    known = {"readme": readme, "name": F.concat(F.lit("doc"), "doc_id"), "owner": F.col("source"), "nwo": F.concat("source", F.lit("/doc"), "doc_id")}
    facts = t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])
    return catalogue.scored(facts, F.lit(cases.NOW)).select("doc_id", "points", "points_max", "coverage", "lane")


_SEEDS = """s AS (SELECT o_orderkey, o_custkey, c_acctbal, o_orderdate::TIMESTAMP AS made, o_orderkey % 40 AS stars, o_orderkey % 1000 AS kb, o_orderkey % 29 = 0 AS fork, o_custkey % 7 AS queued,
CASE o_orderkey % 9 WHEN 0 THEN 'nvim' WHEN 1 THEN 'o' || o_custkey WHEN 2 THEN 'x.github.io' WHEN 3 THEN 'my-keygen' ELSE 'tool' END AS name, CASE WHEN o_orderkey % 19 = 0 THEN 'slots and judi' WHEN o_orderkey % 3 = 0 THEN 'a tool' END AS about, CASE WHEN o_orderkey % 4 <> 0 THEN 'Go' END AS lang, CASE WHEN o_orderkey % 5 <> 0 THEN 'MIT' END AS licence FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _seeds(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    name = F.when(k % 9 == 0, "nvim").when(k % 9 == 1, F.concat(F.lit("o"), "o_custkey")).when(k % 9 == 2, "x.github.io").when(k % 9 == 3, "my-keygen").otherwise("tool")
    return o.select(
        "o_orderkey", F.concat(F.lit("o"), "o_custkey", F.lit("/"), name).alias("nwo"), F.when(k % 19 == 0, "slots and judi").when(k % 3 == 0, "a tool").alias("description"), (k % 40).alias("stars"), (k % 1000).alias("diskKB"), F.when(k % 4 != 0, "Go").alias("lang"),
        F.when(k % 5 != 0, "MIT").alias("licence"), F.col("o_orderdate").cast("timestamp").cast("string").alias("createdAt"), (k % 29 == 0).alias("isFork"), F.lit(False).alias("isArchived"), F.lit(False).alias("isTemplate"), F.lit(None).cast("boolean").alias("isMirror"),
        F.when(F.col("c_acctbal") < -500, F.array(F.lit("farm"))).alias("flags"), (F.col("o_custkey") % 7).alias("queued"), F.lit(None).cast("boolean").alias("hasDesc"), F.when(k % 6 == 0, "archive:2026:Release").otherwise("census").alias("source"), F.lit(None).cast("array<string>").alias("sources"),
    )


@query(f"""WITH {_SEEDS} SELECT o_orderkey, CASE WHEN fork OR stars > 25 OR kb < 200 OR name IN ('nvim', 'x.github.io') OR name = 'o' || o_custkey THEN 'dropped' WHEN name = 'my-keygen' THEN 'quarantined' WHEN about = 'slots and judi' OR c_acctbal < -500 THEN 'dropped' WHEN lang IS NULL AND made + INTERVAL 7 DAY > TIMESTAMP '1998-07-15' THEN 'deferred' WHEN lang IS NULL OR queued >= 5 THEN 'dropped' ELSE 'queued' END AS state,
CASE WHEN fork THEN 'excluded-kind' WHEN stars > 25 THEN 'attention' WHEN kb < 200 THEN 'too-small' WHEN name IN ('nvim', 'x.github.io') OR name = 'o' || o_custkey THEN 'profile-or-site' WHEN name = 'my-keygen' THEN 'lure-name' WHEN about = 'slots and judi' THEN 'spam-words' WHEN c_acctbal < -500 THEN 'farm-owner' WHEN lang IS NULL AND made + INTERVAL 7 DAY > TIMESTAMP '1998-07-15' THEN 'no-language-yet' WHEN lang IS NULL THEN 'no-language' WHEN queued >= 5 THEN 'owner-cap' END AS reason,
(licence IS NOT NULL)::INT + (about IS NOT NULL)::INT + (lang IS NOT NULL)::INT + (o_orderkey % 6 = 0)::INT AS prior FROM s""")
def rule_prefilter(spark, d):
    """The prefilter's rules in order, with the prior."""
    judged = _seeds(spark, d).withColumn("p", catalogue.prefilter(F.lit("1998-07-15T00:00:00Z"), F.col("flags"), F.col("queued")))
    return judged.select("o_orderkey", "p.state", "p.reason", catalogue.prior().alias("prior"))


_BASE = "o_orderkey % 29 <> 0 AND o_orderkey % 40 <= 25 AND o_orderkey % 1000 >= 200"


@query(f"SELECT o_orderkey FROM orders WHERE {_BASE}")
def base_filter(spark, d):
    seeds = _seeds(spark, d)
    return seeds.where(~F.col("isFork") & (F.col("stars") <= 25) & (F.col("diskKB") >= 200)).select("o_orderkey")


@query("""WITH s AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'deferred' WHEN 1 THEN 'queued' WHEN 2 THEN 'enriched' WHEN 3 THEN 'dropped' WHEN 4 THEN 'gone' ELSE 'quarantined' END AS state, CASE WHEN c_custkey % 6 = 3 THEN CASE WHEN c_custkey % 4 = 1 THEN 'owner-cap' ELSE 'g.spam.words' END END AS reason, c_custkey % 5 AS prior, c_nationkey % 5 AS pre_prior, c_acctbal > 0 AS pushed, c_custkey % 10 AS looked FROM customer)
SELECT c_custkey, CASE WHEN state IN ('deferred', 'gone') OR reason = 'owner-cap' THEN 'queued' WHEN state = 'enriched' AND pushed AND looked >= 7 THEN 'queued' ELSE state END AS state, CASE WHEN state IN ('deferred', 'gone') OR reason = 'owner-cap' THEN NULL WHEN state = 'enriched' AND pushed AND looked >= 7 THEN 'pushed' ELSE reason END AS reason,
(CASE WHEN state IN ('deferred', 'gone') OR reason = 'owner-cap' THEN pre_prior WHEN state = 'queued' THEN greatest(prior, pre_prior) WHEN state = 'enriched' AND pushed AND looked >= 7 THEN pre_prior + 2 ELSE prior END)::INT AS prior, state IN ('deferred', 'gone') OR coalesce(reason = 'owner-cap', false) OR (state = 'enriched' AND pushed AND looked >= 7) AS reopened FROM s""")
def merge_seed(spark, d):
    """What becomes of a known candidate that is seen again."""
    k = F.col("c_custkey")
    state = F.element_at(F.array(*map(F.lit, ("deferred", "queued", "enriched", "dropped", "gone", "quarantined"))), (k % 6 + 1).cast("int"))
    now = F.lit("2024-02-01").cast("timestamp")
    rows = t(spark, d, "customer").select(
        k, state.alias("state"), F.when(k % 6 == 3, F.when(k % 4 == 1, "owner-cap").otherwise("g.spam.words")).alias("reason"), (k % 5).alias("prior"), (F.col("c_nationkey") % 5).alias("pre_prior"), F.lit("queued").alias("pre_state"), F.lit(None).cast("string").alias("pre_reason"), F.lit(None).cast("timestamp").alias("pre_next_at"),
        F.lit("2024-01-05").cast("timestamp").alias("pushed_at"), F.when(F.col("c_acctbal") > 0, F.lit("2024-01-20").cast("timestamp")).alias("seed_pushed_at"), (now - F.make_dt_interval(days=(k % 10).cast("int"))).alias("looked_at"),
    )
    return rows.withColumn("m", lifecycle.merged_seed(now)).select("c_custkey", "m.state", "m.reason", "m.prior", "m.reopened")


_ACTIONS = "CASE c_custkey % 4 WHEN 0 THEN ['g.injection'] WHEN 1 THEN ['g.lure.name', 'g.spam.words'] WHEN 2 THEN ['g.lure.link', 'g.injection'] ELSE []::VARCHAR[] END"


def _gated(spark, d):
    k = F.col("c_custkey")
    gates = F.when(k % 4 == 0, F.array(F.lit("g.injection"))).when(k % 4 == 1, F.array(F.lit("g.lure.name"), F.lit("g.spam.words"))).when(k % 4 == 2, F.array(F.lit("g.lure.link"), F.lit("g.injection"))).otherwise(F.array().cast("array<string>"))
    known = F.create_map(*[F.lit(x) for kv in catalogue.GATES.items() for x in kv])
    return t(spark, d, "customer").withColumn("gates", gates).withColumn("actions", F.transform("gates", lambda g: F.element_at(known, g)))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'dropped' WHEN 2 THEN 'quarantined' ELSE 'enriched' END AS state, CASE c_custkey % 4 WHEN 1 THEN 'g.spam.words' WHEN 2 THEN 'g.lure.link' END AS reason FROM customer")
def settle(spark, d):
    return _gated(spark, d).select("c_custkey", lifecycle.settled_state(F.col("gates"), F.col("actions")).alias("s")).select("c_custkey", "s.*")


@query("SELECT c_custkey, c_custkey % 4 <> 1 AND (c_custkey % 10 = 0 OR c_custkey % 9 = 0 OR c_custkey % 8 = 0 OR c_acctbal >= 0) AS kept FROM customer")
def keep_rule(spark, d):
    k = F.col("c_custkey")
    lane, sources = F.when(F.col("c_acctbal") < 0, "low").otherwise("look"), F.array(F.lit("census"), F.when(k % 8 == 0, "add").otherwise("archive"))
    return _gated(spark, d).select("c_custkey", lifecycle.kept(F.col("actions"), lane, k % 10 == 0, k % 9 == 0, sources).alias("kept"))


@query("SELECT c_custkey, c_acctbal < -900 OR c_custkey % 4 IN (1, 2) OR c_nationkey = 3 OR c_custkey % 11 = 0 AS quarantined FROM customer")
def ever_quarantined(spark, d):
    c, n, k = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_custkey")
    found = lifecycle.ever_quarantined(F.when(c < -900, "quarantine"), F.col("actions"), F.array(F.lit("look"), F.when(n == 3, "quarantine").otherwise("low")), F.when(k % 11 == 0, "quarantined"))
    return _gated(spark, d).select("c_custkey", found.alias("quarantined"))


@query("""WITH w AS (SELECT DISTINCT lower(trim(CASE n_nationkey % 3 WHEN 0 THEN ' ' || (n_nationkey * 7)::VARCHAR WHEN 1 THEN 'Owner' || n_nationkey ELSE 'OWNER' || (n_nationkey * 10) || '/Name' || (n_nationkey * 10) END)) AS x FROM nation)
SELECT c_custkey, EXISTS (SELECT 1 FROM w WHERE x IN (c_custkey::VARCHAR, 'owner' || (c_custkey % 1000), 'owner' || (c_custkey % 1000) || '/name' || c_custkey)) AS opted_out FROM customer""")
def opt_out(spark, d):
    n = F.col("n_nationkey")
    wishes = t(spark, d, "nation").select(F.when(n % 3 == 0, F.concat(F.lit(" "), (n * 7).cast("string"))).when(n % 3 == 1, F.concat(F.lit("Owner"), n)).otherwise(F.concat(F.lit("OWNER"), n * 10, F.lit("/Name"), n * 10)).alias("value"))
    rows = t(spark, d, "customer").select("c_custkey", F.concat(F.lit("Owner"), F.col("c_custkey") % 1000, F.lit("/name"), "c_custkey").alias("nwo"))
    return lifecycle.opted_out(rows, wishes, "c_custkey", "nwo").select("c_custkey", "opted_out")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 'not published' WHEN c_custkey % 6 = 0 THEN 'no longer saved as a gem' WHEN c_custkey % 10 = 0 THEN 'no stored record' WHEN c_custkey % 14 = 0 THEN 'not a valid owner/name' WHEN c_nationkey = 1 THEN 'opted out' WHEN c_nationkey < 7 THEN 'younger than 7 days' WHEN c_acctbal < 0 THEN 'was quarantined' WHEN c_mktsegment = 'MACHINERY' THEN 'its review asked not to promote it' END AS skip_reason FROM customer""")
def eligible_picks(spark, d):
    """All rules of what is shown of the published picks."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    name = F.when(k % 14 == 0, "no name").otherwise("a-b/c.d")
    why = lifecycle.skip_reason(k % 2 == 0, F.when(k % 6 != 0, "gem"), k % 10 != 0, name, n == 1, n, F.col("c_acctbal") < 0, F.col("c_mktsegment") == "MACHINERY")
    return t(spark, d, "customer").select("c_custkey", why.alias("skip_reason"))


@query("""SELECT c_custkey, list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'c_acctbal=' || c_nationkey END, CASE WHEN c_custkey % 3 = 0 THEN 'c_mktsegment=null' END], lambda x: x IS NOT NULL) AS patch FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def minimal_patch(spark, d):
    """Only the fields that differ."""
    stored = t(spark, d, "customer").select("c_custkey", F.lit(-1).cast("int").alias("c_acctbal"), F.lit("x").alias("c_mktsegment"))
    k = F.col("c_custkey")
    new = t(spark, d, "customer").select("c_custkey", F.when(k % 2 == 0, F.col("c_nationkey").cast("int")).otherwise(-1).alias("c_acctbal"), F.when(k % 3 != 0, "x").alias("c_mktsegment"))
    patches = lifecycle.minimal_patches(stored, new, "c_custkey", ["c_acctbal", "c_mktsegment"])
    return patches.select("c_custkey", F.transform(F.map_entries("patch"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))).alias("patch"))


@query("SELECT event_id, CASE WHEN event_type = 'view' AND (user_id % 3)::VARCHAR <> '1' THEN 'planned' WHEN event_type = 'view' THEN 'running' ELSE event_type END AS state FROM events")
def orphan_recovery(spark, d):
    units = t(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "running").otherwise(F.col("event_type")).alias("state"), (F.col("user_id") % 3).cast("string").alias("run"))
    return lifecycle.recovered(units, "state", "run", F.lit("1")).select("event_id", "state")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY event_id DESC) AS n FROM events) WHERE date_trunc('month', ts) >= TIMESTAMP '2024-02-01' OR n = 1")
def ledger_collapse(spark, d):
    return lifecycle.collapsed(t(spark, d, "events"), "user_id", "ts", ["event_id"], F.lit("2024-02-01").cast("timestamp")).select("event_id", "user_id")


@query("SELECT user_id, arg_min(event_type, event_id) AS first_type, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id")
def first_last_seen(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("""SELECT user_id, head, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'HEAD' ELSE 'h' || event_id % 2 END AS head FROM events) GROUP BY user_id, head""")
def verdict_latest(spark, d):
    """The latest row of a composite key; a missing head is HEAD."""
    k = F.col("event_id")
    v = t(spark, d, "events").select("user_id", F.when(k % 3 != 0, F.concat(F.lit("h"), k % 2)).alias("head"), "event_type", "event_id")
    return lifecycle.latest_verdict(v, ["user_id", "head"], "head", ["event_id"]).select("user_id", "head", "event_type", "event_id")


@query("""SELECT p_partkey FROM part WHERE p_size % 5 < 4 AND p_partkey % 7 <> 0 AND (p_partkey % 3 <> 0 OR p_partkey % 2 = 0) ORDER BY p_retailprice DESC, p_size, p_partkey LIMIT 40""")
def deep_selection(spark, d):
    """Rows of the lanes worth it that weren't looked at in depth at their head, best first."""
    k, lanes = F.col("p_partkey"), F.array(*map(F.lit, [*lifecycle.DEEP_LANES, "low"]))
    lane = F.element_at(lanes, (F.col("p_size") % 5 + 1).cast("int"))
    rows = t(spark, d, "part").withColumns({"lane": lane, "head": F.when(k % 7 != 0, "h"), "stages": F.when(k % 3 == 0, F.array(F.lit("deep"))), "deep_head": F.when(k % 2 == 0, "old").otherwise("h")})
    return rows.where(F.col("lane").isin(lifecycle.DEEP_LANES) & lifecycle.needs_deep(F.col("head"), F.col("stages"), F.col("deep_head"))).orderBy(F.desc("p_retailprice"), "p_size", "p_partkey").limit(40).select("p_partkey")


@query("""WITH v AS (SELECT doc_id, repeat('ab', 60 + doc_id % 30) AS pitch, [doc_id % 7 - 1.5, 2.4, 9.0] AS scores, doc_id % 13 / 10.0 AS confidence, range(doc_id % 20) AS claims FROM documents)
SELECT doc_id, length(CASE WHEN length(pitch) > 140 THEN pitch[:139] || '…' ELSE pitch END) AS pitch, array_to_string(list_transform(scores, lambda x: least(greatest(floor(x + 0.5), 1), 4)::INT), ',') AS scores, least(greatest(confidence, 0.0), 1.0)::DOUBLE AS confidence, least(len(claims), 12) AS claims, greatest(len(claims) - 12, 0) AS extra FROM v""")
def verdict_bounds(spark, d):
    k = F.col("doc_id")
    claims = F.transform(F.slice(F.sequence(F.lit(0), k % 20), 1, (k % 20).cast("int")), lambda x: F.struct(x.cast("string").alias("text"), x.cast("string").alias("quote")))
    v = F.struct(F.expr("repeat('ab', cast(60 + doc_id % 30 as int))").alias("pitch"), F.lit("a").alias("audience"), F.lit("b").alias("summary"), F.array((k % 7 - 1.5).cast("double"), F.lit(2.4).cast("double"), F.lit(9.0)).alias("scores"), (k % 13 / 10.0).alias("confidence"), F.array(F.lit("x"), F.lit("x")).alias("flags"), claims.alias("claims"))
    out = t(spark, d, "documents").select("doc_id", lifecycle.bounded_verdict(v).alias("b"))
    return out.select("doc_id", F.char_length("b.pitch").alias("pitch"), F.array_join("b.scores", ",").alias("scores"), "b.confidence", F.size("b.claims").alias("claims"), "b.extra")


@query("SELECT event_id FROM (SELECT event_id, sum(round_even(value, 2)::DECIMAL(18, 2)) OVER (PARTITION BY user_id ORDER BY event_id) AS spent FROM events) WHERE spent <= 100")
def review_budget(spark, d):
    e = t(spark, d, "events").withColumn("cost", F.bround("value", 2).cast("decimal(18,2)"))
    return lifecycle.within_budget(e, ["user_id"], [F.col("event_id")], "cost", 100).select("event_id")


@query("""WITH p AS (SELECT user_id, min(ts) AS published FROM events WHERE event_type = 'signup' GROUP BY user_id) SELECT p.user_id, published, count(e.ts) AS releases FROM p LEFT JOIN events e ON e.user_id = p.user_id AND e.event_type = 'purchase' AND e.ts > published GROUP BY ALL""")
def releases_since(spark, d):
    e = t(spark, d, "events")
    picks = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("published"))
    return lifecycle.releases_since(picks, e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("released")), "user_id", "published", "released")


@query("""WITH n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'new' || c_custkey ELSE upper(c_name) END AS nwo FROM customer), r AS (SELECT c_custkey AS id, lower(c_name) AS nwo FROM customer WHERE c_custkey % 5 <> 0)
SELECT n.id, coalesce(a.id, b.id) AS known, a.id IS NULL AND b.id IS NOT NULL AS renamed FROM n LEFT JOIN r a ON lower(n.nwo) = a.nwo LEFT JOIN r b ON n.id = b.id""")
def name_then_id(spark, d):
    k = F.col("c_custkey")
    nodes = t(spark, d, "customer").select(k.alias("id"), F.when(k % 4 == 0, F.concat(F.lit("new"), k)).otherwise(F.upper("c_name")).alias("nwo"))
    records = t(spark, d, "customer").where(k % 5 != 0).select(k.alias("id"), F.col("c_name").alias("nwo"))
    return lifecycle.by_name_or_id(nodes, records, "nwo", "id").select("id", "known", "renamed")


@query("""SELECT c_custkey, list_filter([CASE WHEN c_nationkey % 3 = 0 THEN 'lane' END, CASE WHEN c_acctbal < 500 THEN 'too few points' END, CASE WHEN c_custkey % 4 <> 3 THEN 'gated' END, CASE WHEN c_custkey % 2 = 0 AND c_nationkey % 3 <> 1 THEN 'not quarantined' END], lambda x: x IS NOT NULL) AS problems FROM customer""")
def named_expectations(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    lane = F.element_at(F.array(F.lit("low"), F.lit("quarantine"), F.lit("look")), (n % 3 + 1).cast("int"))
    no = F.lit(None).cast("array<string>")
    expect = F.struct(F.array(F.lit("look"), F.lit("quarantine")).alias("lanes"), no.alias("not_lanes"), no.alias("bands"), F.lit(500.0).alias("min_points"), F.lit(None).cast("double").alias("max_points"), F.array().cast("array<string>").alias("gates"), F.when(k % 2 == 0, "quarantined").alias("outcome"))
    rows = _gated(spark, d).withColumn("e", expect)
    return rows.select("c_custkey", lifecycle.expectation_problems(lane, F.lit("gem"), F.col("c_acctbal"), F.col("gates"), F.col("actions"), F.col("e")).alias("problems"))


@query("SELECT user_id, k, date_trunc('hour', last_at - INTERVAL 75 MINUTE) - to_hours(k) AS hour FROM (SELECT user_id, max(ts) AS last_at FROM events GROUP BY user_id), (SELECT unnest(generate_series(0, 23)) AS k)")
def complete_hours(spark, d):
    """The newest whole hours before each user's last event."""
    last = t(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("at"))
    return last.select("user_id", F.posexplode(census.complete_hours(F.col("at"), 24)).alias("k", "hour")).withColumn("k", F.col("k").cast("long"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') || '-' || extract(hour FROM ts) AS name FROM events")
def hour_names(spark, d):
    return t(spark, d, "events").select("event_id", census.hour_name(F.col("ts")).alias("name"))


@query("SELECT user_id, k, (last_at::DATE - 3 - k::INT)::VARCHAR AS day FROM (SELECT user_id, max(ts) AS last_at FROM events GROUP BY user_id), (SELECT unnest(generate_series(0, 5)) AS k)")
def census_days(spark, d):
    """The days to look at again, from three days before each user's last event on."""
    last = t(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("at"))
    days = last.select("user_id", F.posexplode(census.planned_days(F.to_date("at"), 3, 5)).alias("k", "day"))
    return days.select("user_id", F.col("k").cast("long").alias("k"), F.col("day").cast("string").alias("day"))


@query("SELECT n_nationkey, k, (DATE '2024-01-31')::TIMESTAMP + to_hours(((CASE WHEN n_nationkey <= 23 THEN n_nationkey ELSE 0 END + k) % 24)::INT) AS hour FROM nation, (SELECT unnest(generate_series(0, 23)) AS k)")
def rotated_hours(spark, d):
    hours = census.rotated_hours(F.lit("2024-01-31").cast("date"), F.col("n_nationkey"))
    return t(spark, d, "nation").select("n_nationkey", F.posexplode(hours).alias("k", "hour")).select("n_nationkey", F.col("k").cast("long").alias("k"), "hour")


@query("""SELECT o_orderkey, o_orderkey + i * w // n AS low, (i + 1) * w // n - i * w // n AS width FROM (SELECT o_orderkey, (o_orderkey % 100 + 1)::BIGINT AS w, least(o_orderkey % 7 + 1, o_orderkey % 100 + 1)::BIGINT AS n, unnest(generate_series(0, least(o_orderkey % 7 + 1, o_orderkey % 100 + 1)::BIGINT - 1)) AS i FROM orders)""")
def window_parts(spark, d):
    """Windows cut into equal parts of whole seconds."""
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", F.inline(census.equal_parts(k, k % 100 + 1, k % 7 + 1)))


@query("""WITH s AS (SELECT range AS no, floor(('0x' || md5('walk:' || range)[:8])::UINTEGER / 4294967296.0::DOUBLE * ((SELECT max(o_orderkey) FROM orders) + 1))::BIGINT AS start FROM range(40)),
m AS (SELECT o_orderkey, row_number() OVER (PARTITION BY no ORDER BY o_orderkey) AS n FROM s JOIN orders ON o_orderkey >= start AND o_orderkey < start + 100 WHERE o_totalprice > 50000) SELECT DISTINCT o_orderkey FROM m WHERE n <= 2""")
def id_walk(spark, d):
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("walk:"), "draw_no").cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    return census.id_walk(t(spark, d, "orders"), "o_orderkey", F.col("o_totalprice") > 50000, draw, 40, 100).select("o_orderkey")


@query("SELECT max(o_orderkey) AS latest FROM orders")
def max_id(spark, d):
    return t(spark, d, "orders").agg(F.max("o_orderkey").alias("latest"))


@query("SELECT event_id, round(sum(round_even(value, 2)::DECIMAL(18, 2)) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW), 2)::DOUBLE AS load FROM events")
def rolling_load(spark, d):
    e = t(spark, d, "events").withColumn("cost", F.bround("value", 2).cast("decimal(18,2)"))
    return census.rolling_load(e, ["user_id"], "ts", "cost", 86_400).select("event_id", F.col("load").cast("double").alias("load"))


@query("""SELECT p_partkey FROM part ORDER BY CASE WHEN p_size % 9 <> 0 THEN p_retailprice END DESC NULLS LAST, p_size, p_brand DESC, p_partkey LIMIT 60""")
def index_order(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 9 != 0, F.col("p_retailprice")).alias("gem"), "p_size", "p_brand")
    return rows.orderBy(*explain.index_order("gem", "p_size", "p_brand", "p_partkey")).limit(60).select("p_partkey")


@query("""SELECT p_partkey FROM part ORDER BY coalesce(CASE WHEN p_size % 9 <> 0 THEN 1400 - p_retailprice END, 0) DESC, p_size, p_brand DESC, p_partkey LIMIT 60""")
def entry_order(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 9 != 0, 1400 - F.col("p_retailprice")).alias("gem"), "p_size", "p_brand")
    return rows.orderBy(*explain.entry_order("gem", "p_size", "p_brand", "p_partkey")).limit(60).select("p_partkey")


@query("""WITH s AS (SELECT doc_id, n_chars >= 1000 AS a, contains(text, ',') AS b, CASE WHEN lang IS NOT NULL THEN lang = 'en' END AS c, contains(text, '|') AS e, contains(text, '@') AS f, n_chars < 200 AS g FROM documents)
SELECT doc_id, list_filter([CASE WHEN b THEN 'q.release' END, CASE WHEN c THEN 'q.tests' END, CASE WHEN a THEN 'q.readme' END], lambda x: x IS NOT NULL) AS top, list_filter([CASE WHEN e THEN 's.prose' END, CASE WHEN f AND NOT e THEN 's.mdheavy' END, CASE WHEN g THEN 's.junk' END], lambda x: x IS NOT NULL)[:2] AS negatives,
list_filter([CASE WHEN NOT b THEN 'q.release' END, CASE WHEN c IS NULL OR NOT c THEN 'q.tests' END, CASE WHEN NOT a THEN 'q.readme' END], lambda x: x IS NOT NULL) AS why FROM s""")
def explained(spark, d):
    """Reasons, penalties that count, and what would help."""
    sig = lambda name, hit, w, g=None: F.struct(F.lit(name).alias("id"), F.when(hit.isNull(), "unknown").otherwise("ok").alias("status"), hit.alias("hit"), F.lit(w).alias("weight"), F.lit(g).cast("string").alias("grp"))
    n, text = F.col("n_chars"), F.col("text")
    given = F.array(sig("q.readme", n >= 1000, 1), sig("q.release", F.contains(text, F.lit(",")), 1), sig("q.tests", F.when(F.col("lang").isNotNull(), F.col("lang") == "en"), 1), sig("s.prose", F.contains(text, F.lit("|")), -2, "prose"), sig("s.mdheavy", F.contains(text, F.lit("@")), -1, "prose"), sig("s.junk", n < 200, -1))
    rows = t(spark, d, "documents").select("doc_id", explain.counted(given).alias("x"))
    return rows.select("doc_id", explain.top_reasons(F.col("x")).alias("top"), explain.negatives(F.col("x")).alias("negatives"), explain.why_not_higher(F.col("x")).alias("why"))


@query("SELECT p_brand, list_transform(list_sort(list_distinct(list({'l': NOT regexp_matches(lower(p_type), 'test|ci|build|check'), 'n': p_type})))[:3], lambda x: x.n) AS chosen FROM part GROUP BY p_brand")
def workflow_choice(spark, d):
    """Names that speak of tests or builds first."""
    return t(spark, d, "part").groupBy("p_brand").agg(explain.workflow_choice(F.collect_set("p_type")).alias("chosen"))


@query("SELECT CASE WHEN n_chars >= 3000 THEN 'gem' WHEN n_chars >= 1000 THEN 'look' ELSE 'low' END AS band, quality AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def band_by_label(spark, d):
    joined = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    return joined.groupBy(catalogue.band(F.col("n_chars"), 3000, 1000).alias("band"), F.col("quality").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l.lane AS shelf, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('none')) l(lane) LEFT JOIN orders ON o_orderstatus = l.lane GROUP BY 1")
def lane_counts(spark, d):
    """Counts for a fixed list, zero where there are none."""
    return views.counted_lanes(t(spark, d, "orders"), "o_orderstatus", ["F", "O", "P", "none"])


@query("SELECT o_custkey, o_orderdate::DATE::VARCHAR AS day, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) >= 2")
def prolific_owners(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate + INTERVAL 7 DAY <= TIMESTAMP '1997-01-01'")
def deferred_due(spark, d):
    return t(spark, d, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS") <= F.lit("1997-01-01").cast("timestamp"))).select("o_orderkey")


@query("""SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (event_id % 2 = 0))) AS known, list_sort(list_distinct(list(event_type))) AS together FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 2 = 0) > 0""")
def sources_union(spark, d):
    """Sources known before, and with those of a new seed."""
    e = t(spark, d, "events")
    both = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("known"), F.collect_set(F.when(F.col("event_id") % 2 == 1, F.col("event_type"))).alias("new"))
    return both.where(F.size("known") > 0).select("user_id", F.array_sort("known").alias("known"), F.array_sort(F.array_union("known", "new")).alias("together"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def stale_pages(spark, d):
    return t(spark, d, "documents").select("doc_id").exceptAll(t(spark, d, "labels").select("doc_id").distinct())


@query("SELECT round(sum(CASE WHEN positive THEN -ln(1 + exp(-z)) ELSE -ln(1 + exp(z)) END), 6) AS log_likelihood FROM (SELECT quality = 1 AS positive, -2 + n_chars / 2000.0 AS z FROM labels JOIN documents USING (doc_id))")
def platt_ll(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.agg(F.round(F.sum(s.log_likelihood(-2 + F.col("n_chars") / 2000.0, F.col("quality") == 1)), 6).alias("log_likelihood"))


@query("SELECT event_id, round((greatest(0, event_id % 5000 - event_id % 700 - event_id % 300) * 3 + event_id % 300 * 3 * 1.25 + event_id % 700 * 3 * 0.1 + event_id % 900 * 15) / 1e6, 9)::DOUBLE AS dollars FROM events")
def review_cost(spark, d):
    k = F.col("event_id")
    return t(spark, d, "events").select("event_id", F.round(s.cost(k % 5000, k % 900, k % 700, k % 300, F.lit(3.0), F.lit(15.0)), 9).alias("dollars"))


@query("""SELECT event_id, date_trunc('week', ts)::DATE::VARCHAR AS monday, extract(isoyear FROM ts - INTERVAL 28 DAY)::VARCHAR || '-W' || lpad(extract(week FROM ts - INTERVAL 28 DAY)::VARCHAR, 2, '0') AS before FROM events""")
def week_arithmetic(spark, d):
    week = s.iso_week(F.col("ts"))
    return t(spark, d, "events").select("event_id", s.week_start(week).cast("string").alias("monday"), s.shifted_week(week, -4).alias("before"))


@query("""SELECT p_partkey, CASE WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576) WHEN b >= 1024 THEN printf('%.1f KB', b / 1024) ELSE b || ' bytes' END AS size, CASE WHEN length(p_name) > 12 THEN p_name[:11] || '…' ELSE p_name END AS name, regexp_replace(lower(trim(p_name)), '\\s+', '-', 'g') AS slug, regexp_replace(lower(p_type), '[-_.]+', '-', 'g') AS pkg, sha1(p_name) AS key FROM (SELECT *, (p_partkey * p_partkey * 8)::BIGINT AS b FROM part)""")
def text_helpers(spark, d):
    b = (F.col("p_partkey") * F.col("p_partkey") * 8).cast("long")
    return t(spark, d, "part").select("p_partkey", s.size_text(b).alias("size"), s.clipped(F.col("p_name"), 12).alias("name"), s.slug(F.col("p_name")).alias("slug"), s.package_key(F.col("p_type")).alias("pkg"), F.sha1(F.col("p_name").cast("binary")).alias("key"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def escaped_pages(spark, d):
    return t(spark, d, "pages").select("page_id", s.escaped(F.col("html")).alias("escaped"))


@query("""WITH x AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t, unnest(generate_series(0, 3)) AS k FROM events), z AS (SELECT user_id, (t // 604800 - k) * 604800 AS start FROM x)
SELECT user_id, make_timestamp(start * 1000000) AS start, count(*) AS n FROM z GROUP BY ALL""")
def sliding_windows(spark, d):
    """Four weeks, each week."""
    return t(spark, d, "events").groupBy("user_id", F.window("ts", "28 days", "7 days").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("""SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE labels.quality IS NULL AND 1 / (1 + exp(6.403 - 1.113 * (n_chars / 500.0))) BETWEEN 0.35 AND 0.65 ORDER BY md5('help:' || doc_id) LIMIT 1""")
def help_calibrate(spark, d):
    """One unlabelled row that the model is unsure of."""
    from lodestone.operators.scoring import quality

    unlabelled = t(spark, d, "documents").join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return unlabelled.where(quality(F.col("n_chars") / 500.0).between(0.35, 0.65)).orderBy(s.draw("help", F.col("doc_id"))).limit(1).select("doc_id")


@query("""WITH f AS (SELECT doc_id, 'sample' AS why FROM documents WHERE source IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars DESC, doc_id LIMIT 20)
SELECT * FROM f UNION ALL (SELECT doc_id, 'pool' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM f) ORDER BY md5('calibrate:' || doc_id) LIMIT 10)""")
def calibrate_draw(spark, d):
    """The newest of the sample first, then a seeded draw from the rest; labelled rows are out."""
    rows = t(spark, d, "documents").select("doc_id", "source", "n_chars").join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    first = rows.where("source IS NOT NULL").orderBy(F.desc("n_chars"), "doc_id").limit(20).select("doc_id")
    more = rows.join(F.broadcast(first), "doc_id", "left_anti").orderBy(s.draw("calibrate", F.col("doc_id"))).limit(10)
    return first.select("doc_id", F.lit("sample").alias("why")).unionByName(more.select("doc_id", F.lit("pool").alias("why")))


@query("""SELECT c_custkey, last_action, coalesce(last_action = 'error' OR snooze > TIMESTAMP '2024-01-15', false) AS hidden FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS last_action, arg_max_null(CASE WHEN value > 50 THEN ts END, event_id) AS snooze FROM events GROUP BY user_id) ON user_id = c_custkey""")
def index_with_feedback(spark, d):
    """Records with what people did to them last, and whether that hides them."""
    e = t(spark, d, "events").withColumn("snooze", F.when(F.col("value") > 50, F.col("ts")))
    state = folds.feedback_state(e, "user_id", ["event_id"], "event_type", "snooze")
    joined = t(spark, d, "customer").join(state, F.col("c_custkey") == F.col("user_id"), "left")
    hidden = F.coalesce((F.col("last_action") == "error") | (F.col("snooze_until") > F.lit("2024-01-15").cast("timestamp")), F.lit(False))
    return joined.select("c_custkey", "last_action", hidden.alias("hidden"))


@query("SELECT c_custkey AS id, 'record' AS origin FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'candidate' FROM customer WHERE c_acctbal < 0 AND c_custkey % 3 <> 0")
def quarantined_union(spark, d):
    """Quarantined candidates that have no record join the index by what identifies them."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    records = c.where(F.col("id") % 3 == 0).select("id", F.lit("record").alias("origin"))
    return records.unionByName(c.where("c_acctbal < 0").join(records.select("id"), "id", "left_anti").select("id", F.lit("candidate").alias("origin")))


_DRESSED = "CASE WHEN NOT positive THEN 1 + 1 + 2 + 1 ELSE (n_chars >= 1000)::INT + contains(text, ',')::INT + 2 * coalesce(lang = 'en', false)::INT + (n_chars >= 5000)::INT END + 3 * contains(text, '.')::INT + CASE WHEN contains(text, '|') THEN -2 WHEN contains(text, '@') THEN -1 ELSE 0 END - (n_chars < 200)::INT"


@query(f"""WITH l AS (SELECT positive, ({_DRESSED})::DOUBLE AS s FROM (SELECT *, quality = 1 AS positive FROM labels JOIN documents USING (doc_id))), c AS (SELECT s, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM l GROUP BY s),
b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 9)::DOUBLE AS auc FROM b""")
def dressed_auc(spark, d):
    """How well points tell rows apart once the others have put on all cheap signals."""
    from lodestone.operators import metrics, scoring
    from lodestone.plans.tables import _signals

    cheap = {"long", "marks", "english", "very_long"}
    rows = t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id").withColumn("positive", F.col("quality") == 1)
    dressed = [scoring.Signal(x.name, x.weight, F.when(F.col("positive"), x.rule).otherwise(True) if x.name in cheap else x.rule, x.group) for x in _signals()]
    return metrics.auc(rows.withColumn("points", scoring.points_in_row(dressed)), "points", F.col("positive")).withColumn("auc", F.round("auc", 9))


_HITS = {"long": "n_chars >= 1000", "marks": "contains(text, ',')", "mail": "contains(text, '@')", "short": "n_chars < 200"}


@query(" UNION ALL ".join(f"""SELECT '{k}' AS signal, count(*) FILTER (h AND y) AS tp, count(*) FILTER (h AND NOT y) AS fp, count(*) FILTER (NOT h AND y) AS fn, count(*) FILTER (NOT h AND NOT y) AS tn FROM (SELECT {e} AS h, quality = 1 AS y FROM labels JOIN documents USING (doc_id))""" for k, e in _HITS.items()))
def signal_table(spark, d):
    """Hits against labels for each signal, in one pass."""
    rows = t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id").withColumn("y", F.col("quality") == 1)
    hits = {"long": F.col("n_chars") >= 1000, "marks": F.contains("text", F.lit(",")), "mail": F.contains("text", F.lit("@")), "short": F.col("n_chars") < 200}
    each = rows.select("y", F.inline(F.array(*[F.struct(F.lit(k).alias("signal"), h.alias("h")) for k, h in hits.items()])))
    y, h = F.col("y"), F.col("h")
    return each.groupBy("signal").agg(F.count_if(h & y).alias("tp"), F.count_if(h & ~y).alias("fp"), F.count_if(~h & y).alias("fn"), F.count_if(~h & ~y).alias("tn"))


@query("""SELECT p_partkey FROM part WHERE contains(lower(p_name), 'e') AND p_brand IN ('Brand#1', 'Brand#11', 'Brand#12', 'Brand#21') AND p_size <= 30 AND p_retailprice >= 950""")
def view_filter(spark, d):
    """A query, a list, a bound and evidence at once."""
    chips = F.array(F.struct(F.lit("dear").alias("id"), F.lit("ok").alias("status"), (F.col("p_retailprice") >= 950).alias("hit")))
    keep = views.matching(F.col("p_name"), "e", {"brand": (F.col("p_brand"), ["Brand#1", "Brand#11", "Brand#12", "Brand#21"])}, {"size": (F.col("p_size"), 30)}, (chips, ["dear"]))
    return t(spark, d, "part").where(keep).select("p_partkey")


@query("SELECT shelf::VARCHAR AS shelf, count(p_partkey) AS n FROM (VALUES (10), (25), (40)) v(shelf) LEFT JOIN part ON p_size <= shelf AND p_retailprice <= 1200 GROUP BY 1")
def step_counts(spark, d):
    """Cumulative steps under the other filters."""
    return views.step_counts(t(spark, d, "part"), F.col("p_size"), [10, 25, 40], F.col("p_retailprice") <= 1200)


@query("SELECT p_brand AS family, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, family LIMIT 10")
def families(spark, d):
    return t(spark, d, "part").groupBy(F.col("p_brand").alias("family")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "family").limit(10)


@query("SELECT event_id, regexp_replace(regexp_replace('key=sk-' || md5(event_id::VARCHAR) || ' ' || event_type, 'sk-[A-Za-z0-9_-]{16,}', '[redacted]', 'g'), 'gh[pousr]_[A-Za-z0-9]{20,}', '[redacted]', 'g') AS line FROM events")
def redaction(spark, d):
    """Tokens don't reach a log."""
    line = F.concat(F.lit("key=sk-"), F.md5(F.col("event_id").cast("string").cast("binary")), F.lit(" "), "event_type")
    return t(spark, d, "events").select("event_id", s.redacted(line).alias("line"))


@query("""SELECT event_id, event_type, user_id FROM events WHERE event_id % 10 <> 0 AND event_type IN ('view', 'purchase')""")
def event_extract(spark, d):
    """Typed fields of log lines of the wanted kinds; lines that aren't such JSON are counted out."""
    from lodestone.sources import events_log

    e = t(spark, d, "events").select("event_id", "event_type", "user_id")
    text = F.to_json(F.struct("event_id", "event_type", "user_id"))
    lines = e.select(F.when(F.col("event_id") % 10 == 0, F.substring(text, 1, 20)).otherwise(text).alias("value")).where(F.contains("value", F.lit('"view"')) | F.contains("value", F.lit('"purchase"')) | (F.length("value") <= 20))
    found = events_log.parsed(lines, e.schema)
    return found.where(F.col("bad").isNull() & F.col("event_type").isin("view", "purchase")).drop("bad")


@query("SELECT doc_id, '{\"lang\":' || coalesce('\"' || lang || '\"', 'null') || ',\"n\":' || n_chars || '}' AS key FROM documents")
def stable_json(spark, d):
    """Objects with their fields in order of name, nulls and all."""
    return t(spark, d, "documents").select("doc_id", s.stable_json({"n": F.col("n_chars"), "lang": F.col("lang")}).alias("key"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS done, count(*) AS events, (SELECT count(DISTINCT user_id) FROM events) AS users FROM events GROUP BY user_id")
def run_counters(spark, d):
    """Counts by stage, with the number of units in the same pass over the log."""
    by = t(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "purchase").alias("done"), F.count(F.lit(1)).alias("events"))
    return by.join(F.broadcast(by.agg(F.count(F.lit(1)).alias("users"))))  # one row of totals


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND year(o_orderdate) = 1996 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4)""")
def list_filter(spark, d):
    """By states, by day, by a list of ids."""
    ids = t(spark, d, "customer").where("c_nationkey = 4").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "P") & (F.year("o_orderdate") == 1996)).join(ids, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT user_id, count(*) AS calls, round(sum(round_even(value, 2)::DECIMAL(18, 2)), 2)::DOUBLE AS cost, max(ts) AS last_at FROM events GROUP BY user_id ORDER BY calls DESC, user_id LIMIT 20")
def status_counts(spark, d):
    by = t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.bround("value", 2).cast("decimal(18,2)")).cast("double").alias("cost"), F.max("ts").alias("last_at"))
    return by.orderBy(F.desc("calls"), "user_id").limit(20)


def _mulberry(seed: str, n: str) -> str:
    """The n-th number of the generator, in SQL."""
    times = lambda a, b: f"((({a})::HUGEINT * ({b})) % 4294967296)::BIGINT"
    state = f"(({seed})::BIGINT + {times(n, '1831565813')}) % 4294967296"
    first = f"(SELECT {times('xor(a, a >> 15)', 'a | 1')} FROM (SELECT {state} AS a))"
    second = f"(SELECT xor(t, (t + {times('xor(t, t >> 7)', 't | 61')}) % 4294967296) FROM (SELECT {first} AS t))"
    return f"(SELECT xor(u, u >> 14) / 4294967296.0::DOUBLE FROM (SELECT {second} AS u))"


@query(f"SELECT event_id, {_mulberry('user_id * 7919', 'event_id % 1000 + 1')} AS draw FROM events")
def mulberry_draws(spark, d):
    """Numbers of a published generator, any of them without those before."""
    return t(spark, d, "events").select("event_id", s.mulberry32(F.col("user_id") * 7919, F.col("event_id") % 1000 + 1).alias("draw"))


@query(f"""WITH RECURSIVE x AS (SELECT i, {_mulberry('7', 'i')} AS x FROM (SELECT unnest(range(1, 51)) AS i)), c AS (SELECT count(*) AS n FROM documents),
r AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS place, []::STRUCT(k BIGINT, v BIGINT)[] AS moved UNION ALL
SELECT i + 1, coalesce(list_filter(moved, lambda m: m.k = j)[1].v, j), list_prepend({{'k': j, 'v': coalesce(list_filter(moved, lambda m: m.k = i)[1].v, i)}}, list_filter(moved, lambda m: m.k <> j)) FROM (SELECT r.i, r.moved, (r.i + floor(x.x * (c.n - r.i)))::BIGINT AS j FROM r JOIN x ON x.i = r.i + 1, c WHERE r.i < c.n))
SELECT doc_id, r.i AS draw FROM r JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents) USING (place)""")
def seeded_draw(spark, d):
    """Fifty documents without replacement, by a partial shuffle."""
    return views.drawn(t(spark, d, "documents").select("doc_id"), [F.col("doc_id")], 50, 7)


_STARS = "SELECT floor(epoch(ts))::BIGINT AS x, user_id % 40 AS stars FROM events WHERE user_id % 40 <= 25"
_WINDOWS = f"""e AS (SELECT x, count(*) AS n FROM ({_STARS}) GROUP BY ALL),
r AS (SELECT x, n, x // 86400 * 86400 AS low, 86400::BIGINT AS width, (sum(n) OVER (PARTITION BY x // 86400))::BIGINT AS total FROM e
UNION ALL SELECT x, n, low + a, b - a, (sum(n) OVER (PARTITION BY low + a))::BIGINT FROM (SELECT *, i * width // parts AS a, (i + 1) * width // parts AS b FROM
(SELECT *, ((x - low + 1) * parts - 1) // width AS i FROM (SELECT *, least((total + 19) // 20, width) AS parts FROM r WHERE total > 20 AND width > 7200)))),
w AS (SELECT low, width, sum(n)::BIGINT AS n FROM r WHERE total <= 20 OR width <= 7200 GROUP BY ALL),
g AS (SELECT low, width, part, a, b FROM w, (VALUES ('0', 0, 0), ('1', 1, 1), ('2..25', 2, 25)) v(part, a, b) WHERE n > 12 AND width <= 7200),
z AS (SELECT low, width, NULL::VARCHAR AS part, n FROM w WHERE NOT (n > 12 AND width <= 7200) UNION ALL SELECT low, width, part, count(x) AS n FROM g LEFT JOIN ({_STARS}) s ON s.x >= low AND s.x < low + width AND stars BETWEEN a AND b GROUP BY ALL)"""


def _windows(spark, d):
    e = t(spark, d, "events").withColumn("stars", F.col("user_id") % 40)
    return discovery.scan_windows(e, "ts", "stars", 86_400, 20, 7_200, 12, 0, 25)


@query(f"WITH RECURSIVE {_WINDOWS} SELECT *, n > 12 AS saturated FROM z")
def scan_windows(spark, d):
    """Windows split in time, and at their least width by stars; what is still too full is flagged."""
    return _windows(spark, d)


@query(f"""WITH RECURSIVE {_WINDOWS}, u AS (SELECT low // 86400 AS day, * FROM z WHERE NOT coalesce(part = '1' AND low % 3 = 0, false)), c AS (SELECT day, low AS s, low + width - 1 AS e FROM u GROUP BY day, low, width HAVING count(*) FILTER (part IS NULL) > 0 OR count(DISTINCT part) = 3),
m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY day ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS f FROM c), k AS (SELECT *, sum(f) OVER (PARTITION BY day ORDER BY s) AS g FROM m) SELECT day, min(s) AS start, max(e) AS "end" FROM k GROUP BY day, g""")
def scanned_spans(spark, d):
    """What is scanned when some parts of split windows are missing."""
    done = _windows(spark, d).where(~F.coalesce((F.col("part") == "1") & (F.col("low") % 3 == 0), F.lit(False))).withColumn("day", F.floor(F.col("low") / 86_400))
    return discovery.done_spans(done, [k for k, _, _ in discovery.value_parts(0, 25)], ["day"]).select("day", "start", "end")


def _ladders_sql() -> str:
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(command)}, {quoted(' '.join((['try'] if command else []) + rungs.split()))})" for i, (_, _, command, rungs) in enumerate(cases.LADDERS))
    return f"SELECT c_custkey, command, rungs FROM customer JOIN (VALUES {values}) v(case_no, command, rungs) ON c_custkey % {len(cases.LADDERS)} = case_no"


@query(_ladders_sql())
def support_ladders(spark, d):
    """Commands that check out against a repository's own files, and the rungs that apply."""
    given = [("", facts | {"nwo": "octo/tool"} | cases.readme(f"words\n```sh\n{code}\n```\n")) for code, facts, _, _ in cases.LADDERS]
    found = _facts(spark, d, given).withColumn("l", support.ladder())
    return found.select("c_custkey", F.get("l", F.lit(0))["command"].alias("command"), F.array_join(F.transform("l", lambda x: x["kind"]), " ").alias("rungs"))


def _markdown_sql() -> str:
    values = ", ".join(f"({i}, '{said}')" for i, (_, said) in enumerate(cases.MARKDOWN))
    return f"SELECT c_custkey, outline FROM customer JOIN (VALUES {values}) v(case_no, outline) ON c_custkey % {len(cases.MARKDOWN)} = case_no"


@query(_markdown_sql())
def readme_blocks(spark, d):
    """Markdown of many shapes as plain blocks."""
    texts = F.array(*[F.lit(md) for md, _ in cases.MARKDOWN])
    rows = t(spark, d, "customer").select("c_custkey", texts[(F.col("c_custkey") % len(cases.MARKDOWN)).cast("int")].alias("text"))
    return rows.withColumn("b", markdown.safe_blocks(F.col("text"), None)).select("c_custkey", F.replace(markdown.outline(F.col("b")), F.lit(" | "), F.lit(" / ")).alias("outline"))


@query("SELECT doc_id, text IS NOT NULL AND trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> '' AS says FROM documents")
def document_blocks(spark, d):
    """Whole documents as blocks: one that says something has a block."""
    return t(spark, d, "documents").select("doc_id", (F.size(markdown.safe_blocks(F.col("text"), None)) > 0).alias("says"))


_MERGE = """c AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'deferred' WHEN 1 THEN 'queued' WHEN 2 THEN 'enriched' WHEN 3 THEN 'dropped' WHEN 4 THEN 'gone' ELSE 'quarantined' END AS state, CASE WHEN c_custkey % 6 = 3 THEN CASE WHEN c_custkey % 4 = 1 THEN 'owner-cap' ELSE 'g.spam.words' END END AS reason, c_custkey % 5 AS prior,
CASE WHEN c_custkey % 6 = 0 THEN TIMESTAMP '2024-03-01' END AS next_at, TIMESTAMP '2024-01-05' AS pushed_at, c_custkey % 30 AS stars, ['census'] AS sources, TIMESTAMP '2024-02-01' - to_days((c_custkey % 11)::INT) AS seen_at, CASE WHEN c_custkey % 4 <> 0 THEN TIMESTAMP '2024-02-01' - to_days((c_custkey % 10)::INT) END AS looked_at FROM customer WHERE c_custkey % 3 <> 2),
n AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN TIMESTAMP '2024-01-20' END AS pushed_at, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey END AS stars, CASE WHEN c_custkey % 2 = 0 THEN 'census' ELSE 'archive' END AS source, CASE WHEN c_nationkey % 4 = 0 THEN 'deferred' WHEN c_nationkey % 4 = 1 THEN 'dropped' ELSE 'queued' END AS pre_state, CASE WHEN c_nationkey % 4 = 0 THEN 'no-language-yet' WHEN c_nationkey % 4 = 1 THEN 'attention' END AS pre_reason, c_nationkey % 5 AS pre_prior, TIMESTAMP '2024-02-08' AS pre_next_at FROM customer WHERE c_custkey % 5 <> 0)"""


@query(f"""WITH {_MERGE}, j AS (SELECT coalesce(c.k, n.k) AS c_custkey, c.k IS NOT NULL AS known, n.k IS NOT NULL AS met, c.*, n.pushed_at AS np, n.stars AS ns, source, pre_state, pre_reason, pre_prior, pre_next_at FROM c FULL JOIN n ON c.k = n.k),
o AS (SELECT *, known AND met AND (state IN ('deferred', 'gone') OR coalesce(reason = 'owner-cap', false)) AS anew, known AND met AND state = 'enriched' AND coalesce(np > pushed_at, false) AND date_diff('day', coalesce(looked_at, seen_at), TIMESTAMP '2024-02-01') >= 7 AS again FROM j)
SELECT c_custkey, coalesce(np, pushed_at)::VARCHAR AS pushed_at, coalesce(ns, stars) AS stars, array_to_string(CASE WHEN source IS NULL OR list_contains(coalesce(sources, []), source) THEN coalesce(sources, []) ELSE list_append(coalesce(sources, []), source) END, ',') AS sources, CASE WHEN NOT known OR anew THEN pre_state WHEN again THEN 'queued' ELSE state END AS state, CASE WHEN NOT known OR anew THEN pre_reason WHEN again THEN 'pushed' ELSE reason END AS reason,
(CASE WHEN NOT known OR anew THEN pre_prior WHEN met AND state = 'queued' THEN greatest(prior, pre_prior) WHEN again THEN pre_prior + 2 ELSE prior END)::INT AS prior, CASE WHEN NOT known OR anew THEN CASE WHEN pre_state = 'deferred' THEN pre_next_at::VARCHAR END WHEN again THEN NULL ELSE next_at::VARCHAR END AS next_at, CASE WHEN NOT known OR anew OR again THEN '2024-02-01 00:00:00' ELSE seen_at::VARCHAR END AS seen_at, CASE WHEN NOT known THEN 'new' WHEN anew OR again THEN 'reopened' WHEN met THEN 'merged' ELSE 'kept' END AS change FROM o""")
def merge_candidates(spark, d):
    """Seeds merged into stored candidates, whole: live values, sources, states, times and what changed."""
    x, k, nk = t(spark, d, "customer"), F.col("c_custkey"), F.col("c_nationkey")
    day = lambda text: F.lit(text).cast("timestamp")
    state = F.element_at(F.array(*map(F.lit, ("deferred", "queued", "enriched", "dropped", "gone", "quarantined"))), (k % 6 + 1).cast("int"))
    back = lambda n: day("2024-02-01") - F.make_dt_interval(days=(k % n).cast("int"))
    stored = x.where(k % 3 != 2).select(k, day("2024-01-05").alias("pushed_at"), (k % 30).alias("stars"), F.array(F.lit("census")).alias("sources"), state.alias("state"), F.when(k % 6 == 3, F.when(k % 4 == 1, "owner-cap").otherwise("g.spam.words")).alias("reason"), (k % 5).alias("prior"), F.when(k % 6 == 0, day("2024-03-01")).alias("next_at"), back(11).alias("seen_at"), F.when(k % 4 != 0, back(10)).alias("looked_at"))
    pre = F.when(nk % 4 == 0, "deferred").when(nk % 4 == 1, "dropped").otherwise("queued")
    why = F.when(nk % 4 == 0, "no-language-yet").when(nk % 4 == 1, "attention")
    seeds = x.where(k % 5 != 0).select(k, F.when(F.col("c_acctbal") > 0, day("2024-01-20")).alias("pushed_at"), F.when(nk % 2 == 0, nk.cast("long")).alias("stars"), F.when(k % 2 == 0, "census").otherwise("archive").alias("source"), pre.alias("pre_state"), why.alias("pre_reason"), (nk % 5).alias("pre_prior"), day("2024-02-08").alias("pre_next_at"))
    found = lifecycle.merged_candidates(stored, seeds, "c_custkey", day("2024-02-01"), ["pushed_at", "stars"])
    times = {c: F.col(c).cast("string") for c in ("pushed_at", "next_at", "seen_at")}
    return found.withColumns({"sources": F.array_join("sources", ",")} | times).drop("looked_at")
