"""The registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scalars as s
from lodestone.operators import catalogue, discovery, folds, joins, metrics, rules, scoring, views
from lodestone.operators.common import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _signals() -> list[scoring.Signal]:
    c = F.col
    return [
        scoring.Signal("long", 1, c("n_chars") >= 1000),
        scoring.Signal("marks", 1, F.contains("text", F.lit(","))),
        scoring.Signal("english", 2, F.when(c("lang").isNotNull(), c("lang") == "en")),
        scoring.Signal("very_long", 1, c("n_chars") >= 5000),
        scoring.Signal("stops", 3, F.contains("text", F.lit("."))),
        scoring.Signal("pipes", -2, F.contains("text", F.lit("|")), "noise"),
        scoring.Signal("mail", -1, F.contains("text", F.lit("@")), "noise"),
        scoring.Signal("short", -1, c("n_chars") < 200),
    ]


_POINTS = """(CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END + CASE WHEN contains(text, ',') THEN 1 ELSE 0 END + CASE WHEN lang = 'en' THEN 2 ELSE 0 END
 + CASE WHEN n_chars >= 5000 THEN 1 ELSE 0 END + CASE WHEN contains(text, '.') THEN 3 ELSE 0 END
 + CASE WHEN contains(text, '|') THEN -2 WHEN contains(text, '@') THEN -1 ELSE 0 END + CASE WHEN n_chars < 200 THEN -1 ELSE 0 END)::DOUBLE"""


@query(f"""WITH p AS (SELECT doc_id, source, n_chars, {_POINTS} AS points FROM documents)
SELECT doc_id, points, round(1 / (1 + exp(6.403 - 1.113 * points)), 6) AS quality, CASE WHEN points >= 7 THEN 'gem' WHEN points >= 5 THEN 'look' ELSE 'low' END AS band
FROM p ORDER BY points DESC, n_chars, doc_id LIMIT 200""")
def index_topk(spark, d):
    ranked = t(spark, d, "documents").withColumn("points", scoring.points_in_row(_signals())).select("doc_id", "points", "n_chars")
    best = scoring.top(ranked, 200, F.desc("points"), F.col("n_chars"), F.col("doc_id"))
    return best.select("doc_id", "points", F.round(scoring.quality(F.col("points")), 6).alias("quality"), catalogue.band(F.col("points")).alias("band"))


@query(f"SELECT doc_id, {_POINTS} AS points, 8.0::DOUBLE AS points_max, CASE WHEN lang IS NULL THEN round(10.0 / 12, 9) ELSE 1.0 END::DOUBLE AS coverage FROM documents")
def points_group_min(spark, d):
    return scoring.points(scoring.signal_rows(t(spark, d, "documents"), "doc_id", _signals()), "doc_id")


@query("""WITH g AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY ALL), m AS (SELECT user_id, least(0.9, v / 1000.0) AS m FROM g)
SELECT user_id, round(1 - exp(sum(ln(1 - m))), 6) AS confidence FROM m GROUP BY user_id""")
def conf_product(spark, d):
    items = t(spark, d, "events").select("user_id", F.col("event_type").alias("grp"), F.least(F.lit(0.9), F.col("value") / 1000.0).alias("strength"))
    return scoring.confidence(items, "user_id").withColumn("confidence", F.round("confidence", 6))


@query("""SELECT p_partkey, round(ln(1 + p_size) / ln(1 + greatest(p_size, 25)), 6) AS attention, round(p_retailprice / 200 + 0.6 - 1.5 * ln(1 + p_size) / ln(1 + greatest(p_size, 25)), 4) AS gem FROM part""")
def gem_rank(spark, d):
    att = scoring.attention(F.col("p_size"), F.lit(0))
    return t(spark, d, "part").select("p_partkey", F.round(att, 6).alias("attention"), F.round(scoring.gem(F.col("p_retailprice") / 200, F.lit(0.4), att), 4).alias("gem"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < -900 THEN 'quarantine' WHEN c_custkey % 17 = 0 THEN 'gone' WHEN c_nationkey = 0 THEN 'institutional' WHEN c_nationkey * 1.5 > 25 THEN 'graduated' WHEN c_custkey % 13 >= 10 THEN 'rising'
WHEN c_mktsegment = 'MACHINERY' OR c_custkey % 11 = 0 THEN 'doubted' WHEN c_acctbal / 1000 >= 7 AND c_nationkey / 25.0 >= 0.5 THEN 'proven' WHEN c_acctbal / 1000 >= 7 THEN 'promising' WHEN c_acctbal / 1000 >= 5 THEN 'look' ELSE 'low' END AS lane FROM customer""")
def lane_case(spark, d):
    c, n, k = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_custkey")
    actions = F.array_compact(F.array(F.when(c < -900, "quarantine"), F.when(n == 0, "institutional"), F.when(F.col("c_mktsegment") == "MACHINERY", "doubt")))
    lane = catalogue.lane(actions, catalogue.band(c / 1000), n / 25.0, n * 1.5, F.when(k % 2 >= 0, k % 13), k % 11 == 0, k % 17 == 0)
    return t(spark, d, "customer").select("c_custkey", lane.alias("lane"))


@query("""SELECT o_orderkey, (o_totalprice > 100000)::INT + (o_orderstatus = 'F')::INT + (o_orderpriority < '3')::INT + (year(o_orderdate) >= 1998)::INT + (o_custkey % 2 = 0)::INT AS prior FROM orders""")
def prior_sum(spark, d):
    o = t(spark, d, "orders")
    signs = [F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "F", F.col("o_orderpriority") < "3", F.year("o_orderdate") >= 1998, F.col("o_custkey") % 2 == 0]
    return o.select("o_orderkey", rules.prior(*signs).alias("prior"))


@query("""SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'dropped' WHEN o_totalprice < 5000 THEN 'dropped' WHEN c_acctbal < 0 AND c_mktsegment <> 'BUILDING' THEN 'deferred' WHEN o_orderpriority = '5-LOW' THEN 'deferred' ELSE 'queued' END AS state,
CASE WHEN c_custkey IS NULL THEN 'no-owner' WHEN o_totalprice < 5000 THEN 'small' WHEN c_acctbal < 0 AND c_mktsegment <> 'BUILDING' THEN 'owner' WHEN o_orderpriority = '5-LOW' THEN 'young' END AS reason,
CASE WHEN c_custkey IS NULL OR o_totalprice < 5000 THEN NULL WHEN c_acctbal < 0 AND c_mktsegment <> 'BUILDING' OR o_orderpriority = '5-LOW' THEN o_orderdate + INTERVAL 7 DAY END AS next_at
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def prefilter_cascade(spark, d):
    j = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    first = rules.cascade([(F.col("c_custkey").isNull(), "dropped", "no-owner"), (F.col("o_totalprice") < 5000, "dropped", "small"), ((F.col("c_acctbal") < 0) & (F.col("c_mktsegment") != "BUILDING"), "deferred", "owner"), (F.col("o_orderpriority") == "5-LOW", "deferred", "young")], "queued")
    return j.select("o_orderkey", first.alias("f"), "o_orderdate").select("o_orderkey", "f.state", "f.reason", F.when(F.col("f.state") == "deferred", F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("next_at"))


@query("""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, date_trunc('year', o_orderdate) ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 2""")
def owner_cap_topn(spark, d):
    o = t(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return discovery.capped(o, ["o_custkey", "year"], [F.col("o_orderpriority"), F.desc("o_orderdate"), F.col("o_orderkey")], 2).select("o_orderkey", "o_custkey")


@query("""WITH b AS (SELECT *, (o_orderkey % 3 = 0)::INT AS is_new FROM orders)
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, is_new, o_orderkey) <= 5 AS kept FROM b""")
def owner_cap_incremental(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    fresh = F.col("o_orderkey") % 3 == 0
    return discovery.capped_with_incumbents(o.where(~fresh), o.where(fresh), ["o_custkey"], "o_orderpriority", [F.col("o_orderkey")], 5).select("o_orderkey", "kept")


@query("""WITH d AS MATERIALIZED (SELECT o_orderkey, md5('q:' || o_orderkey) AS h FROM orders WHERE o_orderpriority > '3' ORDER BY h LIMIT 10),
r AS MATERIALIZED (SELECT o.* FROM orders o LEFT JOIN d USING (o_orderkey) WHERE d.h IS NULL ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 90),
h AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) - 1 AS k FROM r)
SELECT o_orderkey, (row_number() OVER (ORDER BY h) - 1) * 10 + 9 AS place, true AS explored FROM d UNION ALL SELECT o_orderkey, k + least(k // 9, 10), false FROM h""")
def explore_queue(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    found = discovery.explored_queue(o, "o_orderkey", [F.col("o_orderpriority"), F.desc("o_orderdate"), F.col("o_orderkey")], F.col("o_orderpriority") > "3", s.draw("q", F.col("o_orderkey")), 100, 0.1)
    return found.select("o_orderkey", "place", "explored")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, event_id) AS n FROM events WHERE event_type <> 'error') WHERE n = 1""")
def archive_priority_dedupe(spark, d):
    e = t(spark, d, "events").where("event_type <> 'error'")
    key = F.struct("user_id", F.date_trunc("hour", "ts"))
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    return discovery.first_by_rank(e, key, rank, ["event_id"]).select("event_id", "user_id", "event_type")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, max(event_id) FILTER (event_id = last_id) AS event_id FROM (SELECT *, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS last_id FROM events) GROUP BY user_id")
def upsert_fold(spark, d):
    return folds.latest(t(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "value", "event_id"])


@query("""WITH p AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN value END AS a, event_type = 'click' AS has_a, CASE WHEN event_type = 'view' THEN value END AS b, event_type IN ('view', 'error') AS has_b FROM events)
SELECT user_id, arg_max_null(a, event_id) FILTER (has_a) AS a, arg_max_null(b, event_id) FILTER (has_b) AS b FROM p GROUP BY user_id""")
def patch_fold(spark, d):
    e = t(spark, d, "events").withColumn("patch", F.when(F.col("event_type") == "click", F.create_map(F.lit("a"), F.col("value"))).when(F.col("event_type") == "view", F.create_map(F.lit("b"), F.col("value"))).when(F.col("event_type") == "error", F.create_map(F.lit("b"), F.lit(None).cast("double"))))
    return folds.patched(e, "user_id", ["event_id"], "patch", ["a", "b"])


@query("""WITH l AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'failed' ELSE 'done' END AS state FROM events),
f AS (SELECT user_id, arg_max(state, event_id) AS state, arg_max(ts, event_id) AS "at", count(*) FILTER (state = 'start') AS attempts FROM l GROUP BY user_id)
SELECT user_id, state, "at", attempts, CASE WHEN state = 'failed' AND attempts < 20 THEN "at" + to_minutes((10 * pow(2, attempts))::BIGINT) END AS next_at FROM f""")
def ledger_backoff(spark, d):
    state = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "failed").otherwise("done")
    return folds.ledger(t(spark, d, "events").withColumn("state", state), "user_id", ["event_id"], "state", "ts", most_attempts=20)


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type) WHERE n <= 50""")
def history_on_change(spark, d):
    return folds.history(t(spark, d, "events"), "user_id", ["event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


_FEEDBACK = """f AS (SELECT event_id AS seq, user_id, (event_id % 500)::BIGINT AS "at", event_type AS action, CASE WHEN event_type = 'error' THEN ((event_id - (value::BIGINT % 40)) % 500)::BIGINT END AS undoes FROM events)"""


def _feedback(spark, d):
    e = t(spark, d, "events")
    undoes = F.when(F.col("event_type") == "error", F.pmod(F.col("event_id") - F.pmod(F.rint("value").cast("long"), F.lit(40)), F.lit(500)))
    return e.select(F.col("event_id").alias("seq"), "user_id", (F.col("event_id") % 500).alias("at"), F.col("event_type").alias("action"), undoes.alias("undoes"))


@query(f"WITH {_FEEDBACK.replace('((event_id - (value::BIGINT % 40)) % 500)', '((event_id - (value::BIGINT % 40) + 500) % 500)')} SELECT seq, user_id, action FROM f WHERE undoes IS NULL AND \"at\" NOT IN (SELECT undoes FROM f WHERE undoes IS NOT NULL)")
def feedback_fold_a(spark, d):
    return folds.without_undone(_feedback(spark, d), "at", "undoes").select("seq", "user_id", "action")


@query(f"WITH {_FEEDBACK.replace('((event_id - (value::BIGINT % 40)) % 500)', '((event_id - (value::BIGINT % 40) + 500) % 500)')} SELECT seq, user_id, action FROM f WHERE undoes IS NULL AND NOT EXISTS (SELECT 1 FROM f u WHERE u.user_id = f.user_id AND u.undoes = f.\"at\")")
def feedback_fold_b(spark, d):
    return folds.without_undone(_feedback(spark, d), "at", "undoes", "user_id").select("seq", "user_id", "action")


_LAST = "(list_filter(st, lambda x: x.action IN ({})))[-1].action"


@query(f"""WITH RECURSIVE {_FEEDBACK.replace('((event_id - (value::BIGINT % 40)) % 500)', '((event_id - (value::BIGINT % 40) + 500) % 500)')}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k, count(*) OVER (PARTITION BY user_id) AS last FROM f),
r AS (SELECT user_id, 0::BIGINT AS k, last, []::STRUCT("at" BIGINT, action VARCHAR)[] AS st FROM o WHERE k = 1 UNION ALL
SELECT user_id, k, last, CASE WHEN undoes IS NULL THEN list_append(st, {{'at': "at", 'action': action}}) WHEN len(st) = 0 THEN st ELSE list_concat(st[:i - 1], st[i + 1:]) END FROM
(SELECT r.user_id, o.k, r.last, st, undoes, o."at", action, coalesce(list_max(list_filter(range(1, len(st) + 1), lambda j: st[j]."at" = undoes)), len(st)) AS i FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1))
SELECT user_id, st[-1].action AS action, len(st)::BIGINT AS events_left, {_LAST.format("'purchase'")} AS bought, {_LAST.format("'click', 'view'")} AS moved FROM r WHERE k = last""")
def feedback_fold_c(spark, d):
    return folds.stacked_actions(_feedback(spark, d), "user_id", "seq", "at", "action", "undoes", {"bought": ["purchase"], "moved": ["click", "view"]})


_POSITIONS = """f AS (SELECT event_id AS seq, user_id, event_id % 500 AS "at", event_type AS action, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN (event_id + 490) % 500 END AS undoes, CASE WHEN event_type = 'error' AND event_id % 2 = 1 THEN event_id - 3 END AS undoes_seq, CASE WHEN value > 50 THEN ts END AS snooze FROM events)"""
_STATE = """SELECT user_id, (arg_max({'a': action, 's': snooze}, seq) FILTER (action NOT IN ('purchase', 'signup'))).a AS last_action, (arg_max({'a': action, 's': snooze}, seq) FILTER (action NOT IN ('purchase', 'signup'))).s AS snooze_until,
coalesce(arg_max(action, seq) FILTER (action IN ('purchase', 'signup')) = 'purchase', false) AS published FROM x GROUP BY user_id"""


def _positions(spark, d):
    e, error, even = t(spark, d, "events"), F.col("event_type") == "error", F.col("event_id") % 2 == 0
    return e.select(F.col("event_id").alias("seq"), "user_id", (F.col("event_id") % 500).alias("at"), F.col("event_type").alias("action"), F.when(error & even, (F.col("event_id") + 490) % 500).alias("undoes"), F.when(error & ~even, F.col("event_id") - 3).alias("undoes_seq"), F.when(F.col("value") > 50, F.col("ts")).alias("snooze"))


@query(f"WITH {_POSITIONS}, x AS (SELECT * FROM f WHERE undoes IS NULL AND undoes_seq IS NULL AND \"at\" NOT IN (SELECT undoes FROM f WHERE undoes IS NOT NULL) AND seq NOT IN (SELECT undoes_seq FROM f WHERE undoes_seq IS NOT NULL)) {_STATE}")
def feedback_state_a(spark, d):
    """The state that the index shows: undos by time or place, whosever they are."""
    active = folds.without_undone(_positions(spark, d), "at", "undoes", None, "seq", "undoes_seq")
    return folds.feedback_state(active, "user_id", ["seq"], "action", "snooze", ("purchase", "signup"))


@query(f"WITH {_POSITIONS}, x AS (SELECT * FROM f WHERE undoes IS NULL AND undoes_seq IS NULL AND NOT EXISTS (SELECT 1 FROM f u WHERE u.user_id = f.user_id AND (u.undoes = f.\"at\" OR u.undoes_seq = f.seq))) SELECT user_id, arg_max(action, seq) FILTER (action IN ('click', 'view')) AS last_action, CASE WHEN arg_max(action, seq) FILTER (action IN ('click', 'view')) = 'view' THEN (arg_max({{'s': snooze}}, seq) FILTER (action IN ('click', 'view'))).s END AS snooze_until, coalesce(arg_max(action, seq) FILTER (action IN ('purchase', 'signup')) = 'purchase', false) AS published FROM x GROUP BY user_id")
def feedback_state_b(spark, d):
    """The state of the queue: undos by time or place of the same key; clicks and views set it, views snooze, errors change nothing."""
    active = folds.without_undone(_positions(spark, d), "at", "undoes", "user_id", "seq", "undoes_seq")
    return folds.queue_state(active, "user_id", ["seq"], "action", "snooze", ["click", "view"], ["view"], ("purchase", "signup"))


@query("""SELECT user_id, list_sort(list_distinct(list(event_type))) AS flags, arg_max(value, event_id) FILTER (value > 50) AS big FROM events GROUP BY user_id""")
def owner_memory(spark, d):
    e = t(spark, d, "events").withColumn("big", F.when(F.col("value") > 50, F.col("value")))
    return folds.owner_memory(e, "user_id", "event_type", ["event_id"], ["big"])


@query("""WITH s AS (SELECT * FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(s.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_mktsegment, s.c_mktsegment) AS c_mktsegment, coalesce(n.c_acctbal, s.c_acctbal) AS c_acctbal,
CASE WHEN s.c_custkey IS NULL THEN 'insert' WHEN n.c_custkey IS NULL THEN 'keep' WHEN s.c_acctbal <> n.c_acctbal THEN 'update' ELSE 'same' END AS change FROM s FULL JOIN n ON s.c_custkey = n.c_custkey""")
def upsert_merge(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    seeds = c.where("c_custkey % 5 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return folds.upsert(c.where("c_custkey % 3 <> 0"), seeds, "c_custkey", ["c_mktsegment", "c_acctbal"])


@query("SELECT event_id FROM events WHERE event_type = 'purchase' OR ts >= TIMESTAMP '2024-01-31' - to_days(CASE event_type WHEN 'click' THEN 7 WHEN 'view' THEN 3 ELSE 14 END)")
def retention(spark, d):
    days = F.when(F.col("event_type") == "purchase", None).when(F.col("event_type") == "click", 7).when(F.col("event_type") == "view", 3).otherwise(14)
    return folds.retained(t(spark, d, "events"), "ts", F.lit("2024-01-31").cast("timestamp"), days).select("event_id")


@query("SELECT user_id, count(DISTINCT ts::DATE) AS days, min(ts) AS first_at, max(ts) AS last_at, count(*) FILTER (event_type = 'error') AS forced FROM events GROUP BY user_id")
def push_activity(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("days"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count_if(F.col("event_type") == "error").alias("forced"))


@query("""WITH w AS (SELECT user_id, date_trunc('week', ts) AS week, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, sum(n)::BIGINT AS gain4w FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY week DESC) AS k FROM w) WHERE k <= 4 GROUP BY user_id""")
def star_weeks_gain4w(spark, d):
    weeks = t(spark, d, "events").groupBy("user_id", F.date_trunc("week", "ts").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return discovery.capped(weeks, ["user_id"], [F.desc("week")], 4).groupBy("user_id").agg(F.sum("n").alias("gain4w"))


def _spans(spark, d):
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return t(spark, d, "events").where("event_type = 'view'").select("user_id", at.alias("a"), (at + F.rint("value").cast("long") * 600).alias("b"))


_SPANS = "s AS (SELECT user_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + round_even(value, 0)::BIGINT * 600 AS b FROM events WHERE event_type = 'view')"
_MERGED = f"""{_SPANS}, r AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum((reach IS NULL OR a > reach + 1)::INT) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM r), m AS (SELECT user_id, min(a) AS a, max(b) AS b FROM i GROUP BY user_id, island)"""


@query(f"WITH {_MERGED} SELECT user_id, a, b FROM m")
def interval_merge(spark, d):
    return discovery.merged_spans(_spans(spark, d), "a", "b", ["user_id"]).select("user_id", "a", "b")


@query(f"WITH {_MERGED}, w AS (SELECT DISTINCT user_id, floor(epoch(ts))::BIGINT // 3600 * 3600 AS low FROM events) SELECT w.user_id, low, low + 3599 AS high, EXISTS (SELECT 1 FROM m WHERE m.user_id = w.user_id AND m.a <= low AND m.b >= low + 3599) AS covered FROM w")
def interval_covered(spark, d):
    low = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) * 3600).cast("long")
    windows = t(spark, d, "events").select("user_id", low.alias("low")).distinct().withColumn("high", F.col("low") + 3599)
    return discovery.covered(windows, discovery.merged_spans(_spans(spark, d), "a", "b", ["user_id"]), "low", "high", "a", "b", ["user_id"]).select("user_id", "low", "high", "covered")


@query("""WITH e AS (SELECT floor(epoch(ts))::BIGINT AS x, floor(epoch(ts))::BIGINT // 86400 * 86400 AS start FROM events), p AS (SELECT start, greatest(1, least(ceil(count(*) / 50.0), 86400))::BIGINT AS parts FROM e GROUP BY start)
SELECT e.start, e.start + (x - e.start) // ceil(86400.0 / parts)::BIGINT * ceil(86400.0 / parts)::BIGINT AS low, ceil(86400.0 / parts)::BIGINT AS width, count(*) AS n FROM e JOIN p USING (start) GROUP BY ALL""")
def adaptive_windows(spark, d):
    return discovery.split_windows(t(spark, d, "events"), "ts", 86_400, 50)


@query("""WITH RECURSIVE e AS (SELECT floor(epoch(ts))::BIGINT AS x, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT x, n, x // 86400 * 86400 AS start, x // 86400 * 86400 AS low, 86400::BIGINT AS width, (sum(n) OVER (PARTITION BY x // 86400))::BIGINT AS total FROM e
UNION ALL SELECT x, n, start, low + a, b - a, (sum(n) OVER (PARTITION BY low + a))::BIGINT FROM (SELECT *, i * width // parts AS a, (i + 1) * width // parts AS b FROM
(SELECT *, ((x - low + 1) * parts - 1) // width AS i FROM (SELECT *, least((total + 49) // 50, width) AS parts FROM r WHERE total > 50 AND width > 1))))
SELECT start, low, width, sum(n)::BIGINT AS n FROM r WHERE total <= 50 OR width <= 1 GROUP BY ALL""")
def adaptive_windows_whole(spark, d):
    """Splits on until every window fits; adaptive_windows splits once, as its SQL says."""
    return discovery.split_until(t(spark, d, "events"), "ts", 86_400, 50)


_PARTS = {"brand": "p_brand < 'Brand#3'", "size": "p_size <= 25", "price": "p_retailprice <= 1500"}


@query(f"""SELECT 'brand' AS facet, p_brand AS value, count(*) AS n FROM part WHERE {_PARTS['size']} AND {_PARTS['price']} GROUP BY ALL UNION ALL
SELECT 'size', CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 25 THEN 'middle' ELSE 'large' END, count(*) FROM part WHERE {_PARTS['brand']} AND {_PARTS['price']} GROUP BY ALL UNION ALL
SELECT 'price', (floor(p_retailprice / 250)::BIGINT)::VARCHAR, count(*) FROM part WHERE {_PARTS['brand']} AND {_PARTS['size']} GROUP BY ALL""")
def facet_counts(spark, d):
    size = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 25, "middle").otherwise("large")
    return views.facet_counts(t(spark, d, "part"), {"brand": (F.col("p_brand"), F.expr(_PARTS["brand"])), "size": (size, F.expr(_PARTS["size"])), "price": (F.floor(F.col("p_retailprice") / 250), F.expr(_PARTS["price"]))})


@query("""SELECT 'cheap' AS shelf, count(*) FILTER (p_retailprice < 1000) AS n FROM part UNION ALL SELECT 'large', count(*) FILTER (p_size > 40) FROM part UNION ALL SELECT 'none', 0""")
def shelf_counts(spark, d):
    return views.shelf_counts(t(spark, d, "part"), {"cheap": F.col("p_retailprice") < 1000, "large": F.col("p_size") > 40, "none": F.lit(False)})


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_type), 'a') AND contains(lower(p_name || ' ' || p_type), 'st') AND p_size BETWEEN 5 AND 30")
def shelf_filter(spark, d):
    return t(spark, d, "part").where(views.all_terms(F.concat_ws(" ", "p_name", "p_type"), "A st") & F.col("p_size").between(5, 30)).select("p_partkey")


_TASTE = """e AS (SELECT (event_id % (SELECT count(*) FROM part) + 1)::BIGINT AS p_partkey, event_type FROM events), f AS (SELECT p_partkey, p_brand AS facet FROM part UNION ALL SELECT p_partkey, 'size' || (p_size // 10) FROM part),
ta AS (SELECT facet, count(*) FILTER (event_type = 'purchase') AS liked, count(*) FILTER (event_type = 'error') AS disliked FROM e JOIN f USING (p_partkey) GROUP BY facet)"""


def _taste(spark, d):
    p = t(spark, d, "part")
    n = p.count()
    facets = p.select("p_partkey", F.explode(F.array("p_brand", F.concat(F.lit("size"), F.floor(F.col("p_size") / 10).cast("string")))).alias("facet"))
    events = t(spark, d, "events").select((F.col("event_id") % n + 1).alias("p_partkey"), "event_type")
    return facets, views.taste(events, facets, "p_partkey", F.col("event_type") == "purchase", F.col("event_type") == "error")


@query(f"WITH {_TASTE} SELECT facet, liked, disliked, round(ln((liked + 1) / (disliked + 1)), 6) AS affinity FROM ta")
def taste_affinity(spark, d):
    return _taste(spark, d)[1].withColumn("affinity", F.round("affinity", 6))


@query(f"WITH {_TASTE} SELECT p_partkey, round(greatest(-1, least(1, coalesce(avg(ln((liked + 1) / (disliked + 1))), 0))), 6) AS taste FROM f LEFT JOIN ta USING (facet) GROUP BY p_partkey")
def taste_term(spark, d):
    facets, tastes = _taste(spark, d)
    return views.taste_terms(facets, tastes, "p_partkey").withColumn("taste", F.round("taste", 6))


@query(f"""WITH RECURSIVE {_TASTE}, tt AS (SELECT p_partkey, round(greatest(-1, least(1, coalesce(avg(ln((liked + 1) / (disliked + 1))), 0))), 6) AS taste FROM f LEFT JOIN ta USING (facet) GROUP BY p_partkey),
x AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN 'high' ELSE 'low' END AS band, taste, p_retailprice, taste < 0 AS wild, row_number() OVER (PARTITION BY p_size > 25 ORDER BY p_retailprice / 200 + taste DESC, p_partkey) AS rk FROM part JOIN tt USING (p_partkey)),
o AS (SELECT band, CASE WHEN band = 'low' THEN (SELECT count(*) FROM x WHERE band = 'high') ELSE 0 END AS ahead FROM (SELECT DISTINCT band FROM x)), y AS (SELECT *, row_number() OVER (PARTITION BY band, wild ORDER BY rk) AS i FROM x),
r AS (SELECT band, ahead, 0::BIGINT AS p, 0::BIGINT AS ni, 0::BIGINT AS wi, NULL::BIGINT AS p_partkey FROM o UNION ALL
SELECT band, ahead, p + 1, ni + (NOT takes)::INT, wi + takes::INT, CASE WHEN takes THEN wk ELSE nk END FROM (SELECT r.band, r.ahead, r.p, r.ni, r.wi, w.p_partkey AS wk, n.p_partkey AS nk, w.rk IS NOT NULL AND ((r.ahead + r.p + 1) % 10 = 0 OR n.rk IS NULL OR w.rk < n.rk) AS takes
FROM r LEFT JOIN y n ON n.band = r.band AND NOT n.wild AND n.i = r.ni + 1 LEFT JOIN y w ON w.band = r.band AND w.wild AND w.i = r.wi + 1 WHERE n.rk IS NOT NULL OR w.rk IS NOT NULL))
SELECT p_partkey, r.band, x.taste, x.p_retailprice, ahead + p AS place FROM r JOIN x USING (p_partkey)""")
def for_you(spark, d):
    facets, tastes = _taste(spark, d)
    terms = views.taste_terms(facets, tastes, "p_partkey").withColumn("taste", F.round("taste", 6))
    index = t(spark, d, "part").join(terms, "p_partkey").select("p_partkey", F.when(F.col("p_size") > 25, "high").otherwise("low").alias("band"), "taste", "p_retailprice")
    return views.for_you(index, "band", [F.desc(F.col("p_retailprice") / 200 + F.col("taste")), F.col("p_partkey")], "taste", bands=["high", "low"])


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('2024-W01:' || source || ':' || doc_id)) AS n FROM documents) WHERE n <= 10")
def audit_sample(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "source")
    return views.sampled(rows, "source", s.draw("2024-W01", F.col("source"), F.col("doc_id")), 10)


@query("""WITH f AS (SELECT doc_id, 'plan' AS why FROM documents ORDER BY (n_chars BETWEEN 800 AND 1500) DESC, n_chars DESC, doc_id LIMIT 50)
SELECT * FROM f UNION ALL (SELECT doc_id, 'audit' FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM f) ORDER BY md5('audit:' || doc_id) LIMIT 5)""")
def review_plan(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return views.review_plan(rows, F.col("n_chars").between(800, 1500), F.col("lang") == "en", F.col("n_chars"), s.draw("audit", F.col("doc_id")), "doc_id", 50)


@query("""SELECT split_part(source || '/' || lang || '/' || doc_id, '/', 1) AS segment, true AS is_dir, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1 ORDER BY files DESC, segment LIMIT 40""")
def tree_summary(spark, d):
    paths = t(spark, d, "documents").select(F.concat_ws("/", "source", "lang", "doc_id").alias("path"), "n_chars")
    return views.tree_summary(paths, "path", "n_chars")


@query("""SELECT a.event_id, a.user_id, (SELECT arg_max(b.value, (b.ts)) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND b.ts <= a.ts) AS value FROM events a WHERE a.event_type = 'purchase'""")
def asof_stars(spark, d):
    e = t(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", "value")
    return joins.as_of(left, right, "user_id", "ts", "ts", "value").select("event_id", "user_id", "value")


@query("""WITH w AS (SELECT user_id, date_trunc('week', ts)::DATE AS week, count(*) AS n FROM events GROUP BY ALL) SELECT a.user_id, a.week::VARCHAR AS week, a.n AS now, b.n AS "then" FROM w a JOIN w b ON a.user_id = b.user_id AND b.week = a.week - 28""")
def week_cohort(spark, d):
    weeks = t(spark, d, "events").groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return joins.cohort(weeks, "user_id", "week", "n").withColumn("week", F.col("week").cast("string"))


@query("""SELECT user_id, max(ts) AS last_at, max(ts) < TIMESTAMP '2024-01-29' AS gone FROM events GROUP BY user_id""")
def recheck_gone(spark, d):
    e = t(spark, d, "events")
    ids = e.groupBy("user_id").agg(F.max("ts").alias("last_at"))
    return joins.missing(ids, e.where(F.col("ts") >= F.lit("2024-01-29").cast("timestamp")), "user_id").select("user_id", "last_at", "gone")


@query("""WITH s AS (SELECT user_id, event_type, event_id % 100 AS "at" FROM events WHERE event_id % 2 = 0), n AS (SELECT DISTINCT user_id, event_type, event_id % 100 AS "at" FROM events WHERE event_id % 2 = 1 AND value > 20)
SELECT * FROM s UNION ALL SELECT * FROM n ANTI JOIN s USING (user_id, event_type, "at")""")
def feedback_merge(spark, d):
    e = t(spark, d, "events").withColumn("at", F.col("event_id") % 100)
    own = ["user_id", "event_type", "at"]
    stored, new = e.where("event_id % 2 = 0").select(*own), e.where("event_id % 2 = 1").select(*own, "value")
    return joins.merged_feedback(stored, new.where("value > 20").select(*own), own, F.col("event_type").isNotNull())


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'blocked' WHEN c_mktsegment = 'MACHINERY' THEN 'opt-out' WHEN e.n IS NULL THEN 'no-record' WHEN e.n < 5 THEN 'too-young' END AS skip_reason FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) e ON c_custkey = e.user_id""")
def export_eligibility(spark, d):
    n = t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    j = t(spark, d, "customer").join(n, F.col("c_custkey") == F.col("user_id"), "left")
    first = rules.cascade([(F.col("c_acctbal") < 0, "skip", "blocked"), (F.col("c_mktsegment") == "MACHINERY", "skip", "opt-out"), (F.col("n").isNull(), "skip", "no-record"), (F.col("n") < 5, "skip", "too-young")], "export")
    return j.select("c_custkey", first["reason"].alias("skip_reason"))


@query("SELECT c_custkey, list_filter([CASE WHEN NOT (c_acctbal >= 0) THEN 'negative' END, CASE WHEN NOT (length(c_name) > 18) THEN 'short name' END], lambda x: x IS NOT NULL) AS problems FROM customer")
def row_problems(spark, d):
    return t(spark, d, "customer").select("c_custkey", rules.problems([(F.col("c_acctbal") >= 0, "negative"), (F.length("c_name") > 18, "short name")]).alias("problems"))


def _labelled(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return t(spark, d, "labels").join(docs, "doc_id").withColumn("positive", F.col("quality") == 1).withColumn("p", F.least(F.lit(1.0), F.col("n_chars") / 5000.0))


_LABELLED = "l AS (SELECT doc_id, lang, n_chars, quality = 1 AS positive, toxic, least(1.0, n_chars / 5000.0)::DOUBLE AS p FROM labels JOIN documents USING (doc_id))"
_AUC = "c AS (SELECT {by} n_chars AS s, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM l GROUP BY ALL), b AS (SELECT *, coalesce(sum(n) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)"


@query(f"WITH {_LABELLED}, {_AUC.format(by='', part='')} SELECT round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 9)::DOUBLE AS auc FROM b")
def auc(spark, d):
    return metrics.auc(_labelled(spark, d), "n_chars", F.col("positive")).withColumn("auc", F.round("auc", 9))


@query(f"WITH {_LABELLED}, {_AUC.format(by='lang,', part='PARTITION BY lang')} SELECT lang, round(sum(p * (below + n / 2.0)) / nullif(sum(p) * sum(n), 0), 9)::DOUBLE AS auc FROM b GROUP BY lang")
def auc_by_stratum(spark, d):
    return metrics.auc(_labelled(spark, d), "n_chars", F.col("positive"), ["lang"]).withColumn("auc", F.round("auc", 9))


@query(f"WITH {_LABELLED} SELECT avg(positive::INT) AS precision, count(*) AS taken FROM (SELECT * FROM l ORDER BY n_chars DESC, doc_id LIMIT 25)")
def precision_at_k(spark, d):
    return metrics.precision_at(_labelled(spark, d), [F.desc("n_chars"), F.col("doc_id")], F.col("positive"), 25)


@query(f"WITH {_LABELLED} SELECT round(avg(pow(p - positive::INT, 2)), 9) AS brier, count(*) AS n FROM l")
def brier(spark, d):
    return metrics.brier(_labelled(spark, d), F.col("p"), F.col("positive")).withColumn("brier", F.round("brier", 9))


@query(f"WITH {_LABELLED}, c AS (SELECT least(9, floor(p * 10))::INT AS bin, count(*) AS n, avg(p) AS mean_p, avg(positive::INT) AS share FROM l GROUP BY 1) SELECT r.range::INT AS bin, coalesce(n, 0) AS n, round(mean_p, 9) AS mean_p, round(share, 9) AS share FROM range(10) r LEFT JOIN c ON r.range = bin")
def reliability(spark, d):
    return metrics.reliability(_labelled(spark, d), F.col("p"), F.col("positive")).withColumns({"mean_p": F.round("mean_p", 9), "share": F.round("share", 9)})


@query(" UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, quantile_cont(n_chars, {q})::DOUBLE AS v FROM documents" for q in (0.1, 0.5, 0.9)))
def quantiles(spark, d):
    return metrics.quantiles(t(spark, d, "documents"), "n_chars", [0.1, 0.5, 0.9])


@query(f"""WITH {_LABELLED}, c AS (SELECT count(*) FILTER (h AND positive) AS tp, count(*) FILTER (h AND NOT positive) AS fp, count(*) FILTER (NOT h AND positive) AS fn, count(*) FILTER (NOT h AND NOT positive) AS tn FROM (SELECT *, n_chars > 1500 AS h FROM l))
SELECT *, round((tp / (tp + fn)) / (fp / (fp + tn)), 9) AS lr_plus FROM c""")
def lr_plus(spark, d):
    return metrics.likelihood_ratio(_labelled(spark, d), F.col("n_chars") > 1500, F.col("positive")).withColumn("lr_plus", F.round("lr_plus", 9))


@query(f"""WITH {_LABELLED}, x AS (SELECT positive::INT AS a, (n_chars > 1500)::INT AS b FROM l), n AS (SELECT count(*) AS n, avg((a = b)::INT) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM x) SELECT round((po - pe) / (1 - pe), 9) AS kappa, n FROM n""")
def kappa(spark, d):
    rows = _labelled(spark, d).select(F.col("positive").cast("int").alias("a"), (F.col("n_chars") > 1500).cast("int").alias("b"))
    return metrics.kappa(rows, "a", "b").withColumn("kappa", F.round("kappa", 9))


def _bootstrap_sql(key: str) -> str:
    weight = " + ".join(f"(u >= {x!r})::INT" for x in metrics.poisson_steps())
    return f"""WITH {_LABELLED}, d AS (SELECT rep.range AS rep, {key} AS k, n_chars AS s, positive, ('0x' || md5(rep.range || ':' || {key})[:8])::UINTEGER / 4294967296.0::DOUBLE AS u FROM l, range(200) rep),
w AS (SELECT rep, s, sum(w) FILTER (positive) AS p, sum(w) FILTER (NOT positive) AS n FROM (SELECT *, {weight} AS w FROM d) GROUP BY rep, s), b AS (SELECT rep, coalesce(p, 0) AS p, coalesce(n, 0) AS n, coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY rep ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM w),
a AS (SELECT rep, sum(p * (below + n / 2.0)) / nullif(sum(p) * sum(n), 0) AS auc FROM b GROUP BY rep) SELECT round(quantile_cont(auc, 0.025), 9)::DOUBLE AS low, round(quantile_cont(auc, 0.975), 9)::DOUBLE AS high, count(auc) AS n, 200 - count(auc) AS skipped FROM a"""


def _resampled(spark, d, key: str):
    u = F.conv(F.substring(F.md5(F.concat_ws(":", "rep", key).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    aucs = metrics.bootstrap(_labelled(spark, d), 200, u, lambda rows: metrics.auc(rows, "n_chars", F.col("positive"), ["rep"], F.col("weight")))
    return metrics.interval(aucs, "auc", 200).withColumns({"low": F.round("low", 9), "high": F.round("high", 9)})


@query(_bootstrap_sql("doc_id"))
def bootstrap_auc(spark, d):
    return _resampled(spark, d, "doc_id")


@query(_bootstrap_sql("lang"))
def bootstrap_auc_clustered(spark, d):
    """Rows of one language are drawn together."""
    return _resampled(spark, d, "lang")


@query()
def platt(spark, d):
    a, b = metrics.platt(_labelled(spark, d).withColumn("s", F.ln("n_chars")), "s", F.col("positive"))
    return spark.range(1).select(F.lit(a).alias("a"), F.lit(b).alias("b"))


@query("SELECT event_id, CAST(extract(isoyear FROM ts) AS VARCHAR) || '-W' || lpad(CAST(extract(week FROM ts) AS VARCHAR), 2, '0') AS week, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400e6, 6) AS days FROM events")
def iso_weeks(spark, d):
    return t(spark, d, "events").select("event_id", s.iso_week(F.col("ts")).alias("week"), F.round(s.days_between(F.col("ts"), F.lit("2024-02-01").cast("timestamp")), 6).alias("days"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_windows(spark, d):
    return t(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@query("""WITH g AS (SELECT *, (lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR)::INT AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, k""")
def session_windows(spark, d):
    return t(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("""SELECT doc_id, len(regexp_extract_all(text, '\\p{Latin}'))::INT AS latin, len(regexp_extract_all(text, '\\p{Cyrillic}'))::INT AS cyrillic, 'latin' AS script FROM documents""")
def script_shares(spark, d):
    counts = s.script_letters(F.col("text"))
    return t(spark, d, "documents").select("doc_id", counts["latin"].alias("latin"), counts["cyrillic"].alias("cyrillic"), s.script_of(F.col("text")).alias("script"))


@query("""SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links, length(regexp_replace(html, '(?s)<!--.*?(-->|$)', '', 'g'))::INT AS bare, len(regexp_extract_all(html, '<!--'))::INT AS comments FROM pages""")
def page_links(spark, d):
    return t(spark, d, "pages").select("page_id", s.hrefs(F.col("html")).alias("links"), F.length(s.without_comments(F.col("html"))).alias("bare"), s.comments(F.col("html")).alias("comments"))


@query("SELECT page_id, regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def url_parts(spark, d):
    return t(spark, d, "pages").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.try_parse_url("url", F.lit("PATH")).alias("path"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS folded FROM documents")
def norm_ws(spark, d):
    return t(spark, d, "documents").select("doc_id", s.normalise_space(F.col("text")).alias("folded"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n FROM events WHERE ts < (SELECT date_trunc('hour', max(ts) - INTERVAL 15 MINUTE) FROM events) GROUP BY ALL")
def stream_hourly(spark, d):
    from lodestone.streaming import streams

    source = t(spark, d, "events")
    events = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.run_once(streams.hourly(events, "ts", "event_type"), *_scratch(spark, "hourly"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def stream_latest(spark, d):
    from lodestone.streaming import streams

    events = spark.readStream.schema(t(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return streams.run_once(streams.latest(events, "user_id", ["ts", "event_id"], ["event_type"]), *_scratch(spark, "latest"), mode="complete")


def _scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    """Folders for a stream's rows and state, in the session's shared folder."""
    import uuid

    base = shared_folder(spark)
    return f"{base}/stream-{name}-{(own := uuid.uuid4().hex)}", f"{base}/state-{name}-{own}"
