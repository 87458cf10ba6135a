"""Rules, folds, metrics and texts at their boundaries, on small frames."""

import datetime
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars as s
from lodestone.operators import discovery, folds, joins, metrics, rules, scoring, views
from lodestone.plans import tables
from lodestone.sources import events_log
from lodestone.streaming import streams


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, s.fnv1a(F.lit("hello"))) == 1335831723 and one(spark, s.fnv1a(F.lit(""))) == 2166136261
    assert one(spark, s.iso_week(F.lit("2026-09-11").cast("timestamp"))) == "2026-W37"
    assert one(spark, s.iso_week(F.lit("2024-12-30").cast("timestamp"))) == "2025-W01"
    assert one(spark, s.half_up(F.lit(-2.5), 0)) == -2 and one(spark, s.tidy(F.lit(-0.0))) == 0
    assert one(spark, s.cut_utf8(F.lit("añb"), 2)) == "a" and one(spark, s.cut_utf8(F.lit("añb"), 3)) == "añ" and one(spark, s.cut_utf8(F.lit("añb"), 9)) == "añb"
    assert one(spark, s.fence_lines(F.lit("```sh\nx\n```\n~~~\ny\n~~~"))) == 4 and one(spark, s.fence_lines(F.lit("```\r\na\r```"))) == 2
    assert one(spark, s.without_comments(F.lit("a<!-- b --> c <!-- d"))) == "a c " and one(spark, s.comments(F.lit("a<!-- b --> c <!-- d"))) == 2
    assert one(spark, s.invisible_run(F.lit("a​​​b"))) == 3 and one(spark, s.invisible_run(F.lit("ab"))) == 0
    assert one(spark, s.script_of(F.lit("漢字漢字漢字 abcdefgh"))) == "cjk" and one(spark, s.script_of(F.lit("漢字"))) == "latin"
    assert one(spark, s.distinct_words(F.lit("Slot gacor slots"), ["slot", "gacor"])) == 2
    assert one(spark, s.clone_targets(F.lit("git clone https://host.example/b/x.git now"))) == ["b/x"]
    assert one(spark, s.safe_link(F.lit("https://a.example/x"))) and one(spark, s.safe_link(F.lit("javascript:alert(1)"))) is None and one(spark, s.safe_link(F.lit("https://u:p@a.example/"))) is None
    assert one(spark, s.sat(F.lit(0), 25)) == 0 and one(spark, s.sat(F.lit(25), 25)) == 1 and one(spark, s.normalise_space(F.lit(" a  b "))) == "a b"
    with pytest.raises(ValueError):
        s.sat(F.lit(1), 0)


def test_scoring(spark):
    rows = spark.createDataFrame([(1, True, True, None), (2, False, False, True)], "id long, a boolean, b boolean, c boolean")
    signals = [scoring.Signal("prose", -2, F.col("a"), "prose"), scoring.Signal("mdheavy", -1, F.col("b"), "prose"), scoring.Signal("ci", 1, F.col("c"))]
    found = {r["id"]: r for r in scoring.points(scoring.signal_rows(rows, "id", signals), "id").collect()}
    assert (found[1]["points"], found[1]["coverage"], found[2]["points"], found[2]["coverage"]) == (-2, 0.75, 1, 1)
    assert {r["id"]: r["p"] for r in rows.select("id", scoring.points_in_row(signals).alias("p")).collect()} == {1: -2, 2: 1}
    items = spark.createDataFrame([(1, "a", 0.3), (1, "a", 0.2), (1, "b", 0.4)], "id long, grp string, strength double")
    assert scoring.confidence(items, "id").first()["confidence"] == 0.58
    assert one(spark, scoring.gem(F.lit(8.0), F.lit(0.3), F.lit(0.0))) == 8.45
    assert [round(one(spark, scoring.quality(F.lit(float(x)))), 2) for x in (3, 5, 7, 9)] == [0.04, 0.30, 0.80, 0.97]


def test_rules(spark):
    first = rules.cascade([(F.col("x") > 5, "dropped", "big"), (F.col("x") > 3, "deferred", "middle")], "queued")
    found = spark.createDataFrame([(9,), (4,), (1,), (None,)], "x int").select(first.alias("f")).collect()
    assert [(r["f"]["state"], r["f"]["reason"]) for r in found] == [("dropped", "big"), ("deferred", "middle"), ("queued", None), ("queued", None)]
    assert one(spark, rules.prior(F.lit(True), F.lit(None).cast("boolean"), F.lit(False))) == 1
    assert one(spark, rules.problems([(F.lit(True), "a"), (F.lit(None).cast("boolean"), "b")])) == ["b"]


def test_folds(spark):
    log = spark.createDataFrame([(1, 1, {"a": 1.0, "b": 2.0}), (1, 2, {"a": None}), (2, 1, {"b": 5.0}), (1, 0, {"a": 9.0})], "id long, seq long, patch map<string,double>")
    assert {(r["id"], r["a"], r["b"]) for r in folds.patched(log, "id", ["seq"], "patch", ["a", "b"]).collect()} == {(1, None, 2.0), (2, None, 5.0)}
    at = datetime.datetime(2024, 1, 1)
    runs = spark.createDataFrame([("u", 1, "start", at), ("u", 2, "failed", at), ("u", 3, "start", at), ("u", 4, "failed", at)], "key string, seq long, state string, at timestamp")
    found = folds.ledger(runs, "key", ["seq"], "state", "at").first()
    assert found["attempts"] == 2 and found["next_at"] == at + datetime.timedelta(minutes=40)
    assert folds.ledger(runs, "key", ["seq"], "state", "at", most_attempts=2).first()["next_at"] is None
    points = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, "y"), (1, 4, None), (1, 5, None)], "id long, seq long, lane string")
    assert [r["seq"] for r in folds.history(points, "id", ["seq"], ["lane"]).orderBy("seq").collect()] == [1, 3, 4]
    doubled = log.unionByName(log)  # a replay changes nothing
    assert folds.patched(doubled, "id", ["seq"], "patch", ["a", "b"]).exceptAll(folds.patched(log, "id", ["seq"], "patch", ["a", "b"])).isEmpty()


def test_three_undo_folds(spark):
    schema = "seq long, id long, at long, action string, undoes long"
    log = spark.createDataFrame([(1, 1, 1, "gem", None), (2, 2, 1, "gem", None), (3, 1, 2, "undo", 1)], schema)
    assert folds.without_undone(log, "at", "undoes").count() == 0
    assert [r["id"] for r in folds.without_undone(log, "at", "undoes", "id").collect()] == [2]
    assert {r["id"]: r["action"] for r in folds.stacked_actions(log, "id", "seq", "at", "action", "undoes").collect()} == {1: None, 2: "gem"}
    unknown = spark.createDataFrame([(1, 1, 1, "gem", None), (2, 1, 2, "undo", 9)], schema)
    assert folds.without_undone(unknown, "at", "undoes").count() == folds.without_undone(unknown, "at", "undoes", "id").count() == 1
    assert folds.stacked_actions(unknown, "id", "seq", "at", "action", "undoes").first()["events_left"] == 0


def test_discovery(spark):
    spans = spark.createDataFrame([(0, 10), (11, 20), (30, 40), (32, 35)], "a long, b long")
    assert sorted(map(tuple, discovery.merged_spans(spans, "a", "b").collect())) == [(0, 20), (30, 40)]
    queue = spark.createDataFrame([(k, k % 3) for k in range(60)], "id long, prior int")
    found = discovery.explored_queue(queue, "id", [F.desc("prior"), F.col("id")], F.col("prior") <= 1, s.draw("x", F.col("id")), 20, 0.2).orderBy("place").collect()
    assert [r["place"] for r in found] == list(range(20)) and len({r["id"] for r in found}) == 20 and [r["place"] for r in found if r["explored"]] == [4, 9, 14, 19]
    stored, new = spark.createDataFrame([(1, "o", 2), (2, "o", 1)], "id long, owner string, prior int"), spark.createDataFrame([(3, "o", 3), (4, "o", 1)], "id long, owner string, prior int")
    kept = discovery.capped_with_incumbents(stored, new, ["owner"], "prior", [F.col("id")], 3)
    assert {r["id"] for r in kept.where("kept").collect()} == {1, 2, 3}


def test_windows_split_until_they_fit(spark):
    # A hot second, a hot hour and some single rows of one day.
    at = [1_000] * 120 + [7_200 + k * 36 // 10 for k in range(1_000)] + [50_000, 70_000, 86_399]
    events = spark.createDataFrame([(x,) for x in at], "x long").select(F.timestamp_seconds("x").alias("ts"))
    found = discovery.split_until(events, "ts", 86_400, 50).collect()
    assert all(r["n"] <= 50 or r["width"] == 1 for r in found) and sum(r["n"] for r in found) == len(at)
    assert [(r["low"], r["n"]) for r in found if r["n"] > 50] == [(1_000, 120)]
    assert all(sum(r["low"] <= x < r["low"] + r["width"] for r in found) == 1 for x in set(at))
    assert all(r["n"] == sum(r["low"] <= x < r["low"] + r["width"] for x in at) for r in found)


def test_views(spark):
    rows = spark.createDataFrame([("py", 1), ("py", 5), ("rs", 1), (None, 1)], "lang string, stars int")
    counts = {(r["facet"], r["value"]): r["n"] for r in views.facet_counts(rows, {"lang": (F.col("lang"), F.col("lang") == "py"), "stars": (F.col("stars"), F.col("stars") == 1)}).collect()}
    assert counts == {("lang", "py"): 1, ("lang", "rs"): 1, ("lang", None): 1, ("stars", "1"): 1, ("stars", "5"): 1}
    entries = spark.createDataFrame([(k, "b", -0.5 if k in (2, 30) else 0.5) for k in range(1, 31)], "id long, band string, taste double")
    placed = {r["place"]: r["id"] for r in views.for_you(entries, "band", [F.col("id")], "taste").collect()}
    assert placed[2] == 2 and placed[10] == 30 and placed[11] == 10 and sorted(placed) == list(range(1, 31))
    assert views.shelf_counts(rows, {"none": F.lit(False)}).first()["n"] == 0


def places_one_by_one(rows, every, ahead):
    """id to place behind `ahead` rows, for (id, taste) in order: the definition, slot by slot."""
    left, places = list(rows), {}
    while left:
        turn = (ahead + len(places) + 1) % every == 0
        pick = next((r for r in left if r[1] is not None and r[1] < 0), left[0]) if turn else left[0]
        left.remove(pick)
        places[pick[0]] = ahead + len(places) + 1
    return places


def test_for_you_by_brute_force(spark):
    draw = random.Random(8)
    shares = {"none": 0, "few": 0.03, "some": 0.15, "many": 0.6, "all": 1, None: 0.1}
    rows = [(k, band, draw.choice([-0.5, -0.1]) if draw.random() < share else draw.choice([0.0, 0.5, None])) for k, (band, share) in enumerate(x for x in shares.items() for _ in range(150))]
    rows += [(10_000 + k, "late", -0.5 if k >= 70 else 0.5) for k in range(100)] + [(20_000 + k, "early", -0.5 if k < 30 else 0.5) for k in range(100)]
    table = spark.createDataFrame(rows, "id long, band string, taste double").repartition(5)
    for every in (10, 3):
        found = {r["id"]: r["place"] for r in views.for_you(table, "band", [F.col("id")], "taste", every).collect()}
        want = {}
        for band in sorted({r[1] for r in rows}, key=lambda b: (b is not None, b)):
            want |= places_one_by_one([(i, t) for i, b, t in rows if b == band], every, len(want))
        assert found == want


def test_for_you_places_all_parts(spark, tmp_path):
    n = 20_050
    part = spark.range(1, n + 1).select(F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#"), F.col("id") % 7).alias("p_brand"), (F.col("id") % 50 + 1).cast("int").alias("p_size"), (F.col("id") % 997 + 900.0).alias("p_retailprice"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    spark.range(500).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, "purchase").otherwise("error").alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    assert tables.for_you(spark, str(tmp_path)).count() == n


def test_auc_by_counting_pairs(spark):
    draw = random.Random(2)
    rows = [(draw.randint(0, 8), draw.random() < 0.4) for _ in range(200)]
    pos, neg = [x for x, y in rows if y], [x for x, y in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert abs(metrics.auc(spark.createDataFrame(rows, "s int, y boolean"), "s", F.col("y")).first()["auc"] - want) < 1e-12
    assert metrics.auc(spark.createDataFrame([(2, True), (1, False), (2, False)], "s int, y boolean"), "s", F.col("y")).first()["auc"] == 0.75
    assert metrics.auc(spark.createDataFrame([(1, True)], "s int, y boolean"), "s", F.col("y")).first()["auc"] is None


def test_metrics(spark):
    xs = spark.createDataFrame([(1,), (2,), (3,), (10,)], "x int")
    assert metrics.quantiles(xs, "x", [0.5]).first()["v"] == 2.5
    hits = spark.createDataFrame([(True, True)] * 3 + [(False, False)] * 4 + [(None, True)], "h boolean, y boolean")
    found = metrics.likelihood_ratio(hits, F.col("h"), F.col("y")).first()
    assert (found["tp"], found["fp"], found["fn"], found["tn"]) == (3, 0, 0, 4) and abs(found["lr_plus"] - (3.5 / 4) / (0.5 / 5)) < 1e-12
    same = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert metrics.kappa(same, "a", "b").first()["kappa"] == 1
    draw = random.Random(4)
    rows = [(x, draw.random() < 1 / (1 + 2.718281828 ** -(x - 2))) for x in [draw.uniform(-3, 7) for _ in range(3_000)]]
    a, b = metrics.platt(spark.createDataFrame(rows, "s double, y boolean"), "s", F.col("y"))
    assert abs(a + 2) < 0.35 and abs(b - 1) < 0.15
    bins = metrics.reliability(spark.createDataFrame([(1.0, True), (0.05, False)], "p double, y boolean"), F.col("p"), F.col("y")).orderBy("bin").collect()
    assert [r["n"] for r in bins] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 1] and bins[3]["share"] is None


def test_joins(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "id long, at long")
    right = spark.createDataFrame([(1, 2, 10), (1, 5, 20), (1, 7, 30)], "id long, at long, v long")
    assert {(r["id"], r["at"], r["v"]) for r in joins.as_of(left, right, "id", "at", "at", "v").collect()} == {(1, 5, 20), (1, 1, None), (2, 9, None)}


def test_log_files(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_bytes("﻿".encode() + b'{"a": 1, "kind": "keep"}\r\n{"a": 2, "kind"\n\n{"a": 3, "kind": "skip"}\n{"a": 4, "kind": "keep\xe2\x80\xa8x"}\n')
    from pyspark.sql.types import StructType

    schema = StructType().add("a", "long").add("kind", "string")
    rows = events_log.parsed(events_log.read_lines(spark, str(path)), schema).collect()
    assert sorted(r["a"] for r in rows if r["bad"] is None) == [1, 3, 4] and sum(r["bad"] is not None for r in rows) == 1
    assert events_log.read_lines(spark, str(path), contains=["keep"]).count() == 2
    events_log.write_log(spark.createDataFrame([(1, "x")], "a long, day string"), str(tmp_path / "out"), by="day", gz=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"id": k % 3, "seq": k, "ts": f"2024-01-01T{k % 5:02d}:00:00Z", "kind": "a"} for k in range(30)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("id long, seq long, ts timestamp, kind string").json(str(tmp_path / "in"))
    latest = streams.run_once(streams.latest(stream, "id", ["seq"], ["seq"]), str(tmp_path / "l"), str(tmp_path / "lc"), mode="complete")
    assert {(r["id"], r["seq"]) for r in latest.collect()} == {(0, 27), (1, 28), (2, 29)}
    assert streams.run_once(streams.first_seen(stream, "id", "ts"), str(tmp_path / "f"), str(tmp_path / "fc")).count() == 3


def test_queue_state(spark):
    log = [(1, 1, "gem", None), (1, 2, "label", "2030-01-01"), (2, 1, "snooze", "2030-01-02"), (2, 2, "publish", None), (3, 1, "wip", "2030-01-03"), (3, 2, "notmine", "2030-01-04"), (4, 1, "label", None), (5, 1, "publish", None), (5, 2, "unpublish", None), (5, 3, "wip", None)]
    found = folds.queue_state(spark.createDataFrame(log, "id long, seq long, action string, until string"), "id", ["seq"], "action", "until")
    assert sorted(map(tuple, found.collect())) == [(1, "gem", None, False), (2, "snooze", "2030-01-02", True), (3, "notmine", None, False), (4, None, None, False), (5, "wip", None, False)]


def test_draws(spark):
    got = [r["x"] for r in spark.range(1, 5).select(s.mulberry32(F.lit(42), F.col("id")).alias("x")).orderBy("id").collect()]
    assert got == [0.6011037519201636, 0.44829055899754167, 0.8524657934904099, 0.6697340414393693]  # the published generator's first numbers
    draw = random.Random(2)
    for total in (1, 2, 7, 40):
        draws = [draw.random() for _ in range(draw.randint(0, 50))]
        shuffled = list(range(total))
        for i, x in enumerate(draws[:total]):
            j = i + int(x * (total - i))
            shuffled[i], shuffled[j] = shuffled[j], shuffled[i]
        assert views.drawn_places(draws, total) == shuffled[: len(draws)]
    rows = spark.range(30).withColumn("k", F.col("id") * 7 % 31)
    assert sorted(r["id"] for r in views.drawn(rows, [F.col("k")], 50, 3).collect()) == list(range(30))
    assert views.drawn(rows.where("id < 0"), [F.col("k")], 3, 3).count() == 0 and views.drawn(rows, [F.col("k")], 0, 3).count() == 0


def test_scan_windows(spark):
    rows = [(s, v) for s in range(100, 130) for v in (0, 1, 1, 5)] + [(500, 9)] * 3 + [(90, 99)] * 50
    table = spark.createDataFrame(rows, "s long, v int").withColumn("at", F.timestamp_seconds("s"))
    found = {(r["low"], r["width"], r["part"]): (r["n"], r["saturated"]) for r in discovery.scan_windows(table, "at", "v", 1000, 10, 10, 12, 0, 25).collect()}
    assert sum(n for n, _ in found.values()) == 123 and all(w <= 10 or n <= 10 for (_, w, _), (n, _) in found.items())
    for (low, width, part), (n, full) in found.items():
        of = {"0": [0], "1": [1], "2..25": range(2, 26), None: range(26)}[part]
        assert n == sum(low <= s < low + width and v in of for s, v in rows) and full == (n > 12)
    crowded = {(low, width) for low, width, part in found if part}
    assert crowded and all((*w, p) in found for w in crowded for p in ("0", "1", "2..25"))
    assert [k for k, _, _ in discovery.value_parts(3, 3)] == ["3"] and [k for k, _, _ in discovery.value_parts(0, 1)] == ["0", "1"]
    units = spark.createDataFrame([("d", 0, 10, None), ("d", 10, 5, "0"), ("d", 10, 5, "1"), ("d", 10, 5, "2..25"), ("d", 15, 5, "0"), ("d", 20, 5, None), ("e", 0, 5, "0")], "day string, low long, width long, part string")
    assert sorted(map(tuple, discovery.done_spans(units, ["0", "1", "2..25"], ["day"]).select("day", "start", "end").collect())) == [("d", 0, 14), ("d", 20, 24)]


def test_letters_are_counted_in_runs(spark):
    """The same numbers as a match a letter, which took a match for each."""
    texts = [None, "", "a1b2 caf\u00e9", "\u0436\u0437 x \u4e2d\u6587\U00020000 \U0001d400\u2167\u00aa", "\u0639\u0631 \u0001\n"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    counts = s.script_letters(F.col("t"))
    found = rows.select(*[c.alias(k) for k, c in counts.items()], *[F.regexp_count("t", F.lit(f"[{v}]")).alias(f"want_{k}") for k, v in s.SCRIPTS.items()]).collect()
    assert all(r[k] == r[f"want_{k}"] for r in found for k in counts)
    assert "regexp_count" not in rows.select(s.script_of(F.col("t")), *counts.values())._jdf.queryExecution().optimizedPlan().toString()
