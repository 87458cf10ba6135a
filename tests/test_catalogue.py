"""The rule catalogue: a hit, a miss and an unknown or inapplicable case of each rule, by hand."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import readers, scalars
from lodestone.operators import catalogue
from lodestone.plans.rule_cases import CASES, GATE_CASES, ITEM_CASES, NOW, REMARKS

@pytest.fixture(scope="module")
def judged(spark):
    """All cases, scored at once."""
    cases = [*CASES, *GATE_CASES, *ITEM_CASES, *REMARKS]
    lines = [json.dumps({"nwo": "me/name", "owner": "me", "name": "name"} | facts) for _, facts, _ in cases]
    rows = spark.createDataFrame(list(enumerate(lines)), "at int, line string").select("at", F.from_json("line", catalogue.FACTS).alias("f")).select("at", "f.*")
    return {r["at"]: r for r in catalogue.scored(rows, F.lit(NOW), allow=["big"], deny=["denied"]).collect()}, cases


def test_each_rule(judged):
    found, cases = judged
    wrong = []
    for at, (name, _, want) in enumerate(cases):
        r = found[at]
        if name[0] in "qps":
            s = next(s for s in r["signals"] if s["id"] == name)
            got = {"ok": str(int(bool(s["hit"]))), "unknown": "u", "na": "n"}[s["status"]]
        elif name[0] == "k":
            s = next(s for s in r["items"] if s["id"] == name)
            got = None if s["status"] == "unknown" else round(s["strength"], 9)
        else:
            got = name in r["gates" if name[0] == "g" else "descriptors"]
        if got != want:
            wrong.append((at, name, cases[at][1], want, got))
    assert not wrong


def test_points_and_lane(spark, judged):
    for r in judged[0].values():
        hits = {s["id"]: catalogue.SIGNALS[s["id"]] for s in r["signals"] if s["hit"]}
        prose = [w for w, _, g in hits.values() if g]
        assert r["points"] == sum(w for w, _, g in hits.values() if not g) + min(prose, default=0)
        shut = {catalogue.GATES[g] for g in r["gates"]}
        assert (r["lane"] == "quarantine") == ("quarantine" in shut)
        assert r["points_max"] == sum(max(catalogue.SIGNALS[s["id"]][0], 0) for s in r["signals"] if s["status"] != "na")
    lane = lambda *a: spark.range(1).select(catalogue.lane(*[F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)).cast("array<string>") for x in a])).first()[0]
    assert lane(["quarantine"], "gem", 0.9, 0, 0, False, True) == "quarantine"
    assert lane([], "gem", 0.9, 0, 0, False, True) == "gone"
    assert lane(["institutional"], "gem", 0.9, 99, 0, False, False) == "institutional"
    assert lane([], "gem", 0.9, 26, 99, False, False) == "graduated"
    assert lane([], "gem", 0.9, 25, 10, True, False) == "rising"
    assert lane(["doubt"], "gem", 0.9, 25, 9, False, False) == "doubted"
    assert lane([], "gem", 0.9, 25, None, True, False) == "doubted"
    assert [lane(["drop"], b, k, None, None, None, None) for b, k in (("gem", 0.5), ("gem", 0.49), ("look", 0.9), ("low", 0.9))] == ["proven", "promising", "look", "low"]


def test_prefilter(spark):
    base = {"nwo": "o/n", "diskKB": 500, "lang": "Go", "createdAt": "2026-09-09T00:00:00Z", "stars": 0}
    cases = [({"isMirror": True, "stars": 99}, "dropped", "excluded-kind"), ({"stars": 26}, "dropped", "attention"), ({"diskKB": 199}, "dropped", "too-small"), ({"nwo": "Me/me"}, "dropped", "profile-or-site"), ({"nwo": "a/x.GitHub.io"}, "dropped", "profile-or-site"), ({"nwo": "a/nvim"}, "dropped", "profile-or-site"), ({"nwo": "a/my-keygen"}, "quarantined", "lure-name"), ({"description": "judi togel"}, "dropped", "spam-words"), ({"flags": ["farm"], "lang": None}, "dropped", "farm-owner"), ({"lang": None}, "deferred", "no-language-yet"), ({"lang": None, "createdAt": "2026-09-04T00:00:00Z"}, "dropped", "no-language"), ({"count": 5}, "dropped", "owner-cap"), ({"count": 4}, "queued", None)]
    schema = "nwo string, description string, stars long, diskKB long, lang string, createdAt string, isFork boolean, isArchived boolean, isTemplate boolean, isMirror boolean, flags array<string>, count int"
    rows = spark.createDataFrame([(i, json.dumps(base | x)) for i, (x, _, _) in enumerate(cases)], "at int, line string").select("at", F.from_json("line", schema).alias("f")).select("at", "f.*")
    found = {r["at"]: r["p"] for r in rows.select("at", catalogue.prefilter(F.lit(NOW), F.col("flags"), F.col("count")).alias("p")).collect()}
    assert [(found[i]["state"], found[i]["reason"]) for i in range(len(cases))] == [(s, w) for _, s, w in cases]
    assert [i for i in found if found[i]["next_at"]] == [9] and found[9]["next_at"].isoformat()[:10] == "2026-09-16"


def test_verdict_effect(spark):
    good = {"status": "ok", "category": "G", "categoryConfidence": 0.9, "scores": [3, 3, 3, 3, 3], "claims": [{"supports": "category"}, {"supports": "x"}], "flags": []}
    cases = [({}, 1, None), ({"scores": [3, 3, 3, 3, 2]}, 0, None), ({"status": "failed"}, 0, None), ({"claims": [{"supports": "category"}]}, 0, None), ({"injectionSeen": True}, 0, "doubted"), ({"category": "S"}, -2, "doubted"), ({"category": "S", "categoryConfidence": 0.69}, 0, None), ({"category": "X", "claims": [{"supports": "x"}] * 2}, 0, "doubted"), ({"flags": ["re_upload"]}, 0, "doubted"), ({"flags": ["other"], "scores": []}, 0, None)]
    schema = "v struct<status:string,category:string,categoryConfidence:double,scores:array<double>,claims:array<struct<supports:string>>,flags:array<string>,injectionSeen:boolean>"
    rows = spark.createDataFrame([(i, json.dumps({"v": good | x})) for i, (x, _, _) in enumerate(cases)], "at int, line string").select("at", F.from_json("line", schema).alias("f")).select("at", "f.v")
    found = {r["at"]: tuple(r["e"]) for r in rows.select("at", catalogue.verdict_effect(F.col("v")).alias("e")).collect()}
    assert [found[i] for i in range(len(cases))] == [(p, x) for _, p, x in cases]


def test_readers(spark):
    said = lambda f, text: spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]
    text = "a `one` b ``two ` x`` \n```js\nthree\nfour\n```\nprose\n~~~~\nfive\n~~~\nsix"
    assert said(readers.code_parts, text) == ["one", "two ` x", "three\nfour", "five\n~~~\nsix"]
    assert "prose" in said(readers.prose, text) and "three" not in said(readers.prose, text) and "one" not in said(readers.prose, text)
    refs = said(readers.references, "`npm run build` `yarn add x` `yarn lint` `./src/a.py:3:1` `Next.js` `https://x.y/z.py` `a.zip/b` `foo/bar` `dist/x.js` `src/a.py`, `path/to/x.py` `x.com/a.py` `<b>.py`")
    assert [(r["kind"], r["value"], r["weak"]) for r in refs] == [("script", "build", False), ("script", "lint", False), ("path", "src/a.py", False), ("path", "foo/bar", True), ("path", "dist/x.js", True)]
    found = said(readers.links, "[![badge](b.svg)](https://ci.x/y) [a](b_(c) \"t\")\n[ref]: <http://r.s/t> \n<https://auto.z> <a href='h.html'> see https://bare.q/x). and `[no](code)`")
    assert sorted(x["url"] for x in found) == sorted(["https://ci.x/y", "b.svg", "b_(c)", "http://r.s/t", "https://auto.z", "h.html", "https://bare.q/x"])
    assert [tuple(x) for x in said(readers.clone_addresses, "git clone git@github.com:a/b.git\nGIT  clone https://github.com/c/d\ngit clone https://gitlab.com/e/f")] == [("a", "b"), ("c", "d")]
    steps = readers.workflow_steps("jobs:\n  one:\n    continue-on-error: true\n    steps:\n    - run: pytest -q # all\n    - name: x\n      working-directory: 'sub'\n      run: >\n        npm\n        test\n  two:\n    steps:\n      - uses: a\n        with:\n          run: no\n")
    assert [(s["job"], s["run"], s["lenient"], s["folder"]) for s in steps] == [("one", "pytest -q", True, ""), ("one", "npm test", True, "sub")]


def test_commands_are_plain_rows():
    """A frame for each step cost a repository more than all rules."""
    step = {"run": "cd x && npm test || true; # no\n# pytest\npytest | tee log", "lenient": False, "folder": ""}
    assert readers.commands_of(step) == [("cd x && npm test || true; # no", c, i, "") for c, i in (("cd x", True), ("npm test", True), ("true", False), ("# no", False))] + [("pytest | tee log", c, False, "") for c in ("pytest", "tee log")]


def test_keys_are_dealt_to_all_tasks(spark, sf):
    from lodestone.plans import rules

    assert rules._keys(spark, sf, 3).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_patterns_are_spared(spark):
    """A text without the marks that a pattern needs isn't searched for it; what is found stays the same."""
    texts = [None, "", "plain words", "see WwW.a.example/x", "[r]: http://b.example", "a <b> = c ]( d", "```\nhttp://no.example\n```\n[x](http://yes.example)"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    found = rows.select(F.transform(readers.links(F.col("t")), lambda x: x["url"]).alias("u"), readers.prose(F.col("t")).alias("p"), readers.code_parts(F.col("t")).alias("c")).collect()
    assert [r["u"] for r in found] == [[], [], [], ["WwW.a.example/x"], ["http://b.example"], [], ["http://yes.example"]]
    assert [r["c"] for r in found] == [None, [], [], [], [], [], ["http://no.example"]] and found[0]["p"] is None and found[5]["p"] == texts[5]
    assert "CASE WHEN" in rows.select(readers.prose(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_rules_stay_compiled(spark):
    """A filter has all that it reads interpreted: gates are listed without one, and stored signals and items are found by their places."""
    rows = spark.createDataFrame([(0,), (1,), (2,)], "n int")
    shut = rows.select(catalogue.closed({"a": F.col("n") > 0, "b": F.lit(None).cast("boolean"), "c": F.col("n") < 2}).alias("g"))
    assert [r["g"] for r in shut.collect()] == [["c"], ["a", "c"], ["a"]]
    stored = "signals array<struct<id:string,status:string,hit:boolean,weight:double>>, items array<struct<id:string,status:string,strength:double>>, gates array<string>, stars long, forks long, gain4w long"
    said = [("q.ci", "ok", True, 1.0), None, ("s.webui", "ok", True, -2.0), ("q.ci", "na", None, 1.0), ("no.such", "ok", True, 9.0), (None, "ok", True, 9.0), ("q.licence", "ok", True, 1.0)]
    old = spark.createDataFrame([(said, [("k.time", "ok", 0.25), ("k.time", "ok", 0.9)], [], 0, 0, 0), ([], [], ["g.spam.words"], 0, 0, 0), (None, None, None, None, None, None)], stored)
    found = catalogue.rescored(old, catalogue.Weights())
    assert [(r["points"], r["points_max"], r["k"]) for r in found.collect()] == [(0.0, 13.0, 0.25), (0.0, 13.0, 0.0), (0.0, 13.0, 0.0)]
    for frame in (shut, found):
        assert "filter(" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_plain_texts_are_spared(spark):
    """What a text can't hold isn't looked for; what it holds is found as before."""
    texts = ["plain", "", None, "a\u200b\u200c\u200db\u00ad", "ümläut", "see x.y (z)", "GIT CLONE https://github.com/a/b", "\U0001f600\u200b"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    found = rows.select(scalars.invisible_run(F.col("t")).alias("n"), F.size(readers.links(F.col("t"))).alias("l")).collect()
    assert [r["n"] for r in found] == [0, 0, None, 3, 0, 0, 0, 1] and [r["l"] for r in found] == [0, 0, 0, 0, 0, 0, 1, 0]
    paths = ["tests/", "./a/Tests.java", "a/x.spec.ts", "vendor/test_a.py", "test_a.py", "test_a.py/", "a.tests/b", "attest.py", "", "/", None]
    kept = spark.createDataFrame([(x,) for x in paths], "p string").select(readers.is_test_path(F.col("p")).alias("k"))
    assert [r["k"] for r in kept.collect()] == [True, True, True, False, True, False, True, False, False, False, False]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
