"""Facts of nested answers: kinds, caps, what is missing against what is absent, and later parts."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import catalogue, facts

NODE = {
    "nameWithOwner": "me/tool", "description": "é" * 600, "homepageUrl": " ", "createdAt": "2026-01-01T00:00:00Z", "pushedAt": 7, "diskUsage": 300, "stargazerCount": 3, "forkCount": -1, "licenseInfo": {"spdxId": None}, "primaryLanguage": {"name": "Go"},
    "languages": {"edges": [{"size": 60000, "node": {"name": "Go"}}, {"size": 1, "node": None}, "odd"]}, "releases": {"totalCount": 2, "nodes": [{"tagName": "v1", "publishedAt": "2026-01-01T00:00:00Z", "isPrerelease": False}, None]},
    "owner": {"login": "me", "__typename": "User", "repositories": {"totalCount": 5}}, "tags": {"totalCount": "3"}, "agents": {"byteSize": 7}, "claude": None, "pkg": None, "wf": None,
    "defaultBranchRef": {"target": {"oid": "abc", "history": {"totalCount": 4, "nodes": [{"committedDate": "2026-01-01T00:00:00Z", "messageHeadline": "x" * 250 + "\nmore", "author": {"user": None}}]}, "statusCheckRollup": {"state": "ODD"}}},
    "root": {"entries": [{"name": "README.md", "type": "blob"}, {"name": "go.mod"}, {"name": ""}, 5]}, "readme": {"name": "README.md", "text": "```\na\n```\n" + "x" * 40000},
}
PARTS = {
    "node": {"owner": {"hasSponsorsListing": True, "contributionsCollection": {"contributionYears": [2022, 2020]}}, "fundingLinks": [{"platform": "P", "url": "u"}], "issues": {"nodes": [{"author": {"login": "x", "createdAt": "2020-01-01T00:00:00Z"}, "createdAt": "2026-02-01T00:00:00Z"}, {"author": {"login": "ME"}, "createdAt": "2026-02-01T00:00:00Z"}, {"author": None}]}},
    "tree": {"truncated": False, "tree": [{"path": "a.go", "type": "blob", "size": 3}, ["b.go", "blob", 4], {"type": "blob"}]},
    "activity": [{"timestamp": "2026-01-01T05:00:00Z", "activity_type": "push"}, {"timestamp": "2026-01-01T06:00:00Z", "activity_type": "force_push"}, {"timestamp": "bad", "activity_type": "push"}, {"timestamp": "2026-02-01T06:00:00Z", "activity_type": "branch_deletion"}],
    "stars": [{"week": 1757203200, "total": 5}, {"week": "2025-08-31", "gained": 2}, {"week": 1756000000000, "total": 1}, {"week": "2025-08-01", "total": 1}, {"week": "2025-07-01", "total": 100}, {"total": 9}],
    "files": {".github/workflows/ci.yml": {"text": "on: push"}, ".github/workflows/gone.yml": None, "go.mod": {"text": "module x"}, "package.json": None, "x/go.mod": {"text": "no"}},
}


@pytest.fixture(scope="module")
def read(spark):
    package = {"text": '﻿{"scripts":{"test":"x","b":1,"a":"y"},"dependencies":{"q":"1"},"devDependencies":[]}'}
    nodes = [json.dumps(NODE), '{"nameWithOwner":"bad"}', "nope", None, json.dumps({"nameWithOwner": "a/b", "defaultBranchRef": None, "pkg": package}), json.dumps({"nameWithOwner": "c/d", "readme": None, "pkg": {"text": "[1]"}, "root": None})]
    repairs = [None] * 5 + ['{"name":"readme.rst","text":"hello","byteSize":5}']
    rows = spark.createDataFrame(list(zip(range(6), nodes, ["2026-09-11T00:00:00Z"] * 6, repairs)), "id long, node string, fetched string, repair string")
    return facts.from_nodes(rows, "node", "fetched", "repair").cache()


def test_nodes(read):
    found = {r["id"]: r.asDict(True) for r in read.collect()}
    x = found[0]
    assert (x["nwo"], x["owner"], x["name"], len(x["description"]), x["licence"], x["stars"], x["forks"], x["pushedAt"], x["homepageUrl"]) == ("me/tool", "me", "tool", 512, "NOASSERTION", 3, None, None, None)
    assert x["languages"] == [{"name": "Go", "bytes": 60000}] and x["codeBytes"] == 60000 and x["tags"] is None and (x["agentsMdBytes"], x["claudeMdBytes"]) == (7, 0)
    assert x["releases"] == {"count": 2, "recent": [{"tag": "v1", "publishedAt": "2026-01-01T00:00:00Z", "prerelease": False}]} and x["rollup"] is None and x["headOid"] == "abc"
    assert x["commits"] == {"total": 4, "recent": [{"headline": "x" * 200, "at": "2026-01-01T00:00:00Z", "authorLogin": None}]}
    assert x["root"] == [{"name": "README.md", "type": "blob"}, {"name": "go.mod", "type": "blob"}] and x["workflows"] == [] and x["packageJson"] is None
    assert (x["readme"]["bytes"], len(x["readme"]["text"]), x["readme"]["fenceLines"]) == (40010, 32768, 2)
    assert all(found[i]["problem"] and found[i]["nwo"] is None and found[i]["stars"] is None for i in (1, 2, 3))
    y, z = found[4], found[5]
    assert y["commits"] == {"total": 0, "recent": []} and y["workflows"] is None and y["root"] is None and y["ownerInfo"] is None
    assert y["packageJson"] == {"testScript": "x", "deps": 1, "devDeps": 0, "peerDeps": 0, "optionalDeps": 0, "scripts": ["a", "test"], "name": None}
    assert z["readme"] == {"name": "readme.rst", "bytes": 5, "text": "hello", "fenceLines": 0} and z["packageJson"] is None and z["commits"] is None and z["root"] == []


def test_later_parts(spark, read):
    parts = [(0, *[json.dumps(PARTS[k]) for k in ("node", "tree", "activity", "stars", "files")]), (4, "{}", None, "5", None, '{"a":null}')]
    table = spark.createDataFrame(parts, "id long, node string, tree string, activity string, stars string, files string")
    merged = facts.merged(read, table, "id")
    found = {r["id"]: r.asDict(True) for r in merged.collect()}
    x, y, z = found[0], found[4], found[5]
    assert x["ownerInfo"] == {"login": "me", "type": "User", "createdAt": None, "publicRepos": 5, "contributionYears": [2020, 2022], "sponsorsListing": True}
    assert x["outsiders"] == [{"login": "x", "accountCreatedAt": "2020-01-01T00:00:00Z", "at": "2026-02-01T00:00:00Z"}] and x["funding"] == ["u"]
    assert x["tree"] == {"count": 2, "truncated": False, "entries": [{"path": "a.go", "type": "blob", "size": 3}, {"path": "b.go", "type": "blob", "size": 4}]}
    assert x["activity"] == {"pushDays": 1, "firstAt": "2026-01-01T05:00:00Z", "lastAt": "2026-01-01T06:00:00Z"} and x["gain4w"] == 9
    assert x["workflows"] == [{"name": "ci.yml", "text": "on: push"}, {"name": "gone.yml", "text": None}] and x["manifest"] == {"path": "go.mod", "text": "module x"}
    assert x["stages"] == ["enrich", "deep"] and x["deepHeadOid"] == "abc" and x["releases"]["count"] == 2
    assert y["stages"] == ["enrich", "deep"] and y["packageJson"]["deps"] == 1 and y["activity"] is None and y["tree"] is None and y["ownerInfo"] is None
    assert z["stages"] == ["enrich"] and z["deepHeadOid"] is None
    assert merged.columns == [*read.columns, "deepHeadOid"]
    scored = {r["id"]: (r["points"], r["points_max"]) for r in catalogue.scored(merged.where("problem IS NULL"), F.col("fetchedAt")).collect()}
    assert scored[0][0] == 7 and scored[4] == (0, 12)


def test_trees_are_capped(spark):
    entries = json.dumps([[f"f{i}", "blob", i] for i in range(30)])
    got = spark.createDataFrame([(entries,), ('{"entries":[["a"]],"count":9,"truncated":true}',), ("7",)], "t string").select(facts.tree(F.try_parse_json("t"), 10).alias("t")).collect()
    assert (got[0]["t"]["count"], got[0]["t"]["truncated"], len(got[0]["t"]["entries"])) == (30, True, 10)
    assert got[1]["t"].asDict(True) == {"count": 9, "truncated": True, "entries": [{"path": "a", "type": "blob", "size": None}]} and got[2]["t"] is None
