"""The rule catalogue: signals, confidence items, gates, descriptors, the prefilter and the lanes, as expressions over a row of facts.

A signal is struct(status, hit): ok with a hit or a miss, unknown where a fact wasn't fetched, na where the rule doesn't apply.
All rules of a row are judged in the row itself, so a table of facts is scored in its scan, without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import lexicons as lex
from lodestone.functions import readers as r
from lodestone.functions.scalars import bound, cut_utf8, days_between, detected_script, fence_lines, invisible_run, sat, tidy

from lodestone.operators.scoring import quality

#: A row of facts. Times are ISO text, as their sources write them; one that can't be read counts as unknown.
FACTS = """nwo string, owner string, name string, description string, licence string, createdAt string, pushedAt string, stars long, forks long, diskKB long, lang string, homepageUrl string, codeBytes long,
languages array<struct<name:string,bytes:long>>, releases struct<count:long,recent:array<struct<tag:string,publishedAt:string,prerelease:boolean>>>, tags long,
ownerInfo struct<login:string,type:string,createdAt:string,publicRepos:long,contributionYears:array<int>,sponsorsListing:boolean>, commits struct<total:long,recent:array<struct<headline:string,at:string,authorLogin:string>>>,
root array<struct<name:string,type:string>>, workflows array<struct<name:string,text:string>>, readme struct<name:string,bytes:long,text:string,fenceLines:long>,
packageJson struct<testScript:string,deps:int,devDeps:int,peerDeps:int,optionalDeps:int,scripts:array<string>,name:string>, manifest struct<path:string,text:string>,
tree struct<count:long,truncated:boolean,entries:array<struct<path:string,type:string,size:long>>>, activity struct<pushDays:long,firstAt:string,lastAt:string>, gain4w long,
outsiders array<struct<login:string,accountCreatedAt:string,at:string>>, funding array<string>, rollup string, agentsMdBytes long, claudeMdBytes long, hasIssues boolean, hasDiscussions boolean"""

#: Points of each signal, its kind and, for penalties of which only the worst counts, its group.
SIGNALS = {
    "q.licence": (1, "quality", None), "q.readme": (1, "quality", None), "q.usage": (1, "quality", None), "q.ci": (1, "quality", None), "q.manifest": (1, "quality", None), "q.deps": (1, "quality", None),
    "q.tests": (1, "quality", None), "q.code": (1, "quality", None), "q.release": (1, "quality", None), "q.examples": (1, "quality", None), "p.testsRun": (1, "proof", None), "p.shipped": (1, "proof", None),
    "p.coherent": (1, "proof", None), "s.incoherent": (0, "slop", None), "s.webui": (-2, "slop", None), "s.template": (-2, "slop", None), "s.prose": (-2, "slop", "prose"), "s.mdheavy": (-1, "slop", "prose"),
    "s.junk": (-1, "slop", None), "s.farm": (-1, "slop", None), "s.cloneUrl": (-1, "slop", None),
}
#: The group of each confidence item; the strongest of a group counts.
CONFIDENCE = {"k.owner": "owner", "k.time": "time", "k.pushDays": "time", "k.releases": "releases", "k.outsiders": "people", "k.ciVerified": "ci"}
#: What each gate does, in order.
GATES = {"g.lure.name": "quarantine", "g.lure.link": "quarantine", "g.lure.script": "quarantine", "g.lure.drainer": "quarantine", "g.spam.words": "drop", "g.spam.farm": "drop", "g.spam.streak": "drop", "g.injection": "doubt", "g.institutional": "institutional"}

c = F.col


def text() -> Column:
    return c("readme.text")


def root() -> Column:
    return c("root")


def tree() -> Column:
    return c("tree.entries")


def unknown() -> Column:
    return F.struct(F.lit("unknown").alias("status"), F.lit(None).cast("boolean").alias("hit"))


def na() -> Column:
    return F.struct(F.lit("na").alias("status"), F.lit(None).cast("boolean").alias("hit"))


def ok(hit: Column | bool) -> Column:
    return F.struct(F.lit("ok").alias("status"), F.coalesce(hit if isinstance(hit, Column) else F.lit(hit), F.lit(False)).alias("hit"))


def first(*cases: tuple[Column, Column], otherwise: Column) -> Column:
    """The outcome of the first condition that holds."""
    out = None
    for condition, outcome in cases:
        out = F.when(condition, outcome) if out is None else out.when(condition, outcome)
    return out.otherwise(otherwise)


def some(array: Column, test) -> Column:
    return F.coalesce(F.exists(array, test), F.lit(False))


def times(x: Column) -> Column:
    return x.try_cast("timestamp")


def days(a: Column, b: Column) -> Column:
    return days_between(times(a), times(b))


def root_key(e: Column) -> Column:
    """A root entry's name in lower case, with / behind a directory."""
    return F.concat(F.lower(e["name"]), F.when(e["type"].eqNullSafe("tree"), "/").otherwise(""))


def is_file(e: Column) -> Column:
    return ~e["type"].eqNullSafe("tree")


def has_extension(path: Column, extensions: list[str]) -> Column:
    return r.any_of(lambda x: F.lower(path).endswith(x), extensions)


def name_words(name: Column) -> Column:
    return F.regexp_replace(F.coalesce(name, F.lit("")), "[-_.]+", " ")


def zero_dependency() -> Column:
    """Whether a manifest says that there are no dependencies; null where its content isn't known."""
    named = lambda n: some(root(), lambda e: is_file(e) & (F.lower(e["name"]) == n))
    p = c("packageJson")
    counts = [p[k] for k in ("deps", "devDeps", "peerDeps", "optionalDeps")]
    pkg = F.when(reduce(lambda a, b: a | b, [F.coalesce(x > 0, F.lit(False)) for x in counts]), False).when(p["deps"].isNotNull() & p["devDeps"].isNotNull(), True)
    go = F.when((F.lower(c("manifest.path")) == "go.mod") & c("manifest.text").isNotNull(), ~c("manifest.text").rlike(r"(?m)^\s*require(?![0-9A-Za-z_])"))
    has_pkg, has_go = named("package.json"), named("go.mod")
    return F.when(F.coalesce(has_pkg & pkg, F.lit(False)) | F.coalesce(has_go & go, F.lit(False)), True).when((has_pkg & pkg.isNull()) | (has_go & go.isNull()), None).otherwise(False)


def dated_releases() -> tuple[Column, Column]:
    """Days (as text) of releases that are dated and not for preview, and what is known without them (null: judge by the days)."""
    recent = F.coalesce(c("releases.recent"), F.array().cast("array<struct<tag:string,publishedAt:string,prerelease:boolean>>"))
    dates = F.array_sort(F.transform(F.filter(recent, lambda x: ~x["prerelease"].eqNullSafe(True) & x["publishedAt"].isNotNull()), lambda x: x["publishedAt"]))
    known = first((c("releases").isNull(), unknown()), (c("releases.count") == 0, ok(False)), (~some(recent, lambda x: x["publishedAt"].isNotNull()), unknown()), (F.size(dates) == 0, ok(False)), otherwise=F.lit(None))
    return dates, known


def with_derived(facts: DataFrame) -> DataFrame:
    """facts with what rules read of whole texts: the test step, the references of the README with how many exist, its fences, and its links to archives and programs."""
    step = F.when(F.size(F.coalesce(c("workflows"), F.array().cast("array<struct<name:string,text:string>>"))) > 0, r.test_step("workflows", "packageJson.testScript"))
    read = facts.withColumns({"__step": step, "__refs": r.references(text()), "__lures": lure_links(F.coalesce(text(), F.lit("")), c("nwo")), "__low": F.lower(F.coalesce(text(), F.lit(""))), "__fences": F.coalesce(c("readme.fenceLines"), fence_lines(text()))})
    return read.withColumn("__found", F.when(tree().isNotNull(), r.resolved(c("__refs"), F.transform(tree(), lambda e: e["path"]), c("packageJson.scripts"), c("nwo"))))


def signals() -> dict[str, Column]:
    """Each signal as struct(status, hit), over with_derived(facts)."""
    workflow_files = F.filter(c("workflows"), lambda w: w["name"].rlike(r"(?i)\.ya?ml$"))
    n_yaml, fetched = F.size(workflow_files), F.size(F.filter(workflow_files, lambda w: w["text"].isNotNull()))
    any_yaml = F.coalesce(n_yaml > 0, F.lit(False))
    step, found, code, no_readme = c("__step"), c("__found"), c("codeBytes"), c("readme").isNull()
    has_step = F.coalesce(step["file"].isNotNull(), F.lit(False))
    fences = c("__fences")
    dates, undated = dated_releases()
    release_days = F.array_distinct(F.transform(dates, lambda x: F.substring(x, 1, 10)))
    few = F.coalesce(F.size("__refs") < 5, F.lit(False))
    by_refs = [(no_readme, na()), (text().isNull(), unknown()), (few, na()), (tree().isNull(), unknown()), (found["cited"] < 5, na())]
    share, cut_off = found["resolved"] / found["cited"], F.coalesce(c("tree.truncated"), F.lit(False))
    heads = F.filter(F.transform(c("commits.recent"), lambda x: x["headline"]), lambda h: h.isNotNull())
    head = cut_utf8(text(), 4096)
    template = F.coalesce(r.matches_any(head, c("__low"), lex.TEMPLATE_README), F.lit(False))
    parts = lambda e: F.split(e["path"], "/")
    junk = lambda e: F.exists(F.when(is_file(e), F.slice(parts(e), F.lit(1), F.size(parts(e)) - 1)).otherwise(parts(e)), lambda d: F.lower(d).isin("node_modules", "__pycache__")) | (is_file(e) & (F.element_at(parts(e), -1) == ".env") & ~F.array_contains(parts(e), "examples"))
    kind, repos = c("ownerInfo.type"), c("ownerInfo.publicRepos")
    other = some(F.when(F.contains(c("__low"), F.lit("clone")), r.clone_addresses(text())), lambda t: (F.lower(t["owner"]) != F.lower(c("owner"))) & (F.lower(t["name"]) == F.lower(c("name"))))
    return {
        "q.licence": ok(c("licence").isNotNull()),
        "q.readme": ok(c("readme.bytes") >= 1000),
        "q.usage": first((no_readme, ok(False)), (fences.isNull(), unknown()), otherwise=ok(fences >= 4)),
        "q.ci": first((any_yaml, ok(True)), (some(root(), lambda e: root_key(e).isin(lex.CI_ROOT_FILES)), ok(True)), (root().isNull(), unknown()), (c("workflows").isNull() & some(root(), lambda e: root_key(e) == ".github/"), unknown()), otherwise=ok(False)),
        "q.manifest": first((root().isNull(), unknown()), otherwise=ok(F.exists(root(), lambda e: is_file(e) & r.is_manifest(e["name"])))),
        "q.deps": first(
            (root().isNull(), unknown()), (some(root(), lambda e: is_file(e) & r.is_lockfile(e["name"])), ok(True)), (F.coalesce(zero_dependency(), F.lit(False)), ok(True)),
            (F.size(F.array_intersect(r.ecosystems(root(), c("lang")), F.array(*[F.lit(e.name) for e in lex.ECOSYSTEMS if not e.optional]))) == 0, na()), (zero_dependency().isNull(), unknown()), otherwise=ok(False)),
        "q.tests": first((root().isNull() & c("tree").isNull(), unknown()), otherwise=ok(some(root(), lambda e: r.is_test_path(F.concat(e["name"], F.when(is_file(e), "").otherwise("/")))) | some(tree(), lambda e: is_file(e) & r.is_test_path(e["path"])))),
        "q.code": first((code.isNull(), unknown()), otherwise=ok(code >= 50_000)),
        "q.release": first((F.coalesce(c("releases.count") >= 1, F.lit(False)) | F.coalesce(c("tags") >= 1, F.lit(False)), ok(True)), (c("releases.count").isNull() | c("tags").isNull(), unknown()), otherwise=ok(False)),
        "q.examples": first((root().isNull(), unknown()), otherwise=ok(F.exists(root(), lambda e: ~is_file(e) & F.lower(e["name"]).isin(lex.EXAMPLES_DIRS)))),
        "p.testsRun": first(
            (c("workflows").isNull(), unknown()), (n_yaml == 0, ok(False)), (fetched == 0, unknown()), (~has_step & (fetched < n_yaml), unknown()), (~has_step, ok(False)),
            (step["ignored"] & (fetched < n_yaml), unknown()), (step["ignored"], ok(False)), (~c("rollup").eqNullSafe("SUCCESS"), unknown()), otherwise=ok(True)),
        "p.shipped": F.coalesce(undated, ok((F.size(release_days) >= 2) & (days(release_days[0], F.element_at(release_days, -1)) >= 7))),
        "p.coherent": first(*by_refs, ((share < 0.8) & cut_off, unknown()), otherwise=ok(share >= 0.8)),
        "s.incoherent": first(*by_refs, ((share < 0.4) & cut_off, unknown()), otherwise=ok(share < 0.4)),
        "s.webui": first((c("commits").isNull(), unknown()), (F.coalesce(F.size(heads) < 4, F.lit(True)), na()), otherwise=ok(F.size(F.filter(heads, lambda h: h.rlike(lex.WEB_UI_HEADLINE))) * 2 >= F.size(heads))),
        "s.template": first((template, ok(True)), (some(root(), lambda e: root_key(e).isin(lex.PLATFORM_MARKS)), ok(True)), (root().isNull() | (~no_readme & text().isNull()), unknown()), otherwise=ok(False)),
        "s.prose": first((code.isNull(), unknown()), otherwise=ok(F.coalesce(c("readme.bytes"), F.lit(0)) > 5 * F.greatest(code, F.lit(1)))),
        "s.mdheavy": first((root().isNull() | code.isNull(), unknown()), otherwise=ok((F.size(F.filter(root(), lambda e: is_file(e) & e["name"].rlike(r"(?i)\.md$"))) >= 4) & (code < 20_000))),
        "s.junk": first((root().isNull() & c("tree").isNull(), unknown()), otherwise=ok(some(root(), lambda e: root_key(e).isin(lex.JUNK_ROOT)) | some(tree(), junk))),
        "s.farm": first((c("ownerInfo").isNull(), unknown()), (kind.eqNullSafe("Organization"), ok(False)), (~kind.eqNullSafe("User") | repos.isNull(), unknown()), otherwise=ok(repos >= 200)),
        "s.cloneUrl": first((no_readme, ok(False)), (text().isNull(), unknown()), otherwise=ok(other)),
    }


def confidence_items(now: Column, tests_run: Column) -> dict[str, Column]:
    """Each item as struct(status, strength); now is ISO text, tests_run the signal p.testsRun."""
    known = lambda s: F.struct(F.lit("ok").alias("status"), s.cast("double").alias("strength"))
    unsure = F.struct(F.lit("unknown").alias("status"), F.lit(0.0).alias("strength"))
    steps = lambda *pairs: F.coalesce(*[F.when(cond, F.lit(float(v))) for cond, v in pairs], F.lit(0.0))
    o, a = c("ownerInfo"), c("activity")
    before = F.size(F.filter(o["contributionYears"], lambda y: y < 2024))
    span, pushed, age = days(c("createdAt"), c("pushedAt")), days(a["firstAt"], a["lastAt"]), days(o["createdAt"], now)
    dates, undated = dated_releases()
    released = days(dates[0], F.element_at(dates, -1))
    insiders = F.transform(F.coalesce(c("commits.recent"), F.array().cast("array<struct<headline:string,at:string,authorLogin:string>>")), lambda x: F.lower(x["authorLogin"]))
    outside = F.filter(c("outsiders"), lambda x: (F.coalesce(x["login"], F.lit("")) != "") & (F.lower(x["login"]) != F.lower(c("owner"))) & ~F.coalesce(F.array_contains(insiders, F.lower(x["login"])), F.lit(False)) & ~F.lower(x["login"]).endswith("[bot]") & (days(x["accountCreatedAt"], x["at"]) >= 365))
    people = F.size(F.array_distinct(F.transform(outside, lambda x: F.lower(x["login"]))))
    return {
        "k.owner": first((o.isNull(), unsure), (o["type"].eqNullSafe("Organization") & age.isNull(), unsure), (o["type"].eqNullSafe("Organization"), known(steps((age >= 730, 0.15)))), (o["contributionYears"].isNull(), unsure), otherwise=known(steps((before >= 3, 0.3), (before >= 1, 0.15)))),
        "k.time": first((span.isNull(), unsure), otherwise=known(steps((span >= 180, 0.25), (span >= 30, 0.1)))),
        "k.pushDays": first((a.isNull(), unsure), otherwise=known(steps(((a["pushDays"] >= 20) & (pushed >= 180), 0.4), ((a["pushDays"] >= 5) & (pushed >= 30), 0.25)))),
        "k.releases": first((undated["status"] == "unknown", unsure), (undated.isNotNull(), known(F.lit(0.0))), otherwise=known(steps(((F.size(dates) >= 3) & (released >= 28), 0.3)))),
        "k.outsiders": first((c("outsiders").isNull(), unsure), otherwise=known(F.least(F.lit(0.45), people * 0.15))),
        "k.ciVerified": first((tests_run["status"] != "ok", unsure), otherwise=known(F.when(tests_run["hit"], 0.15).otherwise(0.0))),
    }


def confidence(items: dict[str, Column]) -> Column:
    """1 less the product of what the strongest item of each group leaves open."""
    groups: dict[str, list[Column]] = {}
    for name, item in items.items():
        groups.setdefault(CONFIDENCE[name], []).append(item["strength"])
    open_ = reduce(lambda a, b: a * b, [1 - (F.greatest(*g) if len(g) > 1 else g[0]) for g in groups.values()])
    return tidy(1 - open_)


def lure_name(name: Column, description: Column) -> Column:
    hay = [name_words(name), F.substring(F.coalesce(description, F.lit("")), 1, 200)]
    return r.any_of(lambda p: hay[0].rlike(lex.pattern(p)) | hay[1].rlike(lex.pattern(p)), lex.LURE_WORDS)


def lure_links(readme: Column, nwo: Column) -> Column:
    """Links to archives or programs in this repository or at a file host: array of struct(key, path)."""
    own = F.lower(nwo)
    unescaped = lambda p: F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)

    def addressed(x: Column) -> Column:
        return F.struct(F.lower(x["text"]).alias("label"), F.regexp_replace(F.trim(x["url"]), "^<|>$", "").alias("url"))

    def located(x: Column) -> Column:
        full = F.when(x["url"].startswith("//"), F.concat(F.lit("https:"), x["url"])).otherwise(x["url"])
        host = F.regexp_replace(F.lower(F.regexp_extract(full, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
        return F.struct(x["label"], x["url"], full.alias("full"), host.alias("host"), unescaped(F.regexp_extract(full, r"(?i)^https?://[^/?#]+([^?#]*)", 1)).alias("path"))

    def kept_in(p: Column) -> Column:
        return F.when(has_extension(p, lex.ARCHIVE_EXTENSIONS), F.struct(F.concat(F.lit("repo:"), F.lower(p)).alias("key"), p.alias("path")))

    def stored(x: Column, segments: Column) -> Column:
        """The path of a file of this repository that an address shows."""
        n = F.size(segments)
        rest = lambda k: F.array_join(F.slice(segments, F.lit(k + 1), F.greatest(n - k, F.lit(0))), "/")
        same = F.lower(F.concat_ws("/", F.slice(segments, 1, 2))) == own
        return F.when(same & (x["host"] == "raw.githubusercontent.com") & (n >= 4), rest(3)).when(same & (x["host"] == "github.com") & (n >= 5) & F.try_element_at(segments, F.lit(3)).isin("raw", "blob"), rest(4))

    def hosted(x: Column) -> Column:
        at_host = r.any_of(lambda h: (x["host"] == h) | x["host"].endswith("." + h), lex.FILE_HOSTS)
        low = F.lower(x["path"])
        named = r.any_of(lambda e: low.endswith(e) | F.contains(low, F.lit(e + "/")) | F.contains(x["label"], F.lit(e)), lex.ARCHIVE_EXTENSIONS) | x["label"].rlike(r"(?<![0-9A-Za-z_])download")
        return F.when(at_host & named, F.struct(F.concat(F.lit("url:"), F.lower(x["full"])).alias("key"), F.lit(None).cast("string").alias("path")))

    def candidate(x: Column) -> Column:
        plain = ~x["url"].rlike(r"(?i)^[a-z][a-z0-9+.-]*:") & ~x["url"].startswith("//")
        inner = F.regexp_replace(F.regexp_replace(unescaped(F.regexp_replace(x["url"], "[?#].*$", "")), r"^(\./)+", ""), "^/+", "")
        segments = F.when(x["host"].isin("raw.githubusercontent.com", "github.com"), F.filter(F.split(x["path"], "/"), lambda s: s != ""))
        elsewhere = lambda p: F.when(p.isNotNull(), kept_in(p)).when(x["host"] != "", hosted(x))
        return F.when(plain, bound(inner, kept_in)).otherwise(bound(bound(segments, lambda s: stored(x, s)), elsewhere))

    alive = F.filter(F.transform(r.links(readme), addressed), lambda x: ~((x["url"] == "") | x["url"].startswith("#") | x["url"].rlike("(?i)^mailto:")))
    return F.array_compact(F.transform(F.transform(alive, located), candidate))


def gates(now: Column, allow: list[str] | None = None, deny: list[str] | None = None, least_repos: float = 100) -> dict[str, Column]:
    """Whether each gate closes on a row of facts. allow and deny: logins in lower case, short lists."""
    readme, about = F.coalesce(text(), F.lit("")), F.coalesce(c("description"), F.lit(""))
    code, o = c("codeBytes"), c("ownerInfo")
    age = days(o["createdAt"], now)
    young, small = F.coalesce(age < 90, F.lit(False)), F.coalesce(code < 20_000, F.lit(False))
    found = c("__lures")
    # Three of a key stand two places apart in order.
    thrice = lambda keys: F.exists(F.sequence(F.lit(1), F.greatest(F.size(keys) - 2, F.lit(1))), lambda i: F.try_element_at(keys, i) == F.try_element_at(keys, i + 2))
    repeated = some(F.array(F.array_sort(F.transform(found, lambda x: x["key"]))), thrice)
    folders = lambda p: F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1)
    in_dir = F.exists(found, lambda x: some(folders(x["path"]), lambda d: F.lower(d).isin(lex.LURE_DIRS)))
    main = F.get(F.filter(c("languages"), lambda x: x["name"] == c("lang")), F.lit(0))
    blob = lambda e: e["type"].eqNullSafe("blob")
    words = F.concat_ws(" ", name_words(c("name")), about)
    named, told = r.gambling(words), r.any_of(lambda w: F.contains(c("__low"), F.lit(w)), lex.GAMBLING_WORDS)
    login = F.lower(F.coalesce(o["login"], c("owner"), F.lit("")))
    return {
        "g.lure.name": lure_name(c("name"), c("description")),
        "g.lure.link": (F.size(found) > 0) & (in_dir | small | young | readme.rlike(lex.pattern(lex.PASSWORD_HINT)) | repeated),
        "g.lure.script": (c("lang").isin(lex.SCRIPT_LANGUAGES) & F.coalesce(main["bytes"] >= 1_000_000, F.lit(False))) | some(tree(), lambda e: blob(e) & (e["size"] >= 1_000_000) & has_extension(e["path"], lex.SCRIPT_EXTENSIONS)) | (some(tree(), lambda e: blob(e) & has_extension(e["path"], lex.BINARY_EXTENSIONS)) & small & young),
        "g.lure.drainer": r.matches_any(readme, c("__low"), lex.DRAINER_PHRASES) | r.matches_any(about, F.lower(about), lex.DRAINER_PHRASES),
        "g.spam.words": (named >= 2) | (((named >= 1) | told) & (r.gambling(F.concat_ws(" ", words, cut_utf8(readme, 4096))) >= 3)),
        "g.spam.farm": (o["type"] == "User") & ((o["publicRepos"] >= 1000) | ((o["publicRepos"] >= 200) & young)),
        "g.spam.streak": (c("commits.total") >= 500) & (code < 10_000),
        "g.injection": r.addresses_reader(readme, c("__low")) | r.addresses_reader(about, F.lower(about)) | r.hidden_orders(readme) | (invisible_run(readme) >= 3) | (invisible_run(about) >= 3),
        "g.institutional": (login != "") & ~login.isin(deny or [""]) & (login.isin(allow or [""]) | F.coalesce((o["type"] == "Organization") & (o["publicRepos"] >= least_repos), F.lit(False))),
    }


def closed(found: dict[str, Column]) -> Column:
    """The names of the gates that close, in order."""
    # array_compact is a filter, and what a filter reads is interpreted: all rules with it. A difference of arrays leaves them compiled.
    return F.array_except(F.array(*[F.when(x, k) for k, x in found.items()]), F.array(F.lit(None).cast("string")))


def descriptors() -> dict[str, Column]:
    """Neutral remarks on a row of facts."""
    total = c("commits.total")
    dated = F.filter(c("commits.recent"), lambda x: x["at"].isNotNull())
    return {
        "d.agent": some(root(), lambda e: root_key(e).isin(lex.AGENT_MARKS)) | F.coalesce(c("agentsMdBytes") > 0, F.lit(False)) | F.coalesce(c("claudeMdBytes") > 0, F.lit(False)) | some(tree(), lambda e: F.lower(e["path"]) == ".github/copilot-instructions.md"),
        "d.squashed": F.coalesce(total <= 3, F.lit(False)),
        "d.script": F.coalesce(detected_script(text()) != "latin", F.lit(False)),
        "d.demo": F.coalesce(c("homepageUrl") != "", F.lit(False)),
        "d.imported": F.coalesce(days(F.try_element_at(dated, F.lit(-1))["at"], c("createdAt")) > 30, F.lit(False)),
        "d.sprawl": F.coalesce((total >= 200) & (c("tree.count") >= 2000), F.lit(False)),
        "d.funding": F.coalesce(F.size("funding") > 0, F.lit(False)) | c("ownerInfo.sponsorsListing").eqNullSafe(True),
    }


def prefilter(now: Column, owner_flags: Column, owner_count: Column, most_stars: int = 25, least_kb: int = 200, defer_days: int = 7, cap: int = 5) -> Column:
    """struct(state, reason, next_at) of a seed (nwo, description, stars, diskKB, lang, createdAt, isFork and the like), by the first rule that fits.

    owner_flags: what is remembered of the owner; owner_count: how many of the owner's seeds of that day are queued already.
    """
    owner, name = F.lower(F.substring_index("nwo", "/", 1)), F.lower(F.get(F.split("nwo", "/"), F.lit(1)))
    kind = reduce(lambda a, b: a | b, [F.coalesce(c(k), F.lit(False)) for k in ("isFork", "isArchived", "isTemplate", "isMirror")])
    made = times(c("createdAt"))
    wait = made + F.expr(f"INTERVAL {defer_days} DAYS")
    no_language = F.coalesce(c("lang"), F.lit("")) == ""
    rules = [
        (kind, "dropped", "excluded-kind"),
        (F.coalesce(c("stars"), F.lit(0)) > most_stars, "dropped", "attention"),
        (F.coalesce(c("diskKB"), F.lit(0)) < least_kb, "dropped", "too-small"),
        ((name == owner) | name.endswith(".github.io") | name.isin(lex.PERSONAL_NAMES), "dropped", "profile-or-site"),
        (lure_name(name, c("description")), "quarantined", "lure-name"),
        (r.gambling(F.concat_ws(" ", name_words(name), F.coalesce(c("description"), F.lit("")))) >= 2, "dropped", "spam-words"),
        (some(owner_flags, lambda f: f.isin("farm", "streak")), "dropped", "farm-owner"),
        (no_language & (wait > times(now)), "deferred", "no-language-yet"),
        (no_language, "dropped", "no-language"),
        (F.coalesce(owner_count, F.lit(0)) >= cap, "dropped", "owner-cap"),
    ]
    value = lambda s, why: F.struct(F.lit(s).alias("state"), F.lit(why).cast("string").alias("reason"), F.when(F.lit(s == "deferred"), wait).alias("next_at"))
    return first(*[(F.coalesce(cond, F.lit(False)), value(s, why)) for cond, s, why in rules], otherwise=value("queued", None))


def prior() -> Column:
    """0 to 5: licence, description, a size of a megabyte, a language, found by a release in an archive."""
    described = F.coalesce(c("hasDesc"), F.trim(F.coalesce("description", F.lit(""))) != "")
    by_release = some(F.concat(F.array("source"), F.coalesce(c("sources"), F.array().cast("array<string>"))), lambda s: s.rlike("^archive:.*:Release$"))
    signs = [F.coalesce(c("licence"), F.lit("")) != "", described, c("diskKB") >= 1024, F.coalesce(c("lang"), F.lit("")) != "", by_release]
    return reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(False)).cast("int") for s in signs])


def band(points: Column, gem: float = 7, look: float = 5) -> Column:
    return F.when(points >= gem, "gem").when(points >= look, "look").when(points.isNotNull(), "low")


def confidence_band(k: Column, high: float = 0.6, medium: float = 0.3) -> Column:
    return F.when(k >= high, "high").when(k >= medium, "medium").when(k.isNotNull(), "low")


def lane(actions: Column, points_band: Column, k: Column, stars: Column, gain4w: Column, doubted: Column, gone: Column, most_stars: int = 25, rising: int = 10, proven: float = 0.5) -> Column:
    """The first that fits. actions: what the row's gates do; doubted: a verdict's doubt."""
    has = lambda a: F.coalesce(F.array_contains(actions, a), F.lit(False))
    yes = lambda x: F.coalesce(x, F.lit(False))
    return (
        F.when(has("quarantine"), "quarantine")
        .when(yes(gone), "gone")
        .when(has("institutional"), "institutional")
        .when(yes(stars > most_stars), "graduated")
        .when(yes(gain4w >= rising), "rising")
        .when(has("doubt") | yes(doubted), "doubted")
        .when(points_band == "gem", F.when(k >= proven, "proven").otherwise("promising"))
        .when(points_band == "look", "look")
        .otherwise("low")
    )


def verdict_effect(v: Column, promote: float = 1, demote: float = -2, least_claims: int = 2, sure: float = 0.7, good_mean: float = 3.0) -> Column:
    """struct(points, lane) of a verdict: status, category, categoryConfidence, scores (array), claims (array with supports), flags, injectionSeen."""
    effect = lambda p, x: F.struct(F.lit(float(p)).alias("points"), F.lit(x).cast("string").alias("lane"))
    adverse, doubts = ["C", "S", "D", "P", "E"], ["malware_suspect", "re_upload", "tutorial_clone"]  # fixed values
    backed = some(v["claims"], lambda x: x["supports"].isin("category", "originality"))
    mean = F.try_divide(F.aggregate(v["scores"], F.lit(0.0), lambda a, x: a + x), F.size(v["scores"]).cast("double"))
    return first(
        (v.isNull() | ~v["status"].eqNullSafe("ok"), effect(0, None)),
        (F.coalesce(F.size(v["claims"]) < least_claims, F.lit(True)), effect(0, None)),
        (v["injectionSeen"].eqNullSafe(True), effect(0, "doubted")),
        (F.coalesce(v["category"].isin(adverse) & (v["categoryConfidence"] >= sure), F.lit(False)) & backed, effect(demote, "doubted")),
        (v["category"].eqNullSafe("X"), effect(0, "doubted")),
        (backed & some(v["flags"], lambda f: f.isin(doubts)), effect(0, "doubted")),
        (v["category"].eqNullSafe("G") & F.coalesce(mean >= good_mean, F.lit(False)), effect(promote, None)),
        otherwise=effect(0, None),
    )


@dataclass(frozen=True)
class Weights:
    """What judging depends on beside the facts. The defaults are the rules' own."""

    version: str = "w2"
    signals: dict[str, tuple[float, str, str | None]] = field(default_factory=lambda: dict(SIGNALS))
    promote: float = 1
    demote: float = -2
    gem: float = 7
    look: float = 5
    k_weight: float = 1.5
    a_weight: float = 1.5
    saturation: float = 25
    most_stars: float = 25
    rising: float = 10
    least_repos: float = 100
    medium: float = 0.3
    high: float = 0.6
    proven: float = 0.5


#: Where each setting stands in a table of settings (section, key).
SETTINGS = {
    "gem": ("bands", "gem"), "look": ("bands", "look"), "k_weight": ("gem", "kWeight"), "a_weight": ("gem", "aWeight"), "saturation": ("attention", "saturation"), "most_stars": ("eligibility", "maxStars"), "rising": ("eligibility", "risingGain4w"),
    "least_repos": ("institutions", "orgMinRepos"), "medium": ("confidenceBands", "medium"), "high": ("confidenceBands", "high"), "proven": ("lanes", "provenK"),
}


def weights_of(settings: DataFrame) -> Weights:
    """Weights of a table of settings: section, key, field, value (text).

    Section signals has a row for each field (points, kind, group) of a signal, and promote and demote of the judge (llm.review);
    the other sections are those of SETTINGS, with field null; version has only a value. What is missing, isn't a finite number or
    has a name that no rule has leaves the default. Only rows that a rule reads come to the driver, so their number has a bound;
    of repeated rows one is taken, the greatest by value.
    """
    known = F.col("section").eqNullSafe("version") | ((F.col("section") == "signals") & F.col("key").isin("llm.review", *SIGNALS)) | F.concat_ws(".", "section", "key").isin([".".join(x) for x in SETTINGS.values()])
    read = settings.where(known).groupBy("section", "key", "field").agg(F.max("value").alias("value"))
    given = {(r["section"], r["key"], r["field"]): r["value"] for r in read.collect()}
    base = Weights()

    def number(at: tuple, otherwise: float) -> float:
        try:
            found = float(given.get(at))
        except (TypeError, ValueError):
            return otherwise
        return found if math.isfinite(found) else otherwise

    signals = {k: (number(("signals", k, "points"), w), given.get(("signals", k, "kind")) or kind, given.get(("signals", k, "group")) or group) for k, (w, kind, group) in base.signals.items()}
    version = next((v for (section, _, _), v in given.items() if section == "version" and v), base.version)
    judge = {k: number(("signals", "llm.review", k), getattr(base, k)) for k in ("promote", "demote")}
    return Weights(version, signals, **judge, **{k: number((*at, None), getattr(base, k)) for k, at in SETTINGS.items()})


def _totals(rows: DataFrame, at: dict[str, Column], held: dict[str, Column], w: Weights, verdict: Column | None, gone: Column) -> DataFrame:
    """rows (with gates) with points, points_max, coverage, k, k_band, attention, quality, gem, band, judge, lane and weights; at and held: each signal and item."""
    # An order to the reviewer in the repository disables the judge.
    trusted = ~F.array_contains("gates", "g.injection")
    none = F.struct(F.lit(0.0).alias("points"), F.lit(None).cast("string").alias("lane"))
    effect = none if verdict is None else F.when(trusted, verdict_effect(verdict, w.promote, w.demote)).otherwise(none)
    suspect = F.lit(False) if verdict is None else trusted & verdict["status"].eqNullSafe("ok") & some(verdict["flags"], lambda f: f == "malware_suspect")
    rows = rows.withColumn("judge", effect)
    size = lambda kept, amount: reduce(lambda a, b: a + b, [F.when(kept(at[k]["status"]), F.lit(float(amount(p)))).otherwise(0.0) for k, (p, _, _) in w.signals.items()])
    groups: dict[str, list[Column]] = {}
    for k, (p, _, group) in w.signals.items():
        groups.setdefault("group " + group if group else k, []).append(F.when((at[k]["status"] == "ok") & at[k]["hit"], F.lit(float(p))))
    # Of a group the least contribution counts; a member that doesn't hit contributes 0.
    one = lambda g: g[0] if len(g) == 1 else F.least(*[F.coalesce(x, F.lit(0.0)) for x in g])
    own = reduce(lambda a, b: a + b, [F.coalesce(one(g), F.lit(0.0)) for g in groups.values()])
    applies = lambda s: s != "na"
    rows = rows.withColumns({
        "points": tidy(own + c("judge.points")), "points_max": tidy(size(applies, lambda p: max(p, 0)) + F.greatest(c("judge.points"), F.lit(0.0))),
        "coverage": tidy(F.coalesce(F.try_divide(size(lambda s: s == "ok", abs), size(applies, abs)), F.lit(0.0))), "k": confidence(held),
        "attention": tidy(sat(F.greatest(F.coalesce("stars", F.lit(0)), F.lit(0)) + F.greatest(F.coalesce("forks", F.lit(0)), F.lit(0)), w.saturation)),
    })
    rows = rows.withColumns({"gem": tidy(c("points") + w.k_weight * c("k") - w.a_weight * c("attention")), "band": band(c("points"), w.gem, w.look), "k_band": confidence_band(c("k"), w.high, w.medium), "quality": quality(c("points"))})
    actions = F.transform("gates", lambda g: F.element_at(F.create_map(*[F.lit(x) for kv in GATES.items() for x in kv]), g))
    placed = lane(actions, c("band"), c("k"), c("stars"), c("gain4w"), (c("judge.lane") == "doubted") | suspect, gone, w.most_stars, w.rising, w.proven)
    return rows.withColumns({"lane": placed, "weights": F.lit(w.version)})


def scored(facts: DataFrame, now: Column, verdict: Column | None = None, gone: Column | None = None, weights: Weights | None = None, **institutions) -> DataFrame:
    """facts with signals, items, gates, descriptors, and their totals (see _totals). In the row: no shuffle.

    verdict: struct(status, category, ...) as verdict_effect reads it; gone: not found when last looked for. A table of facts and
    another of weights are judged again in the scan.
    """
    w = weights or Weights()
    rows = with_derived(facts).withColumn("__s", F.struct(*[x.alias(k.replace(".", "_")) for k, x in signals().items()]))
    at = {k: F.col(f"__s.{k.replace('.', '_')}") for k in SIGNALS}
    items, shut = confidence_items(now, at["p.testsRun"]), gates(now, **{"least_repos": w.least_repos} | institutions)
    rows = rows.withColumns({"__k": F.struct(*[x.alias(k.replace(".", "_")) for k, x in items.items()]), "gates": closed(shut), "descriptors": closed(descriptors())})
    held = {k: F.col(f"__k.{k.replace('.', '_')}") for k in CONFIDENCE}
    chips = {
        "signals": F.array(*[F.struct(F.lit(k).alias("id"), at[k]["status"].alias("status"), at[k]["hit"].alias("hit"), F.lit(float(p)).alias("weight")) for k, (p, _, _) in w.signals.items()]),
        "items": F.array(*[F.struct(F.lit(k).alias("id"), held[k]["status"].alias("status"), held[k]["strength"].alias("strength")) for k in CONFIDENCE]),
    }
    found = _totals(rows.withColumns(chips), at, held, w, verdict, gone if gone is not None else F.lit(False))
    return found.drop("__s", "__k", "__step", "__refs", "__found", "__lures", "__low", "__fences")


def rescored(judged: DataFrame, weights: Weights, verdict: Column | None = None, gone: Column | None = None) -> DataFrame:
    """Rows of scored() under other weights, from their stored signals, items and gates: no text is read again.

    The gates stay as they were; a change of least_repos needs scored(). A signal or item that a stored row lacks is unknown.
    """
    # The place of an id among the ids: compiled, where a filter for each of them goes through all entries by an interpreter.
    entry = lambda of, k: F.get(F.col(of), (F.array_position(F.col(f"{of}.id"), k) - 1).cast("int"))
    inner = lambda of, k, other: F.coalesce(F.struct(entry(of, k)["status"].alias("status"), entry(of, k)[other].alias(other)), F.lit(None))
    rows = judged.withColumn("__s", F.struct(*[inner("signals", k, "hit").alias(k.replace(".", "_")) for k in SIGNALS])).withColumn("__k", F.struct(*[inner("items", k, "strength").alias(k.replace(".", "_")) for k in CONFIDENCE]))
    at = {k: {x: F.coalesce(F.col(f"__s.{k.replace('.', '_')}.{x}"), F.lit(y)) for x, y in (("status", "unknown"), ("hit", False))} for k in SIGNALS}
    held = {k: {"strength": F.coalesce(F.col(f"__k.{k.replace('.', '_')}.strength"), F.lit(0.0))} for k in CONFIDENCE}
    points_of = F.create_map(*[F.lit(x) for k, (p, _, _) in weights.signals.items() for x in (k, float(p))])
    chips = F.transform("signals", lambda s: s.withField("weight", F.coalesce(points_of[s["id"]], s["weight"])))
    return _totals(rows.withColumn("signals", chips), at, held, weights, verdict, gone if gone is not None else F.lit(False)).drop("__s", "__k")
