"""Facts of source rows: nested answers of an API become the typed row that the catalogue judges, and later answers are merged into it.

A field that an answer lacks wasn't fetched, and is null; an object that it gives as null is absent, and becomes the empty value.
Answers are read as variants, which keep that difference and each value's kind: a value of another kind than the field's is null.
All is in the row: no shuffle but the join of facts and parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import readers as r
from lodestone.functions.scalars import bound, cut_utf8, fence_lines
from lodestone.operators.catalogue import FACTS

#: Caps of bytes, entries and characters, states of checks, and the activities that push work.
README_BYTES, FILE_BYTES, TREE_ENTRIES, DESCRIPTION_BYTES, HEADLINE_CHARS, RECENT_COMMITS = 32_768, 16_384, 5_000, 1_024, 200, 20
ROLLUPS = ["SUCCESS", "FAILURE", "PENDING", "ERROR", "EXPECTED"]
PUSHES = ["push", "force_push", "pr_merge", "merge_queue_merge", "branch_creation"]


def at(v: Column, path: str) -> Column:
    """The variant at a path below v; null where v has no such field."""
    return F.try_variant_get(v, "$" + path, "variant")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def text(v: Column, path: str = "") -> Column:
    x = at(v, path) if path else v
    return F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string"))


def filled(v: Column, path: str = "") -> Column:
    """A text that isn't blank, else null."""
    x = text(v, path)
    return F.when(F.trim(x) != "", x)


def flag(v: Column, path: str = "") -> Column:
    x = at(v, path) if path else v
    return F.when(kind(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))


def count(v: Column, path: str = "") -> Column:
    """A whole number from 0 on, else null. 3.0 is one."""
    x = at(v, path) if path else v
    number = F.try_variant_get(x, "$", "double")
    return F.when((kind(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")) & (number >= 0) & (number == F.floor(number)), F.try_variant_get(x, "$", "long"))


def shown(v: Column, path: str, otherwise: str) -> Column:
    """Any value as text, `otherwise` where there is none."""
    return F.coalesce(F.try_variant_get(v, "$" + path, "string"), F.lit(otherwise))


def objects(v: Column, path: str = "") -> Column:
    """The objects of an array, as variants; no elements where it isn't one."""
    found = F.filter(F.try_variant_get(v, "$" + path, "array<variant>"), is_object)
    return F.coalesce(found, F.array().cast("array<variant>"))


def entries(v: Column) -> Column:
    """name and type of a folder's entries: null if it wasn't fetched, none if it is absent."""
    made = F.transform(objects(v, ".entries"), lambda e: F.struct(shown(e, ".name", "").alias("name"), shown(e, ".type", "blob").alias("type")))
    return F.when(v.isNotNull(), F.filter(made, lambda e: e["name"] != ""))


def package_summary(body: Column) -> Column:
    """struct(testScript, deps, devDeps, peerDeps, optionalDeps, scripts, name) of a package.json; null if it isn't a JSON object. Scripts stand in order of name, 200 at most."""

    def read(v: Column) -> Column:
        size = lambda k: F.coalesce(F.size(F.map_keys(F.try_variant_get(v, f"$.{k}", "map<string,variant>"))), F.lit(0)).cast("int")
        known = F.map_filter(F.try_variant_get(v, "$.scripts", "map<string,variant>"), lambda _, x: kind(x) == "STRING")
        names = F.slice(F.array_sort(F.coalesce(F.map_keys(known), F.array().cast("array<string>"))), 1, 200)
        sizes = [size(k).alias(n) for k, n in (("dependencies", "deps"), ("devDependencies", "devDeps"), ("peerDependencies", "peerDeps"), ("optionalDependencies", "optionalDeps"))]
        return F.when(is_object(v), F.struct(F.substring(text(v, ".scripts.test"), 1, 500).alias("testScript"), *sizes, names.alias("scripts"), F.substring(text(v, ".name"), 1, 214).alias("name")))

    return bound(F.try_parse_json(F.regexp_replace(body, "^\\x{FEFF}", "")), read)


def readme(v: Column, fallback: Column) -> Column:
    """struct(name, bytes, text, fenceLines): the text up to its cap, the lines of fences of the whole of it."""
    body = text(v, ".text")
    size = F.coalesce(count(v, ".byteSize"), count(v, ".bytes"), count(v, ".size"), F.octet_length(body).cast("long"), F.lit(0))
    made = F.struct(F.coalesce(filled(v, ".name"), fallback, F.lit("README.md")).alias("name"), size.alias("bytes"), cut_utf8(body, README_BYTES).alias("text"), fence_lines(body).cast("long").alias("fenceLines"))
    return F.when(is_object(v), made)


def releases(v: Column) -> Column:
    recent = F.transform(objects(v, ".nodes"), lambda x: F.struct(F.coalesce(F.try_variant_get(x, "$.tagName", "string"), shown(x, ".tag_name", "")).alias("tag"), F.coalesce(text(x, ".publishedAt"), text(x, ".published_at")).alias("publishedAt"), F.coalesce(flag(x, ".isPrerelease"), flag(x, ".prerelease")).alias("prerelease")))
    return F.when(is_object(v), bound(recent, lambda xs: F.struct(F.coalesce(count(v, ".totalCount"), F.size(xs).cast("long")).alias("count"), xs.alias("recent"))))


def commits(branch: Column) -> Column:
    """struct(total, recent): none for an empty repository (a null branch), null where history wasn't fetched."""
    first_line = lambda h: F.substring(F.regexp_replace(h, r"(?s)\r?\n.*$", ""), 1, HEADLINE_CHARS)
    recent = F.transform(F.slice(objects(branch, ".target.history.nodes"), 1, RECENT_COMMITS), lambda x: F.struct(first_line(text(x, ".messageHeadline")).alias("headline"), text(x, ".committedDate").alias("at"), text(x, ".author.user.login").alias("authorLogin")))
    none = F.slice(recent, 1, 0)
    return F.when(F.is_variant_null(branch), F.struct(F.lit(0).cast("long").alias("total"), none.alias("recent"))).when(is_object(at(branch, ".target.history")), F.struct(count(branch, ".target.history.totalCount").alias("total"), recent.alias("recent")))


def languages(v: Column) -> Column:
    """struct(languages, codeBytes)."""
    listed = F.filter(F.transform(objects(v, ".edges"), lambda e: F.struct(shown(e, ".node.name", "").alias("name"), F.coalesce(count(e, ".size"), F.lit(0)).alias("bytes"))), lambda x: x["name"] != "")
    total = lambda xs: F.coalesce(count(v, ".totalSize"), F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["bytes"]))
    return F.when(is_object(v), bound(listed, lambda xs: F.struct(xs.alias("languages"), total(xs).alias("codeBytes"))))


def from_nodes(rows: DataFrame, node: str, fetched_at: str, repair: str | None = None) -> DataFrame:
    """rows (without those columns) with the columns of FACTS, stages, headOid, fetchedAt and problem.

    node: a repository's answer as JSON text; repair: the README found afterwards, as JSON text. A node that isn't an object with an
    owner/name has a problem and null facts.
    """
    n, others = F.col("__n"), [c for c in rows.columns if c not in (node, fetched_at, repair)]
    read = rows.withColumns({"__n": F.try_parse_json(node), "__r": F.try_parse_json(repair) if repair else F.lit(None).cast("variant"), "__fetched": F.col(fetched_at)})
    nwo = text(n, ".nameWithOwner")
    read = read.withColumns({"__nwo": F.when(nwo.rlike(r"^[^/\s]+/[^/\s]+$"), nwo), "__langs": languages(at(n, ".languages")), "__found": F.coalesce(F.when(is_object(at(n, ".readme")), at(n, ".readme")), F.when(is_object(F.col("__r")), F.col("__r")))})
    name = F.col("__nwo")
    size_of = lambda v: F.when(v.isNotNull(), F.coalesce(F.when(is_object(v), count(v, ".byteSize")), F.lit(0)))
    owner = F.struct(
        F.coalesce(text(n, ".owner.login"), F.substring_index(name, "/", 1)).alias("login"), F.coalesce(text(n, ".owner.__typename"), F.lit("Unknown")).alias("type"), text(n, ".owner.createdAt").alias("createdAt"),
        count(n, ".owner.repositories.totalCount").alias("publicRepos"), F.lit(None).cast("array<int>").alias("contributionYears"), F.lit(None).cast("boolean").alias("sponsorsListing"),
    )
    rollup, licence = text(n, ".defaultBranchRef.target.statusCheckRollup.state"), at(n, ".licenseInfo")
    made = {
        "nwo": name, "owner": F.substring_index(name, "/", 1), "name": F.substring_index(name, "/", -1), "description": cut_utf8(text(n, ".description"), DESCRIPTION_BYTES),
        "licence": F.when(is_object(licence), F.coalesce(filled(licence, ".spdxId"), filled(licence, ".spdx_id"), F.lit("NOASSERTION"))), "createdAt": text(n, ".createdAt"), "pushedAt": text(n, ".pushedAt"),
        "stars": count(n, ".stargazerCount"), "forks": count(n, ".forkCount"), "diskKB": count(n, ".diskUsage"), "lang": text(n, ".primaryLanguage.name"), "homepageUrl": filled(n, ".homepageUrl"), "codeBytes": F.col("__langs.codeBytes"),
        "languages": F.col("__langs.languages"), "releases": releases(at(n, ".releases")), "tags": count(n, ".tags.totalCount"), "ownerInfo": F.when(is_object(at(n, ".owner")), owner), "commits": commits(at(n, ".defaultBranchRef")),
        "root": entries(at(n, ".root")), "workflows": F.transform(entries(at(n, ".wf")), lambda e: F.struct(e["name"], F.lit(None).cast("string").alias("text"))), "readme": readme(F.col("__found"), text(F.col("__r"), ".name")),
        "packageJson": F.when(is_object(at(n, ".pkg")), package_summary(text(n, ".pkg.text"))), "rollup": F.when(rollup.isin(ROLLUPS), rollup), "agentsMdBytes": size_of(at(n, ".agents")), "claudeMdBytes": size_of(at(n, ".claude")), "hasIssues": flag(n, ".hasIssuesEnabled"), "hasDiscussions": flag(n, ".hasDiscussionsEnabled"),
    }
    empty = rows.sparkSession.createDataFrame([], FACTS).schema
    facts = [F.when(name.isNotNull(), made[f.name]).cast(f.dataType).alias(f.name) if f.name in made else F.lit(None).cast(f.dataType).alias(f.name) for f in empty]
    return read.select(*[F.col(f"`{c}`") for c in others], *facts, F.array(F.lit("enrich")).alias("stages"), text(n, ".defaultBranchRef.target.oid").alias("headOid"), F.col("__fetched").alias("fetchedAt"), F.when(name.isNull(), "no repository of that name").alias("problem"))


def tree(v: Column, most: int = TREE_ENTRIES) -> Column:
    """struct(count, truncated, entries) of a listing: an array of entries (objects or [path, type, size]), or an object with entries or tree; null for anything else."""
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.entries", "array<variant>"), F.try_variant_get(v, "$.tree", "array<variant>"))
    one = lambda e: F.when(is_object(e), F.struct(text(e, ".path").alias("path"), F.coalesce(text(e, ".type"), F.lit("blob")).alias("type"), count(e, ".size").alias("size"))).otherwise(F.struct(text(e, "[0]").alias("path"), F.coalesce(text(e, "[1]"), F.lit("blob")).alias("type"), count(e, "[2]").alias("size")))
    kept = F.filter(F.transform(items, one), lambda e: e["path"] != "")
    made = lambda es: F.struct(F.greatest(F.coalesce(count(v, ".count"), F.lit(0)), F.size(es).cast("long")).alias("count"), (F.coalesce(flag(v, ".truncated"), F.lit(False)) | (F.size(es) > most)).alias("truncated"), F.slice(es, 1, most).alias("entries"))
    return F.when(items.isNotNull(), bound(kept, made))


def activity(v: Column) -> Column:
    """struct(pushDays, firstAt, lastAt) of a page of activity: distinct days with pushed work; what is reduced already is kept."""
    pushes = F.filter(objects(v), lambda e: text(e, ".activity_type").isin(PUSHES) & text(e, ".timestamp").try_cast("timestamp").isNotNull())
    times = F.array_sort(F.transform(pushes, lambda e: F.struct(text(e, ".timestamp").try_cast("timestamp").alias("t"), text(e, ".timestamp").alias("said"))))
    reduced = F.struct(F.coalesce(count(v, ".pushDays"), F.lit(0)).alias("pushDays"), text(v, ".firstAt").alias("firstAt"), text(v, ".lastAt").alias("lastAt"))
    made = lambda ts: F.struct(F.size(F.array_distinct(F.transform(ts, lambda x: F.substring(x["said"], 1, 10)))).cast("long").alias("pushDays"), F.get(ts, F.lit(0))["said"].alias("firstAt"), F.try_element_at(ts, F.lit(-1))["said"].alias("lastAt"))
    return F.when(is_object(v) & at(v, ".pushDays").isNotNull(), reduced).when(F.try_variant_get(v, "$", "array<variant>").isNotNull(), bound(times, made))


def gain(v: Column, weeks: int = 4) -> Column:
    """Stars gained in the newest weeks of a history: an array of (week, total or gained), or an object with weeks. Null for anything else."""
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.weeks", "array<variant>"))

    def one(e: Column) -> Column:
        number = F.when(kind(at(e, ".week")).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(e, "$.week", "double"))
        day = text(e, ".week").try_cast("timestamp")
        gained = F.coalesce(F.try_variant_get(e, "$.gained", "long"), F.try_variant_get(e, "$.total", "long"), F.lit(0))
        return F.struct(F.coalesce(F.when(number < 1e12, number).otherwise(number / 1000), F.unix_seconds(day).cast("double")).alias("at"), gained.alias("gained"))

    dated = F.filter(F.transform(F.filter(items, is_object), one), lambda e: e["at"].isNotNull())
    newest = F.slice(F.reverse(F.array_sort(dated)), 1, weeks)
    return F.when(items.isNotNull(), F.aggregate(newest, F.lit(0).cast("long"), lambda a, e: a + e["gained"]))


def outsiders(node: Column, owner: Column) -> Column:
    """Authors other than the owner of recent issues and pull requests; null if neither was fetched."""
    of = lambda path: objects(node, path + ".nodes")
    made = F.transform(F.concat(of(".issues"), of(".pullRequests")), lambda x: F.struct(filled(x, ".author.login").alias("login"), text(x, ".author.createdAt").alias("accountCreatedAt"), text(x, ".createdAt").alias("at")))
    kept = F.filter(made, lambda x: x["login"].isNotNull() & (F.coalesce(x["at"], F.lit("")) != "") & (F.lower(x["login"]) != F.lower(owner)))
    return F.when(is_object(at(node, ".issues")) | is_object(at(node, ".pullRequests")), kept)


def merged(facts: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """facts with the parts of a deeper look (node, tree, activity, stars, files, each JSON text or null), joined by key; stages and deepHeadOid say so.

    A part that is null leaves its fields as they were, and so do fields that a part lacks. Of files (path to {text, byteSize} or
    null): texts of workflows, the first manifest at the root other than package.json, and a fuller package.json. parts must be
    unique by key.
    """
    asked = parts.select(F.col(key).alias("__key"), *[F.try_parse_json(c).alias(f"__{c}") for c in ("node", "tree", "activity", "stars", "files")])
    rows = facts.join(asked, F.col(key) == F.col("__key"), "left")
    deep, node, files = F.col("__key").isNotNull(), F.col("__node"), F.try_variant_get("__files", "$", "map<string,variant>")
    kept = lambda new, c: F.coalesce(new, F.col(c))
    o = F.col("ownerInfo")
    years = F.array_sort(F.filter(F.try_variant_get(node, "$.owner.contributionsCollection.contributionYears", "array<int>"), lambda y: y.isNotNull()))
    owner = F.struct(
        F.coalesce(o["login"], F.col("owner")).alias("login"), F.coalesce(o["type"], F.lit("Unknown")).alias("type"), o["createdAt"].alias("createdAt"), o["publicRepos"].alias("publicRepos"),
        F.coalesce(years, o["contributionYears"]).alias("contributionYears"), F.coalesce(flag(node, ".owner.hasSponsorsListing"), o["sponsorsListing"]).alias("sponsorsListing"),
    )
    body = lambda path: text(files[path], ".text")
    named = F.transform(F.filter(F.map_keys(files), lambda p: p.rlike(r"^\.github/workflows/[^/]+$")), lambda p: F.substring_index(p, "/", -1))
    held = F.coalesce("workflows", F.array().cast("array<struct<name:string,text:string>>"))
    file = lambda n: F.concat(F.lit(".github/workflows/"), n)
    flows = F.concat(F.transform(held, lambda w: F.struct(w["name"], F.coalesce(cut_utf8(body(file(w["name"])), FILE_BYTES), w["text"]).alias("text"))), F.transform(F.array_sort(F.array_except(named, F.transform(held, lambda w: w["name"]))), lambda x: F.struct(x.alias("name"), cut_utf8(body(file(x)), FILE_BYTES).alias("text"))))
    in_root = F.transform(F.filter(F.coalesce("root", F.array().cast("array<struct<name:string,type:string>>")), lambda e: ~e["type"].eqNullSafe("tree")), lambda e: e["name"])
    candidates = F.filter(F.concat(in_root, F.array_sort(F.map_keys(files))), lambda p: ~F.contains(p, F.lit("/")) & (F.lower(p) != "package.json") & r.is_manifest(p) & body(p).isNotNull())
    manifest = bound(F.get(candidates, F.lit(0)), lambda p: F.when(p.isNotNull(), F.struct(p.alias("path"), cut_utf8(body(p), FILE_BYTES).alias("text"))))
    funding = F.transform(F.filter(F.try_variant_get(node, "$.fundingLinks", "array<variant>"), is_object), lambda x: shown(x, ".url", ""))
    new = {
        "ownerInfo": F.when(is_object(at(node, ".owner")), owner).otherwise(o), "releases": kept(releases(at(node, ".releases")), "releases"), "outsiders": kept(outsiders(node, F.col("owner")), "outsiders"), "funding": kept(funding, "funding"),
        "tree": kept(tree(F.col("__tree")), "tree"), "activity": kept(activity(F.col("__activity")), "activity"), "gain4w": kept(gain(F.col("__stars")), "gain4w"), "workflows": F.when(F.size(named) > 0, flows).otherwise(F.col("workflows")),
        "manifest": kept(manifest, "manifest"), "packageJson": kept(package_summary(body(F.lit("package.json"))), "packageJson"), "stages": F.when(deep, F.array_union("stages", F.array(F.lit("deep")))).otherwise(F.col("stages")), "deepHeadOid": F.when(deep, F.col("headOid")),
    }
    kinds = {f.name: f.dataType for f in facts.schema}
    return rows.withColumns({c: x.cast(kinds[c]) if c in kinds else x for c, x in new.items()}).select(*facts.columns, *[c for c in ("deepHeadOid",) if c not in facts.columns])
