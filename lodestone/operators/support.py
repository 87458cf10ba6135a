"""What a reader can do for a repository: try it by a command that checks out, and the ladder of support, as expressions over a row of facts.

A command is shown only if the README's code has it and its target is the repository's own: the package, crate or project that a
manifest names, a module path inside it, or a script that exists. It is built again of the checked parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import lexicons as lex
from lodestone.functions.readers import code_parts, lines_of
from lodestone.functions.scalars import bound, crate_key, package_key, safe_link

FEEDBACK = "Try it first; then say what you tried, what worked and what did not, kindly."


def repo_url(nwo: Column, *segments: str) -> Column:
    """The repository's address, null for what isn't owner/name."""
    return F.when(F.trim(nwo).rlike(lex.NWO), F.concat_ws("/", F.lit("https://github.com"), F.trim(nwo), *map(F.lit, segments)))


def toml_name(text: Column, sections: list[str]) -> Column:
    """The value of `name` in the first of the sections that has one."""
    header = r"^[ \t]*\[\s*{}\s*\][ \t]*(?:#[^\n]*)?\r?$"
    wanted, any_ = header.format("(?:" + "|".join(x.replace(".", r"\.") for x in sections) + ")"), header.format(r"[^\]\s]+")
    pattern = rf"""(?ms){wanted}(?:(?!{any_}).)*?^[ \t]*name\s*=\s*(?:"([^"]+)"|'([^']+)')"""
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")))


def commands(text: Column) -> Column:
    """The simple commands of a README's code, in order: without comments, prompts and sudo, chains taken apart."""
    lines = F.slice(F.flatten(F.transform(code_parts(text), lambda part: F.split(lines_of(part), "\n"))), 1, lex.MOST_COMMANDS)
    bare = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+#.*$|\t", " "))), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("//"))
    parts = F.flatten(F.transform(bare, lambda x: F.split(F.regexp_replace(x, r"^(?:\$|%|>|PS>)\s+", ""), r"\s*(?:&&|\|\||;)\s*")))
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"^sudo\s+", ""))), lambda x: x != "")


def _hit(command: Column, basis: str) -> Column:
    return F.struct(command.alias("command"), F.lit(basis).alias("basis"))


def _tokens(command: Column, pattern: str, flags: list[str]) -> Column:
    """struct(flags, only) of what stands behind a command: null unless it has one word besides these flags."""
    rest = F.regexp_extract(command, pattern + r"\s+(\S.*)$", 1)

    def read(words: Column) -> Column:
        given, own = F.filter(words, lambda w: w.startswith("-")), F.filter(words, lambda w: ~w.startswith("-"))
        fine = (F.size(own) == 1) & F.forall(given, lambda w: w.isin(flags))
        return F.when(fine, F.struct(given.alias("flags"), own[0].alias("only")))

    return F.when(rest != "", bound(F.split(F.trim(rest), r"\s+"), read))


def install_command(nwo: Column, readme: Column, package: Column, manifest: Column) -> Column:
    """struct(command, basis) of the first command of the README that checks out, else null. package: struct(name, scripts, ...); manifest: struct(path, text)."""
    of_file = lambda name: F.when(F.lower(manifest["path"]) == name, manifest["text"])
    known = F.struct(
        package["name"].alias("package"), package["scripts"].alias("scripts"), toml_name(of_file("cargo.toml"), ["package"]).alias("crate"), toml_name(of_file("pyproject.toml"), ["project", "tool.poetry"]).alias("project"),
        F.nullif(F.lower(F.regexp_extract(of_file("go.mod"), r"(?m)^\s*module\s+(\S+)", 1)), F.lit("")).alias("module"), F.lower(F.concat(F.lit("github.com/"), nwo)).alias("home"),
    )

    def npm(x: Column, k: Column) -> Column:
        checked = lambda t: bound(F.regexp_replace(t["only"], "^(.+)@[^@]*$", "$1"), lambda name: F.when((name == k["package"]) & name.rlike(lex.NPM_NAME), _hit(F.concat(F.lit("npm install "), F.when(F.size(t["flags"]) > 0, "-g ").otherwise(""), name), "The README installs the package that package.json names.")))
        return bound(_tokens(x, r"^npm\s+(?:i|install|add)", ["-g", "--global"]), checked)

    def cargo(x: Column, k: Column) -> Column:
        checked = lambda t: F.when(t["only"].rlike(lex.CRATE_NAME) & (crate_key(t["only"]) == crate_key(k["crate"])), _hit(F.concat(F.lit("cargo install "), t["only"], F.when(F.size(t["flags"]) > 0, " --locked").otherwise("")), "The README installs the crate that Cargo.toml names."))
        return bound(_tokens(x, r"^cargo\s+install", ["--locked"]), checked)

    def pip(x: Column, k: Column) -> Column:
        tool = F.when(x.startswith("pipx"), "pipx").otherwise("pip")
        checked = lambda t: bound(F.regexp_extract(F.regexp_replace(t["only"], "^[\"']|[\"']$", ""), lex.PY_SPEC, 1), lambda name: F.when((name != "") & (package_key(name) == package_key(k["project"])), _hit(F.concat(tool, F.lit(" install "), name), "The README installs the project that pyproject.toml names.")))
        return bound(_tokens(x, r"^(?:pipx|pip3?|python3?\s+-m\s+pip|py\s+-m\s+pip)\s+install", ["-U", "--upgrade", "--user"]), checked)

    def go(x: Column, k: Column) -> Column:
        within = lambda path, root: (path == root) | path.startswith(F.concat(root, F.lit("/")))
        inside = lambda p: within(p, k["home"]) & F.coalesce(within(p, k["module"]), F.lit(True)) & ~F.contains(p, F.lit(".."))
        return bound(F.regexp_extract(x, r"^go\s+install\s+(\S+)$", 1), lambda spec: F.when(inside(F.lower(F.regexp_extract(spec, lex.GO_SPEC, 1))), _hit(F.concat(F.lit("go install "), spec), "The module path is inside this repository.")))

    def script(x: Column, k: Column) -> Column:
        named = F.regexp_extract(x, r"^npm\s+(?:run(?:-script)?\s+(\S+)|start)(?:\s|$)", 1)
        start = x.rlike(r"^npm\s+start(?:\s|$)")
        checked = lambda name: F.when(name.rlike(lex.SCRIPT_NAME) & ~name.rlike(lex.HOUSEKEEPING) & F.array_contains(k["scripts"], name), _hit(F.when(start, "npm start").otherwise(F.concat(F.lit("npm run "), name)), "package.json defines this script."))
        return bound(F.when(start, "start").otherwise(named), checked)

    candidates = F.filter(commands(readme), lambda x: x.rlike(r"^(npm|cargo|pipx?|pip3|python3?|py|go)\s"))
    found = bound(known, lambda k: F.array_compact(F.transform(candidates, lambda x: F.coalesce(npm(x, k), cargo(x, k), pip(x, k), go(x, k), script(x, k)))))
    return F.when(repo_url(nwo).isNotNull() & readme.isNotNull(), F.get(found, F.lit(0)))


def ladder(page_url: Column | None = None) -> Column:
    """The rungs that apply to a row of facts, in order: array of struct(kind, label, url, command, basis, note)."""
    none = F.lit(None).cast("string")
    nwo = F.col("nwo")
    rung = lambda when, kind, label, url=none, command=none, basis=none, note=none: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), url.alias("url"), command.alias("command"), basis.alias("basis"), note.alias("note")))
    released = (F.coalesce("releases.count", F.lit(0)) > 0) | (F.coalesce("tags", F.lit(0)) > 0)
    where = F.when(F.col("hasDiscussions"), repo_url(nwo, "discussions")).when(F.col("hasIssues"), repo_url(nwo, "issues"))
    safe = F.array_compact(F.transform("funding", safe_link))
    at_home = F.filter(safe, lambda u: u.rlike(r"(?i)^https?://github\.com/"))
    sponsor = F.coalesce(F.get(at_home, F.lit(0)), F.get(safe, F.lit(0)), F.when(F.col("ownerInfo.sponsorsListing"), F.concat(F.lit("https://github.com/sponsors/"), F.substring_index(nwo, "/", 1))))
    page = page_url if page_url is not None else none
    always = F.lit(True)

    def rungs(x: Column) -> Column:
        return F.array_compact(F.array(
            rung(x["command"].isNotNull(), "try", "Try it", command=x["command"], basis=x["basis"]), rung(safe_link(F.col("homepageUrl")).isNotNull(), "demo", "Open the demo", safe_link(F.col("homepageUrl"))), rung(always, "star", "Star it yourself", repo_url(nwo)),
            rung(released, "releases", "Follow releases", repo_url(nwo, "releases.atom")), rung(where.isNotNull(), "feedback", "Give feedback after trying it", where, note=F.lit(FEEDBACK)), rung(page != "", "share", "Share this page", page), rung(sponsor.isNotNull(), "sponsor", "Sponsor the maintainer", sponsor),
        ))

    empty = F.array().cast("array<struct<kind:string,label:string,url:string,command:string,basis:string,note:string>>")
    return F.when(repo_url(nwo).isNotNull(), bound(install_command(nwo, F.col("readme.text"), F.col("packageJson"), F.col("manifest")), rungs)).otherwise(empty)
