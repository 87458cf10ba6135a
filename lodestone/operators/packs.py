"""Evidence packs: for each repository one bounded text of facts, tree and chosen files for a reviewer, with the owner masked.

Which file fills which role is an expression over the row of facts. The files that are asked for (six at most, capped) are joined by
repository and path. Texts are prepared by expressions; only the last step, which fits the sections to the pack's size by cutting them
in a fixed order, is a function of Arrow batches, as each cut depends on the sizes after the one before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.functions import lexicons as lex
from lodestone.functions.scalars import bound, comments, cut_utf8, without_comments

#: Most bytes of a pack, lines of its tree, bytes of a file that is fetched and of one that may be chosen as source.
MOST_BYTES, TREE_LINES, FETCHED_BYTES, SOURCE_BYTES = 48 * 1024, 400, 16 * 1024, 256 * 1024

#: Packs that are Python objects at a time.
ROWS = 64

SLOT = "struct<role:string,path:string,text:string,bytes:bigint,known:boolean>"


def _slot(role: str, path: Column, text: Column | None = None, size: Column | None = None) -> Column:
    body = text if text is not None else F.lit(None).cast("string")
    made = F.struct(F.lit(role).alias("role"), path.alias("path"), body.alias("text"), (size if size is not None else F.lit(None)).cast("bigint").alias("bytes"), body.isNotNull().alias("known"))
    return F.when(path.isNotNull(), made)


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(_name(path), r"^.+\.([^.]*)$", 1))


def in_folder(path: Column, names: list[str], suffix: str = "") -> Column:
    parts = F.split(F.lower(path), "/")
    return F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda d: d.isin(names) | (d.endswith(suffix) if suffix else F.lit(False)))


def is_test(path: Column) -> Column:
    return in_folder(path, lex.PACK_TEST_DIRS, ".tests") | reduce(lambda a, b: a | b, [_name(path).rlike(p) for p in lex.PACK_TEST_FILES])


def is_excluded(path: Column) -> Column:
    return in_folder(path, lex.EXCLUDED_DIRS) | F.lower(_name(path)).isin(lex.PACK_LOCKFILES) | _name(path).rlike(lex.GENERATED_FILES)


def blobs() -> Column:
    """path and size of the files of the tree, else of the root."""
    listed = F.transform(F.filter("tree.entries", lambda e: (e["type"] == "blob") & e["path"].isNotNull()), lambda e: F.struct(e["path"].alias("path"), e["size"].alias("size")))
    shown = F.transform(F.filter("root", lambda e: (e["type"] == "blob") & e["name"].isNotNull()), lambda e: F.struct(e["name"].alias("path"), F.lit(None).cast("long").alias("size")))
    return F.coalesce(F.when(F.size("tree.entries") > 0, listed), shown, F.array().cast("array<struct<path:string,size:bigint>>"))


def planned(facts: DataFrame) -> DataFrame:
    """facts with slots: an array of SLOT, one for each role that a file fills, in order. A slot whose text the facts hold is known."""
    names = F.transform(F.coalesce("root", F.array().cast("array<struct<name:string,type:string>>")), lambda e: e["name"])
    rows = facts.withColumns({"__blobs": blobs(), "__names": F.filter(names, lambda n: n != "")})
    rows = rows.withColumn("__paths", F.transform("__blobs", lambda b: b["path"]))
    files = F.col("__blobs")
    has = lambda p: F.array_contains("__paths", p) | (~F.contains(p, F.lit("/")) & F.array_contains("__names", p))
    size = lambda p: F.get(F.filter(files, lambda x: x["path"] == p), F.lit(0))["size"]
    first = lambda xs: F.get(xs, F.lit(0))
    suffixed = F.filter("__names", lambda n: reduce(lambda a, b: a | b, [F.lower(n).endswith(x) for x in lex.PACK_MANIFEST_SUFFIXES]))
    by_name = F.coalesce(first(F.filter(F.array(*map(F.lit, lex.PACK_MANIFESTS)), has)), first(suffixed))
    package = F.coalesce(has(F.lit("package.json")), F.lit(False))
    held = F.col("manifest.path").isNotNull() & F.col("manifest.text").isNotNull()
    manifest = F.when(package, _slot("manifest", F.lit("package.json"), None, size(F.lit("package.json")))).when(held, _slot("manifest", F.col("manifest.path"), F.col("manifest.text"))).otherwise(bound(by_name, lambda p: _slot("manifest", p, None, size(p))))
    flows = F.filter("workflows", lambda w: w["name"].rlike(r"(?i)\.ya?ml$"))
    read = F.filter(flows, lambda w: w["text"].isNotNull())
    flow = F.coalesce(first(F.filter(read, lambda w: w["text"].rlike(lex.PACK_TEST_COMMAND))), first(read), first(F.filter(flows, lambda w: w["name"].rlike("(?i)test|ci|build|check"))), first(flows))
    workflow = bound(flow, lambda w: bound(F.concat(F.lit(".github/workflows/"), w["name"]), lambda p: _slot("workflow", p, w["text"], size(p))))
    small = lambda x: F.coalesce(x["size"] <= SOURCE_BYTES, F.lit(True)) & extension(x["path"]).isin(lex.SOURCE_EXTENSIONS) & ~is_excluded(x["path"])
    rows = rows.withColumns({"__manifest": manifest, "__workflow": workflow, "__code": F.filter(files, small)})
    rows = rows.withColumns({"__sources": F.filter("__code", lambda x: ~is_test(x["path"])), "__tests": F.filter("__code", lambda x: is_test(x["path"]))})
    # * stands for a stretch within a segment.
    globs = ["^" + "[^/]*".join(part.replace(".", r"\.") for part in glob.split("*")) + "$" for glob in lex.ENTRY_POINTS]
    sources = F.transform("__sources", lambda x: x["path"])
    fits = lambda glob: lambda p: p.rlike(glob)
    entry = F.coalesce(*[first(F.filter(sources, fits(g))) for g in globs])
    taken = lambda *slots: F.array_compact(F.array(*[F.col(x)["path"] for x in slots]))
    free = lambda p, *slots: ~F.coalesce(F.array_contains(taken(*slots), p), F.lit(False))
    # The largest, and of these the first by path.
    largest = lambda of, *slots: F.get(F.array_sort(F.transform(F.filter(of, lambda x: x["size"].isNotNull() & free(x["path"], *slots)), lambda x: F.struct((-x["size"]).alias("order"), x["path"].alias("path"), x["size"].alias("size")))), F.lit(0))
    rows = rows.withColumn("__entry", bound(entry, lambda p: F.when(free(p, "__manifest", "__workflow"), _slot("entry", p, None, size(p)))))
    rows = rows.withColumn("__source", bound(largest("__sources", "__manifest", "__workflow", "__entry"), lambda x: _slot("source", x["path"], None, x["size"])))
    rows = rows.withColumn("__test", bound(largest("__tests", "__manifest", "__workflow", "__entry", "__source"), lambda x: _slot("test", x["path"], None, x["size"])))
    alike = lambda n: F.coalesce(*[first(F.filter(of, lambda p: F.lower(p) == n.lower())) for of in ("__paths", "__names")[: 1 if "/" in n else 2]])
    notes = F.filter(F.array_compact(F.array(*map(alike, lex.DESIGN_NOTES))), lambda p: free(p, "__manifest", "__workflow", "__entry", "__source", "__test"))
    rows = rows.withColumn("__design", bound(first(notes), lambda p: _slot("design", p, None, size(p))))
    slots = [f"__{role}" for role in lex.PACK_ROLES[1:]]
    return rows.withColumn("slots", F.array_compact(F.array(*slots)).cast(f"array<{SLOT}>")).drop(*slots, "__blobs", "__names", "__paths", "__code", "__sources", "__tests")


def asked(plan: DataFrame, key: str) -> DataFrame:
    """key, path and place of the files to fetch: those of slots whose text isn't known."""
    return plan.select(key, F.posexplode(F.transform(F.filter("slots", lambda s: ~s["known"]), lambda s: s["path"])).alias("place", "path"))


def masked(text: Column, owner: Column, repo: Column) -> Column:
    """The owner's login as OWNER where it names the owner: in addresses, after @, before @host and before /repo; and as a word of its own, unless it is short or an everyday word."""
    quoted = lambda x: F.regexp_replace(F.trim(x), r"([.*+?^${}()|\[\]\\])", r"\\$1")
    before, after = "(?<![A-Za-z0-9-])", "(?![A-Za-z0-9-])"
    login, name = quoted(owner), quoted(F.coalesce(repo, F.lit("")))
    everywhere = (F.char_length(F.trim(owner)) > 3) & ~F.lower(F.trim(owner)).isin(lex.COMMON_LOGINS)
    pattern = F.concat(
        F.lit(r"(?i)(?<=(?:github\.com|githubusercontent\.com)/)"), login, F.lit(after + r"|(?<=(?:^|[^\w.%+-])@)"), login, F.lit(after + "|" + before), login, F.lit(r"(?=\.github\.io" + after + r")|(?<![\w.%-])"), login, F.lit(r"(?=@[A-Za-z0-9-]+\.)"),
        F.when(name != "", F.concat(F.lit("|" + before), login, F.lit("(?=/"), name, F.lit("(?![A-Za-z0-9_-]))"))).otherwise(""), F.when(everywhere, F.concat(F.lit("|" + before), login, F.lit(after))).otherwise(""),
    )
    return F.when(F.coalesce(F.trim(owner), F.lit("")) != "", F.regexp_replace(text, pattern, F.lit("OWNER"))).otherwise(text)


def escaped(text: Column) -> Column:
    r"""Quotes, angles, backslashes, control and invisible characters as \uXXXX."""
    odd = F.regexp_extract_all(text, F.lit(rf'[\x00-\x1F\x7F\x{{2028}}\x{{2029}}{lex.UNSHOWN}"\\<>]'), F.lit(0))
    code = lambda ch: F.lower(F.ltrim(F.hex(F.encode(ch, "UTF-32")), F.lit("0")))
    written = lambda ch: bound(code(ch), lambda x: F.when(F.length(x) > 4, F.concat(F.lit("\\u{"), x, F.lit("}"))).otherwise(F.concat(F.lit("\\u"), F.lpad(x, 4, "0"))))
    backslash_first = lambda found: F.array_sort(F.array_distinct(found), lambda a, b: F.when(a == b, 0).when(a == "\\", -1).when(b == "\\", 1).when(a < b, -1).otherwise(1))
    return F.when(F.size(odd) > 0, F.aggregate(backslash_first(odd), text, lambda out, ch: F.replace(out, ch, written(ch)))).otherwise(text)


def prepared(text: Column, path: Column, owner: Column, repo: Column, mark: Column) -> Column:
    """struct(text, notes, cut) of a file's text: comments of Markdown and invisible characters taken out (with a note), the owner masked, all from the pack's mark on cut."""
    markdown = _name(path).rlike(r"(?i)\.(md|markdown|mdx)$|^readme$")
    plain = F.when(markdown, without_comments(text)).otherwise(text)
    hidden = F.char_length(F.regexp_replace(plain, f"[^{lex.UNSHOWN}]+", ""))
    counted = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}"), F.when(n == 1, "").otherwise("s")))
    removed = F.array_compact(F.array(counted(F.when(markdown, comments(text)).otherwise(0), "HTML comment"), counted(hidden, "invisible character")))
    note = F.when(F.size(removed) > 0, F.concat(F.lit("Note: "), F.array_join(removed, " and "), F.lit(' removed from "'), escaped(masked(path, owner, repo)), F.lit('".'))).otherwise("")
    body = masked(F.regexp_replace(plain, f"[{lex.UNSHOWN}]", ""), owner, repo)
    return bound(body, lambda x: F.struct(F.call_function("substring_index", x, mark, F.lit(1)).alias("text"), note.alias("note"), F.contains(x, mark).alias("cut")))


def _tree_lines(owner: Column, repo: Column) -> Column:
    """Collapsed folders with their numbers of files, then source folders, the root and the rest; paths escaped and masked."""
    listed = F.when(F.size("tree.entries") > 0, blobs()).otherwise(F.transform(F.coalesce("root", F.array().cast("array<struct<name:string,type:string>>")), lambda e: F.struct(F.concat(e["name"], F.when(e["type"] == "tree", "/").otherwise("")).alias("path"), F.lit(None).cast("long").alias("size"))))
    folder = rf"(?i)^((?:[^/]+/)*?(?:{'|'.join(lex.COLLAPSED_DIRS)})/)[^/]"
    placed = F.transform(listed, lambda x: F.struct(F.regexp_extract(x["path"], folder, 1).alias("under"), x["path"].alias("path"), x["size"].alias("size")))
    shown = lambda p: bound(escaped(p), lambda e: F.when((e == p) & (F.trim(p) == p), p).otherwise(F.concat(F.lit('"'), e, F.lit('"'))))

    def lines(xs: Column) -> Column:
        unders = F.filter(F.transform(xs, lambda x: x["under"]), lambda u: u != "")
        folded = F.transform(F.array_distinct(unders), lambda u: F.concat(shown(u), F.lit(" ("), F.format_number(F.size(F.filter(unders, lambda v: v == u)), 0), F.lit(" files, collapsed)")))
        kept = F.filter(xs, lambda x: x["under"] == "")
        group = lambda x: F.when(~F.contains(F.regexp_replace(x["path"], "/$", ""), F.lit("/")), 1).when(F.lower(F.substring_index(x["path"], "/", 1)).isin(lex.PACK_SOURCE_DIRS), 0).otherwise(2)
        of = lambda k: lambda x: group(x) == k
        parts = [F.transform(F.filter(kept, of(k)), lambda x: F.concat(shown(x["path"]), F.coalesce(F.concat(F.lit(" "), x["size"].cast("string")), F.lit("")))) for k in (0, 1, 2)]
        return F.concat(folded, *parts)

    return F.transform(bound(placed, lines), lambda line: masked(line, owner, repo))


def _fact_lines(owner: Column, repo: Column) -> Column:
    quoted = lambda x, most: F.concat(F.lit('"'), escaped(bound(masked(x, owner, repo), lambda m: F.when(F.char_length(m) > most, F.concat(F.substring(m, 1, most - 1), F.lit("…"))).otherwise(m))), F.lit('"'))
    total = F.aggregate("languages", F.lit(0).cast("long"), lambda a, x: a + x["bytes"])
    share = lambda x: F.when(total > 0, F.concat(F.lit(" ("), F.round(100 * x["bytes"] / total).cast("int").cast("string"), F.lit(" %)"))).otherwise("")
    langs = F.array_join(F.transform("languages", lambda x: F.concat(quoted(x["name"], 40), F.lit(" "), F.format_number(x["bytes"], 0), F.lit(" bytes"), share(x))), ", ")
    day = lambda c: F.when(F.length(c) >= 10, F.substring(c, 1, 10)).otherwise("unknown")
    recent = F.array_join(F.transform(F.slice("releases.recent", 1, 5), lambda x: F.concat(quoted(x["tag"], 40), F.lit(" "), day(x["publishedAt"]), F.when(x["prerelease"].eqNullSafe(True), " (prerelease)").otherwise(""))), ", ")
    flows = F.array_join(F.transform("workflows", lambda w: quoted(w["name"], 60)), ", ")
    tests = F.size(F.filter(F.transform(blobs(), lambda b: b["path"]), lambda p: is_test(p) & ~is_excluded(p))).cast("string")
    said = F.when(F.col("tree").isNotNull(), F.concat(F.lit("- Test files in the tree: "), tests)).otherwise(F.concat(F.lit("- Test files at the root: "), tests, F.lit(" (the full tree was not fetched)")))
    lines = [
        F.concat(F.lit("- Languages: "), F.when(F.coalesce(F.size("languages"), F.lit(0)) > 0, langs).otherwise("unknown")), F.concat(F.lit("- Code: "), F.coalesce(F.concat(F.format_number("codeBytes", 0), F.lit(" bytes")), F.lit("unknown"))),
        F.concat(F.lit("- Licence: "), F.coalesce(quoted(F.col("licence"), 40), F.lit("none detected"))), F.concat(F.lit("- Created "), day(F.col("createdAt")), F.lit("; last push "), day(F.col("pushedAt"))),
        F.coalesce(F.concat(F.lit("- Releases: "), F.col("releases.count").cast("string"), F.when(recent != "", F.concat(F.lit(", latest "), recent)).otherwise(""), F.coalesce(F.concat(F.lit("; tags: "), F.col("tags").cast("string")), F.lit(""))), F.lit("- Releases: unknown")),
        said, F.concat(F.lit("- Workflows: "), F.when(F.col("workflows").isNull(), "unknown").when(flows != "", flows).otherwise("none")), F.concat(F.lit("- CI state on the scored commit: "), F.coalesce("rollup", F.lit("unknown"))),
    ]
    return F.array_join(F.array(*lines), "\n")


def cut_text(text: str, limit: int) -> tuple[str, bool]:
    """At most so many bytes of whole characters; back to a line's end, if one lies in the last quarter."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= limit:
        return text, False
    kept = raw[: max(0, limit)].decode("utf-8", "ignore")
    end = kept.rfind("\n")
    return (kept[: end + 1] if end >= 0 and end >= len(kept) * 0.75 else kept), True


class _Draft:
    """The sections of one pack and their limits at the moment."""

    def __init__(self, head: str, facts: str, mark: str, tree: list[str], lines: int, total: int, notes: list[str], files: list[dict]) -> None:
        self.mark, self.tree, self.total, self.files = mark, tree, total, files
        self.top = "\n".join([head, "", "## Facts (quoted strings come from the repository)", cut_text(facts, lex.PACK_CAPS["facts"])[0], "", "## Tree", *notes])
        self.lines = lines
        self.limit = {k: lex.PACK_CAPS[k] for k in lex.PACK_CAPS}

    def tree_block(self) -> str:
        out, left = [], self.limit["tree"]
        for line in self.tree:
            left -= len(line.encode()) + 1
            if left < 0:
                break
            out.append(line)
        shown = len(out)
        more = [f"… {self.lines - shown:,} more lines not shown"] if self.lines > shown else []
        return "\n".join([f"<<<TREE files={self.total} shown={shown} id={self.mark}>>>", *out, *more, f"<<<END {self.mark}>>>"])

    def file_block(self, f: dict) -> tuple[str, str, bool]:
        text, short = cut_text(f["text"], self.limit[f["role"]])
        short = short or f["cut"]
        body = text if not text or text.endswith("\n") else text + "\n"
        header = f'<<<FILE path="{f["shown"]}" bytes={f["bytes"]} truncated={str(short).lower()} id={self.mark}>>>'
        return (f["note"] + "\n" if f["note"] else "") + f"{header}\n{body}<<<END {self.mark}>>>", text, short

    def whole(self) -> str:
        return "\n".join([self.top, self.tree_block(), "", "## Files", *([self.file_block(f)[0] + "\n" for f in self.files] or ["(no files)"])])

    def fit(self, most: int) -> str:
        """Cuts sections in order until the whole fits, three times over if need be; then drops files from the end."""
        text = self.whole()
        sizes = {f["role"]: len(f["text"].encode()) for f in self.files}
        for key in lex.PACK_SHRINKS * 3:
            over = len(text.encode()) - most
            if over <= 0:
                return text
            now = self.limit[key] if key == "tree" else min(self.limit[key], sizes.get(key, 0))
            self.limit[key] = max(lex.PACK_FLOORS[key], now - over - 64)
            text = self.whole()
        while len(text.encode()) > most and self.files:
            self.files.pop()
            text = self.whole()
        return text


def _within_cap(text: Column, role: Column) -> Column:
    """As much of a section's text as its cap lets a pack show, and a character more, which tells that there is more."""
    return reduce(lambda out, r: out.when(role == r, cut_utf8(text, lex.PACK_CAPS[r] + 4)), lex.PACK_ROLES, F.when(F.lit(False), text))


PACK = "text string, bytes bigint, files array<struct<path:string,real_path:string,role:string,text:string,bytes:bigint,truncated:boolean>>"


def built(plan: DataFrame, files: DataFrame, key: str, seed: str = "") -> DataFrame:
    """key, block_id, text, bytes and files (array of struct(path, real_path, role, text, bytes, truncated)) of each row of planned(facts).

    files: key, path, text and byteSize of what was fetched, unique by key and path; a null text fills no slot. block_id marks the blocks:
    12 digits of a digest of seed and key, so a replay gives the same pack.
    """
    wanted = asked(plan, key).select(key, "path")
    fetched = files.join(wanted, [key, "path"]).where(F.col("text").isNotNull()).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("path", F.struct(cut_utf8(F.col("text"), FETCHED_BYTES).alias("text"), F.col("byteSize").alias("size"))))).alias("__files"))
    rows = plan.join(fetched, key, "left").withColumn("__mark", F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, 12))
    owner, repo, mark = F.col("owner"), F.col("name"), F.col("__mark")
    given = lambda s: F.struct(s["role"].alias("role"), s["path"].alias("path"), F.coalesce(s["text"], F.col("__files")[s["path"]]["text"]).alias("text"), F.coalesce(F.col("__files")[s["path"]]["size"], s["bytes"]).alias("bytes"))
    readme = F.when(F.col("readme.text").isNotNull(), F.struct(F.lit("readme").alias("role"), F.coalesce(F.nullif("readme.name", F.lit("")), F.lit("README.md")).alias("path"), F.col("readme.text").alias("text"), F.col("readme.bytes").alias("bytes")))
    texts = F.filter(F.concat(F.array_compact(F.array(readme)), F.transform("slots", given)), lambda x: x["text"].isNotNull())

    def section(x: Column) -> Column:
        size = F.coalesce(x["bytes"], F.octet_length(x["text"]).cast("long"))
        return bound(prepared(x["text"], x["path"], owner, repo, mark), lambda p: F.struct(x["role"].alias("role"), x["path"].alias("real_path"), escaped(masked(x["path"], owner, repo)).alias("shown"), _within_cap(p["text"], x["role"]).alias("text"), p["note"].alias("note"), size.alias("bytes"), (p["cut"] | (size > F.octet_length(x["text"]))).alias("cut")))

    deep = F.coalesce(F.size("tree.entries") > 0, F.lit(False))
    notes = F.when(~deep, F.array(F.lit("Only the root listing was fetched; sizes are unknown."))).when(F.col("tree.truncated"), F.array(F.lit("The tree listing is cut short."))).otherwise(F.array().cast("array<string>"))
    head = F.concat(F.lit("Evidence pack for a review.\nRepository: "), masked(F.col("nwo"), owner, repo), F.lit("\nEvery block below carries the id "), mark, F.lit("; only an END line with that id closes a block."))
    total = F.when(deep, F.size(blobs())).otherwise(F.coalesce(F.size("root"), F.lit(0)))
    # What reaches Python of a row has a bound: texts up to their caps, the lines of the tree that may be shown.
    facts = bound(F.call_function("substring_index", _fact_lines(owner, repo), mark, F.lit(1)), lambda x: cut_utf8(x, lex.PACK_CAPS["facts"] + 4))
    tree = bound(_tree_lines(owner, repo), lambda xs: F.struct(F.size(xs).alias("all"), F.slice(F.filter(xs, lambda x: ~F.contains(x, mark)), 1, TREE_LINES).alias("shown")))
    ready = rows.select(F.col(key).alias("key"), mark.alias("block_id"), head.alias("head"), facts.alias("facts"), tree.alias("tree"), total.alias("total"), notes.alias("notes"), F.transform(texts, section).alias("sections"))
    schema = StructType([ready.schema["key"]]).add("block_id", "string").add("text", "string").add("bytes", "long").add("files", StructType.fromDDL(PACK)["files"].dataType)

    def packed(r: dict) -> dict:
        draft = _Draft(r["head"], r["facts"], r["block_id"], r["tree"]["shown"], r["tree"]["all"], r["total"], r["notes"], r["sections"])
        text = draft.fit(MOST_BYTES)
        shown = [(f, *draft.file_block(f)[1:]) for f in draft.files]
        return {"key": r["key"], "block_id": r["block_id"], "text": text, "bytes": len(text.encode()), "files": [{"path": f["shown"], "real_path": f["real_path"], "role": f["role"], "text": t, "bytes": f["bytes"], "truncated": c} for f, t, c in shown]}

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            yield pa.RecordBatch.from_pylist([packed(r) for r in batch.to_pylist()], schema=kinds)

    return ready.mapInArrow(assemble, schema).withColumnRenamed("key", key)
