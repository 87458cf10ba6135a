"""Untrusted Markdown as plain blocks of runs: nothing in it is read as HTML, and no address is judged here.

A text is read line by line by a short list of rules; each either takes lines and says where reading goes on, or passes. One block at
most is open (a paragraph, list or quote), and rules say what they close. Nested lists and quotes are flattened, tables become a
paragraph for each row, images their description. Works in Arrow batches, a row at a time. Texts may be long, and hostile: what a rule or
a mark costs grows with the text, not with its square, and blocks leave Python before the text is through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lodestone.functions.scalars import cut_utf8

#: How much of a text a view shows, unless it says otherwise.
MOST_BYTES = 32_768
RUN = "struct<type:string,text:string,url:string>"
#: Texts, and their bytes (or one longer text), that are Python objects at a time; blocks of a text that are.
ROWS, ROWS_BYTES, HELD = 64, 2 << 20, 1_024
BLOCKS = f"array<struct<type:string,level:int,lang:string,ordered:boolean,start:bigint,text:string,runs:array<{RUN}>,items:array<array<{RUN}>>>>"

#: The marks of lines.
FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})(.*)")
FENCE_END = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*$")
HEADING = re.compile(r" {0,3}(#{1,6})(?![^ \t])")
RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
QUOTE = re.compile(r"(?: {0,3}>[ ]?)+(.*)$")
ITEM = re.compile(r"(\s*)(?:[-*+]|(\d{1,9})[.)])(?:[ \t]+(.*))?$")
UNDER_CELL = re.compile(r":?-+:?")
DEFINITION = re.compile(r" {0,3}\[([^\]]+)\]:[ \t]*<?([^\s>]+)>?(?:[ \t]+.*)?$")
INDENTED = re.compile(r" {4,}|\t")
#: The marks within lines. Where ticks and labels end is looked up in Marks.
INLINE = re.compile(
    r"\\(?P<escaped>[\\`*_{}\[\]()#+\-.!|>~<\"'])"
    r"|(?P<ticks>`+)"
    r"|(?P<label>!?\[)"
    r"|<(?P<auto>(?:https?|ftp)://[^\s<>]+|mailto:[^\s<>]+)>"
    r"|(?<![0-9A-Za-z_/])(?P<bare>https?://[^\s<>\"'`]+)"
)
TARGET = re.compile(r"\((\s*)<?([^()\s<>]*(?:\([^()\s]*\)[^()\s<>]*)*)>?(\s*)")
SPACE = re.compile(r"\s*")
WORD = re.compile(r"\S")
#: Emphasis: marks of two characters by their openers and closers, then those of one.
PAIRS = [re.compile(r"(\*\*|__)(?=\S)"), re.compile(r"(~~)(?=\S)")]
CLOSERS = {"**": re.compile(r"(?<=\S)\*\*"), "__": re.compile(r"(?<=\S)__"), "~~": re.compile(r"(?<=\S)~~")}
EMPHASIS = [
    (re.compile(r"(^|[^0-9A-Za-z_*])\*(?=[^\s*])([^*]*?[^\s*])\*(?![0-9A-Za-z_*])"), r"\1\2"),
    (re.compile(r"(^|[^0-9A-Za-z_])_(?=[^\s_])([^_]*?[^\s_])_(?![0-9A-Za-z_])"), r"\1\2"),
]


def run(kind: str, text: str, url: str | None = None) -> dict:
    return {"type": kind, "text": text, "url": url}


def plain(label: str) -> str:
    """The text of a label without marks."""
    return " ".join("".join(r["text"] for r in runs_of(label, {})).split())


def bare_address(url: str) -> str:
    """An address without the marks that end a sentence and without closing brackets beyond those that it opens."""
    url = url.rstrip(".,;:!?*_~")
    end, over = len(url), url.count(")") - url.count("(")
    while over > 0 and url[end - 1] == ")":
        end, over = end - 1, over - 1
        while url[end - 1] in ".,;:!?":
            end -= 1
    return url[:end]


class Marks:
    """Where marks of a text end. Each table is made once a text, when it is first asked for."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def ticks(self) -> dict[int, list[int]]:
        """Places of the runs of ticks, by length."""
        found: dict[int, list[int]] = {}
        for m in re.finditer("`+", self.text):
            found.setdefault(len(m[0]), []).append(m.start())
        return found

    def code(self, start: int, end: int) -> tuple[int, int] | None:
        """The most of the ticks from start to end that a later run equals, and the place of that run."""
        for n in range(end - start, 0, -1):
            places = self.ticks.get(n, [])
            if (i := bisect_left(places, end)) < len(places):
                return n, places[i]

    @cached_property
    def labels(self) -> dict[int, int]:
        """Place of the bracket that opens a label to that which closes it. Escaped characters and simple pairs of brackets may stand in one."""
        text, places = self.text, [m.start() for m in re.finditer(r"[\[\]\\]", self.text)]
        ends, found = [-1] * (len(places) + 2), {}  # for each place, where a label ends that was read up to it
        bracket = len(places)
        for i in range(len(places) - 1, -1, -1):
            at = places[i]
            if text[at] == "\\":
                if at + 1 < len(text) and text[at + 1] != "\n":
                    ends[i] = ends[i + 2] if i + 1 < len(places) and places[i + 1] == at + 1 else ends[i + 1]
                continue
            if text[at] == "]":
                ends[i] = at
            else:
                if ends[i + 1] >= 0:
                    found[at] = ends[i + 1]
                if bracket < len(places) and text[places[bracket]] == "]":
                    ends[i] = ends[bracket + 1]
            bracket = i
        return found

    @cached_property
    def rounds(self) -> list[int]:
        return [m.start() for m in re.finditer(r"\)", self.text)]

    @cached_property
    def behind(self) -> dict[int, int]:
        return {}

    def titled(self, at: int) -> int | None:
        """Where a target ends whose title is at a place."""
        mark = self.text[at : at + 1]
        if mark == "(":
            i = bisect_left(self.rounds, at)
            end = self.rounds[i] if i < len(self.rounds) else -1
        else:
            end = self.text.find(mark, at + 1) if mark and mark in "\"'" else -1
        if end >= 0:
            if end not in self.behind:
                self.behind[end] = SPACE.match(self.text, end + 1).end()
            return self.behind[end] + 1 if self.text.startswith(")", self.behind[end]) else None

    def target(self, at: int) -> tuple[str, int] | None:
        """The address in the round brackets at a place, and where they end."""
        if m := TARGET.match(self.text, at):
            if m[3] and (end := self.titled(m.end())):
                return m[2], end
            if self.text.startswith(")", m.end()):
                return m[2], m.end() + 1
            if m[1] and (end := self.titled(m.end(1))):
                return "", end

    def known(self, start: int, end: int, refs: dict[str, str], widest: int) -> str | None:
        """The address that a label is defined as."""
        if refs:
            start = SPACE.match(self.text, start, end).end()
            return None if WORD.search(self.text, start + widest, end) else refs.get(self.text[start:end].strip().lower())


def without_emphasis(text: str) -> str:
    for opener in PAIRS if "**" in text or "__" in text or "~~" in text else []:
        out, start, at, spent = [], 0, 0, set()
        while m := opener.search(text, at):
            if m[1] not in spent and (end := CLOSERS[m[1]].search(text, m.end() + 1)):
                out += [text[start : m.start()], text[m.end() : end.start()]]
                start = at = end.end()
            else:  # no later one is closed either
                spent.add(m[1])
                at = m.start() + 1
        text = "".join([*out, text[start:]])
    for pattern, kept in EMPHASIS if "*" in text or "_" in text else []:
        text = pattern.sub(kept, text)
    return text


def runs_of(text: str, refs: dict[str, str], widest: int | None = None) -> list[dict]:
    """Text, code and links of a block's text; `widest` is the length of the longest label in refs. Emphasis is dropped; raw HTML stays text."""
    widest = max(map(len, refs), default=0) if widest is None else widest
    marks, out = Marks(text), []
    said: list[str] = []  # of the text run that is being made
    raw: list[str] = []  # of the part in which emphasis may be read: up to the next mark other than an image
    start = at = 0

    def words(upto: int) -> None:
        said.append(without_emphasis("".join([*raw, text[start:upto]])))
        raw.clear()

    def ended() -> None:
        if whole := "".join(said):
            out.append(run("text", whole))
        said.clear()

    while m := INLINE.search(text, at):
        begin, end, made = m.start(), m.end(), None
        if m["escaped"]:
            words(begin)
            said.append(m["escaped"])
            start = at = end
            continue
        if m["ticks"]:
            if closed := marks.code(begin, end):
                n, close = closed
                inner = text[end:close].replace("\n", " ")
                made = run("code", inner[1:-1] if len(inner) > 1 and inner[0] == inner[-1] == " " and inner.strip() else inner)
                begin, end = end - n, close + n
        elif m["label"]:
            if (close := marks.labels.get(end - 1)) is not None:
                target, ref, after = marks.target(close + 1), (end, close), close + 1
                if target:
                    after = target[1]
                elif text.startswith("[", close + 1) and (to := text.find("]", close + 2)) >= 0:
                    ref, after = (close + 2, to) if to > close + 2 else ref, to + 1
                if m["label"] == "![":
                    alt = plain(text[end:close])
                    raw += [text[start:begin], f"[image: {alt}]" if alt else "[image]"]
                    start = at = after
                    continue
                url = target[0] if target else marks.known(*ref, refs, widest)
                if url is not None:
                    made, end = run("link", plain(text[end:close]) or url, url), after
        else:
            url = m["auto"] or bare_address(m["bare"])
            made, end = run("link", url, url), begin + len(url) if m["bare"] else end
        if made is None:  # stands for itself
            at = end
            continue
        words(begin)
        ended()
        out.append(made)
        start = at = end
    words(len(text))
    ended()
    return out


def table_row(line: str) -> str:
    cells = [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", re.sub(r"(?<!\\)\|$", "", line.strip().removeprefix("|")))]
    return " | ".join(c for i, c in enumerate(cells) if c or 0 < i < len(cells) - 1)


def under_table(line: str) -> bool:
    """Dashes in cells: what follows the head of a table."""
    return all(UNDER_CELL.fullmatch(c.strip()) for c in line.strip().removeprefix("|").removesuffix("|").split("|"))


class Reader:
    """Reads the lines of one text into blocks, which it gives one after another."""

    def __init__(self, text: str) -> None:
        self.lines = re.sub("\r\n?", "\n", text).replace("\0", "�").split("\n")
        self.made: list[dict] = []
        self.open: dict | None = None
        self.refs: dict[str, str] = {}
        self.defined: set[int] = set()
        fenced = False
        for i, line in enumerate(self.lines):
            fenced ^= bool(re.match(r"\s*(`{3,}|~{3,})", line))
            if not fenced and (m := DEFINITION.match(line)):
                self.defined.add(i)
                self.refs.setdefault(m[1].strip().lower(), m[2])
        self.widest = max(map(len, self.refs), default=0)

    def __iter__(self) -> Iterator[dict]:
        rules: list[Callable[[int, str], int | None]] = [self.definition, self.fence, self.blank, self.underline, self.heading, self.rule, self.quote, self.item, self.more_of_item, self.table, self.indented, self.words]
        at = 0
        while at < len(self.lines):
            at = next(to for rule in rules if (to := rule(at, self.lines[at])) is not None)
            yield from self.made
            self.made.clear()
        self.close()
        yield from self.made

    @cached_property
    def blocks(self) -> list[dict]:
        return list(self)

    def add(self, kind: str, **of) -> None:
        self.made.append({"type": kind, "level": None, "lang": None, "ordered": None, "start": None, "text": None, "runs": None, "items": None} | of)

    def said(self, text: str) -> list[dict]:
        return runs_of(text, self.refs, self.widest)

    def is_open(self, kind: str) -> bool:
        return self.open is not None and self.open["type"] == kind

    def close(self, *kinds: str) -> None:
        """Ends the open block, if it is one of the kinds (any, if none is named)."""
        if self.open is None or kinds and self.open["type"] not in kinds:
            return
        done, self.open = self.open, None
        if done["type"] == "list":
            self.add("list", ordered=done["ordered"], start=done["start"], items=[self.said(" ".join(x)) for x in done["parts"]])
        else:
            self.add(done["type"], runs=self.said(" ".join(done["parts"])))

    def definition(self, at: int, line: str) -> int | None:
        if at in self.defined:
            self.close()
            return at + 1

    def fence(self, at: int, line: str) -> int | None:
        if m := FENCE.match(line):
            self.close()
            ends = lambda x: (e := FENCE_END.match(x)) and e[1][0] == m[2][0] and len(e[1]) >= len(m[2])
            to = next((j for j in range(at + 1, len(self.lines)) if ends(self.lines[j])), len(self.lines))
            body = [re.sub(f"^ {{0,{len(m[1])}}}", "", x) for x in self.lines[at + 1 : to]]
            self.add("code", lang=(m[3].split() or [None])[0], text="\n".join(body))
            return to + 1

    def blank(self, at: int, line: str) -> int | None:
        if not line.strip():
            self.close()
            return at + 1

    def underline(self, at: int, line: str) -> int | None:
        if self.is_open("paragraph") and (m := UNDERLINE.match(line)):
            text, self.open = " ".join(self.open["parts"]), None
            self.add("heading", level=1 if m[1][0] == "=" else 2, runs=self.said(text))
            return at + 1

    def heading(self, at: int, line: str) -> int | None:
        if m := HEADING.match(line):
            self.close()
            said = line[m.end() :].strip(" \t")
            opened = said.rstrip("#")
            self.add("heading", level=len(m[1]), runs=self.said(opened.rstrip(" \t") if opened.endswith((" ", "\t")) else said))
            return at + 1

    def rule(self, at: int, line: str) -> int | None:
        if RULE.match(line):
            self.close()
            self.add("rule")
            return at + 1

    def quote(self, at: int, line: str) -> int | None:
        if m := QUOTE.match(line):
            self.close("paragraph", "list")
            self.open = self.open or {"type": "quote", "parts": []}
            self.open["parts"] += [m[1].strip()] if m[1].strip() else []
            return at + 1
        self.close("quote")

    def item(self, at: int, line: str) -> int | None:
        m = ITEM.match(line)
        if m and (not self.is_open("paragraph") or not m[1]):
            ordered = m[2] is not None
            if not self.is_open("list") or (len(m[1]) < 2 and self.open["ordered"] != ordered):
                self.close()
                self.open = {"type": "list", "ordered": ordered, "start": int(m[2]) if ordered else None, "parts": []}
            self.open["parts"].append([said] if (said := (m[3] or "").strip()) else [])
            return at + 1

    def more_of_item(self, at: int, line: str) -> int | None:
        if self.is_open("list") and re.match(r"\s{2,}\S", line):
            self.open["parts"][-1].append(line.strip())
            return at + 1
        self.close("list")

    def table(self, at: int, line: str) -> int | None:
        below = self.lines[at + 1] if at + 1 < len(self.lines) else ""
        if "|" in line and "-" in below and under_table(below):
            self.close("paragraph")
            to = at + 2
            while to < len(self.lines) and "|" in self.lines[to] and self.lines[to].strip():
                to += 1
            for row in (line, *self.lines[at + 2 : to]):
                self.add("paragraph", runs=self.said(table_row(row)))
            return to

    def indented(self, at: int, line: str) -> int | None:
        if not self.is_open("paragraph") and INDENTED.match(line):
            to = at
            while to < len(self.lines) and (INDENTED.match(self.lines[to]) or not self.lines[to].strip()):
                to += 1
            body = [re.sub(r"^( {4}|\t)", "", x) for x in self.lines[at:to]]
            while not body[-1].strip():
                body.pop()
            self.add("code", text="\n".join(body))
            return to

    def words(self, at: int, line: str) -> int:
        self.open = self.open or {"type": "paragraph", "parts": []}
        self.open["parts"].append(line.strip().removesuffix("\\"))
        return at + 1


def few(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch in slices of ROWS texts, or of fewer if they are long."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and (at - start == ROWS or held + size > ROWS_BYTES):
            yield texts.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < len(texts):
        yield texts.slice(start)


def safe_blocks(text: Column, most: int | None = MOST_BYTES) -> Column:
    """An array of blocks (BLOCKS): heading, paragraph, code, list, quote and rule; none for a null or empty text. `most` bytes are read, as
    for a view; None reads whole texts."""

    kind = to_arrow_type(StructType.fromDDL(f"blocks {BLOCKS}")["blocks"].dataType)

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in (x for b in batches for x in few(b)):
            parts, held, ends = [pa.array([], kind.value_type)], [], [0]
            for t in texts:
                n = 0
                for n, block in enumerate(Reader(t.as_py() or ""), 1):
                    held.append(block)
                    if len(held) == HELD:
                        parts.append(pa.array(held, kind.value_type))
                        held = []
                ends.append(ends[-1] + n)
            parts.append(pa.array(held, kind.value_type))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts), type=kind)

    return F.arrow_udf(read, BLOCKS)(text if most is None else cut_utf8(text, most))


def outline(blocks: Column) -> Column:
    """Blocks in a line of text: kind, what it says, and addresses of links in angles."""
    said = lambda runs: F.array_join(F.transform(runs, lambda r: F.concat(r["text"], F.coalesce(F.concat(F.lit("<"), r["url"], F.lit(">")), F.lit("")))), "")
    detail = lambda b: F.coalesce(b["level"].cast("string"), b["lang"], b["start"].cast("string"), F.lit(""))
    body = lambda b: F.coalesce(b["text"], F.array_join(F.transform(b["items"], said), ";"), said(b["runs"]), F.lit(""))
    return F.array_join(F.transform(blocks, lambda b: F.concat(b["type"], detail(b), F.lit(":"), body(b))), "|")
