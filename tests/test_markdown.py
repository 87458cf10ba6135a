"""Markdown as plain blocks: nesting, marks within lines, odd and hostile texts."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.functions import markdown
from lodestone.functions.markdown import Reader, run


def blocks(text):
    return [{k: v for k, v in b.items() if v is not None} for b in Reader(text).blocks]


def test_a_whole_text():
    md = "# Title *with* emphasis\n\nSub\n===\n\nA **bold** `code` [link](https://a.example/x) ![alt](i.png) <https://b.example> https://c.example.\n<script>alert(1)</script> and \\*escaped\\*\n\n- one\n- two [ref][r]\n  continued\n\n3. three\n4. four\n\n> quoted\n> > nested\n\n---\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```js\nconst x = \"<b>\";\n```\n\n    indented code\n\n[r]: https://ref.example"
    words = lambda t: [run("text", t)]
    assert blocks(md) == [
        {"type": "heading", "level": 1, "runs": words("Title with emphasis")}, {"type": "heading", "level": 1, "runs": words("Sub")},
        {"type": "paragraph", "runs": [run("text", "A bold "), run("code", "code"), run("text", " "), run("link", "link", "https://a.example/x"), run("text", " [image: alt] "), run("link", "https://b.example", "https://b.example"), run("text", " "), run("link", "https://c.example", "https://c.example"), run("text", ". <script>alert(1)</script> and *escaped*")]},
        {"type": "list", "ordered": False, "items": [words("one"), [run("text", "two "), run("link", "ref", "https://ref.example"), run("text", " continued")]]}, {"type": "list", "ordered": True, "start": 3, "items": [words("three"), words("four")]},
        {"type": "quote", "runs": words("quoted nested")}, {"type": "rule"}, {"type": "paragraph", "runs": words("a | b")}, {"type": "paragraph", "runs": words("1 | 2")}, {"type": "code", "lang": "js", "text": 'const x = "<b>";'}, {"type": "code", "text": "indented code"},
    ]


@pytest.mark.parametrize(
    "text,want",
    [
        ("[x](javascript:alert(1)) <b onclick=\"x\">bold</b>", [run("link", "x", "javascript:alert(1)"), run("text", ' <b onclick="x">bold</b>')]),
        ("[![badge](b.svg)](https://ci.x) and [no][where]", [run("link", "[image: badge]", "https://ci.x"), run("text", " and [no][where]")]),
        ("`` a ` b `` and `open", [run("code", "a ` b"), run("text", " and `open")]),
        ("see (https://x.y/a_(b)))! xhttps://no", [run("text", "see ("), run("link", "https://x.y/a_(b)", "https://x.y/a_(b)"), run("text", "))! xhttps://no")]),
        ("snake_case_name __bold__ ~~gone~~ 2 * 3 * 4", [run("text", "snake_case_name bold gone 2 * 3 * 4")]),
        ("![](x.png)", [run("text", "[image]")]), ("", []),
    ],
)
def test_runs(text, want):
    assert markdown.runs_of(text, {}) == want


def test_blocks_that_follow_each_other():
    assert [b["type"] for b in blocks("words\n- no list yet? yes\n1. other\n\n  - nested\nend\n> q\nplain\n* * *\n    code\n# h")] == ["paragraph", "list", "list", "list", "paragraph", "quote", "paragraph", "rule", "code", "heading"]
    assert blocks("words\n    more words\nlast\\") == [{"type": "paragraph", "runs": [run("text", "words more words last")]}]
    assert blocks("```\nunclosed\n[r]: http://x") == [{"type": "code", "text": "unclosed\n[r]: http://x"}] and blocks("[r]: http://x") == []


def test_odd_texts(spark):
    hostile = ["```\nunclosed <img src=x>", "[" * 500, "\0nul", "> " * 300, "*" * 2_000, "`" * 999, "|-|\n" * 50, "- " * 400, None, "", "word " * 20_000]
    rows = spark.createDataFrame(list(enumerate(hostile)), "i int, t string").select("i", markdown.safe_blocks(F.col("t")).alias("b")).orderBy("i").collect()
    assert [bool(r["b"]) for r in rows] == [True] * 8 + [False, False, True] and rows[2]["b"][0]["runs"][0]["text"] == "�nul"
    assert {b["type"] for r in rows for b in r["b"]} <= {"heading", "paragraph", "code", "list", "quote", "rule"} and len(rows[10]["b"][0]["runs"][0]["text"]) <= markdown.MOST_BYTES


def test_few_texts_at_a_time(spark):
    """Blocks leave the task in small batches, in the order of the rows, nulls among them."""
    n = 5 * markdown.ROWS + 7
    rows = spark.range(0, n, 1, 1).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("# t"), "id")).alias("t")).select("id", markdown.safe_blocks(F.col("t")).alias("b"))
    assert "ArrowEvalPython" in rows._jdf.queryExecution().executedPlan().toString() and markdown.ROWS <= 1_000
    found = {r["id"]: [x["text"] for b in r["b"] for x in b["runs"]] for r in rows.collect()}
    assert found == {i: [f"t{i}"] if i % 3 else [] for i in range(n)}


def test_whole_documents(spark, tmp_path):
    """What stands behind the first 32 KB counts, as in the SQL."""
    texts = ["\n" * 40_000 + "end", " " * 70_000 + "\n\t", "é" + " " * 50_000, "\t \n" * 30_000 + "`" * 3, None, "", "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["says"] for r in catalog.queries()["document_blocks"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert found == dict(con.execute(catalog.oracle_sql()["document_blocks"]).fetchall()) == dict(enumerate([True, False, True, True, False, False, True]))


def test_a_long_text(spark):
    """All of it is read, and a label defined at its end is known at its start; blocks leave in parts, texts in smaller slices."""
    n = 2 * markdown.HELD + 5
    long = "[top][r]\n\n" + "word " * 20_000 + "\n\n" + "# h\n" * n + "\n[r]: https://end.example"
    rows = spark.createDataFrame([(0, "a"), (1, long), (2, None), (3, long + "\n\n> last"), (4, "b")], "i int, t string").coalesce(1)
    found = [r["b"] for r in rows.select("i", markdown.safe_blocks(F.col("t"), None).alias("b")).orderBy("i").collect()]
    assert [len(b) for b in found] == [1, n + 2, 0, n + 3, 1] and found[1] == found[3][:-1] and found[3][-1]["type"] == "quote"
    assert found[1][0]["runs"][0]["url"] == "https://end.example" and found[1][1]["runs"][0]["text"] == ("word " * 20_000).strip() and found[1][-1]["runs"][0]["text"] == "h"


def test_slices():
    texts = pa.array(["a"] * (markdown.ROWS + 1) + [None, "b" * markdown.ROWS_BYTES, "c", None, "d" * 2 * markdown.ROWS_BYTES])
    slices = [x.to_pylist() for x in markdown.few(texts)]
    assert [len(x) for x in slices] == [markdown.ROWS, 2, 1, 2, 1] and sum(slices, []) == texts.to_pylist() and list(markdown.few(texts[:0])) == []


@pytest.mark.parametrize(
    "text,want",
    [
        ("a " + "`" * 300_000, None), ("a `` " + "x ` " * 100_001 + "y", "a `" + "x x " * 50_000 + "x y"), ("a " + "[" * 300_000, None), ("a " + "[\\]" * 100_000, "a " + "[]" * 100_000), ("**a " * 100_000 + "b", None), ("~~a __b " * 50_000 + "c", None),
        ("\\*" * 200_000, "*" * 200_000), ("a ![b](c) " * 50_000 + "d", "a [image: b] " * 50_000 + "d"), ("[a](" + " " * 300_000 + "x", None), ("[a](x (" * 50_000, None), ("[a](b " + "( " * 100_000 + "c", None), ("# a" + " " * 300_000 + "b", "a" + " " * 300_000 + "b"),
    ],
    ids=range(12),
)
def test_hostile_and_long(text, want):
    """Marks that nothing closes, or many of them, in long texts: the time of each grows with the text."""
    said = "".join(r["text"] for b in blocks(text) for r in b["runs"])
    assert said == (text if want is None else want)


def test_long_items_and_addresses():
    assert blocks("- a\n" + "  b\n" * 100_000)[0]["items"] == [[run("text", "a" + " b" * 100_000)]]
    assert markdown.runs_of("http://x" + ")" * 200_000, {}) == [run("link", "http://x", "http://x"), run("text", ")" * 200_000)]
    assert blocks("a|b\n" + " " * 200_000 + "x-|") == [{"type": "paragraph", "runs": [run("text", "a|b x-|")]}]
