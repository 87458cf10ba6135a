"""Quotes at any place of a text, claims against files, objects in answers."""

import itertools
import random
import unicodedata

import pytest

from lodestone.operators import claims


def plain_fold(text):
    return claims.WHITE.sub(" ", unicodedata.normalize("NFC", text)).strip(" ")


@pytest.mark.parametrize("at_once", [1_000_000, 3])
def test_quotes_stand_anywhere(spark, monkeypatch, at_once):
    monkeypatch.setattr(claims, "AT_ONCE", at_once)
    draw = random.Random(at_once)
    alphabet = "ab é́  漢😀"
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 300))) for _ in range(60)] + [None, "", "short", "x" * 100, "one two  three\nfour five six", "Café au lait, s'il vous plaît"]
    cuts = [t[a : a + n] for t in texts if t for a, n in [(draw.randint(0, len(t)), draw.choice([6, 8, 9, 16, 17, 31, 32, 60]))]]
    quotes = [*cuts, *cuts[:3], None, "", "   ", "xxxxxxx", "xxxxxxxx", "wo three four", "three\t four fi", "Café au lait", "no such quote here", "x" * 101]
    table = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "doc long, text string, `a.b` int")
    asked = spark.createDataFrame(list(enumerate(quotes)), "item long, quote string")
    found = sorted((r["doc"], r["item"]) for r in claims.quoted(table, asked, "text", "quote").collect())
    want = [(i, k) for (i, t), (k, q) in itertools.product(enumerate(texts), enumerate(quotes)) if t is not None and q is not None and len(plain_fold(q)) >= 8 and plain_fold(q) in plain_fold(t)]
    assert (sorted(set(found) - set(want))[:3], sorted(set(want) - set(found))[:3]) == ([], []) and found == want and len(want) > 30


def test_no_quotes(spark):
    table = spark.createDataFrame([(1, "a text of some length")], "doc long, text string")
    for rows in ([], [(1, "tiny")]):
        assert claims.quoted(table, spark.createDataFrame(rows, "item long, quote string"), "text", "quote").count() == 0
    empty = spark.createDataFrame([], "doc long, text string")
    assert claims.quoted(empty, spark.createDataFrame([(1, "a text of some")], "item long, quote string"), "text", "quote").count() == 0


def test_claims_name_files(spark):
    files = [("p", 1, "cmd/OWNER/main.go", "cmd/octo/main.go", "package main\n\nfunc main() { serveForever() }\n"), ("p", 2, "README.md", "README.md", "It does not model\tstorm surge. tide"), ("p", 3, "README.md", "other.md", "never looked at"), ("q", 1, "README.md", "README.md", None)]
    made = [
        ("p", 1, "cmd/OWNER/main.go", "func main() { serveForever() }", "cmd/octo/main.go", None),
        ("p", 2, "cmd/octo/main.go", "package main", "cmd/octo/main.go", None),
        ("p", 3, "./README.md", "does  not model storm surge.", "README.md", None),
        ("p", 4, "src/missing.rs", "pub fn predict", None, "not a file in the pack"),
        ("p", 5, "README.md", "tide", "README.md", "quote too short"),
        ("p", 6, "README.md", "never looked at", "README.md", "quote not in the file"),
        ("p", 7, "other.md", "never looked at", "other.md", None),
        ("p", 8, None, "never looked at", None, "not a file in the pack"),
        ("q", 1, "README.md", "never looked at", "README.md", "quote not in the file"),
        ("q", 2, "README.md", None, "README.md", "quote too short"),
        ("r", 1, "README.md", "never looked at", None, "not a file in the pack"),
    ]
    table = spark.createDataFrame([m[:4] for m in made], "pack string, no int, path string, quote string")
    checked = claims.verified(table, spark.createDataFrame(files, "pack string, place int, path string, real_path string, text string"), "pack", "path", "quote", "no")
    assert sorted(map(tuple, checked.collect())) == sorted(made, key=lambda m: m[:2])
    assert sorted(map(tuple, claims.support(checked, "pack").collect())) == [("p", 4, 4, "ok"), ("q", 0, 2, "unsupported"), ("r", 0, 1, "unsupported")]


def test_objects_in_answers():
    whole = '{"a": {"b": "} \\" {"}, "c": ["```"]}'
    for text in (whole, f" {whole}\n", f"```json\n{whole}\n```", f"Words.\n\n```\r\n{whole}\r\n  ```\r\nThat is all.", f"[{whole}]", f"Note: {{ is odd.\n{whole}", f"```\nnothing\n```\n{whole}", f"{{x}} {whole} {{}}"):
        assert claims.answer_object(text) == (whole, None), text
    cut_off = "the answer ends before its object closes"
    assert claims.answer_object('{"a": {"b": 1}') == (None, cut_off)
    assert claims.answer_object('```json\n{"a": [{"b": 1}]') == (None, cut_off)
    assert claims.answer_object('```json\n{"a": "x\n```\n') == (None, cut_off)
    assert claims.answer_object("no object") == claims.answer_object(None) == claims.answer_object("[1, 2]") == (None, "the answer holds no object")
    assert claims.answer_object('{"a": NaN}')[0] is None
