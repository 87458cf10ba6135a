"""Splitting of texts into words whose BPE encodings, put together, are the encoding of the whole text.

A cut is safe where the tokenizer's own pre-tokenizer always cuts: the byte-level tokenizer takes an ASCII space with the
word behind it and keeps runs of white space apart; the word-end tokenizer drops white space.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc

#: White space as the tokenizers' patterns have it (Unicode's White_Space).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WHITE_CHARS = frozenset(chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: Letters that every tokenizer here takes as letters, that are composed already, and whose lower case is one letter.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: A run of such letters before white space, the end or one of these marks are a word of its own: all pre-tokenizers cut there.
MARKS = ".,;:!?"
#: A run of letters with the space before it; a word with it; white space but for the last before a word; that last.
BYTE_LEVEL = re.compile(f" ?[{LETTERS}]++(?![^{WHITE}{MARKS}])| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
WHITE_DROPPED = re.compile(rf"[{LETTERS}]++(?![^ \n{MARKS}])|[^ \n]+")


def segments(text: str, specials: dict[str, int]) -> list[str]:
    """The text's stretches of ordinary text and of special strings, in order: specials are found before all else."""
    if not any(s in text for s in specials):
        return [text]
    longest_first = sorted(specials, key=len, reverse=True)
    return [x for x in re.split("(" + "|".join(map(re.escape, longest_first)) + ")", text) if x]


def byte_level_words(text: str, specials: dict[str, int]) -> list[str]:
    if "<|" not in text:
        return BYTE_LEVEL.findall(text)
    return [w for x in segments(text, specials) for w in ([x] if x in specials else BYTE_LEVEL.findall(x))]


def white_dropped_words(text: str, specials: dict[str, int]) -> list[str]:
    """Cuts at spaces and line feeds only; other white space stays inside words, for the tokenizer to drop.

    ASCII texts are lower-cased here, as the tokenizer would, so that words are the same in either case; but not where a
    special string may stand, as those are found in the text as it is.
    """
    return WHITE_DROPPED.findall(text.lower() if text.isascii() and "<|" not in text else text)


def check_format(spec: dict, split) -> None:
    """Raises a ValueError unless the vocabulary file splits texts as `split` takes for granted."""
    steps, special = spec["pre_tokenizer"] or {}, [x["content"] for x in spec["added_tokens"]]
    if split is byte_level_words:
        fine = spec["normalizer"] is None and steps.get("type") == "ByteLevel" and steps.get("use_regex") and not steps.get("add_prefix_space")
    else:
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        fine = kinds[-1:] == ["Lowercase"] and [x["type"] for x in steps.get("pretokenizers", [])] == ["Split", "ByteLevel"] and steps["pretokenizers"][0]["behavior"] == "Removed"
    if not fine or spec["model"]["type"] != "BPE" or not all("<|" in x for x in special):
        raise ValueError("the vocabulary file isn't of the format that this way of splitting knows")


#: How byte-level models write the space and the two bytes of each letter beyond ASCII: bytes 128 to 160 and 173 as 256 + 34 on.
AS_BYTES = {32: "\u0120"} | {c: "\u00c3" + (chr(x + 162) if (x := (c & 63) + 128) < 161 else "\u0143" if x == 173 else chr(x)) for c in range(0xC0, 0x100)}
PLAIN_WORD = re.compile(f" ?[{LETTERS}]+")


def byte_level_plain(word: str) -> str | None:
    """The word as the BPE model itself takes it, if it is letters with or without a space before them."""
    if word.isascii():
        return word if word.isalpha() else "\u0120" + word[1:] if word[:1] == " " and word[1:].isalpha() else None
    return word.translate(AS_BYTES) if PLAIN_WORD.fullmatch(word) else None


def white_dropped_plain(word: str) -> str | None:
    if word.isascii():
        return word.lower() if word.isalpha() else None
    return word.lower().translate(AS_BYTES) if PLAIN_WORD.fullmatch(word) else None


#: How each way of splitting gives plain words to the model.
PLAIN = {byte_level_words: byte_level_plain, white_dropped_words: white_dropped_plain}


def white_dropped_column(texts: pa.Array) -> pa.Array | None:
    """white_dropped_words of a whole column without a Python string for any word; None where a special string may stand."""
    if pc.any(pc.match_substring(texts, "<|")).as_py():
        return None
    spaced = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
    return pc.split_pattern(pc.replace_substring_regex(spaced, f"([a-z])([{MARKS}])", r"\1 \2"), " ")


#: Ways of splitting that can do whole columns.
COLUMNS = {white_dropped_words: white_dropped_column}
