"""Exact token counts of every prefix of a text, by dynamic programming over the BPE vocabulary.

The last token of each prefix is the one token that ends there and is compatible with the last token of what it leaves:
two tokens are compatible if the pair's own encoding is the pair. So the count at a prefix is the count at an earlier prefix
plus one, and no prefix is ever encoded again. Words (as the pre-tokenizer cuts them) are solved once per task and reused.

Truncation ("the longest prefix of at most n tokens") and budgets are then look-ups in the table.

Defined cases: a null text counts as empty (0 tokens, an empty table). Special strings inside a text count as the special
token, as the library does by default; a prefix that ends inside one counts as the ordinary text that it is. Very long
texts and words are whole: time and memory are linear in their length. Repeated rows give repeated rows; an empty table
gives none; other columns of the input are not read unless named.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.byte_words import BYTE_LEVEL, WHITE_CHARS, byte_level_words, check_format
from lodestone.llm.common import held

#: How many solved words a task keeps; then it starts anew. Bounds memory, never results.
KEPT_WORDS = 250_000

#: Texts that are Python strings at a time.
ROWS = 512

#: Prefixes up to this many bytes are kept for other words that share them.
KEPT_PREFIX = 24

#: Two numbers are packed in one: a token's number takes the low bits.
BITS = 24
LOW = (1 << BITS) - 1

#: The pre-tokenizer's pattern inside a word (a fixed value of the vocabulary's format).
INSIDE = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def byte_alphabet() -> dict[str, int]:
    """The byte of each character in a byte-level vocabulary: printable Latin-1 stands for itself, the rest for 256 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixTable:
    """Counts of all prefixes, with a memo of words. One for each task.

    A token's number is its place in the merge order: the 256 bytes first, then what each merge makes.
    """

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        check_format(spec, byte_level_words)
        if len(spec["model"]["merges"]) + 256 > LOW:
            raise ValueError(f"at most {LOW} tokens")
        alphabet = byte_alphabet()
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.number = {bytes([i]): i for i in range(256)}
        self.halves: list[tuple[int, int]] = [(-1, -1)] * 256
        self.made: dict[tuple[int, int], int] = {}
        for m in spec["model"]["merges"]:
            a, b = (bytes(alphabet[c] for c in x) for x in (m if isinstance(m, list) else m.split(" ")))
            pair = self.number[a], self.number[b]
            self.made[pair] = self.number[a + b] = len(self.halves)
            self.halves.append(pair)
        self.longest = max(map(len, self.number))
        self._forget()

    def _forget(self) -> None:
        self.fits: dict[int, bool] = {}
        self.states: dict[bytes, int] = {}
        self.pieces: dict[str, bytes | tuple] = {}
        self.index: dict[str, int] = {}
        self.totals: list[int] = []
        self.prefixes: list[np.ndarray | bytes] = []

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b stand side by side in the encoding of their bytes.

        Takes back the merges at the border from the latest on: if the tokens that met there before could merge earlier
        than the merge just taken back (or, on the right, as early, as merging goes from left to right), they would have.
        """
        left, right, before, ok = a, b, len(self.halves), True
        while True:
            if self.made.get((left, right), before) < before:
                ok = False
                break
            if left < 256 and right < 256:
                break
            if left > right:
                before, left = left, self.halves[left][1]
            else:
                before, right = right + 1, self.halves[right][0]
        self.fits[a << BITS | b] = ok
        return ok

    def solve(self, piece: bytes) -> list[int]:
        """Counts of the prefixes of 0 to len(piece) bytes of one piece of the pre-tokenizer.

        Pieces share prefixes; states keeps, for each prefix seen, its count and its last token.
        """
        counts, last, number, states, fits = [0], [-1], self.number, self.states, self.fits
        for end in range(1, len(piece) + 1):
            if end <= KEPT_PREFIX and (state := states.get(prefix := piece[:end])) is not None:
                counts.append(state >> BITS)
                last.append(state & LOW)
                continue
            for start in range(end - 1, end - self.longest - 1 if end > self.longest else -1, -1):
                if (token := number.get(piece[start:end])) is not None and (not start or (ok if (ok := fits.get(last[start] << BITS | token)) is not None else self.compatible(last[start], token))):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    if end <= KEPT_PREFIX:
                        states[prefix] = counts[-1] << BITS | token
                    break
        return counts

    def by_character(self, piece: str) -> list[int]:
        """Counts of the prefixes of 1 to len(piece) characters of one piece."""
        if (known := self.pieces.get(piece)) is None:
            counts = self.solve(piece.encode())
            if len(counts) == len(piece) + 1:
                known = counts[1:]
            else:
                end, known = 0, []
                for c in piece:
                    end += len(c.encode())
                    known.append(counts[end])
            if piece in ("'re", "'ve", "'ll"):  # cut inside, it is a quote and a letter
                known[1] = 2
            self.pieces[piece] = bytes(known) if len(known) < 64 else tuple(known)
        return list(known)

    def plain(self, text: str) -> list[int]:
        """Counts of the prefixes of one word without special strings."""
        if text.isascii():  # most words are a run of letters, or one with a mark behind it
            if text.isalpha() or text[0] == " " and text[1:].isalpha():
                return self.by_character(text)
            if text[-1] in ",." and (text[:-1].isalpha() or text[0] == " " and text[1:-1].isalpha()):
                counts = self.by_character(text[:-1])
                return [*counts, counts[-1] + 1]
        out: list[int] = []
        for piece in INSIDE.findall(text):
            counts = self.by_character(piece)
            out += [out[-1] + n for n in counts] if out else counts
        return out

    def word(self, text: str) -> list[int]:
        return [*self.plain(text)[:-1], 1] if text in self.specials else self.plain(text)

    def words(self, text: str) -> tuple[list[str], np.ndarray]:
        """The text's words and their places in the memo."""
        found = byte_level_words(text, self.specials)
        if len(self.index) > KEPT_WORDS:
            self._forget()
        at = [self.index.get(w, -1) for w in found]
        if -1 in at:
            for i, (w, k) in enumerate(zip(found, at, strict=True)):
                if k < 0:
                    if (k := self.index.get(w, -1)) < 0:
                        k = self.index[w] = len(self.totals)
                        counts = self.word(w)
                        self.prefixes.append(bytes(counts) if len(counts) < 64 else np.array(counts, dtype=np.int32))
                        self.totals.append(counts[-1])
                    at[i] = k
        return found, np.array(at, dtype=np.int64)

    def corrections(self, words: list[str], ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """(characters, count) of prefixes that end where words, as they stand, aren't yet cut as in the whole text.

        These are ends after the last of several white spaces (all of them are one piece then), and ends inside a special
        string (it is still ordinary text, and may be one piece with what stands before).
        """
        chars = 0
        for i, w in enumerate(words):
            if i and (w in self.specials or w[0] in WHITE_CHARS and words[i - 1][-1] in WHITE_CHARS):
                ahead, before = words[i - 1], int(ends[i - 2]) if i > 1 else 0
                if ahead in self.specials:
                    ahead, before = "", int(ends[i - 1])
                for k in range(1, len(w)) if w in self.specials else (1,):
                    yield chars + k, before + sum(self.plain(x)[-1] for x in BYTE_LEVEL.findall(ahead + w[:k]))
            chars += len(w)

    def counts(self, text: str) -> np.ndarray:
        """Token counts of the prefixes of 1 to len(text) characters."""
        words, at = self.words(text)
        if not words:
            return np.zeros(0, dtype=np.int32)
        ends, lengths = np.cumsum([self.totals[k] for k in at]), np.array(list(map(len, words)))
        out = np.concatenate([as_array(self.prefixes[k]) for k in at]) + np.repeat(np.append(0, ends[:-1]), lengths)
        for k, n in self.corrections(words, ends):
            out[k - 1] = n
        return out.astype(np.int32)

    def summary(self, text: str, limit: int) -> tuple[int, int]:
        """Tokens of the text, and characters of its longest prefix of at most limit tokens."""
        words, at = self.words(text)
        if not words:
            return 0, 0
        ends = np.cumsum([self.totals[k] for k in at])
        total = int(ends[-1])
        if total <= limit:
            return total, len(text)
        # The counts at ends of words never fall, so the answer lies in the first word that ends beyond the limit, or in the next.
        k = int(np.searchsorted(ends, limit, side="right"))
        first = max(0, k - 1)
        done, chars = int(ends[first - 1]) if first else 0, sum(map(len, words[:first]))
        near = words[first : k + 2]
        counts = np.concatenate([as_array(self.prefixes[j]) for j in at[first : k + 2]]) + np.repeat(np.append(done, ends[first : k + 1])[: len(near)], list(map(len, near)))
        if first or near:
            for n, c in self.corrections(near, ends[first : k + 2] - done):
                counts[n - 1] = c + done
        inside = np.flatnonzero(counts <= limit)
        return total, chars + (int(inside[-1]) + 1 if len(inside) else 0)


def as_array(counts: np.ndarray | bytes) -> np.ndarray:
    return np.frombuffer(counts, dtype=np.uint8).astype(np.int32) if isinstance(counts, bytes) else counts


def prefix_table(path: str) -> PrefixTable:
    """One for each Python worker, which serves several tasks."""
    return held(PrefixTable, path)


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, with_table: bool = False) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit and fit_chars (the longest prefix within the limit, in characters) of each row.

    with_table adds prefix_counts, an array of the counts of all prefixes of 1 to n characters.
    """
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = source.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {schema}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_counts array<int>" * with_table

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(tokenizer_path)
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            texts = batch.column(1).to_pylist()
            found = [table.summary(t, limit) for t in texts]
            n = pa.array([x[0] for x in found], pa.int64())
            columns = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), n, pa.array([x[0] > limit for x in found], pa.bool_()), pa.array([x[1] for x in found], pa.int64())]
            names = [id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"]
            if with_table:
                columns.append(pa.array([table.counts(t) for t in texts], pa.list_(pa.int32())))
                names.append("prefix_counts")
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(solve, schema)


def longest_prefix(counts: str, budget: int) -> Column:
    """Column: characters of the longest prefix within a budget, from a prefix_counts column."""
    return F.coalesce(F.expr(f"array_max(filter(transform({counts}, (c, i) -> if(c <= {int(budget)}, i + 1, 0)), x -> x > 0))"), F.lit(0))
