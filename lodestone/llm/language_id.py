"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1 (seeded by its code point). An n-gram's vector binds its letters' vectors, each
permuted (rotated) by its place; a text's vector bundles (sums) its n-grams' vectors; a language's prototype bundles its
training texts' vectors, each of unit length. A text gets the language of the prototype with the largest cosine.

Runs of anything but letters are one blank, letters are lower-cased. Prototypes are sums, so tasks add up their own rows and
one vector a language and task is shuffled; the model is languages x dimensions numbers. Texts are never shuffled.

Defined cases: a text that is null or has no letter is `und` with score 0. Texts shorter than an n-gram count as padded with
blanks. Very long texts are whole. Ties go to the language that sorts first. Rows without a language aren't learnt from.
With no training rows every text is `und`. Repeated rows are judged alike; an empty table gives none; other columns are unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm.common import held, whole_text

DIMENSIONS = 1_024
#: More languages than this mean that the column holds no languages.
MOST_LANGUAGES = 4_096
KEPT_GRAMS = 60_000
#: Texts that are Python strings at a time.
ROWS = 512


class Encoder:
    """Turns texts into vectors; keeps the vectors of n-grams it has met. One for each Python worker."""

    def __init__(self, n: int = 3, dimensions: int = DIMENSIONS, seed: int = 7):
        self.n, self.dimensions, self.seed = n, dimensions, seed
        self._forget()

    def _forget(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.place: dict[tuple, int] = {}
        self.vectors = np.zeros((1024, self.dimensions), dtype=np.int8)

    def letter(self, code: int) -> np.ndarray:
        if (v := self.letters.get(code)) is None:
            v = self.letters[code] = np.random.default_rng((self.seed, code)).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
        return v

    def gram(self, codes: tuple[int, ...]) -> int:
        """The place of an n-gram's vector."""
        if (at := self.place.get(codes)) is None:
            at = self.place[codes] = len(self.place)
            if at >= len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            bound = np.ones(self.dimensions, dtype=np.int8)
            for k, c in enumerate(codes):
                bound *= np.roll(self.letter(c), self.n - 1 - k)
            self.vectors[at] = bound
        return at

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Places and counts of a text's distinct n-grams, and how many letters it has; None without letters."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        distinct = np.unique(points) if len(points) < 2_000_000 else np.flatnonzero(np.bincount(points)).astype(np.uint32)
        letters = np.array([c for c in distinct.tolist() if chr(c).isalpha()], dtype=np.uint32)
        if not len(letters):
            return None
        code = np.zeros(int(distinct[-1]) + 1, dtype=np.int64)
        code[letters] = np.arange(1, len(letters) + 1)
        row = code[points]
        n_letters = int(np.count_nonzero(row))
        row = row[(row > 0) | (np.append(1, row[:-1]) > 0)]
        row = np.concatenate([[0], row[int(row[0] == 0) :], [0] * max(1, self.n - len(row) - 1)])
        base = len(letters) + 1
        joined = np.zeros(len(row) - self.n + 1, dtype=np.int64)
        for k in range(self.n):
            joined = joined * base + row[k : len(row) - self.n + 1 + k]
        found, counts = np.unique(joined, return_counts=True)
        original = np.append(0, letters)
        digits = np.stack([original[found // base ** (self.n - 1 - k) % base] for k in range(self.n)], axis=1)
        return np.fromiter((self.gram(tuple(d)) for d in digits.tolist()), np.int64, len(digits)), counts, n_letters

    def encode(self, texts: list[str], rows: int = 64) -> Iterator[tuple[int, np.ndarray]]:
        """(place in texts, unit vector) of each text that has letters."""
        for i, v, _ in self.counted(texts, rows):
            yield i, v

    def counted(self, texts: list[str], rows: int = 64) -> Iterator[tuple[int, np.ndarray, int]]:
        """encode(), with how many letters each text has."""
        for start in range(0, len(texts), rows):
            if len(self.place) > KEPT_GRAMS:
                self._forget()
            found = [(start + i, g) for i, t in enumerate(texts[start : start + rows]) if (g := self.grams(t))]
            if not found:
                continue
            used, at = np.unique(np.concatenate([g[0] for _, g in found]), return_inverse=True)
            counts = np.zeros((len(found), len(used)), dtype=np.float32)
            counts[np.repeat(np.arange(len(found)), [len(g[0]) for _, g in found]), at] = np.concatenate([g[1] for _, g in found])
            bundled = counts @ self.vectors[used].astype(np.float32)
            norms = np.linalg.norm(bundled, axis=1, keepdims=True)
            for (i, g), v in zip(found, bundled / np.where(norms > 0, norms, 1), strict=True):
                yield i, v, g[2]


def encoder(n: int, dimensions: int) -> Encoder:
    return held(Encoder, n, dimensions)


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", n: int = 3, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes as rows of unit length."""
    source = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), whole_text(text_col).alias("text"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for whole in batches:
            langs = whole.column(0).to_pylist()
            for k in range(0, whole.num_rows, ROWS):
                for i, v in encoder(n, dimensions).encode(whole.column(1).slice(k, ROWS).to_pylist()):
                    if (held := found.get(langs[k + i])) is None:
                        found[langs[k + i]] = v.astype(np.float64)
                    else:
                        held += v
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))], ["lang", "v"])

    parts = source.mapInArrow(sums, "lang string, v array<double>").select("lang", F.posexplode("v").alias("at", "x"))
    bundled = parts.groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = bundled.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("v")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values")
    prototypes = np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), dimensions)
    return [r["lang"] for r in rows], prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray, keep: list[Column | str], text_col: str = "text", n: int = 3, length_col: str | None = None) -> DataFrame:
    """The kept columns, lang_pred, score (cosine, from 0) and margin (over the next language) of each row.

    length_col, if named, is a text's length class: the whole part of log2 of its letters, null without letters or where nothing
    was learnt. Scores grow with length, so texts are compared within a class.
    """
    kept = docs.select(*keep)
    added = ["lang_pred", "score", "margin", *([length_col] if length_col else [])]
    if len({*kept.columns, *added, "__text"}) < len(kept.columns) + len(added) + 1:
        raise ValueError("kept columns must differ from those that are added")
    dimensions, model, n_kept, names = prototypes.shape[1], prototypes.astype(np.float32), len(kept.columns), [*kept.columns, *added]
    # A text that is kept as it is goes to Python once.
    as_it_is = any(isinstance(k, str) and k == text_col for k in keep)
    at = kept.columns.index(text_col) if as_it_is else n_kept
    source = kept if as_it_is else docs.select(*keep, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                texts = [t or "" for t in batch.column(at).to_pylist()]
                lang, score, margin, length = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [None] * len(texts)
                for i, v, letters in encoder(n, dimensions).counted(texts) if languages else ():
                    cosines = np.clip(model @ v, 0, 1)
                    best = int(cosines.argmax())
                    lang[i], score[i] = languages[best], float(cosines[best])
                    margin[i] = float(cosines[best] - np.delete(cosines, best).max(initial=0.0))
                    length[i] = letters.bit_length() - 1
                made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(length, pa.int32())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *made[: len(added)]], names)

    schema = StructType(list(kept.schema.fields)).add("lang_pred", "string").add("score", "double").add("margin", "double")
    return source.mapInArrow(run, schema.add(length_col, "integer") if length_col else schema)


def cutoffs(judged: DataFrame, clean: Column, class_col: str, share: float = 0.01, slack: float = 0.5) -> list[tuple[int, float, float]]:
    """(class, least score, least margin): of each length class, slack times the quantile `share` among clean labelled rows.

    One aggregation; a row a class comes to the driver, some 30 at most. The same rule holds at every size of the table.
    """
    part = judged.where(clean).groupBy(class_col).agg(F.percentile_approx("score", share).alias("s"), F.percentile_approx("margin", share).alias("m"))
    return sorted((r[class_col], r["s"] * slack, r["m"] * slack) for r in part.where(F.col(class_col).isNotNull()).collect())


def accepted(cuts: list[tuple[int, float, float]], class_col: str) -> Column:
    """Whether score and margin reach the cut-offs of the row's class; a class that no clean row has takes those of the next shorter one, else of the shortest."""
    reach = lambda s, m: (F.col("score") >= s) & (F.col("margin") >= m)
    if not cuts:
        return F.lit(False)
    found = reach(*cuts[0][1:])
    for k, s, m in cuts[1:]:
        found = F.when(F.col(class_col) >= k, reach(s, m)).otherwise(found)
    return (F.col("lang_pred") != "und") & found


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score and margin of each row, with prototypes learnt from the rows that aren't held out."""
    languages, prototypes = learn(docs.where(~held_out(id_col) & F.col(id_col).isNotNull()), text_col, lang_col)
    return predict(docs, languages, prototypes, [F.col(id_col), held_out(id_col).alias("held_out")], text_col)
