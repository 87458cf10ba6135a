"""Claims and what backs them: quotes found in texts at any place, claims checked against the file that they name, and the object that an answer holds.

Quotes and texts are compared after composition of characters (NFC) and with white space folded, by characters.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lodestone.operators.common import settled

#: White space as it is folded, and the characters that a quote needs.
WHITE = re.compile("[\t-\r \xa0  -     　﻿]+")
LEAST_QUOTE = 8
#: Lengths of the stretches that quotes are looked up by; each quote by the longest that it holds.
GRAMS = (32, 16, 8)
#: Quotes looked up in one pass over the texts: 16 bytes each in every task.
AT_ONCE = 1_000_000

_FACTOR = 0x9E3779B97F4A7C15


def folded(text: str) -> str:
    composed = text if text.isascii() else unicodedata.normalize("NFC", text)
    return WHITE.sub(" ", composed).strip(" ")


def folded_text(text: Column | str) -> Column:
    """Composed, with runs of white space as one blank and none at the ends."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(folded, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def gram_hashes(text: str) -> dict[int, np.ndarray]:
    """For each length of GRAMS the hash of the stretch that begins at each character."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    # A stretch of twice the length is two of the shorter ones.
    width, found = 1, {1: chars * np.uint64(0xBF58476D1CE4E5B9)}
    while width < max(GRAMS):
        half = found[width]
        if len(half) <= width:
            break
        found[2 * width] = half[:-width] * np.uint64(pow(_FACTOR, width, 1 << 64)) + (half[width:] ^ (half[width:] >> np.uint64(29)))
        width *= 2
    return {g: found[g] for g in GRAMS if g in found}


def _looked_up_by(quote: str) -> tuple[int, int] | None:
    """The hash and place of the stretch that a quote is looked up by: of its longest ones, that of the least hash."""
    grams = gram_hashes(quote) if len(quote) >= LEAST_QUOTE else {}
    width = next((g for g in GRAMS if g in grams), None)
    if width is None:
        return None
    scrambled = grams[width] * np.uint64(0x94D049BB133111EB)
    at = int(np.argmin(scrambled ^ (scrambled >> np.uint64(31))))
    return int(grams[width][at].view(np.int64)), at


def _anchored(quotes: DataFrame, quote: str) -> DataFrame:
    """quotes with __quote (folded), __gram, __before and __after: what a window around a hit must hold. Quotes under LEAST_QUOTE characters go."""

    def anchor(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            own = folded(t) if t is not None else ""
            by = _looked_up_by(own)
            rows.append((own, *by, len(own) - by[1]) if by else (None, None, None, None))
        return pd.DataFrame(rows, columns=["quote", "gram", "before", "after"]).astype({"gram": "Int64", "before": "Int32", "after": "Int32"})

    found = quotes.withColumn("__a", F.pandas_udf(anchor, "struct<quote:string,gram:long,before:int,after:int>")(F.col(quote))).where(F.col("__a.gram").isNotNull())
    return found.select(*[F.col(f"`{c}`") for c in quotes.columns], F.col("__a.quote").alias("__quote"), F.col("__a.gram").alias("__gram"), F.col("__a.before").alias("__before"), F.col("__a.after").alias("__after"))


def quoted(texts: DataFrame, quotes: DataFrame, text: str, quote: str) -> DataFrame:
    """Pairs of rows where the folded text holds the folded quote at any place. Null texts and quotes, and quotes under 8 characters, pair with nothing.

    A quote is looked up by one stretch of 32, 16 or 8 characters. Texts are read once for each AT_ONCE quotes: a task hashes
    all their stretches, and of those that some quote is looked up by it gives a window that is long enough for any such quote.
    Windows meet quotes in an equi-join; texts themselves don't travel. The columns of a pair but the text are carried by the windows.
    """
    own = {c: f"__{i}" for i, c in enumerate(texts.columns) if c != text}  # names that any function takes
    anchored = settled(_anchored(quotes, quote))
    grams = settled(anchored.groupBy("__gram").agg(F.max("__before").alias("before"), F.max("__after").alias("after")))
    parts = max(1, -(-grams.count() // AT_ONCE))
    schema = StructType([StructField(n, texts.schema[c].dataType) for c, n in own.items()]).add("__gram", "long").add("__window", "string")

    def windows(part: int) -> DataFrame:
        wanted = grams.where(F.pmod(F.xxhash64("__gram"), F.lit(parts)) == part).toPandas().sort_values("__gram")
        values, before, after = wanted["__gram"].to_numpy(dtype=np.int64), wanted["before"].to_numpy(), wanted["after"].to_numpy()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, found, shown = [], [], []
                for row, value in enumerate(batch.column(0)):
                    body = value.as_py()
                    if body is None or not len(values):
                        continue
                    body, seen = folded(body), set()
                    for hashes in gram_hashes(body).values():
                        hashes = hashes.view(np.int64)
                        place = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
                        for at in np.flatnonzero(values[place] == hashes).tolist():
                            k = place[at]
                            window = (int(values[k]), body[max(0, at - before[k]) : at + after[k]])
                            if window not in seen:
                                seen.add(window)
                                rows.append(row)
                                found.append(window[0])
                                shown.append(window[1])
                kept = batch.select(list(range(1, batch.num_columns))).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.int64()), pa.array(shown, pa.string())], [*own.values(), "__gram", "__window"])

        return texts.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`").alias(n) for c, n in own.items()]).mapInArrow(run, schema)

    hits = windows(0)
    for part in range(1, parts):
        hits = hits.unionByName(windows(part))
    met = hits.alias("t").join(anchored.alias("q"), F.col("t.__gram") == F.col("q.__gram")).where(F.contains("t.__window", F.col("q.__quote")))
    # A text that holds a quote twice gives it twice; a row of texts is one row, as far as its columns tell.
    return met.select(*[F.col(f"t.{n}").alias(c) for c, n in own.items()], *[F.col(f"q.`{c}`") for c in quotes.columns]).distinct()


def verified(claims: DataFrame, files: DataFrame, pack: str, path: str, quote: str, number: str) -> DataFrame:
    """claims with real_path and problem: null where the quote stands in the file that the claim names, of the same pack.

    files: the pack's column, place (order), path (as shown), real_path and text. A path is looked up as it is, shown or real, then
    without ./ before it; of files with one path the first counts. claims must be unique by pack and number. Texts meet only the
    claims that name them.
    """
    own = [c for c in claims.columns]
    named = files.select(pack, "place", "real_path", F.explode(F.array(F.struct(F.col("path").alias("key"), F.lit(0).alias("kind")), F.struct(F.col("real_path").alias("key"), F.lit(1).alias("kind")))).alias("by"))
    by_key = named.where("by.key IS NOT NULL").groupBy(pack, F.col("by.key").alias("key")).agg(F.min(F.struct("place", "by.kind", "real_path")).alias("file"))
    asked = claims.select(pack, number, F.explode(F.array(F.struct(F.lit(0).alias("order"), F.col(path).alias("key")), F.struct(F.lit(1).alias("order"), F.regexp_replace(path, r"^\./", "").alias("key")))).alias("by"))
    found = asked.select(pack, number, "by.order", "by.key").join(by_key, [pack, "key"]).groupBy(pack, number).agg(F.min_by("file", "order").alias("file"))
    placed = claims.join(found, [pack, number], "left").withColumns({"__place": F.col("file.place"), "__real": F.col("file.real_path"), "__quote": folded_text(F.col(quote))})
    texts = files.select(F.col(pack).alias("__pack"), F.col("place").alias("__at"), folded_text("text").alias("__text"))
    joined = placed.join(texts, (F.col(pack) == F.col("__pack")) & (F.col("__place") == F.col("__at")), "left")
    held = F.coalesce(F.contains("__text", F.col("__quote")), F.lit(False))
    problem = F.when(F.col("__place").isNull(), "not a file in the pack").when(F.coalesce(F.char_length("__quote"), F.lit(0)) < LEAST_QUOTE, "quote too short").when(~held, "quote not in the file")
    return joined.select(*[F.col(f"`{c}`") for c in own], F.col("__real").alias("real_path"), problem.alias("problem"))


def support(checked: DataFrame, pack: str, least: int = 2) -> DataFrame:
    """pack, kept, dropped and status: ok with at least so many claims whose quotes were found, else unsupported."""
    counts = checked.groupBy(pack).agg(F.count_if(F.col("problem").isNull()).alias("kept"), F.count_if(F.col("problem").isNotNull()).alias("dropped"))
    return counts.withColumn("status", F.when(F.col("kept") >= least, "ok").otherwise("unsupported"))


FENCE = re.compile(r"```[\w-]*[ \t]*\r?\n(?P<inside>.*?)\r?\n[ \t]*```[ \t]*(?=\r?\n|\Z)", re.S | re.A)
#: Strings and braces of JSON; a string that isn't ended runs to the end.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}]', re.S)


def _object(text: str) -> bool:
    def refuse(word: str):
        raise ValueError(word)

    try:
        return isinstance(json.loads(text, parse_constant=refuse), dict)
    except (ValueError, RecursionError):
        return False


def first_object(text: str) -> tuple[str | None, str | None]:
    """(the first stretch in balanced braces that is a JSON object, None) or (None, problem).

    Braces in strings don't count. Where a brace never closes, those behind it that stand where a value may stand are taken as parts
    of what was cut off.
    """
    cut_off = False
    for at in (m.start() for m in re.finditer("{", text)):
        if cut_off and text[:at].rstrip()[-1:] in (":", ",", "[", "{"):
            continue
        depth = 0
        for token in TOKEN.finditer(text, at):
            depth += {"{": 1, "}": -1}.get(token[0], 0)
            if not depth:
                if _object(text[at : token.end()]):
                    return text[at : token.end()], None
                break
        else:
            cut_off = True
    return None, "the answer ends before its object closes" if cut_off else "the answer holds no object"


def answer_object(text: str | None) -> tuple[str | None, str | None]:
    """The JSON object of an answer: the whole text, else the first one in its first code fence, else the first anywhere."""
    text = text or ""
    bare = WHITE.sub(" ", text[:1]).strip() + text[1:]
    if _object(bare.strip()):
        return bare.strip(), None
    fence = FENCE.search(text)
    found = first_object(fence["inside"]) if fence else (None, None)
    if found[0] is None:
        anywhere = first_object(text)
        found = anywhere if anywhere[0] is not None or not fence else found
    return found


def answer(text: Column | str) -> Column:
    """struct(object, problem): the JSON object that an answer in free text holds, or why there is none."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([answer_object(t) for t in texts], columns=["object", "problem"])

    return F.pandas_udf(run, "struct<object:string,problem:string>")(text)


def read_answers(rows: DataFrame, text: Column, schema: str) -> DataFrame:
    """rows with answer (the object by schema; null where there is none) and problem."""
    found = rows.withColumn("__a", answer(text))
    return found.withColumns({"answer": F.from_json("__a.object", schema), "problem": F.col("__a.problem")}).drop("__a")
