"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees are trained here, from URLs that a rule labels (or any labelled URLs the caller has). Training takes a bounded
sample of the labelled rows (`max_train`, the rows with the smallest hashes of each label); judging takes every row.

Nulls and odd rows: a null URL or one without `://` has an empty host and path, fits no rule and is judged by the trees as
the empty URL. Repeated rows are judged one by one, alike. An empty table gives an empty result. Other columns don't matter.
Without labelled URLs every unmatched URL is allowed; with labels of one class only, it gets that class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "longest_segment", "hyphens", "suffix1", "suffix2", "suffix1_share", "segment_rate")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, with A-Z lower-cased (only these letters)."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def rule(verdict: str, text: str) -> Rule:
    host, _, path = text.partition("/")
    return Rule(verdict, host, "/" + path)


def match_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rule and rule_verdict: of the longest rule that fits host and path, else null. Part of the scan's own stage."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = r.fits(F.col("host"), F.col("path"))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return df.withColumns({"rule": name, "rule_verdict": verdict})


#: A part of an address and the statistic that the model takes of it: its smoothed share of blocks, or its share of rows.
SUFFIXES = (("suffix1", "s1", "block"), ("suffix2", "s2", "block"), ("suffix1_share", "s1", "share"), ("segment_rate", "s3", "block"))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds what the features are made of to rows with url, host and path: counts by Spark's own functions, and the keys s1, s2, s3.

    s1 and s2 are the last label and the last two labels of the host, s3 is the path's first segment.
    """
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    return urls.withColumns({
        "length": F.char_length(url), "host_length": F.char_length(host), "path_length": F.char_length(path), "depth": F.size(segments),
        "digit_ratio": F.coalesce(F.try_divide(F.regexp_count(url, F.lit(r"\p{Nd}")), F.char_length(url)), F.lit(0.0)),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")), "host_labels": F.when(host == "", 0).otherwise(F.size(labels)),
        "longest_segment": F.coalesce(F.array_max(F.transform(segments, lambda x: F.char_length(x))), F.lit(0)), "hyphens": F.regexp_count(url, F.lit("-")),
        "s1": F.concat(F.lit("1"), F.substring_index(host, ".", -1)), "s2": F.concat(F.lit("2"), F.substring_index(host, ".", -2)), "s3": F.concat(F.lit("3/"), F.regexp_extract(path, "^/([^/]*)", 1)),
    })


COUNTED = ("length", "host_length", "path_length", "depth", "digit_ratio", "parameters", "host_labels", "longest_segment", "hyphens")


def entropy(urls: pd.Series) -> np.ndarray:
    """Bits a byte of each text, from one table of (text, byte) counts."""
    raw = [x.encode() for x in urls]
    size = np.array(list(map(len, raw)), dtype=np.int64)
    at = np.repeat(np.arange(len(raw)), size) * 256 + np.frombuffer(b"".join(raw), dtype=np.uint8)
    cells, n = np.unique(at, return_counts=True)
    share = n / size[cells >> 8]
    return np.bincount(cells >> 8, -share * np.log2(share), len(raw))


@dataclass
class Suffixes:
    """Statistics of suffix keys in the training sample: share of rows, smoothed share of blocks."""

    base: float = 0.0
    block: dict[str, float] = field(default_factory=dict)
    share: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, sample: pd.DataFrame, y: np.ndarray, strength: float = 20.0) -> Suffixes:
        keys = pd.concat([sample["s1"], sample["s2"], sample["s3"]])
        by = pd.Series(np.tile(y, 3), dtype=float).groupby(keys.to_numpy()).agg(["sum", "count"])
        base = float(np.mean(y)) if len(y) else 0.0
        return cls(base, ((by["sum"] + strength * base) / (by["count"] + strength)).to_dict(), (by["count"] / max(len(y), 1)).to_dict())

    def features(self, rows: pd.DataFrame) -> np.ndarray:
        """A row of FEATURES for each row of lexical()."""
        made = {"entropy": entropy(rows["url"].fillna(""))} | {c: rows[c].to_numpy(dtype=float) for c in COUNTED}
        for name, key, of in SUFFIXES:
            made[name] = rows[key].map(getattr(self, of)).fillna(self.base if of == "block" else 0.0).to_numpy(dtype=float)
        return np.column_stack([made[c] for c in FEATURES]) if len(rows) else np.zeros((0, len(FEATURES)))


class BoostedTrees:
    """Binary logistic boosting of complete trees over binned features."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.start, self.edges, self.trees = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if len(y) else 1e-6
        self.start = math.log(share / (1 - share))
        if not len(y) or y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1])) for c in x.T]
        codes, margin = self._codes(x), np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree, node = self._grow(codes, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += tree[2][node]
        return self

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)])

    def _grow(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple, np.ndarray]:
        node, features, cuts = np.zeros(codes.shape[1], dtype=np.int64), [], []
        for level in range(self.depth):
            n, best = 1 << level, None
            for f, c in enumerate(codes):
                at = node * self.bins + c
                left_g, left_h = (np.bincount(at, w, n * self.bins).reshape(n, self.bins).cumsum(1) for w in (g, h))
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + self.ridge) + (all_g - left_g) ** 2 / (all_h - left_h + self.ridge) - all_g**2 / (all_h + self.ridge)
                cut, top = gain.argmax(1), gain.max(1)
                if best is None:
                    best, feature, where = top, np.zeros(n, dtype=np.int64), cut
                else:
                    better = top > best + 1e-12
                    best, feature, where = np.where(better, top, best), np.where(better, f, feature), np.where(better, cut, where)
            features.append(feature)
            cuts.append(where)
            node = node * 2 + (codes[feature[node], np.arange(len(node))] > where[node])
        n = 1 << self.depth
        return (features, cuts, -self.rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + self.ridge)), node

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.start)
        if self.trees and len(x):
            codes, rows = self._codes(x), np.arange(len(x))
            for features, cuts, leaf in self.trees:
                node = np.zeros(len(x), dtype=np.int64)
                for f, c in zip(features, cuts, strict=True):
                    node = node * 2 + (codes[f[node], rows] > c[node])
                margin += leaf[node]
        return 1 / (1 + np.exp(-margin))


def train(labelled: DataFrame, max_train: int = 20_000) -> tuple[BoostedTrees, Suffixes]:
    """labelled: url, host, path, label (allow or block). Of each label the max_train / 2 URLs with the smallest hashes, each URL once."""
    keyed = labelled.select("url", "host", "path", "label").distinct().withColumn("h", F.xxhash64("url", "label"))
    halves = [keyed.where(F.col("label") == x).orderBy("h", "url").limit(max_train // 2) for x in ("allow", "block")]
    sample = lexical(halves[0].unionByName(halves[1])).toPandas()  # max_train rows at most
    y = (sample["label"] == "block").to_numpy(dtype=float)
    suffixes = Suffixes.fit(sample, y)
    return BoostedTrees().fit(suffixes.features(sample), y), suffixes


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", max_train: int = 20_000, cut_at: float = 0.5) -> DataFrame:
    """Every row's id, host, path, rule (null where none fits), verdict and block_score (the trees' probability of a block; null under a rule)."""
    urls = match_rules(pages.select(F.col(id_col), F.col(url_col).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}), rules)
    model, suffixes = train(urls.where(F.col("rule").isNotNull()).withColumn("label", F.col("rule_verdict")), max_train)
    keys = ["s1", "s2", "s3"]

    @F.pandas_udf("double")
    def block_score(url: pd.Series, counts: pd.DataFrame) -> pd.Series:
        out, free = np.full(len(url), np.nan), counts["free"].to_numpy(dtype=bool)
        if free.any():
            rows = counts[free].assign(url=url[free])
            out[free] = model.probability(suffixes.features(rows))
        return pd.Series(out)

    free = F.col("rule").isNull().alias("free")
    scored = lexical(urls).withColumn("block_score", F.nanvl(block_score("url", F.struct(free, *COUNTED, *keys)), F.lit(None).cast("double")))
    return scored.select(id_col, "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("block_score") >= cut_at, "block").otherwise("allow")).alias("verdict"), "block_score")
