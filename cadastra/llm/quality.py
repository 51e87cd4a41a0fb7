"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown in numpy on histograms of a bounded labelled sample, with monotonic constraints on
statistics that can only count against a text, and flattened into node arrays: scoring walks all
trees for a block of documents at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, renamed

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SHORTEST, MOST_REPEATED = 20, 30  # words; percent

_word = re.compile(r"[^\x20\x09-\x0D]+")
_symbol = re.compile(r"[#*$%&|<>]")
_digit = re.compile(r"[0-9]")

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Statistics the trees see, and what a larger value may do to the score: 1 raise, -1 lower, 0 either.
FEATURES: Mapping[str, int] = {
    "words": 0,
    "chars_per_word": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "shouted_share": -1,
    "exclamations_per_word": -1,
    "distinct_share": 0,
    "stutter_share": -1,
    "digits_per_char": 0,
    "words_per_line": 0,
}


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice in the text, the first included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, dtype=np.uint64)
    spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    for i in range(window):
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9) + spread[i : i + n]
        mixed ^= mixed >> np.uint64(31)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the trees' features of a whole text; null as a text without words."""
    words = _word.findall(text) if text else []
    n = len(words)
    if not n:
        return [0, 0, len(_symbol.findall(text)) if text else 0, 0, 0], [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    symbols = len(_symbol.findall(text))
    lines, seen, dups = 0, set(), 0
    for line in text.split("\n"):
        if line in seen:
            dups += 1
            lines += 1
        elif _word.search(line):
            seen.add(line)
            lines += 1
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    repeats = repeated_words(ids)
    shouted = sum(map(str.isupper, words))
    stutter = int((ids[1:] == ids[:-1]).sum())
    return [n, chars, symbols, dups, repeats], [
        float(np.log1p(n)), chars / n, symbols / n, dups / lines, repeats / n, shouted / n, text.count("!") / n, len(known) / n, stutter / n, len(_digit.findall(text)) / chars, n / lines,
    ]


@dataclass(frozen=True)
class Forest:
    """Flat nodes of all trees: a leaf points at itself on both sides."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 1.0, ridge: float = 1.0) -> Forest:
    """Boosted trees for the log odds of ``y``; with one class or no rows, the prior alone."""
    width = len(monotone)
    nodes: list[list[float]] = []
    roots: list[int] = []
    share = (float(y.sum()) + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
        margin = np.full(len(y), base)

        def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> int:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            value = float(np.clip(-total_g / (total_h + ridge), lo, hi))
            best = (1e-6, -1, -1, 0.0, 0.0)
            if level < depth and len(rows) > 1:
                for f in range(width):
                    k = len(cuts[f]) + 1
                    gl = np.bincount(binned[rows, f], g[rows], k).cumsum()[:-1]
                    hl = np.bincount(binned[rows, f], h[rows], k).cumsum()[:-1]
                    gr, hr = total_g - gl, total_h - hl
                    vl, vr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-gr / (hr + ridge), lo, hi)
                    gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - (gr * vr + 0.5 * (hr + ridge) * vr**2) + (total_g * value + 0.5 * (total_h + ridge) * value**2)
                    gain[(hl < least) | (hr < least) | (monotone[f] * (vr - vl) < 0)] = -np.inf
                    if len(gain) and gain.max() > best[0]:
                        i = int(gain.argmax())
                        best = (float(gain[i]), f, i, float(vl[i]), float(vr[i]))
            _, f, i, vl, vr = best
            if f < 0:
                margin[rows] += rate * value
                return leaf(rate * value)
            at = len(nodes)
            nodes.append([f, float(cuts[f][i]), 0, 0, 0.0])
            mid = (vl + vr) / 2
            bounds = {1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid)), 0: ((lo, hi), (lo, hi))}[monotone[f]]
            goes = binned[rows, f] <= i
            nodes[at][2] = split(rows[goes], g, h, level + 1, *bounds[0])
            nodes[at][3] = split(rows[~goes], g, h, level + 1, *bounds[1])
            return at

        for _ in range(trees):
            p = 0.5 * (1 + np.tanh(0.5 * margin))
            roots.append(split(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), 0, -np.inf, np.inf))
    if not roots:
        roots.append(leaf(0.0))
    feature, threshold, left, right, value = zip(*nodes)
    return Forest(np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(right, np.int64), np.array(value), np.array(roots, np.int64), depth, base)


def fit(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = 20_000) -> Forest:
    """Trees for the quality label of at most ``sample`` labelled ids, the first by a hash, and as many of their texts.

    A text labelled twice is good if all its labels say so; null labels are none; null texts count as empty.
    Rows equal in id and text are one example. Texts of any length count whole. Without examples, in empty
    tables too, the trees are one leaf.
    """
    told = renamed(labels, [id_column, label_column]).where(F.col(f"in_{label_column}").isNotNull())
    told = told.groupBy(F.col(f"in_{id_column}").alias("id")).agg(F.min(F.col(f"in_{label_column}").cast("int")).alias("y"))
    few = told.orderBy(F.xxhash64(F.lit("q"), "id"), "id").limit(sample)
    rows = renamed(documents, [id_column, text_column])
    matched = rows.join(F.broadcast(few), F.col(f"in_{id_column}") == F.col("id")).select("id", F.xxhash64(f"in_{text_column}").alias("sum"), F.col(f"in_{text_column}").alias("text"), "y")
    kinds = {f.name: f.dataType for f in matched.schema.fields}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield {"id": part.column(0), "sum": part.column(1), "x": [statistics(t)[1] for t in part.column(2).to_pylist()], "y": part.column(3)}

    schema = T.StructType([T.StructField("id", kinds["id"]), T.StructField("sum", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("y", T.IntegerType())])
    seen = arrow_rows(matched, make, schema).dropDuplicates(["id", "sum"])
    got = seen.orderBy(F.xxhash64(F.lit("q"), "id"), "id", "sum").limit(sample).select("x", "y").collect()
    # the same trees however the sample's rows arrive
    got.sort(key=lambda r: (r.x, r.y))
    x = np.array([r.x for r in got]).reshape(-1, len(FEATURES))
    return grow(x, np.array([r.y for r in got], dtype=float), tuple(FEATURES.values()))


def judge(df: DataFrame, forest: Forest, id_columns: tuple[str, ...] = ("doc_id",), text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_columns``, the base counts, base_failed, kept and quality (the trees' score), a row for each row.

    A text fails the base rules with under 20 words or over 30 % repeated words; it is kept if it passes
    them and scores at least ``threshold``. Whole texts; null has no words. Rows with null or repeated
    ids are judged each; an empty table gives an empty table; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(forest)
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                counts, x = zip(*map(statistics, part.column(f"in_{text_column}").to_pylist()))
                out = {f"in_{c}": part.column(f"in_{c}") for c in id_columns}
                out |= {name: [c[i] for c in counts] for i, name in enumerate(BASE)}
                yield out | {"quality": shared.value.score(np.array(x)).tolist()}

    source = renamed(df, [*dict.fromkeys([*id_columns, text_column])])
    schema = T.StructType([T.StructField(f"in_{c}", kinds[c]) for c in id_columns] + [T.StructField(c, T.LongType()) for c in BASE] + [T.StructField("quality", T.DoubleType())])
    out = arrow_rows(source, make, schema)
    failed = (F.col("n_words") < SHORTEST) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= threshold))
    return out.select(*(F.col(f"in_{c}").alias(c) for c in id_columns), *BASE, "base_failed", "kept", "quality")
