"""Quality of documents by a linear-chain conditional random field over their lines.

Every line of a text is good or bad. A line's evidence are banded statistics of itself, of the line
before and of the line after it; two neighbours' labels are tied by a transition weight. Forward and
backward sums give each line's chance of being good, and a text's quality is their mean weighted by the
lines' lengths, put on the labels' scale by one logistic curve that is the same for all texts.

Labels are known for whole texts only. Training starts with every line carrying its text's label; then
the lines of bad texts that look good on their own are taken for good, never all of them, and the field
is fitted again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, renamed
from .toxicity import held_out, logistic

WINDOW = 8  # words of a passage that may repeat
SLICE = 512  # texts whose chains are summed together

_word = re.compile(r"[^\x20\x09-\x0D]+")
_symbol = re.compile(r"[#*$%&<>]")
_digit = re.compile(r"[0-9]")

#: Statistics of a line, and the upper ends of their bands; a value above the last end is a band too.
BANDS: dict[str, tuple[float, ...]] = {
    "words": (0, 2, 5, 10, 20, 40, 80, 160),
    "chars_per_word": (2, 3, 4, 5, 6, 7, 9, 12),
    "symbols_per_word": (0, 0.02, 0.1, 0.3),
    "bars_per_word": (0, 0.1, 0.3),
    "exclamations_per_word": (0, 0.02, 0.1, 0.3),
    "shouted_share": (0, 0.1, 0.3, 0.6),
    "digits_per_char": (0, 0.02, 0.1),
    "stutter_share": (0, 0.05, 0.2),
    "distinct_share": (0.2, 0.4, 0.6, 0.8, 0.95),
    "repeat_share": (0, 0.1, 0.3, 0.6),
    "seen_before": (0,),
    "ends_sentence": (0,),
    "starts_upper": (0,),
    "lines": (1, 2, 5, 20),
    "text_words": (5, 20, 50, 200),
}
WIDTH = len(BANDS)
STARTS = np.cumsum([0] + [len(b) + 1 for b in BANDS.values()])


def in_repeats(ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each word, whether it stands in a passage of ``window`` words that the text has at least twice."""
    out = np.zeros(len(ids), dtype=bool)
    if len(ids) <= window:
        return out
    mixed = np.zeros(len(ids) - window + 1, dtype=np.uint64)
    for i in range(window):
        mixed = (mixed ^ ids[i : i + len(mixed)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    _, which, times = np.unique(mixed, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[which] > 1)
    for i in range(window):
        out[starts + i] = True
    return out


def line_statistics(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, WIDTH) statistics and each line's length in characters; a null text is one empty line."""
    lines = (text or "").split("\n")
    split = [_word.findall(x) for x in lines]
    sizes = np.array([len(w) for w in split])
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for words in split for w in words), dtype=np.int64, count=int(sizes.sum()))
    ends = np.cumsum(sizes)
    repeats = np.concatenate([[0], np.cumsum(in_repeats(ids))])
    repeats = repeats[ends] - repeats[ends - sizes]
    out, seen = np.zeros((len(lines), WIDTH)), set()
    for i, (line, words) in enumerate(zip(lines, split)):
        n = len(words)
        if n:
            chars = sum(map(len, words))
            out[i, :13] = (
                n, chars / n, len(_symbol.findall(line)) / n, line.count("|") / n, line.count("!") / n, sum(map(str.isupper, words)) / n, len(_digit.findall(line)) / chars,
                sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n, repeats[i] / n, line in seen, words[-1][-1] in ".?!:;", words[0][0].isupper(),
            )
            seen.add(line)
    out[:, 13:] = len(lines), len(ids)
    return out, np.array([len(x) for x in lines], dtype=np.float64)


def features(stats: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """0/1 rows of all lines: its own bands, those of the line before and after (none at a text's ends), and a 1."""
    own = np.zeros((len(stats), STARTS[-1] + 1), np.float32)
    rows = np.arange(len(stats))
    for k, ends in enumerate(BANDS.values()):
        own[rows, STARTS[k] + np.searchsorted(ends, stats[:, k], side="left")] = 1
    own[:, -1] = 1
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    starts = np.cumsum(counts) - counts
    before[starts] = 0
    after[starts + counts - 1] = 0
    return np.hstack([before, after, own])


FEATURES = 3 * (int(STARTS[-1]) + 1)


def marginals(odds: np.ndarray, step: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's chance of being good, the expected steps (from, to) summed over all texts, and each text's log sum.

    ``odds`` are the lines' log odds of good, text after text; ``step[a, b]`` the weight of label b after
    label a (0 bad, 1 good). Texts advance together, longest first, one line at a time.
    """
    order = np.argsort(-counts, kind="stable")
    starts, left = (np.cumsum(counts) - counts)[order], counts[order]
    longest = int(left[0]) if len(left) else 0
    going = np.searchsorted(-left, -np.arange(1, longest + 1), side="right")  # texts that have a line t
    ahead, behind = np.zeros((len(odds), 2)), np.zeros((len(odds), 2))
    for t in range(longest):
        at = starts[: going[t]] + t
        if t:
            a = ahead[at - 1]
            ahead[at] = np.logaddexp(a[:, :1] + step[0], a[:, 1:] + step[1])
        ahead[at, 1] += odds[at]
    for t in range(longest - 2, -1, -1):
        at = starts[: going[t + 1]] + t
        b = behind[at + 1].copy()
        b[:, 1] += odds[at + 1]
        behind[at] = np.logaddexp(b[:, :1] + step[:, 0], b[:, 1:] + step[:, 1])
    total = np.zeros(len(counts))
    total[order] = np.logaddexp(*ahead[starts + left - 1].T) if len(left) else 0
    of = np.repeat(total, counts)
    good = np.exp(ahead[:, 1] + behind[:, 1] - of)
    steps = np.zeros((2, 2))
    inner = np.ones(len(odds), bool)
    inner[starts] = False
    to = np.flatnonzero(inner)
    if len(to):
        for a in (0, 1):
            for b in (0, 1):
                steps[a, b] = np.exp(ahead[to - 1, a] + step[a, b] + (odds[to] if b else 0.0) + behind[to, b] - of[to]).sum()
    return np.clip(good, 0, 1), steps, total


@dataclass(frozen=True)
class Field:
    """Weights of the line features, of the steps, and the curve (offset, slope) from mean marginals to the score."""

    weights: np.ndarray
    step: np.ndarray
    curve: tuple[float, float]

    def means(self, stats: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The length-weighted mean marginal of each text, as log odds, and its number of good lines.

        A line weighs its characters and the line break.
        """
        good, _, _ = marginals(features(stats, counts) @ self.weights.astype(np.float32), self.step, counts)
        weight = lengths + 1
        starts = np.cumsum(counts) - counts
        share = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
        share = np.clip(share, 1e-4, 1 - 1e-4)
        return np.log(share / (1 - share)), np.add.reduceat((good > 0.5).astype(np.int64), starts)

    def judged(self, stats: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of good lines of each text."""
        z, good = self.means(stats, lengths, counts)
        return logistic(self.curve[0] + self.curve[1] * z), good


def likelihood(x: np.ndarray, y: np.ndarray, counts: np.ndarray, weights: np.ndarray, step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log likelihood a text of the line labels ``y``, and its gradients by weights and steps."""
    odds = x @ weights
    good, expected, total = marginals(odds, step, counts)
    seen = np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[np.cumsum(counts) - counts] = False
    to = np.flatnonzero(inner)
    np.add.at(seen, (y[to - 1].astype(int), y[to].astype(int)), 1)
    value = float((odds * y).sum() + (seen * step).sum() - total.sum()) / len(counts)
    return value, (y - good).astype(x.dtype) @ x / len(counts), (seen - expected) / len(counts)


def fit_chain(x: np.ndarray, y: np.ndarray, counts: np.ndarray, start: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = 80, rate: float = 0.1, decay: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and steps of the largest penalised likelihood, by Adam on all texts."""
    w, s = start or (np.zeros(x.shape[1]), np.zeros((2, 2)))
    theta = np.concatenate([w, s.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        _, gw, gs = likelihood(x, y, counts, theta[: len(w)].astype(np.float32), theta[len(w) :].reshape(2, 2))
        g = np.concatenate([gw, gs.ravel()]) - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[: len(w)], theta[len(w) :].reshape(2, 2)


def fit_curve(z: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, float]:
    """Offset and slope of a logistic curve by Newton steps; the slope isn't negative."""
    theta = np.array([0.0, 1.0])
    x = np.stack([np.ones(len(z)), z], axis=1)
    for _ in range(rounds):
        p = logistic(x @ theta)
        g = x.T @ (y - p) - ridge * (theta - [0, 1])
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + ridge * np.eye(2)
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        theta = theta + move
        if np.abs(move).max() < 1e-9:
            break
    return (float(theta[0]), float(theta[1])) if theta[1] >= 0 else (float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 0.0)


def learn(stats: np.ndarray, lengths: np.ndarray, counts: np.ndarray, good: np.ndarray, turns: int = 1) -> Field:
    """A field from texts' lines and labels; with one class or no text, the prior alone."""
    share = (float(good.sum()) + 1) / (len(good) + 2)
    if not len(good) or not 0 < good.sum() < len(good):
        return Field(np.zeros(FEATURES), np.zeros((2, 2)), (float(np.log(share / (1 - share))), 0.0))
    x = features(stats, counts)
    of = np.repeat(np.arange(len(counts)), counts)
    y = good[of].astype(np.float64)
    weights, step = fit_chain(x, y, counts)
    for _ in range(turns):
        alone = x @ weights.astype(np.float32) + np.log((1 - share) / share)
        worst = np.full(len(counts), np.inf)
        np.minimum.at(worst, of, alone)
        y = np.where(good[of] > 0, 1.0, ((alone > 0) & (alone > worst[of])).astype(np.float64))
        weights, step = fit_chain(x, y, counts, (weights, step), rounds=40)
    bare = Field(weights, step, (0.0, 1.0))
    return Field(weights, step, fit_curve(bare.means(stats, lengths, counts)[0], good.astype(np.float64)))


def fit(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = 4_000, longest: int = 1_000) -> Field:
    """A field from at most ``sample`` labelled texts that aren't held out, the first by a hash of their id.

    Texts of over ``longest`` lines are no examples, so that the driver holds at most ``sample * longest``
    lines; others count whole. An id labelled twice is good if all its labels say so; null labels are none;
    null texts are empty. Rows equal in id and text are one example. Without examples, in empty tables too,
    every text scores the prior.
    """
    told = renamed(labels, [id_column, label_column]).where(F.col(f"in_{label_column}").isNotNull() & ~held_out(F.col(f"in_{id_column}")))
    told = told.groupBy(F.col(f"in_{id_column}").alias("id")).agg(F.min(F.col(f"in_{label_column}").cast("int")).alias("y"))
    few = told.orderBy(F.xxhash64(F.lit("crf"), "id"), "id").limit(sample)
    rows = renamed(documents, [id_column, text_column])
    matched = rows.join(F.broadcast(few), F.col(f"in_{id_column}") == F.col("id")).select("id", F.xxhash64(f"in_{text_column}").alias("sum"), F.col(f"in_{text_column}").alias("text"), "y")
    kinds = {f.name: f.dataType for f in matched.schema.fields}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                stats, lengths = line_statistics(row["text"])
                if len(stats) <= longest:
                    yield {"id": [row["id"]], "sum": [row["sum"]], "y": [row["y"]], "stats": [stats.astype(np.float32).tobytes()], "lengths": [lengths.astype(np.float32).tobytes()]}

    schema = T.StructType([T.StructField("id", kinds["id"]), T.StructField("sum", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("stats", T.BinaryType()), T.StructField("lengths", T.BinaryType())])
    seen = arrow_rows(matched, make, schema).dropDuplicates(["id", "sum"])
    got = seen.orderBy(F.xxhash64(F.lit("crf"), "id"), "id", "sum").limit(sample).select("y", "stats", "lengths").collect()
    lengths = [np.frombuffer(r.lengths, np.float32) for r in got]
    stats = [np.frombuffer(r.stats, np.float32).reshape(-1, WIDTH) for r in got]
    whole = lambda parts, empty: np.concatenate(parts).astype(np.float64) if parts else empty
    return learn(whole(stats, np.zeros((0, WIDTH))), whole(lengths, np.zeros(0)), np.array([len(x) for x in lengths], dtype=np.int64), np.array([r.y for r in got], dtype=np.int64))


def score(df: DataFrame, field: Field, id_columns: Sequence[str] = ("doc_id",), text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """``id_columns``, held_out (by the first), score (0 to 1), predicted (score >= ``threshold``), n_lines, n_good_lines.

    Whole texts, of any length; a null or empty text is one empty line, with a score of its own. A line is
    counted as good if its marginal is over one half. Rows with null or repeated ids are scored each; an
    empty table gives an empty table; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(field)
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                stats, lengths = zip(*map(line_statistics, part.column(f"in_{text_column}").to_pylist()))
                counts = np.array([len(x) for x in lengths])
                z, good = known.judged(np.concatenate(stats), np.concatenate(lengths), counts)
                yield {f"in_{c}": part.column(f"in_{c}") for c in id_columns} | {"score": z, "n_lines": counts, "n_good_lines": good}

    source = renamed(df, [*dict.fromkeys([*id_columns, text_column])])
    schema = T.StructType([T.StructField(f"in_{c}", kinds[c]) for c in id_columns] + [T.StructField("score", T.DoubleType()), T.StructField("n_lines", T.LongType()), T.StructField("n_good_lines", T.LongType())])
    out = arrow_rows(source, make, schema).select(*(F.col(f"in_{c}").alias(c) for c in id_columns), "score", "n_lines", "n_good_lines")
    return out.select(*id_columns, held_out(F.col(f"`{id_columns[0]}`")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines", "n_good_lines")
