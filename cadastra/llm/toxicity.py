"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives and texts of unknown label the rest. Features are words and
beginnings of words; those kept are the ones that tell the two samples apart best. A numpy classifier
minimises the class-prior-corrected risk of Kiryo et al. (2017): with prior p, p R+(positives) +
max(0, R-(unlabelled) - p R-(positives)), whose second part can't be driven below zero.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, durable, release, renamed

PREFIXES = (3, 4, 5, 6, 7, 8)  # letters of the beginnings of words that are features
CACHE_ENTRIES = 200_000

_letters = re.compile(r"[^\W\d_]+")
_cache: dict[int, dict[str, tuple[int, ...]]] = {}


@dataclass(frozen=True)
class Model:
    """Score: logistic of ``bias`` and the weights of the features that a text has at all."""

    features: dict[str, int]
    weights: np.ndarray
    bias: float
    key: int

    def found(self, word: str) -> tuple[int, ...]:
        return tuple(i for f in spelled(word) if (i := self.features.get(f)) is not None)


def spelled(word: str) -> list[str]:
    """The features of a word: itself, and its beginnings, marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) >= n)]


def words_of(text: str | None) -> set[str]:
    return set(_letters.findall(text.lower())) if text else set()


def present(text: str | None, model: Model) -> list[int]:
    known = _cache.setdefault(model.key, {})
    if len(known) > CACHE_ENTRIES:
        known.clear()
    out: set[int] = set()
    for word in words_of(text):
        hits = known.get(word)
        if hits is None:
            hits = known[word] = model.found(word)
        if hits:
            out.update(hits)
    return sorted(out)


def logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, dtype=np.float64)))


def risk_parts(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, float]:
    """prior R+(positives) and R-(unlabelled) - prior R-(positives) of the logistic loss; rows end with a 1 for the bias."""
    sp, su = logistic(p @ w), logistic(u @ w)
    loss = lambda s: float(-np.log(np.maximum(s, 1e-12)).mean())
    return prior * loss(sp), loss(1 - su) - prior * loss(1 - sp)


def gradient(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float) -> np.ndarray:
    """Of the risk while its second part isn't negative; else of that part's opposite, which undoes what drove it there."""
    sp, su = logistic(p @ w), logistic(u @ w)
    up, down_p, down_u = p.T @ (sp - 1) / len(p), p.T @ sp / len(p), u.T @ su / len(u)
    if risk_parts(p, u, w, prior)[1] >= 0:
        return prior * up + down_u - prior * down_p
    return prior * down_p - down_u


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier on 0/1 rows, by Adam on the non-negative risk with logistic loss."""
    width = positive.shape[1] if len(positive) else unlabelled.shape[1]
    w, moments = np.zeros(width + 1), [np.zeros(width + 1), np.zeros(width + 1)]
    w[-1] = np.log(prior / (1 - prior))
    if not len(positive) or not len(unlabelled):
        return w[:-1], float(w[-1])
    p, u = (np.hstack([x, np.ones((len(x), 1))]).astype(np.float32) for x in (positive, unlabelled))
    for step in range(1, rounds + 1):
        g = gradient(p, u, w.astype(np.float32), prior) + decay * np.append(w[:-1], 0)
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.999 * moments[1] + 0.001 * g * g
        w = w - rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def held_out(id_column: Column) -> Column:
    """Rows whose crc32 of the id as text is divisible by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(
    documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", prior: float | None = None,
    positives: int = 4_000, unlabelled: int = 8_000, features: int = 512, least_z: float = 4.0, least_purity: float = 0.6,
) -> Model:
    """A model from labelled rows that aren't held out and unlabelled texts that aren't either.

    At most ``positives`` toxic and ``unlabelled`` other rows are taken, the first by a hash of their id, so
    that what the driver fits doesn't grow with the corpus. Rows equal in id and text are one example. The
    bound on unlabelled texts only enters the means of the risk: 8,000 of them know a share of 1 % to a
    tenth of it. ``features`` are the most telling words and beginnings of words; each must be
    ``least_z`` standard errors from chance, and ``least_purity`` of its texts toxic by the prior.

    ``prior`` is the share of toxic texts; by default that of the labelled training rows. A text labelled
    twice is toxic if any of its labels says so; labels or texts that are null are no examples. Texts of
    any length count whole. Without examples, in empty tables too, the model is the prior alone.
    """
    rows = renamed(documents, [id_column, text_column]).where(~held_out(F.col(f"in_{id_column}")) & F.col(f"in_{text_column}").isNotNull())
    rows = rows.select(F.col(f"in_{id_column}").alias("id"), F.col(f"in_{text_column}").alias("text"), F.xxhash64(f"in_{text_column}").alias("sum"))
    told = renamed(labels, [id_column, label_column]).where(~held_out(F.col(f"in_{id_column}")) & F.col(f"in_{label_column}").isNotNull())
    told = told.groupBy(F.col(f"in_{id_column}").alias("id")).agg(F.max(F.col(f"in_{label_column}").cast("int")).alias("y"))
    toxic, n = told.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    share = prior if prior is not None else (toxic + 1) / (n + 10)
    few = told.where("y = 1").select("id").orderBy(F.xxhash64(F.lit("pu"), F.col("id")), "id").limit(positives)
    known = rows.join(F.broadcast(few), "id").select("id", "sum").distinct().orderBy(F.xxhash64(F.lit("pu"), F.col("id")), "id", "sum").limit(positives)
    other = rows.select("id", "sum").distinct().orderBy(F.xxhash64(F.lit("u"), F.col("id")), "id", "sum").limit(unlabelled)
    chosen = known.withColumn("positive", F.lit(True)).union(other.withColumn("positive", F.lit(False)))
    chosen = chosen.select(F.col("id").alias("its"), F.col("sum").alias("its_sum"), "positive")
    matched = rows.join(F.broadcast(chosen), F.col("id").eqNullSafe(F.col("its")) & (F.col("sum") == F.col("its_sum")))
    sample = durable(matched.groupBy("id", "sum", "positive").agg(F.first("text").alias("text")).select("text", "positive"))
    sizes = {bool(k): int(v) for k, v in sample.groupBy("positive").count().collect()}
    p, u = sizes.get(True, 0), sizes.get(False, 0)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            seen: Counter = Counter()
            for text, positive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update((f, positive) for f in {f for word in words_of(text) for f in spelled(word)})
            yield {"feature": [k[0] for k in seen], "positive": [k[1] for k in seen], "n": list(seen.values())}

    counts = arrow_rows(sample, spell, "feature string, positive boolean, n long")
    counts = counts.groupBy("feature").agg(F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("positive"), 0).otherwise(F.col("n"))).alias("b"))
    odds = F.log(((F.col("a") + 0.5) / (p + 1)) / ((F.col("b") + 0.5) / (u + 1)))
    # what a few positives hold by chance is no evidence: the log odds must be several standard errors
    sure = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5)) > least_z
    best = counts.where("a >= 2").withColumn("gain", (F.col("a") / max(p, 1)) * odds).where((odds > math.log(least_purity / share)) & sure).orderBy(F.desc("gain"), "feature").limit(features)
    kept = {f: i for i, (f,) in enumerate(best.select("feature").collect())}
    bare = Model(kept, np.zeros(len(kept)), 0.0, hash(tuple(kept)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"positive": batch.column(1).to_pylist(), "at": [present(t, bare) for t in batch.column(0).to_pylist()]}

    x = {True: np.zeros((p, len(kept)), np.float32), False: np.zeros((u, len(kept)), np.float32)}
    filled = {True: 0, False: 0}
    for positive, at in arrow_rows(sample, look, "positive boolean, at array<int>").collect():
        x[positive][filled[positive], at] = 1
        filled[positive] += 1
    weights, bias = fit_nnpu(x[True], x[False], share)
    release(sample)
    return Model(kept, weights, bias, hash((tuple(kept), bias)))


def score(df: DataFrame, model: Model, id_columns: tuple[str, ...] = ("doc_id",), text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_columns``, held_out (by the first), score (0 to 1) and predicted (1 if score >= ``threshold``).

    Whole texts; a null or empty text has no feature and scores by the bias alone. Rows with null or
    repeated ids are scored each; an empty table gives an empty table; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                z = [m.bias + float(m.weights[present(t, m)].sum()) for t in part.column(f"in_{text_column}").to_pylist()]
                yield {f"in_{c}": part.column(f"in_{c}") for c in id_columns} | {"score": logistic(np.array(z)).tolist()}

    source = renamed(df, [*dict.fromkeys([*id_columns, text_column])])
    schema = T.StructType([T.StructField(f"in_{c}", kinds[c]) for c in id_columns] + [T.StructField("score", T.DoubleType())])
    out = arrow_rows(source, make, schema).select(*(F.col(f"in_{c}").alias(c) for c in id_columns), "score")
    return out.select(*id_columns, held_out(F.col(f"`{id_columns[0]}`")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
