"""Best-fit packing of token sequences by vectors of what a sequence has left.

A bin has three capacities: tokens, documents and attention cost (the sum of squared lengths). Only
lengths decide where a piece goes, so the placement is computed on the histogram of lengths, which
has at most ``capacity`` entries however many documents there are: best-fit decreasing over classes
of equal bins, a step placing as many equal pieces as fit. What a step placed is an interval of
ranks; a piece finds its bin by its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import arrow_rows, durable, ranked, renamed, shuffle_width


@dataclass(frozen=True)
class Packing:
    """``documents`` and ``attention`` bound the pieces of a sequence and the sum of their squared lengths.

    At their defaults both follow from the token capacity, so they steer the choice of a bin without
    costing a sequence. ``score`` is "norm" (the least weighted norm of what is left) or "dot" (the
    largest weighted product of a piece and what is left).
    """

    capacity: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    score: str = "norm"


@dataclass(frozen=True)
class Steps:
    """Step i: pieces of ``length`` with ranks from ``rank``, ``each`` to a bin, in bins from ``bin`` on, at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    bins: int


def place(counts: dict[int, int], how: Packing = Packing()) -> Steps:
    """Best-fit decreasing of ``counts[length]`` pieces of each length.

    Ties go to the older class of bins. Lengths below 1 or beyond the capacities are an error.
    """
    full = np.array([how.capacity, how.documents, how.attention], dtype=np.int64)
    weight = np.asarray(how.weights) / full
    left = np.zeros((64, 3), dtype=np.int64)
    first = np.zeros(64, dtype=np.int64)
    size = np.zeros(64, dtype=np.int64)
    classes = bins = 0
    steps: list[tuple[int, int, int, int, int]] = []

    def add(rest: np.ndarray, at: int, n: int) -> None:
        nonlocal left, first, size, classes
        if classes == len(size):
            keep = size[:classes] > 0
            kept = int(keep.sum())
            room = max(64, 2 * kept)
            left, first, size = (np.concatenate([x[:classes][keep], np.zeros((room - kept, *x.shape[1:]), np.int64)]) for x in (left, first, size))
            classes = kept
        left[classes], first[classes], size[classes] = rest, at, n
        classes += 1

    for length in sorted(counts, reverse=True):
        item = np.array([length, 1, length * length], dtype=np.int64)
        if length < 1 or (item > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        todo, rank = int(counts[length]), 0
        while todo:
            fits = np.flatnonzero((size[:classes] > 0) & (left[:classes] >= item).all(axis=1))
            if len(fits):
                rest = (left[fits] - item) * weight
                value = (rest**2).sum(axis=1) if how.score == "norm" else -((left[fits] * weight) * (item * weight)).sum(axis=1)
                best = int(fits[int(np.argmin(value))])
                room, at, n = left[best].copy(), int(first[best]), int(size[best])
            else:
                best, room, at, n = -1, full, bins, todo
            each = min(int((room // item).min()), todo)
            used = min(n, todo // each)
            steps.append((length, rank, each, at, how.capacity - int(room[0])))
            if best < 0:
                bins += used
            else:
                first[best] += used
                size[best] -= used
            if (rest := room - each * item)[0] > 0:
                add(rest, at, used)
            todo -= used * each
            rank += used * each
    columns = np.array(steps, dtype=np.int64).reshape(-1, 5).T
    return Steps(*columns, bins)


def pack(pieces: DataFrame, how: Packing = Packing(), length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with sequence_id and offset (long): at most ``how.capacity`` tokens to a sequence, without gaps.

    ``order`` names columns that tell pieces apart; pieces equal in them are interchangeable, and
    repeated rows are packed as often as they occur. Only a count for each length reaches the driver.
    Columns named sequence_id or offset are replaced. An empty table gives an empty table.
    """
    pieces = durable(pieces.drop("sequence_id", "offset"))
    steps = place({int(n): int(k) for n, k in pieces.groupBy(length).count().collect()}, how)
    shared = pieces.sparkSession.sparkContext.broadcast(steps)
    salts = max(32, shuffle_width(pieces.sparkSession))
    numbered = ranked(pieces, [length], list(order), "_rank", salts)

    @F.pandas_udf("sequence_id long, offset long")
    def placed(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s = shared.value
        span = max(1, int(s.rank.max()) + 1) if len(s.rank) else 1
        # steps run by falling length and rising rank
        keys = (how.capacity - s.length) * span + s.rank
        mine = (how.capacity - size.to_numpy(np.int64)) * span + np.minimum(rank.to_numpy(np.int64), span - 1)
        i = np.searchsorted(keys, mine, side="right") - 1
        nth, inside = np.divmod(rank.to_numpy(np.int64) - s.rank[i], s.each[i])
        return pd.DataFrame({"sequence_id": s.bin[i] + nth, "offset": s.offset[i] + inside * size.to_numpy(np.int64)})

    out = numbered.withColumn("_at", placed(F.col(length), F.col("_rank")))
    return out.select(*pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


_encoders: dict[tuple[str, str, str], tuple[tiktoken.Encoding, Tokenizer, list[str]]] = {}


def encode(text: str, ranks_path: str, json_path: str, pattern: str) -> np.ndarray:
    """Ids of the byte-level vocabulary, special strings inside the text as the JSON file's library takes them.

    Both files hold one vocabulary. The rank file's library is several times faster; texts with a special
    string, and what it can't take (its regex gives up on very long runs of white space), the other encodes.
    """
    key = (ranks_path, json_path, pattern)
    if key not in _encoders:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        plain = Tokenizer.from_file(json_path)
        added = [t.content for t in plain.get_added_tokens_decoder().values()]
        _encoders[key] = (tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), plain, added)
    fast, plain, added = _encoders[key]
    if not any(special in text for special in added):
        try:
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        except BaseException as e:  # the library's panics aren't Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit)):
                raise
    return np.asarray(plain.encode(text, add_special_tokens=False).ids, dtype="<u4")


def tokenized(df: DataFrame, ranks_path: str, json_path: str, pattern: str, capacity: int = 2048, end: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each piece: the id, piece (int), start, length (long), ids (binary, little-endian unsigned 32 bit).

    A document is its text's ids and ``end``; a null text counts as empty, so each document has a
    token. One longer than ``capacity`` is cut into pieces of ``capacity`` tokens, the first of which
    is shorter when they don't divide. Rows with null or repeated ids are documents of their own.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                out: dict = {"in_id": [], "piece": [], "start": [], "length": [], "ids": []}
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.append(encode(text, ranks_path, json_path, pattern), np.uint32(end)).astype("<u4") if text else np.array([end], "<u4")
                    head = len(ids) % capacity or capacity
                    for i, (lo_id, hi_id) in enumerate(zip([0, *range(head, len(ids), capacity)], range(head, len(ids) + 1, capacity))):
                        for name, value in (("in_id", key), ("piece", i), ("start", lo_id), ("length", hi_id - lo_id), ("ids", ids[lo_id:hi_id].tobytes())):
                            out[name].append(value)
                yield out

    source = renamed(df, [id_column, text_column])
    schema = T.StructType([T.StructField("in_id", df.schema[id_column].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    return arrow_rows(source, make, schema).withColumnRenamed("in_id", id_column)
