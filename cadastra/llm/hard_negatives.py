"""Hard negatives by one-dimensional distance keys.

An inner product becomes a distance once every row gets one more component, which fills its length up to
the largest, M, and an anchor a zero: then |q - x|^2 = |q|^2 + M^2 - 2 q.x, and the best score is the nearest
row. Rows
are stored sorted by (pivot, distance to the pivot) and cut into blocks, each an interval of keys. What
lies between two distances of an anchor has a key between two bounds by the triangle inequality, so a
search reads intervals of keys: it starts at the anchor's own place and widens until no unread row can
be nearer than what it has. The negatives of a positive lie in an annulus whose inner edge is the
positive's score and whose outer edge the lowest score allowed; it is read from the inside out.

Anchors are sorted and cut like the rows, so that neighbours ask together; a block meets a bounded number
of anchors in one task. Of rows equal in vector and label only as many as a result can hold are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import arrow_rows, durable, release, renamed

SCALE = 256
PIVOTS, SAMPLE = 32, 4_096  # pivots of a vector length, and rows they are drawn from
BLOCK, CHUNK, GROUP = 1_024, 256, 8  # rows of a block, anchors of a chunk, chunks that meet a block in one task
CELLS = 8  # of keys, a length M
SLACK = 1e-9  # of M, by which intervals are wider than bounds, for rounding
FIRST = 0.75  # of M, the reach after an anchor's own place
SHELLS = (0.92,)  # of a positive's score, before the lowest share allowed

_spread = "dim int, pivot int, key double"


def filled(x: np.ndarray, most: float) -> np.ndarray:
    """``x`` with the component that makes every row as long as ``most``, the square of the largest length."""
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))[:, None]])


def pivots_of(x: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """At most ``count`` centres: far points first, then a few rounds of means; the same for the same rows."""
    at = [0]
    gap = ((x - x[0]) ** 2).sum(axis=1)
    while len(at) < min(count, len(x)) and gap.max() > 0:
        at.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[at[-1]]) ** 2).sum(axis=1))
    centres = x[at].copy()
    for _ in range(rounds):
        near = distances(x, centres).argmin(axis=1)
        for i in np.unique(near):
            centres[i] = x[near == i].mean(axis=0)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None] - 2 * x @ centres.T
    return np.sqrt(np.maximum(square, 0))


def best_of(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best allowed scores of each row; of equal scores the earlier columns."""
    width = score.shape[1]
    mixed = np.where(allowed, score.astype(np.int64) * width + np.arange(width - 1, -1, -1), -np.iinfo(np.int64).max)
    top = np.argpartition(-mixed, k - 1, axis=1)[:, :k] if k < width else np.broadcast_to(np.arange(width), score.shape)
    row = np.repeat(np.arange(len(score)), top.shape[1])
    column = top.ravel()
    good = allowed[row, column]
    return row[good], column[good]


def vectors(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), dim)


def keyed(rows: DataFrame, pivots: dict[int, np.ndarray], most: float) -> DataFrame:
    """``rows`` (any columns, and x: array<double>) with dim, pivot, key and x as bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    names = [c for c in rows.columns if c != "x"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x = batch.column(batch.schema.get_field_index("x"))
            sizes = np.array([len(v) for v in x])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                part = batch.take(pa.array(at))
                v = part.column(part.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                gap = distances(filled(v, most), shared.value.get(int(dim), origin(int(dim), most)))
                near = gap.argmin(axis=1)
                yield {c: part.column(part.schema.get_field_index(c)) for c in names} | {"x": [r.tobytes() for r in v], "dim": np.full(len(at), dim), "pivot": near, "key": gap[np.arange(len(at)), near]}

    schema = T.StructType([rows.schema[c] for c in names] + T._parse_datatype_string(f"x binary, {_spread}").fields)
    return arrow_rows(rows, make, schema)


def origin(dim: int, most: float) -> np.ndarray:
    """The pivot of vector lengths that the sample didn't hold."""
    return filled(np.zeros((1, dim)), most)


def packed(rows: DataFrame, size: int) -> DataFrame:
    """(at, dim, pivot, lo, hi, ids, labels, xs): runs of at most ``size`` rows of one pivot in the order of keys."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        base, number, kept = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            part = batch.to_pandas()
            kept = part if kept is None else pd.concat([kept, part])
            while kept is not None and len(kept):
                same = ((kept["dim"] == kept["dim"].iloc[0]) & (kept["pivot"] == kept["pivot"].iloc[0])).to_numpy()
                run = int(same.argmin()) if not same.all() else len(kept)
                if run == len(kept) < size:
                    break  # more of this pivot may come
                take = min(run, size)
                yield block(base + number, kept.iloc[:take])
                number, kept = number + 1, kept.iloc[take:]
        if kept is not None and len(kept):
            yield block(base + number, kept)

    def block(at: int, part: pd.DataFrame) -> dict:
        part = part.sort_values("id")
        text = {"ids": part["id"].to_numpy(np.int64).tobytes(), "labels": part["label"].to_numpy(np.int64).tobytes(), "xs": b"".join(part["x"])}
        return {k: [v] for k, v in ({"at": at, "dim": int(part["dim"].iloc[0]), "pivot": int(part["pivot"].iloc[0]), "lo": float(part["key"].min()), "hi": float(part["key"].max())} | text).items()}

    order = ["dim", "pivot", "key", "id"]
    return arrow_rows(rows.repartitionByRange(*order).sortWithinPartitions(*order), make, "at long, dim int, pivot int, lo double, hi double, ids binary, labels binary, xs binary")


def intervals(asks: DataFrame, pivots: dict[int, np.ndarray], most: float) -> DataFrame:
    """(chunk, dim, pivot, lo, hi): the keys of what is between ``near`` and ``far`` of any anchor of a chunk."""
    shared = asks.sparkSession.sparkContext.broadcast(pivots)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            part = batch.to_pandas()
            for dim, rows in part.groupby("dim"):
                centres = shared.value.get(int(dim), origin(int(dim), most))
                x = vectors(rows["x"], int(dim))
                gap = distances(np.hstack([x, np.zeros((len(x), 1))]), centres)
                far, near = rows["far"].to_numpy()[:, None], rows["near"].to_numpy()[:, None]
                slack = SLACK * np.sqrt(most) + 1e-12
                lo, hi = np.maximum(gap - far, near - gap) - slack, gap + far + slack
                # a row is in the part of its nearest pivot: half the detour there bounds its distance
                reached = (gap - gap.min(axis=1, keepdims=True)) / 2 <= far + slack
                row, pivot = np.nonzero(reached & (lo <= hi))
                yield {"chunk": rows["chunk"].to_numpy()[row], "dim": np.full(len(row), dim), "pivot": pivot, "lo": np.maximum(lo, 0)[row, pivot], "hi": hi[row, pivot]}

    out = arrow_rows(asks.select("chunk", "dim", "x", "near", "far"), make, "chunk long, dim int, pivot int, lo double, hi double")
    return out.groupBy("chunk", "dim", "pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


class Index:
    """The blocks of all rows, and scans of them."""

    def __init__(self, rows: DataFrame, pivots: dict[int, np.ndarray], most: float):
        self.pivots, self.most = pivots, most
        self.width = max(np.sqrt(most), 1e-300) / CELLS
        self.blocks = durable(packed(keyed(rows, pivots, most), BLOCK))

    def _cells(self, df: DataFrame) -> DataFrame:
        top = 3.0 * CELLS  # keys are at most 2 M
        at = lambda c: F.floor(F.least(F.col(c) / self.width, F.lit(top)))
        return df.withColumn("cell", F.explode(F.sequence(at("lo"), at("hi"))))

    def pairs(self, asks: DataFrame, seen: DataFrame | None) -> DataFrame:
        """(chunk, block): the blocks that the asks' intervals meet and no earlier round has read. Durable."""
        a = self._cells(intervals(asks, self.pivots, self.most)).withColumnsRenamed({"lo": "alo", "hi": "ahi"})
        b = self._cells(self.blocks.select(F.col("at").alias("block"), "dim", "pivot", "lo", "hi"))
        met = a.join(b, ["dim", "pivot", "cell"]).where("lo <= ahi AND alo <= hi").select("chunk", "block").distinct()
        return durable(met if seen is None else met.join(seen, ["chunk", "block"], "left_anti"))

    def scan(self, asks: DataFrame, pairs: DataFrame, k: int, low: int | None) -> DataFrame:
        """(a, p, id, score): of each block read, the ``k`` best rows for each anchor; ``low``: percent of a positive's score.

        Without ``low``, rows of the anchor's label and another id (p is 0); with it, rows of other labels that
        score from ``low`` percent to all of ``scores[p]``.
        """
        groups = pairs.groupBy("block").count().select("block", F.ceil(F.col("count") / GROUP).cast("int").alias("groups"))
        left = pairs.join(groups, "block").select("chunk", "block", F.pmod(F.xxhash64("chunk"), F.col("groups")).cast("int").alias("g"))
        left = left.join(asks, "chunk").select("block", "g", "a", "id", "label", "x", "scores")
        right = self.blocks.join(groups, F.col("at") == F.col("block")).select(F.col("at").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), "dim", "ids", "labels", "xs")

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found: list[pd.DataFrame] = []
            if len(left) and len(right):
                dim = int(right["dim"].iloc[0])
                ids, labels = (np.frombuffer(right[c].iloc[0], np.int64) for c in ("ids", "labels"))
                rows = np.frombuffer(right["xs"].iloc[0], np.float64).reshape(len(ids), dim)
                for lo in range(0, len(left), CHUNK):
                    part = left.iloc[lo : lo + CHUNK]
                    score = np.clip(vectors(part["x"], dim) @ rows.T, -(2.0**53), 2.0**53)
                    same = part["label"].to_numpy()[:, None] == labels[None]
                    if low is None:
                        wanted = [(0, np.arange(len(part)), same & (part["id"].to_numpy()[:, None] != ids[None]))]
                    else:
                        each = [(int(p), i, s) for i, listed in enumerate(part["scores"]) for p, s in enumerate(listed)]
                        at = np.array([i for _, i, _ in each], dtype=np.int64)
                        limit = np.array([s for _, _, s in each], dtype=np.float64)[:, None]
                        wanted = [([p for p, _, _ in each], at, ~same[at] & (low * limit <= 100 * score[at]) & (score[at] <= limit))]
                    for p, at, allowed in wanted:
                        row, column = best_of(score[at], allowed, k)
                        found.append(pd.DataFrame({"a": part["a"].to_numpy()[at[row]], "p": p if p == 0 else np.array(p, np.int64)[row], "id": ids[column], "score": score[at[row], column].astype(np.int64)}))
            return pd.concat(found) if found else pd.DataFrame({"a": [], "p": [], "id": [], "score": []}, dtype="int64")

        return left.groupBy("block", "g").cogroup(right.groupBy("block", "g")).applyInPandas(meet, "a long, p int, id long, score long")


def firsts(found: DataFrame, k: int) -> DataFrame:
    """With rank: the ``k`` best rows of each (a, p), ties by the smaller id."""
    order = Window.partitionBy("a", "p").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sound(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def mine(df: DataFrame, anchors: Column | str, positives: int = 5, negatives: int = 5, low: int = 80, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchors``, a condition on ``id``.

    A component x counts as floor(256 x), a score is an inner product of such. An anchor's positives are its
    ``positives`` best other rows of its label; for each, the ``negatives`` best rows of other labels that score
    from ``low`` percent to all of the positive's score are returned. Equal scores come by the smaller id.
    A positive without such rows returns nothing, as does one with a negative score.

    Rows without id or label, without vector, or with a null or non-finite component take no part. Rows
    equal in id, label and vector are one; other rows of one id are rows of their own, but never positives
    of each other. Vectors of different lengths never meet; empty vectors score 0. Scores are exact up to 2^53
    and clipped there. Ids are integers; labels that aren't are compared by a 64-bit hash. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = renamed(df, [id_column, vector_column, label_column]).select(F.col(f"in_{id_column}").cast("long").alias("id"), F.col(f"in_{label_column}").alias("label"), F.col(f"in_{vector_column}").cast("array<double>").alias("x"))
    whole = isinstance(rows.schema["label"].dataType, T.IntegralType)
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & sound(F.col("x")))
    rows = rows.select("id", (F.col("label").cast("long") if whole else F.xxhash64("label")).alias("label"), F.transform("x", lambda v: F.floor(v * SCALE).cast("double")).alias("x"))
    rows = rows.withColumns({"h": F.xxhash64(F.lit(1), "x"), "g": F.xxhash64(F.lit(2), "x")})
    rows = durable(rows.dropDuplicates(["id", "label", "h", "g"]))
    # an anchor may be one of its own copies; a task hands on only so many rows of a copy
    copy = Window.partitionBy("label", "h", "g").orderBy("id")
    kept = durable(rows.withColumn("copy", F.row_number().over(copy)).where(F.col("copy") <= max(positives + 1, negatives)).select("id", "label", "x"))
    most, n = kept.agg(F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)), F.count(F.lit(1))).first()
    most = most or 0.0
    sampled: dict[int, list] = {}
    for (x,) in kept.orderBy(F.xxhash64("id"), "id", "label").limit(SAMPLE).select("x").collect():
        sampled.setdefault(len(x), []).append(x)
    count = min(PIVOTS, -(-n // BLOCK))
    pivots = {d: pivots_of(filled(np.array(v, np.float64).reshape(len(v), d), most), count) for d, v in sampled.items()}
    index = Index(kept, pivots, most)
    chunks = packed(keyed(rows.where(anchors).select("id", "label", "x"), pivots, most), CHUNK)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, labels, x = (np.frombuffer(r[c], kind) for c, kind in (("ids", np.int64), ("labels", np.int64), ("xs", np.float64)))
                x = x.reshape(len(ids), r["dim"])
                yield {"chunk": [r["at"]] * len(ids), "dim": [r["dim"]] * len(ids), "id": ids, "label": labels, "x": [v.tobytes() for v in x], "square": (x * x).sum(axis=1)}

    asking = durable(arrow_rows(chunks, apart, "chunk long, dim int, id long, label long, x binary, square double").withColumn("a", F.monotonically_increasing_id()))
    length = float(np.sqrt(most))
    # positives: every round reads up to ``far``, which grows until the last of the best is certain
    none = F.array().cast("array<long>")
    todo = asking.withColumns({"near": F.lit(0.0), "far": F.lit(0.0), "scores": none})
    best = seen = None
    while not todo.isEmpty():
        pairs = index.pairs(todo, seen)
        found = index.scan(todo, pairs, positives, None)
        before, best = best, durable(firsts(found if best is None else best.drop("rank").union(found), positives))
        seen = pairs if seen is None else seen.union(pairs)
        last = best.where(F.col("rank") == positives).select("a", F.col("score").alias("last"))
        state = todo.join(last, "a", "left")
        span = F.col("square") + F.lit(most)  # a row unread is farther than far, so it scores less than this
        state = state.where(F.col("last").isNull() | (F.col("last") < (span - F.col("far") * F.col("far")) / 2)).where(F.col("far") < 2 * length)
        reach = F.sqrt(F.greatest(span - 2 * F.col("last"), F.lit(0.0))) * (1 + SLACK) + SLACK * length
        wider = F.greatest(2 * F.col("far"), F.lit(FIRST * length))
        todo = durable(state.withColumn("far", F.when(F.col("last").isNull(), wider).otherwise(F.least(wider, reach))).drop("last"))
        if before is not None:
            release(before)
    if best is None:
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    held = best.where("score >= 0")
    listed = held.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("scores"))
    asked = durable(asking.join(listed, "a"))
    # negatives: annuli from the positives' scores outwards, a shell at a time
    shells = [s for s in SHELLS if 100 * s > low] + [low / 100]
    span = F.col("square") + F.lit(most)
    away = lambda s: F.sqrt(F.greatest(span - 2 * s, F.lit(0.0)))
    todo, out, seen = asked, None, None
    for i, share in enumerate(shells):
        # the best positive is the inner edge, the worst the outer one
        todo = todo.withColumns({"near": away(F.array_max("scores")) * (1 - SLACK), "far": away(F.array_min("scores") * share) * (1 + SLACK)})
        pairs = index.pairs(todo, seen)
        found = index.scan(todo, pairs, negatives, low)
        out = durable(firsts(found if out is None else out.drop("rank").union(found), negatives))
        seen = pairs if seen is None else seen.union(pairs)
        if i + 1 == len(shells):
            break
        full = out.where(F.col("rank") == negatives).select("a", "p", F.col("score").alias("last"))
        each = todo.select("a", F.posexplode("scores").alias("p", "ps"))
        open_ = each.join(full, ["a", "p"], "left").where(F.col("last").isNull() | (F.col("last") <= F.col("ps") * share + 1)).select("a").distinct()
        todo = durable(todo.join(open_, "a", "left_semi"))
        if todo.isEmpty():
            break
    named = best.select("a", (F.col("rank") - 1).alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    result = out.select("a", "p", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["a", "p"]).join(asking.select("a", F.col("id").alias("anchor_id")), "a")
    return result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
