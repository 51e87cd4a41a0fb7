"""Near-duplicate vectors by sorted projection passes.

A pass draws random hyperplanes, writes each vector's signs one after another as a number and sorts
by it, so that vectors with a long common beginning stand together. Each vector is compared with the
next ``window`` of the order; what reaches the threshold is a link. The keys themselves tell how
crowded a vector's place was and so the chance that a pair of it has escaped so far: vectors that
aren't safe go through further rounds, with wider windows and without the others, until none is left
or those left are cheaper compared pair by pair. A window hands on only as many links as join its
vectors, and links of all passes are united to components. Vectors of one component are then counted
against each other exactly, because a window can't hold a family that is larger than it.

Only keys are sorted; a vector is shipped once to each window block that it stands in, as the numbers
that came in. Vectors of another length never meet: the length is part of the sort key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import components, durable, release, renamed, united

WINDOW = 128
BITS = 48
BLOCK = 1024
MISSED = 0.005  # of pairs at the threshold, so many may escape all passes
WIDE, ALL, STRIP = 1024, 4096, 512  # window of the later rounds; rows of a block, and of a product, where all pairs are compared
LENGTHS = 1 << 16  # a pass of one vector length is ``length * LENGTHS + pass``


def passes_for(n: int, threshold: float, window: int = WINDOW) -> int:
    """Enough passes for a pair at the threshold.

    Two vectors at angle a agree in a sign with chance 1 - a/pi. In a sorted order of n they meet in a
    window once about log2(n / (2 window)) signs agree.
    """
    agree = 1 - math.acos(threshold) / math.pi
    met = agree ** max(1.0, math.log2(max(2.0, n / (2 * window))))
    return max(4, math.ceil(math.log(MISSED) / math.log1p(-min(met, 0.999))))


def unit(vectors: list | pd.Series) -> np.ndarray:
    """Unit vectors in rows; shorter ones end with zeros. Scaling by powers of two keeps squares in range and rounds nothing."""
    rows = [np.asarray(x, dtype=np.float64) for x in vectors]
    v = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, row in enumerate(rows):
        v[i, : len(row)] = row
    if v.size:
        v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def keys(vectors: np.ndarray, n_passes: int, seed: int, bits: int = BITS, first: int = 0) -> np.ndarray:
    """(vectors, passes): the signs of each pass from ``first`` on as a number, the first sign the highest bit."""
    weight = 2.0 ** np.arange(bits - 1, -1, -1)
    out = np.empty((len(vectors), n_passes), dtype=np.int64)
    for p in range(n_passes):
        planes = np.random.default_rng([seed, first + p]).standard_normal((vectors.shape[1], bits))
        out[:, p] = ((vectors @ planes >= 0) @ weight).astype(np.int64)
    return out


def joined(v: np.ndarray, of: np.ndarray, own: int, threshold: float, window: int) -> np.ndarray:
    """For unit vectors in order, of passes ``of``, the least row that links of rows below ``own`` with at least ``window`` rows after them reach."""
    label, strip = np.arange(len(v)), min(STRIP, max(64, window))
    for lo in range(0, own, strip):
        hi = min(own, lo + strip)
        i, j = np.nonzero(v[lo:hi] @ v[lo : hi + window].T >= threshold)
        same = (i < j) & (of[i + lo] == of[j + lo])
        label = united(label, i[same] + lo, j[same] + lo)
    return label


def depths(key: np.ndarray, of: np.ndarray, own: int, window: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < ``own`` that have a row i + ``window`` in their pass, and how many first signs the two share."""
    at = np.arange(min(own, max(0, len(key) - window)))
    at = at[of[at] == of[at + window]]
    return at, bits - np.frexp((key[at] ^ key[at + window]).astype(np.float64))[1]


def dedup(df: DataFrame, threshold: float = 0.9, window: int = WINDOW, seed: int = 7, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The id, n_links, component_id and kept (id = component_id), a row for each row.

    Cosines are of doubles. A vector that is null, empty, zero or holds null or non-finite components links
    with nothing; vectors of different lengths don't link. Equal vectors are one node with a multiplicity
    and link with each other. Repeated ids are rows of their own; a row without links is its own component,
    with a null id a null one. An empty table gives an empty table. Other columns, labels among them, are ignored.
    """
    rows = renamed(df, [id_column, vector_column]).withColumnRenamed(f"in_{vector_column}", "v").withColumnRenamed(f"in_{id_column}", "id")
    kind = rows.schema["v"].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)):
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.select("id", F.when(F.coalesce(sound, F.lit(False)), F.transform("v", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))).alias("v"))
    # 128 bits name a vector
    named = rows.withColumn("h1", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("h2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(seed), "v")))
    nodes = named.where("v is not null").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()))
    n = nodes.count()

    links = window_links(nodes.select("node", "v"), n, threshold, window, seed)
    comps = durable(components(links, "x", "y"))
    release(links)
    counts = links_within(nodes.join(comps.withColumnRenamed("component", "c"), "node"), threshold)
    near = durable(comps.join(counts, "node").join(nodes.select("node", "least_id"), "node"))
    least = near.groupBy("component").agg(F.min("least_id").alias("least"))
    found = near.join(least, "component").select("node", "near", "least")
    placed = durable(nodes.select("node", "h1", "h2", "least_id", "copies").join(found, "node", "left").select("h1", "h2", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("least", "least_id").alias("component_id")))
    out = named.select("id", "h1", "h2").join(placed, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def window_links(nodes: DataFrame, n: int, threshold: float, window: int, seed: int) -> DataFrame:
    """Durable (x, y) whose components are those of the links of ``nodes`` (node, v).

    A pair at the threshold shares the first L signs of a pass with chance agree ** L, and it meets in
    the window if no more than ``window`` rows to either side share so many with one of its ends. L is
    measured, so crowding counts as it is. A vector is safe when the chances of its passes leave less
    than ``MISSED``; a pair is met as surely as the safer of its ends, so safe ones may leave.
    """
    agree, need = 1 - math.acos(threshold) / math.pi, -math.log(MISSED)
    left = nodes.select("node", F.lit(0.0).alias("sure"))
    found, first, n_passes = [], 0, passes_for(n, threshold, window)
    while n:
        met = _passes(nodes if not first else nodes.join(left, "node", "left_semi"), first, n_passes, threshold, window, seed)
        found.append(met.where("y is not null").select("x", "y"))
        each = met.where("y is null").groupBy(F.col("x").alias("node"), "pass").agg(F.max("depth").alias("depth"))
        chance = F.when(F.col("depth") < BITS, -F.log1p(-F.pow(F.lit(agree), F.col("depth") + 1))).otherwise(0.0)
        more = each.groupBy("node").agg(F.sum(chance).alias("more"), F.count(F.lit(1)).alias("passes"))
        # a pass in which the window held all rows leaves none
        left = left.join(more.where(F.col("passes") == n_passes), "node").select("node", (F.col("sure") + F.col("more")).alias("sure"), (F.col("more") / n_passes).alias("rate"))
        left = durable(left.where(F.col("sure") < need))
        soonest = F.percentile_approx(F.when(F.col("rate") > 0, (need - F.col("sure")) / F.col("rate")).otherwise(float("inf")), 0.1)
        n, passes = left.agg(F.count(F.lit(1)), soonest).first()
        # a row meets about n / 2 others in all pairs, and 2 * WIDE in a pass
        if n and (n <= 4 * WIDE or (first and n <= 4 * WIDE * passes)):
            found.append(_all_pairs(nodes.join(left, "node", "left_semi"), n, threshold))
            break
        first, window = first + n_passes, max(window, WIDE)
        n_passes = int(min(16, max(4, passes or 0)))
    return durable(reduce(DataFrame.union, found).distinct() if found else nodes.select(F.col("node").alias("x"), F.col("node").alias("y")))


def _passes(nodes: DataFrame, first: int, n_passes: int, threshold: float, window: int, seed: int) -> DataFrame:
    """Durable rows of ``n_passes`` passes: (x, y) that unite what links in a window block;
    y null: a row ``window`` places from x in the pass shares ``depth`` first signs with it."""
    block = max(BLOCK, window)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for length, rows in pdf.groupby(pdf["v"].map(len)):
                at = keys(unit(rows["v"]), n_passes, seed, first=first)
                for p in range(n_passes):
                    yield pd.DataFrame({"pass": length * LENGTHS + p, "key": at[:, p], "node": rows["node"]})

    signs = durable(nodes.mapInPandas(project, "pass long, key long, node long"))
    # sorted over all partitions; the rank of a row is its place in its partition after those before
    spread = durable(signs.repartitionByRange("pass", "key", "node").sortWithinPartitions("pass", "key", "node"))
    release(signs)
    placed = spread.withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).count()  # a row for each partition
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("shift"))
    ranks = placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", place + F.col("shift"))
    chunk = F.floor(F.col("rank") / block)
    homes = F.when((F.col("rank") % block < window) & (chunk > 0), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    dealt = ranks.select("rank", "node", "pass", "key", homes.alias("homes")).join(nodes, "node").select("rank", "node", "pass", "key", "v", F.explode("homes").alias("chunk"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable")
        own = int((pdf["rank"] // block == pdf["chunk"]).sum())
        name, of = pdf["node"].to_numpy(), pdf["pass"].to_numpy()
        label = joined(unit(pdf["v"]), of, own, threshold, window)
        i = np.flatnonzero(label != np.arange(len(label)))
        a, b = name[i], name[label[i]]
        at, depth = depths(pdf["key"].to_numpy(), of, own, window)
        ends = np.concatenate([at, at + window])
        links = pd.DataFrame({"x": np.minimum(a, b), "y": pd.array(np.maximum(a, b), dtype="Int64")}).drop_duplicates().assign(**{"pass": 0, "depth": 0})
        crowd = pd.DataFrame({"x": name[ends], "y": pd.array([pd.NA] * len(ends), dtype="Int64"), "pass": of[ends], "depth": np.tile(depth, 2)})
        return pd.concat([links, crowd]).astype({"x": "int64", "pass": "int64", "depth": "int32"})

    met = durable(dealt.groupBy("chunk").applyInPandas(compare, "x long, y long, pass long, depth int"))
    release(spread)
    return met


def _all_pairs(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(x, y) that unite what links among ``nodes``; each pair of blocks is compared in a task of its own."""
    blocks = -(-n // ALL)
    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    dealt = nodes.select("node", "v", block.alias("block")).withColumn("pair", F.explode(pairs)).select("pair.*", "block", "node", "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", kind="stable")
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        v, name, length = unit(pdf["v"]), pdf["node"].to_numpy(), pdf["v"].map(len).to_numpy()
        own = int((pdf["block"] == i).sum())
        skip, label = 0 if i == j else own, np.arange(len(v))
        for lo in range(0, own, STRIP):
            hi = min(own, lo + STRIP)
            a, b = np.nonzero((v[lo:hi] @ v[skip:].T >= threshold) & (length[lo:hi, None] == length[None, skip:]))
            label = united(label, a + lo, b + skip)
        at = np.flatnonzero(label != np.arange(len(v)))
        return pd.DataFrame({"x": name[at], "y": name[label[at]]})

    return dealt.groupBy("i", "j").applyInPandas(compare, "x long, y long")


def _means(members: DataFrame) -> DataFrame:
    """(c, mean, size): the sum of a component's unit vectors, first over each batch of rows, and their number."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, rows in pdf.groupby(pdf["v"].map(len)):
                rows = rows.sort_values("c", kind="stable")
                c = rows["c"].to_numpy()
                starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                sums = np.add.reduceat(unit(rows["v"]), starts, axis=0)
                yield pd.DataFrame({"c": c[starts], "s": list(sums), "n": np.diff(np.append(starts, len(c)))})

    parts = members.select("c", "v").mapInPandas(partial, "c long, s array<double>, n long")
    added = parts.select("c", F.col("n"), F.posexplode("s").alias("at", "x")).groupBy("c", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return added.groupBy("c").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("mean"), F.max("n").alias("size"))


def links_within(members: DataFrame, threshold: float) -> DataFrame:
    """(node, near): copies of other nodes of its component ``c`` that it links with, by exact cosines.

    A component is cut into blocks, and each pair of blocks is counted in a task of its own. Members so
    close to the component's mean that any two of them must link are only counted, not compared.
    """
    members = durable(members.select("node", "c", "v", "copies"))
    mean = durable(_means(members))
    most = F.array_max(F.transform("v", lambda x: F.abs(x).cast("double")))
    plain = F.transform("v", lambda x: x.cast("double") / most)
    dot = F.aggregate(F.zip_with(plain, "mean", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    long = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    # half the angle, less what rounding may take
    core = F.try_divide(dot, long(plain) * long(F.col("mean"))) >= math.cos(math.acos(threshold) / 2) + 1e-9
    placed = members.join(mean, "c").withColumn("core", F.coalesce(core, F.lit(False)))
    placed = placed.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).drop("mean", "size")
    placed = durable(placed)
    release(members)
    cores = placed.where("core").groupBy("c").agg(F.sum("copies").alias("all_core"))
    # block b goes to the pairs (b, j) and (j, b); only rows outside the core are counted one by one
    loose = placed.where("not core").select("c", F.col("block").alias("i"), "blocks").distinct()
    tasks = loose.select("c", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
    columns = ["c", "i", "j", "node", "v", "copies", "core"]
    left = placed.where("not core").drop("blocks").withColumnRenamed("block", "i").join(tasks, ["c", "i"]).select(*columns, F.lit(0).alias("side"))
    right = placed.drop("blocks").withColumnRenamed("block", "j").join(tasks, ["c", "j"]).select(*columns, F.lit(1).alias("side"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"node": pd.Series(dtype="int64"), "near": pd.Series(dtype="int64")})
        hit = (unit(a["v"]) @ unit(b["v"]).T >= threshold) & (a["node"].to_numpy()[:, None] != b["node"].to_numpy()[None, :])
        loose_to_all = hit @ b["copies"].to_numpy()
        in_core = b["core"].to_numpy(bool)
        core_to_loose = (hit[:, in_core] * a["copies"].to_numpy()[:, None]).sum(axis=0)
        return pd.DataFrame({"node": np.concatenate([a["node"], b["node"][in_core]]), "near": np.concatenate([loose_to_all, core_to_loose])})

    one_by_one = left.union(right).groupBy("c", "i", "j").applyInPandas(count, "node long, near long")
    together = placed.where("core").join(cores, "c").select("node", (F.col("all_core") - F.col("copies")).alias("near"))
    return one_by_one.union(together).groupBy("node").agg(F.sum("near").alias("near"))
