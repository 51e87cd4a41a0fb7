"""Exact Jaccard self-join of shingle sets as a blocked sparse matrix product.

Rows of the matrix are distinct sets (copies are one row), columns are hashed 5-word shingles. Each
set enters the product with so many of its smallest hashes that two sets that link share a known
number of them (the l-prefix bound). Columns are dealt to blocks; a block multiplies its columns,
which gives partial overlap counts of pairs, and counts add up over blocks; pairs below the bound
that follows from their sizes are dropped. What is left is verified on whole sets.

A column of more than ``width`` rows isn't multiplied there: a row loses at most its number of such
columns, so its bound is lowered by that. Rows that could link through them alone are crowded. Two
crowded rows meet in a product of row blocks instead: crowded rows are cut into blocks by their
least frequent-shingle hash, and a row goes to a pair of blocks only if one of its rarer entered
columns has rows in both. Such a product keeps its pairs to itself: it gives each row its number of
links, and of the links themselves only as many as join the rows to their components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import arrow_rows, components, durable, release, renamed, shuffle_width, united

SHINGLE = 5
WIDTH = 32  # rows of a column up to which all its pairs are counted; others go the second way
BLOCK, BLOCK_BYTES = 1024, 8 << 20  # rows of a row block, and bytes of its sets
DENSE = 50  # a column is multiplied as a dense one if it meets more than one in so many pairs of a product
CACHE_ENTRIES = 400_000

class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of the A-Z lower-cased text.

    Fewer words are one shingle, no words none. Only the bytes 09-0D and 20 part words.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    ids = np.array(list(map(_hashes.__getitem__, words)), dtype=np.uint64)
    n = len(ids) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(31) + ids[i : i + n])
    return np.unique(out)


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """A name of 128 bits of a set, as two signed halves."""
    halves = (mixed(hashes).sum(dtype=np.uint64) + np.uint64(len(hashes)), mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))
    return tuple(int(np.uint64(x).astype(np.int64)) for x in halves)


def least_overlap(a, b):
    """Of sets of sizes a and b that link: 100 i >= 80 (a + b - i)."""
    return (4 * (a + b) + 8) // 9


def shared_least(n):
    """So many of the entered hashes are shared with any linking set of n or more."""
    return 1 + n // 10


def entered(n: int) -> int:
    return min(n, n - (4 * n + 4) // 5 + shared_least(n))


def counted_pairs(column: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one block's incidences: pairs x < y with their overlap, and rows with their number of columns beyond ``width``."""
    order = np.lexsort((row, column))
    column, row = column[order], row[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (column[1:] != column[:-1]) | (row[1:] != row[:-1])
    column, row = column[fresh], row[fresh]
    starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]])) if len(column) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(column)))
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in range(2, width + 1):
        at = starts[sizes == size]
        if len(at):
            members = row[at[:, None] + np.arange(size)]
            a, b = np.triu_indices(size, 1)
            lefts.append(members[:, a].ravel())
            rights.append(members[:, b].ravel())
    x, y = np.concatenate(lefts), np.concatenate(rights)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, np.int64)
    overlap = np.diff(np.append(first, len(x)))
    wide = np.repeat(sizes > width, sizes)
    hot, times = np.unique(row[wide], return_counts=True)
    return x[first], y[first], overlap, hot, times


def _sets(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, n, the name (f1, f2), the entered hashes and the last of them (in an order as of signed numbers) of each row."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = list(map(shingle_set, part.column(text).to_pylist()))
                names = list(map(fingerprint, sets))
                tops = [s[: entered(len(s))] for s in sets]
                last = [int((s[-1] ^ np.uint64(1 << 63)).astype(np.int64)) if len(s) else 0 for s in tops]
                yield {c: part.column(c) for c in keep} | {"n": list(map(len, sets)), "f1": [f[0] for f in names], "f2": [f[1] for f in names], "entered": [s.tobytes() for s in tops], "last": last}

    more = [T.StructField(c, T.BinaryType() if c == "entered" else T.LongType()) for c in ("n", "f1", "f2", "entered", "last")]
    return arrow_rows(df.select(*keep, text), make, T.StructType([T.StructField(c, kinds[c]) for c in keep] + more))


def _incidences(nodes: DataFrame, blocks: int) -> DataFrame:
    """Rows of a block: its columns' hashes, each with the place of its set in the row's list of sets."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                names = part.column(0).to_numpy()
                parts = [np.frombuffer(x, np.uint64) for x in part.column(1).to_pylist()]
                h = np.concatenate(parts)
                i = np.repeat(np.arange(len(names), dtype=np.uint16), list(map(len, parts)))
                block = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(blocks)) >> np.uint64(32)
                order = np.argsort(block, kind="stable")
                cuts = np.searchsorted(block[order], np.arange(blocks + 1, dtype=np.uint64))
                out: dict = {"block": [], "hashes": [], "places": [], "names": []}
                for b in range(blocks):
                    mine = order[cuts[b] : cuts[b + 1]]
                    if len(mine):
                        used, places = np.unique(i[mine], return_inverse=True)
                        out["block"].append(b)
                        out["hashes"].append(h[mine].tobytes())
                        out["places"].append(places.astype(np.uint16).tobytes())
                        out["names"].append(names[used].tobytes())
                yield out

    return arrow_rows(nodes.select("node", "entered"), make, "block int, hashes binary, places binary, names binary")


def _multiply(incidences: DataFrame, width: int) -> DataFrame:
    """(x, y, c): partial overlap of a pair; y null: c columns of x beyond ``width``."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        column = np.concatenate([np.frombuffer(h, np.uint64) for h in pdf["hashes"]])
        row = np.concatenate([np.frombuffer(n, np.int64)[np.frombuffer(p, np.uint16)] for n, p in zip(pdf["names"], pdf["places"])])
        x, y, c, hot, times = counted_pairs(column, row, width)
        out = pd.DataFrame({"x": np.concatenate([x, hot]), "y": pd.array(np.concatenate([y, hot]), dtype="Int64"), "c": np.concatenate([c, times])})
        out.loc[len(x) :, "y"] = pd.NA
        return out

    return incidences.groupBy("block").applyInPandas(block, "x long, y long, c long")


def _whole_sets(rows: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """(node, hashes) of the ``wanted`` (node, _key); ``repeated``: several rows may have a key."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield {"node": part.column(0), "hashes": [shingle_set(t).tobytes() for t in part.column(1).to_pylist()]}

    texts = rows.join(wanted, "_key").select("node", "text")
    sets = arrow_rows(texts, make, "node long, hashes binary")
    return sets.dropDuplicates(["node"]) if repeated else sets


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose whole sets link."""
    a = sets.select(F.col("node").alias("x"), F.col("hashes").alias("a"))
    b = sets.select(F.col("node").alias("y"), F.col("hashes").alias("b"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
                keep.append(len(np.intersect1d(p, q, assume_unique=True)) >= least_overlap(len(p), len(q)))
            yield {"x": batch.column(0).filter(pa.array(keep, pa.bool_())), "y": batch.column(1).filter(pa.array(keep, pa.bool_()))}

    both = pairs.select("x", "y").join(a, "x").join(b, "y").select("x", "y", "a", "b")
    return arrow_rows(both, make, "x long, y long")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """(len(a), len(b)): how many hashes each two sets share; columns of many of the pairs as a dense product, the others one by one."""
    out = np.zeros((len(a), len(b)), np.float32)
    sides = []
    for sets in (a, b):
        column, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))
        order = np.argsort(column, kind="stable")
        sides.append((column[order], row[order]))
    common = np.intersect1d(*(np.unique(column) for column, _ in sides), assume_unique=True)
    if not len(common):
        return out
    placed = []
    for column, row in sides:
        at = np.minimum(np.searchsorted(common, column), len(common) - 1)
        held = common[at] == column
        placed.append((at[held], row[held], np.bincount(at[held], minlength=len(common))))
    (ka, ra, na), (kb, rb, nb) = placed
    dense = na * nb * DENSE > out.size
    which = np.flatnonzero(dense)
    for lo in range(0, len(which), 2048):
        chunk = which[lo : lo + 2048]
        slot = np.full(len(common), -1)
        slot[chunk] = np.arange(len(chunk))
        m = []
        for k, r, size in ((ka, ra, len(a)), (kb, rb, len(b))):
            mine = slot[k] >= 0
            m.append(np.zeros((size, len(chunk)), np.float32))
            m[-1][r[mine], slot[k[mine]]] = 1
        out += m[0] @ m[1].T
    thin = np.flatnonzero(~dense[ka])
    starts = np.cumsum(nb) - nb
    ends = np.cumsum(nb[ka[thin]])
    for lo in range(0, int(ends[-1]) if len(thin) else 0, 4_000_000):
        i = thin[np.searchsorted(ends, lo, "right") : np.searchsorted(ends, lo + 4_000_000, "right")]
        times = nb[ka[i]]
        j = np.repeat(starts[ka[i]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        out += np.bincount(np.repeat(ra[i], times) * len(b) + rb[j], minlength=out.size).reshape(out.shape)
    return out


def _row_blocks(crowded: DataFrame, width: int) -> DataFrame:
    """(node, mine, i, j): the pairs of row blocks i <= j, one of them its own, to which a crowded row goes.

    Two linking rows share ``shared_least`` of their entered columns, so each may leave out one less of
    its most frequent ones: the rarest that they share stays in both. Blocks follow the least of a row's
    frequent hashes, as near copies mostly agree in it; large blocks are split, small ones put together.
    Names of blocks are hashes: where two are equal, the blocks are one.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for node, n, hashes in zip(*(batch.column(i).to_pylist() for i in range(3))):
                h = np.frombuffer(hashes, np.int64)
                yield {"node": np.full(len(h), node), "n": np.full(len(h), n), "h": h}

    rows = arrow_rows(crowded.select("node", "n", "entered"), explode, "node long, n long, h long")
    common = durable(rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1))
    left_out = F.floor(F.floor((4 * F.col("n") + 4) / 5) / 10)
    order = Window.partitionBy("node").orderBy(F.desc("df"), "h")
    placed = rows.join(common, "h").withColumn("pos", F.row_number().over(order)).withColumn("kept", F.col("pos") > left_out)
    placed = durable(placed.select("node", "n", "h", "df", "kept"))
    hot = F.min(F.when(F.col("df") > width, F.col("h")))
    keyed = durable(placed.groupBy("node").agg(F.coalesce(hot, F.min("h")).alias("key"), (8 * F.first("n")).alias("bytes")))
    sizes = keyed.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("parts"), F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"))
    sizes = durable(sizes)
    n, size = sizes.where("parts = 1").agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    together = int(max(1, -(-n // BLOCK), -(-size // BLOCK_BYTES)))
    mine = F.when(F.col("parts") > 1, F.xxhash64("key", F.pmod(F.xxhash64("node"), F.col("parts")))).otherwise(F.pmod(F.xxhash64("key"), F.lit(together)))
    homes = durable(keyed.select("node", "key").join(sizes.select("key", "parts"), "key").select("node", mine.alias("mine")))

    kept = placed.where("kept").select("node", "h").join(homes, "node")
    columns = durable(kept.groupBy("h").agg(F.collect_set("mine").alias("blocks")))
    asked = kept.join(columns, "h").groupBy("node", "mine").agg(F.array_distinct(F.flatten(F.collect_set("blocks"))).alias("blocks"))
    return asked.select("node", "mine", F.explode("blocks").alias("other")).select("node", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))


def _block_links(dealt: DataFrame, sets: DataFrame, copies: DataFrame) -> DataFrame:
    """(node, near, root): so many rows of other crowded sets link with a set, and a set that its component in the product holds."""

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        left, right = pdf[pdf["mine"] == i], pdf[pdf["mine"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"node": pd.Series(dtype="int64"), "near": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        a, b = ([np.frombuffer(h, np.uint64) for h in side["hashes"]] for side in (left, right))
        na, nb = (np.array(list(map(len, side)), np.int64) for side in (a, b))
        name = left["node"].to_numpy() if i == j else np.concatenate([left["node"], right["node"]])
        hit = overlaps(a, b) >= least_overlap(na[:, None], nb[None, :])
        if i == j:
            np.fill_diagonal(hit, False)
        near = hit @ right["copies"].to_numpy(np.int64)
        if i != j:
            near = np.concatenate([near, left["copies"].to_numpy(np.int64) @ hit])
        x, y = np.nonzero(hit)
        label = united(np.arange(len(name)), x, y if i == j else y + len(a))
        some = near > 0
        return pd.DataFrame({"node": name[some], "near": near[some], "root": name[label[some]]})

    rows = dealt.join(sets, "node").join(copies, "node")
    return rows.groupBy("i", "j").applyInPandas(product, "node long, near long, root long")


def link(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH) -> DataFrame:
    """The id, n_shingles, component_id (smallest id reachable by links, its own included) and n_links, a row for each row.

    Two rows link when 100 x intersection >= 80 x union of their sets; a row without words has an empty
    set, links with nothing and is its own component. Copies link. n_links counts the other rows that a
    row links with, copies and rows of linking sets alike. Repeated rows are rows. A null id is larger
    than all others: it names a component only if there is no other. Texts of any length enter whole. An
    empty table gives an empty table. Other columns are ignored.
    """
    spark = df.sparkSession
    key = F.col(f"in_{id_column}")
    rows = renamed(df, [*dict.fromkeys([id_column, text_column])]).withColumnRenamed(f"in_{text_column}", "text")
    rows = rows.select(key, "text", F.xxhash64(key, F.col("text")).alias("_key"))
    entering = durable(_sets(rows, "text", [f"in_{id_column}", "_key"]))
    nodes = entering.where("n > 0").groupBy("f1", "f2").agg(F.min(key).alias("least_id"), F.min("_key").alias("_key"), F.first("n").alias("n"), F.first("last").alias("last"), F.first("entered").alias("entered"), F.count(F.lit(1)).alias("copies"))
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()))
    own = durable(entering.drop("entered", "last"))
    release(entering)
    product = durable(_multiply(_incidences(nodes, shuffle_width(spark)), width))

    hot = product.where("y is null").groupBy(F.col("x").alias("node")).agg(F.sum("c").alias("hot"))
    # a smaller set that a row may link with has at least 0.8 n
    alone = F.floor(F.floor((4 * F.col("n") + 4) / 5) / 10)
    sized = durable(nodes.select("node", "_key", "n", "last").join(hot, "node", "left").withColumn("hot", F.coalesce("hot", F.lit(0))).withColumn("crowded", F.col("hot") > alone))
    x, y = (sized.select(F.col("node").alias(s), *(F.col(c).alias(c + s) for c in ("n", "last", "hot", "crowded"))) for s in "xy")
    counted = product.where("y is not null").groupBy("x", "y").agg(F.sum("c").alias("c"))
    held = F.col("c") + F.least("hotx", "hoty")
    # up to the smaller of the last entered hashes, all that two sets share is counted
    beyond = lambda s: F.col(f"n{s}") - F.least(F.col(f"n{s}"), F.col(f"n{s}") - F.floor((4 * F.col(f"n{s}") + 4) / 5) + 1 + F.floor(F.col(f"n{s}") / 10))
    rest = F.when(F.col("lastx") <= F.col("lasty"), beyond("x")).otherwise(beyond("y"))
    fits = (5 * F.least("nx", "ny") >= 4 * F.greatest("nx", "ny")) & (held >= 1 + F.floor(F.least("nx", "ny") / 10)) & (held + rest >= F.floor((4 * (F.col("nx") + F.col("ny")) + 8) / 9))
    pairs = durable(counted.join(x, "x").join(y, "y").where(fits & ~(F.col("crowdedx") & F.col("crowdedy"))).select("x", "y"))
    release(product)

    dealt = durable(_row_blocks(nodes.join(sized.where("crowded").select("node"), "node", "left_semi"), width))
    wanted = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).union(dealt.select("node")).distinct()
    repeated = not own.where("n > 0").groupBy("_key").count().where("count > 1").isEmpty()
    sets = durable(_whole_sets(rows, wanted.join(sized.select("node", "_key"), "node"), repeated))
    copies = nodes.select("node", "copies")
    one_by_one = durable(_verified(pairs, sets))
    in_blocks = durable(_block_links(dealt, sets, copies))
    release(sets, pairs, dealt)

    comps = durable(components(one_by_one.union(in_blocks.select("node", "root")), "x", "y"))
    both = one_by_one.union(one_by_one.select("y", "x")).toDF("node", "other")
    near = both.join(copies.toDF("other", "near"), "other").select("node", "near").union(in_blocks.select("node", "near"))
    near = near.groupBy("node").agg(F.sum("near").alias("near"))
    least = comps.join(nodes.select("node", "least_id"), "node").groupBy("component").agg(F.min("least_id").alias("least"))
    joined = comps.join(least, "component").select("node", "least").join(near, "node", "left")
    placed = durable(nodes.select("node", "f1", "f2", "least_id", "copies").join(joined, "node", "left").select("f1", "f2", F.coalesce("least", "least_id").alias("component_id"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")))
    out = own.where("n > 0").select(key, "n", "f1", "f2").join(placed, ["f1", "f2"]).select(key.alias(id_column), F.col("n").alias("n_shingles"), "component_id", "n_links")
    return out.union(own.where("n = 0").select(key, "n", key, F.lit(0).cast("long")))
