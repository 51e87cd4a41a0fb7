"""Walking scores: nodes near points, multi-source shortest paths, decay scores by category.

What has a row for each node, edge, point or source is joined by sort and merge. Left to Spark, it is
broadcast through the driver as long as its file or its compressed shuffle is small.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.functions import scalars as s
from cadastra.session import durable, release

from .spatial import convex_hull, knn_join, near_hull

# Tags of each category; True allows any value.
AMENITY_TAGS: dict[str, dict[str, object]] = {
    "grocery": {"shop": ["supermarket", "grocery", "convenience"]},
    "food": {"amenity": ["restaurant", "cafe", "fast_food"]},
    "education": {"amenity": ["school", "college", "university", "library"]},
    "park": {"leisure": ["park", "playground"]},
    "transit": {"public_transport": True, "railway": ["station", "tram_stop"], "highway": "bus_stop"},
}
LONGEST_WALK, DECAY = 1600.0, 1.0
BUFFER = 1112.0  # metres, a hundredth of a degree of latitude, around the parcels' hull


CELL_EDGES = 100_000  # that one task searches, 24 bytes each
HALVINGS = 30  # of a cell's side
MERGE = 8  # rounds after which the changed cells' distances are put together


def nearest_node(points: DataFrame, nodes: DataFrame, id_column: str, cell: float = 250.0) -> DataFrame:
    """(id, node): the nearest graph node of each point, ties by the smaller node id."""
    targets = nodes.select(F.col("id").alias("node"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return knn_join(points, targets, 1, cell, id_column, "node").select(id_column, "node")


def graph_cells(nodes: DataFrame, edges: DataFrame, most: int = CELL_EDGES) -> DataFrame:
    """(node, cell): squares of the plane, each halved until no more than ``most`` edges lead into its nodes. Durable.

    A single place that is busier than that stays one cell. Nodes without a row or a coordinate are
    dealt to cells by a hash.
    """
    ends = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")).union(edges.select("src", F.lit(0).cast("long"))).groupBy("node").agg(F.sum("n").alias("n"))
    at = nodes.groupBy(F.col("id").alias("node")).agg(F.min_by(F.struct("x", "y"), F.struct("x", "y")).alias("p")).select("node", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    placed = durable(ends.join(at.hint("merge"), "node", "left"))
    total, left, right, low, high = placed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    groups = max(1, math.ceil(2 * total / most))
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    lost = placed.where(~known).select("node", F.struct(F.lit(-1).alias("level"), F.pmod(F.xxhash64("node"), F.lit(groups)).alias("cx"), F.lit(0).cast("long").alias("cy")).alias("square"))
    done, todo, steps = [lost], placed.where(known), []
    if left is not None:
        side = max(right - left, high - low, 1e-9) / math.sqrt(groups)
        for level in range(HALVINGS):
            square = F.struct(F.lit(level).alias("level"), F.floor((F.col("x") - left) / side).alias("cx"), F.floor((F.col("y") - low) / side).alias("cy"))
            split = todo.withColumn("square", square)
            crowded = split.groupBy("square").agg(F.sum("n").alias("total")).where(F.col("total") > most).select("square") if level < HALVINGS - 1 else split.limit(0).select("square")
            crowded = durable(crowded)
            steps.append(crowded)
            done.append(split.join(crowded, "square", "left_anti").select("node", "square"))
            if crowded.isEmpty():
                break
            todo = durable(split.join(crowded, "square", "left_semi").drop("square"))
            steps.append(todo)
            side /= 2
    of = durable(reduce(DataFrame.union, done))
    names = durable(of.select("square").distinct().withColumn("cell", F.monotonically_increasing_id()))
    out = durable(of.join(names, "square").select("node", "cell"))
    release(placed, of, names, *steps)
    return out


def cell_blocks(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(cell, nodes, first, ends, lengths, exits): each cell's edges by their end node, and those that lead out of it. Durable.

    ``exits`` are (number of the end node, cell and node of the start, length); arrays are bytes.
    """
    least = edges.groupBy("src", "dst").agg(F.min("length").cast("double").alias("length"))
    to, start = cells.select(F.col("node").alias("dst"), "cell"), cells.select(F.col("node").alias("src"), F.col("cell").alias("from_cell"))
    owned = least.join(to.hint("merge"), "dst").join(start.hint("merge"), "src").select("cell", "dst", "src", "length", "from_cell")
    # every node of the cell, marked by a length that no edge has
    owned = owned.union(cells.select("cell", F.col("node").alias("dst"), F.col("node").alias("src"), F.lit(-1.0), F.col("cell").alias("from_cell")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = int(pdf["cell"].iloc[0])
        names = np.unique(pdf.loc[pdf["length"] < 0, "dst"].to_numpy())
        pdf = pdf[pdf["length"] >= 0]
        local = (pdf["from_cell"] == cell).to_numpy()
        dst, src, length = (pdf[c].to_numpy() for c in ("dst", "src", "length"))
        at = np.searchsorted(names, dst)
        order = np.flatnonzero(local)[np.argsort(at[local], kind="stable")]
        first = np.searchsorted(at[order], np.arange(len(names) + 1))
        out = {"nodes": names.astype(np.int64), "first": first.astype(np.int64), "ends": np.searchsorted(names, src[order]).astype(np.int64), "lengths": length[order].astype(np.float64)}
        out |= {"exit_at": at[~local].astype(np.int64), "exit_cell": pdf["from_cell"].to_numpy()[~local].astype(np.int64), "exit_node": src[~local].astype(np.int64), "exit_length": length[~local].astype(np.float64)}
        return pd.DataFrame({"cell": [cell]} | {k: [v.tobytes()] for k, v in out.items()})

    return durable(owned.groupBy("cell").applyInPandas(pack, "cell long, nodes binary, first binary, ends binary, lengths binary, exit_at binary, exit_cell binary, exit_node binary, exit_length binary"))


def _settle(best: np.ndarray, starts: list[tuple[float, int]], first: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Lowers ``best`` from the (distance, node) of ``starts`` over a cell's edges; the numbers of the nodes that changed."""
    changed, heap = set(), []
    for d, i in starts:
        if d < best[i]:
            best[i] = d
            heapq.heappush(heap, (d, i))
            changed.add(i)
    while heap:
        d, i = heapq.heappop(heap)
        if d > best[i]:
            continue
        for k in range(first[i], first[i + 1]):
            j, reach = int(ends[k]), d + lengths[k]
            if reach < best[j]:
                best[j] = reach
                heapq.heappush(heap, (reach, j))
                changed.add(j)
    return np.array(sorted(changed), dtype=np.int64)


def shortest_paths(nodes: DataFrame, edges: DataFrame, sources: DataFrame, category: str = "category", node: str = "node", most: int = CELL_EDGES, rounds: int = 100_000) -> DataFrame:
    """(category, node, distance): from each node to the nearest source of the category; unreachable nodes are absent.

    Edges are directed as given; ``edges`` has src, dst, length >= 0 and ``nodes`` id, x, y; categories are few.
    The graph is cut into cells of at most ``most`` edges. In a round, each cell that was sent shorter
    distances settles its own nodes in one task and sends on what its edges out of the cell make of them,
    so rounds follow the number of cells on a path and not its hops. Cells that nothing reached keep what they
    have: a round writes the distances of changed cells only, and these are merged every ``MERGE`` rounds.
    """
    kinds = sorted(r[0] for r in sources.select(category).distinct().collect() if r[0] is not None)
    number = F.array_position(F.array(*map(F.lit, kinds)), F.col(category)).cast("int") - 1 if kinds else F.lit(None).cast("int")
    cells = graph_cells(nodes, edges, most)
    blocks = cell_blocks(cells, edges)
    given = durable(sources.where(F.col(category).isNotNull() & F.col(node).isNotNull()).select(number.alias("kind"), F.col(node).cast("long").alias("node")).distinct())
    sent = durable(given.join(cells.hint("merge"), "node").select("cell", "kind", "node", F.lit(0.0).alias("distance")))
    states: list[DataFrame] = []
    count = len(kinds)

    def step(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"cell": [], "kind": [], "node": [], "distance": [], "state": []})
        if not len(left) or not len(right):
            return nothing
        row = left.iloc[0]
        names, first, ends, exit_at, exit_cell, exit_node = (np.frombuffer(row[c], np.int64) for c in ("nodes", "first", "ends", "exit_at", "exit_cell", "exit_node"))
        lengths, exit_length = (np.frombuffer(row[c], np.float64) for c in ("lengths", "exit_length"))
        best = np.full((count, len(names)), np.inf) if row["state"] is None else np.frombuffer(row["state"], np.float64).reshape(count, -1).copy()
        out, any_changed = [], False
        for kind, part in right.groupby("kind"):
            at = np.minimum(np.searchsorted(names, part["node"].to_numpy()), len(names) - 1)
            here = names[at] == part["node"].to_numpy()
            now = best[int(kind)]
            changed = _settle(now, sorted(zip(part["distance"].to_numpy()[here].tolist(), at[here].tolist())), first, ends, lengths)
            any_changed |= len(changed) > 0
            leaves = np.isin(exit_at, changed)
            if leaves.any():
                found = pd.DataFrame({"cell": exit_cell[leaves], "node": exit_node[leaves], "distance": now[exit_at[leaves]] + exit_length[leaves]})
                out.append(found.groupby(["cell", "node"], as_index=False)["distance"].min().assign(kind=int(kind), state=None))
        if any_changed:
            out.append(pd.DataFrame({"cell": [row["cell"]], "kind": [-1], "node": [-1], "distance": [0.0], "state": [best.tobytes()]}))
        return pd.concat(out)[["cell", "kind", "node", "distance", "state"]] if out else nothing

    def newest(frames: list[DataFrame]) -> DataFrame:
        tagged = [f.withColumn("round", F.lit(i)) for i, f in enumerate(frames)]
        return reduce(DataFrame.union, tagged).groupBy("cell").agg(F.max_by("state", "round").alias("state"))

    for turn in range(rounds):
        if sent.isEmpty():
            break
        active = sent.select("cell").distinct()
        left = blocks.join(active, "cell", "left_semi")
        if states:
            left = left.join(newest([f.join(active, "cell", "left_semi") for f in states]).hint("merge"), "cell", "left")
        else:
            left = left.withColumn("state", F.lit(None).cast("binary"))
        out = durable(left.groupBy("cell").cogroup(sent.groupBy("cell")).applyInPandas(step, "cell long, kind int, node long, distance double, state binary"))
        before, sent = sent, durable(out.where("kind >= 0").groupBy("cell", "kind", "node").agg(F.min("distance").alias("distance")))
        changed = durable(out.where("kind < 0").select("cell", "state"))
        release(before, out)
        states.append(changed)
        if len(states) > MERGE:
            merged = durable(newest(states))
            release(*states)
            states = [merged]
    else:
        raise RuntimeError("paths did not settle")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for names, state in zip(pdf["nodes"], pdf["state"]):
                names, best = np.frombuffer(names, np.int64), np.frombuffer(state, np.float64).reshape(count, -1)
                kind, at = np.nonzero(np.isfinite(best))
                yield pd.DataFrame({"kind": kind, "node": names[at], "distance": best[kind, at]})

    none = F.lit(0.0)
    found = given.select("kind", "node", none.alias("distance"))  # sources that no edge touches are their own
    if states:
        found = found.union(blocks.join(newest(states).hint("merge"), "cell").select("nodes", "state").mapInPandas(spread, "kind int, node long, distance double"))
    found = found.groupBy("kind", "node").agg(F.min("distance").alias("distance"))
    name = F.element_at(F.array(*map(F.lit, kinds)), F.col("kind") + 1) if kinds else F.lit(None)
    out = durable(found.select(name.cast(sources.schema[category].dataType).alias(category), F.col("node").cast(sources.schema[node].dataType).alias(node), "distance"))
    release(cells, blocks, given, sent, *states)
    return out


def around(points: DataFrame, nodes: DataFrame, edges: DataFrame, places: DataFrame, buffer: float = BUFFER, x: str = "x", y: str = "y") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and places within ``buffer`` of the points' convex hull; of edges those with both ends there. No node there is an error."""
    hull = convex_hull(points, x, y)
    inside = nodes.where(near_hull(hull, F.col("x"), F.col("y"), buffer))
    if inside.isEmpty():
        raise ValueError("the walking network has no node around the parcels")
    ends = inside.select("id").distinct()
    kept = edges.join(ends.withColumnRenamed("id", "src").hint("merge"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst").hint("merge"), "dst", "left_semi").select(*edges.columns)
    return inside, kept, places.where(near_hull(hull, F.col("x"), F.col("y"), buffer))


def walk_scores(points: DataFrame, nodes: DataFrame, edges: DataFrame, places: DataFrame, id_column: str = "geo_pid", longest: float = LONGEST_WALK, exponent: float = DECAY, cell: float = 250.0, categories: tuple[str, ...] | None = None, most: int = CELL_EDGES) -> DataFrame:
    """(id, score by category, walkability): decay of the network distance to each category, their mean to two digits.

    A category without places, or out of reach, is null and doesn't count in the mean; one in reach but
    farther than ``longest`` scores 0 and does. ``places``: category, x, y. Rounding is half to even.
    ``most``: edges of a cell of the graph.
    """
    if exponent <= 0:
        raise ValueError("exponent must be positive")
    names = categories or tuple(sorted(r[0] for r in places.select("category").distinct().collect()))
    numbered = durable(places.withColumn("_place", F.monotonically_increasing_id()).select("_place", "category", "x", "y"))
    sources = numbered.join(nearest_node(numbered, nodes, "_place", cell).hint("merge"), "_place").select("category", "node")
    paths = shortest_paths(nodes, edges, sources, most=most)
    wide = paths.groupBy("node").pivot("category", list(names)).agg(F.min("distance"))
    at = nearest_node(points, nodes, id_column, cell)
    scored = at.join(wide.hint("merge"), "node", "left").select(id_column, *(s.decay_score(F.col(c), longest, exponent).alias(f"{c}_score") for c in names))
    return scored.withColumn("walkability", F.bround(s.mean_known([F.col(f"{c}_score") for c in names]), 2))
