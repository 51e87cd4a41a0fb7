"""Shortest paths over cells against Dijkstra over the whole graph, and walking scores."""

import heapq
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.operators import graph


def dijkstra(edges, sources):
    """(category, node) to distance, on dictionaries."""
    into = {}
    for a, b, w in edges:
        into.setdefault(b, []).append((a, w))
    out = {}
    for kind in {k for k, _ in sources}:
        best = {n: 0.0 for k, n in sources if k == kind}
        heap = [(0.0, n) for n in best]
        heapq.heapify(heap)
        while heap:
            d, n = heapq.heappop(heap)
            if d > best[n]:
                continue
            for m, w in into.get(n, []):
                if d + w < best.get(m, np.inf):
                    best[m] = d + w
                    heapq.heappush(heap, (d + w, m))
        out |= {(kind, n): d for n, d in best.items()}
    return out


def frames(spark, nodes, edges, sources):
    return (
        spark.createDataFrame(nodes, "id long, x double, y double"), spark.createDataFrame(edges, "src long, dst long, length double"), spark.createDataFrame(sources, "category string, node long"),
    )


@pytest.mark.parametrize("most", [1, 12])
def test_paths_are_those_of_dijkstra(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "MERGE", 2)
    rng = np.random.default_rng(4)
    big = 1 << 60  # ids beyond what a double holds
    edges = [(big + int(a), big + int(b), float(w)) for a, b, w in zip(rng.integers(0, 30, 90), rng.integers(0, 30, 90), rng.integers(0, 9, 90))]
    nodes = [(big + i, float(rng.integers(0, 5)), float(rng.integers(0, 5))) for i in range(26)] + [(big + 26, None, 1.0), (big, 9.0, 9.0), (big + 99, 1.0, 1.0)]
    sources = [("a", big + 3), ("a", big + 9), ("b", big + 5), ("b", big + 77), ("b", big + 5), (None, big + 1), ("a", None), ("c", big + 99)]
    got = {(r.category, r.node): r.distance for r in graph.shortest_paths(*frames(spark, nodes, edges, sources), most=most).collect()}
    assert got == dijkstra(edges, [s for s in sources if None not in s]) and got["b", big + 77] == 0.0


def test_rounds_follow_cells_and_not_hops(spark, monkeypatch):
    side, turns = 12, []
    keep = graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: turns.append(df.columns) or keep(df))
    at = lambda x, y: x * side + y
    steps = [(at(x, y), at(x + dx, y + dy)) for x in range(side) for y in range(side) for dx, dy in ((1, 0), (0, 1)) if x + dx < side and y + dy < side]
    edges = [(a, b, 1.0) for s in steps for a, b in (s, s[::-1])]
    nodes = [(at(x, y), float(x), float(y)) for x in range(side) for y in range(side)]
    got = {r.node: r.distance for r in graph.shortest_paths(*frames(spark, nodes, edges, [("a", 0)]), most=150).collect()}
    assert got == {at(x, y): float(x + y) for x in range(side) for y in range(side)}
    rounds = sum("state" in c and "kind" in c for c in turns)
    assert 3 <= rounds <= 8 < 2 * (side - 1)


def test_empty_graphs(spark):
    none = frames(spark, [], [], [])
    assert graph.shortest_paths(*none).count() == 0
    nodes, edges, sources = frames(spark, [(1, 0.0, 0.0)], [], [("a", 1), ("a", 2)])
    assert sorted(map(tuple, graph.shortest_paths(nodes, edges, sources).collect())) == [("a", 1, 0.0), ("a", 2, 0.0)]
    nodes, edges, _ = frames(spark, [(1, 0.0, 0.0)], [(1, 2, 3.0)], [])
    assert graph.shortest_paths(nodes, edges, none[2]).count() == 0


def test_files_of_the_rounds_are_deleted(spark):
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    count = lambda: len(os.listdir(folder))
    before = count()
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b), 1.0) for a, b in rng.integers(0, 40, (80, 2))]
    nodes = [(i, float(i % 7), float(i // 7)) for i in range(40)]
    out = graph.shortest_paths(*frames(spark, nodes, edges, [("a", 1)]), most=10)
    assert count() == before + 1 and out.count() > 1


def test_walk_scores_by_category(spark):
    nodes = spark.createDataFrame([(i, i * 400.0, 0.0) for i in range(8)], "id long, x double, y double")
    edges = spark.createDataFrame([(a, b, 400.0) for i in range(6) for a, b in ((i, i + 1), (i + 1, i))], "src long, dst long, length double")  # node 7 is apart
    places = spark.createDataFrame([("food", 10.0, 0.0), ("park", 800.0, 5.0)], "category string, x double, y double")
    points = spark.createDataFrame([("a", 1.0, 1.0), ("b", 810.0, 0.0), ("c", 2400.0, 0.0), ("d", 2801.0, 0.0)], "geo_pid string, x double, y double")
    got = {r.geo_pid: (r.food_score, r.park_score, r.none_score, r.walkability) for r in graph.walk_scores(points, nodes, edges, places, most=3, categories=("food", "none", "park")).collect()}
    assert got == {"a": (100.0, 50.0, None, 75.0), "b": (50.0, 100.0, None, 75.0), "c": (0.0, 0.0, None, 0.0), "d": (None, None, None, None)}


def test_nothing_of_the_graphs_size_is_broadcast(spark, monkeypatch):
    from cadastra.operators import spatial

    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return durable(df)

    durable = graph.durable
    monkeypatch.setattr(graph, "durable", kept)
    monkeypatch.setattr(spatial, "durable", kept)
    nodes = spark.range(20).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    edges = spark.range(19).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("length"))
    places = nodes.where("id % 7 = 3").select(F.lit("food").alias("category"), "x", "y")
    scored = graph.walk_scores(nodes, nodes, edges, places, "id", cell=2.0)
    assert scored.count() == 20
    # but for the few squares that are too crowded, the squares' names and the cells that a round sent to
    small = ("square", "cell")
    for plan in [*plans, scored._jdf.queryExecution().executedPlan().toString()]:
        joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
        assert all(any(f"[{k}#" in line for k in small) for line in joins), joins
