"""Shared areas of polygons against signed triangles, closed forms and each other."""

import math
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadastra.functions import clipping
from cadastra.functions import geometry as g
from cadastra.operators import choices, spatial
from cadastra.plans import queries


def _fans(polygon: list, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counter-clockwise triangles and their signs, adding up to the polygon."""
    triangles, signs = [], []
    for ring in g.oriented(polygon):
        r = ring - origin
        for b, c in zip(r[1:-1], r[2:]):
            twice = (b[0] - r[0][0]) * (c[1] - r[0][1]) - (c[0] - r[0][0]) * (b[1] - r[0][1])
            if twice:
                triangles.append([r[0], b, c] if twice > 0 else [r[0], c, b])
                signs.append(np.sign(twice))
    return np.array(triangles).reshape(-1, 3, 2), np.array(signs)


def _clipped_area(subject: np.ndarray, clip: np.ndarray) -> float:
    """Area common to two counter-clockwise triangles, by clipping against half planes."""
    points = subject
    for i in range(3):
        a, b = clip[i], clip[(i + 1) % 3]
        side = (b[0] - a[0]) * (points[:, 1] - a[1]) - (b[1] - a[1]) * (points[:, 0] - a[0])
        kept = []
        for j in range(len(points)):
            k = (j + 1) % len(points)
            if side[j] >= 0:
                kept.append(points[j])
            if (side[j] > 0 and side[k] < 0) or (side[j] < 0 and side[k] > 0):
                kept.append(points[j] + (points[k] - points[j]) * (side[j] / (side[j] - side[k])))
        if len(kept) < 3:
            return 0.0
        points = np.array(kept)
    return abs(g.signed_area(points))


def fan_area(a: list, b: list) -> float:
    """The area that two polygons share, by another way: signed fans of triangles, intersected pair by pair near a local origin; pairs whose boxes miss are skipped.
    """
    origin = g.ring_array(a[0][0])[0]
    ta, sa = _fans(a, origin)
    tb, sb = _fans(b, origin)
    if not len(ta) or not len(tb):
        return 0.0
    lo_a, hi_a, lo_b, hi_b = ta.min(axis=1), ta.max(axis=1), tb.min(axis=1), tb.max(axis=1)
    meet = ((lo_a[:, None] <= hi_b[None]) & (lo_b[None] <= hi_a[:, None])).all(axis=2)
    return float(max(0.0, sum(sa[i] * sb[j] * _clipped_area(ta[i], tb[j]) for i, j in zip(*np.nonzero(meet)))))


def star(rng, corners, x=0.0, y=0.0, hole=0.0):
    """A ring around (x, y) that may bend in everywhere; no gap of angles reaches half a turn, so a small hole is inside."""
    angle = (np.arange(corners) + rng.uniform(-0.4, 0.4, corners)) * 2 * math.pi / corners
    ring = np.column_stack([x + (r := rng.uniform(0.6, 2, corners)) * np.cos(angle), y + r * np.sin(angle)]).tolist()
    return [[ring, *([[[float(x + hole * math.cos(t)), float(y + hole * math.sin(t))] for t in (0, 1.5, 3, 4.5)]] if hole else [])]]


def areas(left, right):
    return clipping.shared_areas(pa.array(left, clipping.GEOMETRY), pa.array(right, clipping.GEOMETRY))


@pytest.mark.parametrize("seed", range(4))
def test_areas_are_those_of_signed_triangles(seed):
    rng = np.random.default_rng(seed)
    left, right = [], []
    for k in range(80):
        left.append(star(rng, int(rng.integers(5, 14)), 0, 0, 0.1 * (k % 3)) + (star(rng, 6, 6, 0) if k % 4 == 0 else []))
        right.append(left[-1] if k % 9 == 0 else star(rng, int(rng.integers(5, 14)), *rng.uniform(-3, 3, 2), 0.05 * (k % 2)))
    assert np.allclose(areas(left, right), [fan_area(p, q) for p, q in zip(left, right)], atol=1e-9)
    # far from the origin, and in the other order
    moved = lambda shapes: [[[[[x + 2.3e5, y + 9.1e5] for x, y in r] for r in part] for part in p] for p in shapes]
    assert np.allclose(areas(moved(right), moved(left)), areas(left, right), atol=1e-7)
    assert np.allclose(areas(left, left), [g.area(p) for p in left])


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_boxes_are_products_of_lengths(monkeypatch, chunk):
    monkeypatch.setattr(clipping, "CROSSINGS", chunk)
    rng = np.random.default_rng(9)
    a, b = np.sort(rng.integers(0, 6, (2, 300, 2, 2)), axis=2).astype(float)  # many share edges or corners, some are flat
    as_box = lambda v: [[[[v[0, 0], v[0, 1]], [v[1, 0], v[0, 1]], [v[1, 0], v[1, 1]], [v[0, 0], v[1, 1]], [v[0, 0], v[0, 1]]]]]
    want = np.clip(np.minimum(a[:, 1], b[:, 1]) - np.maximum(a[:, 0], b[:, 0]), 0, None).prod(axis=1)
    assert np.allclose(areas([as_box(v) for v in a], [as_box(v) for v in b]), want)


coordinate = st.integers(-20, 20).map(lambda v: v / 4)
outline = st.lists(st.tuples(coordinate, coordinate), min_size=3, max_size=7, unique=True)


@settings(max_examples=150, deadline=None)
@given(outline, outline)
def test_overlap_is_symmetric_bounded_and_adds_up(a, b):
    def ring(points):
        x, y = (sum(p[i] for p in points) / len(points) for i in (0, 1))
        return [[[list(v) for v in sorted(points, key=lambda p: math.atan2(p[1] - y, p[0] - x))]]]

    p, r = ring(a), ring(b)
    left, right = clipping.overlap_area(p, r), clipping.overlap_area(r, p)
    assert left == pytest.approx(right, abs=1e-9) and -1e-12 <= left <= min(clipping.overlap_area(p, p), clipping.overlap_area(r, r)) + 1e-9
    # two halves of the plane, as boxes, share the polygon between them
    west, east = ([[[[x, -9.0], [x + 9.5, -9.0], [x + 9.5, 9.0], [x, 9.0]]]] for x in (-9.25, 0.25))
    assert clipping.overlap_area(p, west) + clipping.overlap_area(p, east) == pytest.approx(clipping.overlap_area(p, p), abs=1e-9)


def test_shapes_without_area():
    box = [[[[0, 0], [2, 0], [2, 2], [0, 2]]]]
    left = [None, [], [[]], [[[]]], [[[[1, 1]]]], [[[[0, 0], [1, 1]]]], [[[[0, 0], [1, 1], [0, 0]]]], box, box]
    right = [box] * 7 + [None, [[[[2, 0], [3, 0], [3, 2]]]]]
    assert areas(left, right).tolist() == [0.0] * 9
    assert areas([], []).tolist() == []
    # further numbers of a point don't count
    assert areas([[[[[0, 0, 7], [2, 0, 7], [2, 2, 7], [0, 2, 7]]]]], [box]).tolist() == [4.0]


def test_two_hundred_corners_take_milliseconds():
    rng = np.random.default_rng(1)
    left, right = [star(rng, 200) for _ in range(40)], [star(rng, 200, 0.5, 0.5) for _ in range(40)]
    began = time.time()
    got = areas(left, right)
    assert (time.time() - began) / 40 < 0.2 and got.min() > 0


def test_overlay_of_outlines(spark):
    rng = np.random.default_rng(5)
    shapes = [(i, star(rng, int(rng.integers(5, 9)), *rng.uniform(0, 9, 2), 0.2 * (i % 2)) + (star(rng, 5, 12, float(i)) if i % 7 == 0 else [])) for i in range(40)]
    other = [(100 + i, star(rng, 6, *rng.uniform(0, 9, 2))) for i in range(40)]
    as_df = lambda rows, name: spark.createDataFrame([*rows, (-1, None)], f"{name} long, geom {spatial.GEOMETRY_TYPE}")
    a, b = as_df(shapes, "geo_pid"), as_df(other, "prev_geo_pid")
    want = {(i, j): fan_area(p, q) for i, p in shapes for j, q in other}
    got = {(r.geo_pid, r.prev_geo_pid): r for r in spatial.overlay(a, b, 2.0).collect()}
    own = {i: g.area(p) for i, p in shapes}
    assert all(v < 1e-9 for k, v in want.items() if k not in got)
    assert all(abs(r.overlap_area - want[k]) < 1e-9 and abs(r.overlap_share - want[k] / own[k[0]]) < 1e-9 for k, r in got.items())
    half = {(r.geo_pid, r.prev_geo_pid) for r in spatial.overlay(a, b, 2.0, least=0.5).collect()}
    assert {k for k, v in want.items() if v >= 0.5 * own[k[0]]} <= half < set(got)
    areas_of = {r.geo_pid: r.area for r in a.select("geo_pid", spatial.area(a["geom"]).alias("area")).collect()}
    assert areas_of.pop(-1) is None and all(abs(areas_of[i] - own[i]) < 1e-9 for i in own)


def test_predecessors_take_the_largest_share(spark):
    box = lambda x: [[[[x, 0.0], [x + 4, 0.0], [x + 4, 2.0], [x, 2.0]]]]
    rows = [(1, 2020, box(0.0)), (2, 2020, box(3.0)), (3, 2021, box(1.0)), (4, 2021, box(6.0)), (5, 2021, None), (6, 2023, box(0.0))]
    df = spark.createDataFrame(rows, f"geo_pid long, fy int, geom {spatial.GEOMETRY_TYPE}")
    got = [tuple(r) for r in choices.best_predecessors(df, 1.0).collect()]
    assert got == [(3, 2021, 1, 0.75)]


def test_outlines_that_wind_twice_or_against_themselves_are_cut_into_slabs():
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s]]
    tie = [[0.0, 0.0], [4.0, 4.0], [4.0, 0.0], [0.0, 4.0]]
    shapes = [[[square(0, 0, 9)]], [[square(0, 0, 9), square(2, 2, 3)[::-1]]], [[square(0, 0, 9)[::-1], square(2, 2, 3)[::-1]]], [[square(0, 0, 9), square(2, 2, 5)], [square(3, 3, 1)]], [[square(0, 0, 9)], [square(2, 2, 3)]], [[square(0, 0, 9)]] * 2, [[tie]], [[tie[:2] + [[4.0, 1.0]] + tie[2:]]]]
    shapes = pa.array(shapes, clipping.GEOMETRY)
    assert clipping.measured(shapes)[3].tolist() == [True] * 4 + [False] * 4
    assert clipping.measured(shapes)[2].tolist()[:7] == [81.0, 72.0, 72.0, 57.0, 90.0, 162.0, 0.0]
    for box in ([[square(-1.0, 1.0, 4.5)]], [[square(0.5, 0.5, 20.0)]]):
        other = pa.array([box] * len(shapes), clipping.GEOMETRY)
        edges = [clipping.Edges.read(v) for v in (shapes, other)]
        assert clipping.shared_areas(shapes, other) == pytest.approx(clipping._slab_areas(*edges), abs=1e-12)


def test_no_side_of_an_overlay_is_broadcast_and_outlines_come_from_many_tasks(spark):
    # the size that Spark expects of either side is that of the file of keys
    for name in ("rect_overlay_predecessor", "polygon_overlay", "polygon_predecessor"):
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert queries._outlines(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
