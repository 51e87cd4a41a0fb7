"""Areas that pairs of polygons share, for whole batches of pairs at once.

Between two neighbouring heights at which an edge of the pair ends or two of its edges cross, all edges
are straight and keep their order, so the width of what both polygons cover changes linearly: the shared
area of such a slab is its height times the width at its middle. All pairs of a batch are cut into slabs
together; an edge enters the slabs that it spans only. What is inside follows from crossing parity, so
concave outlines, holes and several parts need no care of their own, and shared edges do no harm.

Most outlines have few edges and wind around each of their points once. What two of them share is a sum
over pairs of edges, of the area below both, and needs no sorting. Outlines that wind around a point in
another way, where that sum would count it twice or against another, are told by the same sum with themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CROSSINGS = 1 << 20  # pairs of edges whose crossings are looked for at a time
SUMMED = 1 << 15  # pairs of edges that are summed at a time, which fit a core's cache
FEW = 48  # edges of an outline whose pairs are summed; the sum with itself takes their square

GEOMETRY = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))


@dataclass
class Edges:
    """Edges of polygons, polygon after polygon: ``of`` says whose, ``counts`` how many each has; ``turn`` is 1
    where a shell's edges run counter-clockwise or a hole's clockwise, else -1."""

    of: np.ndarray
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray
    turn: np.ndarray

    @staticmethod
    def read(shapes: pa.Array) -> Edges:
        """From a column of nested lists; a null polygon has no edges, rings close themselves."""
        levels, column = [], shapes
        for _ in range(3):
            levels.append(np.asarray(pc.fill_null(pc.list_value_length(column), 0)))
            column = column.flatten()
        width = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        first = np.cumsum(width) - width
        points = np.stack([flat[first], flat[first + 1]], axis=1) if len(width) else np.zeros((0, 2))
        sizes = levels[2].astype(np.int64)
        ring = np.repeat(np.arange(len(sizes)), sizes)
        polygon = np.repeat(np.repeat(np.arange(len(shapes)), levels[0]), levels[1])[ring] if len(sizes) else np.zeros(0, np.int64)
        following = np.arange(len(points)) + 1
        ends = np.cumsum(sizes)
        some = sizes > 0
        following[ends[some] - 1] = (ends - sizes)[some]
        begin = points[np.minimum(ends - sizes, max(len(points) - 1, 0))][ring] if len(points) else points
        p, q = points - begin, points[following] - begin
        twice = np.bincount(ring, p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0], minlength=len(sizes))
        _, number = spread(levels[1].astype(np.int64))
        turn = np.where((twice < 0) == (number > 0), 1.0, -1.0)[ring]
        return Edges(polygon, points, points[following], np.bincount(polygon, minlength=len(shapes)), turn)

    def chosen(self, keep: np.ndarray, shift: np.ndarray) -> Edges:
        """Only some edges, with each polygon's origin moved by ``shift``."""
        of = self.of[keep]
        return Edges(of, self.start[keep] - shift[of], self.end[keep] - shift[of], np.bincount(of, minlength=len(self.counts)), self.turn[keep])

    def picked(self, polygons: np.ndarray) -> Edges:
        """The edges of only some polygons, which are numbered anew."""
        keep = polygons[self.of]
        of = (np.cumsum(polygons) - 1)[self.of[keep]]
        return Edges(of, self.start[keep], self.end[keep], self.counts[polygons], self.turn[keep])


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of ``counts`` things: the group of each, and its number in the group."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def crossings(a: Edges, b: Edges) -> tuple[np.ndarray, np.ndarray]:
    """(pair, height) of the points where an edge of ``a`` meets one of ``b`` that isn't parallel to it."""
    first = np.cumsum(b.counts) - b.counts
    each = b.counts[a.of]
    pairs, heights = [], []
    cuts = np.searchsorted(np.cumsum(each), np.arange(CROSSINGS, each.sum() + CROSSINGS, CROSSINGS), side="left") + 1 if len(each) else []
    lo = 0
    for hi in np.unique(np.minimum(cuts, len(each))):
        i, number = spread(each[lo:hi])
        i = i + lo
        j = first[a.of[i]] + number
        r, s, gap = a.end[i] - a.start[i], b.end[j] - b.start[j], b.start[j] - a.start[i]
        turn = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[:, 0] * s[:, 1] - gap[:, 1] * s[:, 0]) / turn
            u = (gap[:, 0] * r[:, 1] - gap[:, 1] * r[:, 0]) / turn
        met = (turn != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        pairs.append(a.of[i[met]])
        heights.append(a.start[i[met], 1] + t[met] * r[met, 1])
        lo = hi
    none = np.zeros(0)
    return (np.concatenate(pairs), np.concatenate(heights)) if pairs else (none.astype(np.int64), none)


def summed(a: Edges, b: Edges) -> np.ndarray:
    """The integral over the plane of how often ``a`` winds around a point, times how often ``b`` does.

    A point's number is the sum, over the edges above it, of 1 for those that have the inside below and -1
    for others, so the integral is the sum over pairs of edges of the area below both.
    """
    first = np.cumsum(b.counts) - b.counts
    each = b.counts[a.of]
    total = np.zeros(len(a.counts))
    sides = []
    for e in (a, b):
        left, right = np.minimum(e.start[:, 0], e.end[:, 0]), np.maximum(e.start[:, 0], e.end[:, 0])
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(left < right, (e.end[:, 1] - e.start[:, 1]) / (e.end[:, 0] - e.start[:, 0]), 0.0)
        low = np.where(e.start[:, 0] < e.end[:, 0], e.start[:, 1], e.end[:, 1])
        sides.append((left, right, low, slope, np.where(e.start[:, 0] < e.end[:, 0], -e.turn, e.turn)))
    ends = np.cumsum(each)
    lo = 0
    while lo < len(each):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SUMMED, side="right")))
        i, number = spread(each[lo:hi])
        i = i + lo
        j = first[a.of[i]] + number
        (al, ar, ay, am, at), (bl, br, by, bm, bt) = ([v[k] for v in side] for side, k in zip(sides, (i, j)))
        left = np.maximum(al, bl)
        right = np.minimum(ar, br)
        a0, a1, b0, b1 = ay + (left - al) * am, ay + (right - al) * am, by + (left - bl) * bm, by + (right - bl) * bm
        d0, d1 = a0 - b0, a1 - b1
        least, most = np.minimum(d0, d1), np.maximum(d0, d1)
        with np.errstate(divide="ignore", invalid="ignore"):
            crossed = least * least / (least - most)
        # twice the mean of what a's edge is lower than b's
        under = np.where(most <= 0, d0 + d1, np.where(least >= 0, 0.0, crossed))
        piece = np.where(right > left, at * bt * (right - left) * (b0 + b1 + under) / 2, 0.0)
        total += np.bincount(a.of[i], piece, minlength=len(total))
        lo = hi
    return total


def measured(shapes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, area, once): the corners of the boxes, shells less holes, and whether pairs of edges may be summed.

    They may where a polygon of few edges winds around all points once or not at all: only then the
    integral of that number is the integral of its square. Without points, corners are infinite.
    """
    e = Edges.read(shapes)
    n = len(e.counts)
    low, high = np.full((n, 2), np.inf), np.full((n, 2), -np.inf)
    np.minimum.at(low, e.of, e.start)
    np.maximum.at(high, e.of, e.start)
    own = e.chosen(np.ones(len(e.of), bool), np.where(e.counts[:, None] > 0, low, 0.0))
    area = np.bincount(own.of, own.turn * (own.start[:, 0] * own.end[:, 1] - own.start[:, 1] * own.end[:, 0]), minlength=n) / 2
    once = e.counts <= FEW
    some = own.picked(once)
    with np.errstate(invalid="ignore"):
        size = np.where(e.counts > 0, (high - low).prod(axis=1), 1.0)
        once[once] = np.abs(summed(some, some) - area[once]) <= 1e-12 * size[once]
    return low, high, area, once


def shared_areas(left: pa.Array, right: pa.Array, once: np.ndarray | None = None) -> np.ndarray:
    """The area that ``left[i]`` and ``right[i]`` both cover. Rings of one polygon must not cross each other.

    ``once``: that of both by ``measured``, where known.
    """
    a, b = Edges.read(left), Edges.read(right)
    if once is None:
        once = measured(left)[3] & measured(right)[3]
    out = np.zeros(len(left))
    for way, which in ((_summed_areas, once), (_slab_areas, ~once)):
        if which.any():
            out[which] = way(a, b) if which.all() else way(a.picked(which), b.picked(which))
    return out


def _common(a: Edges, b: Edges) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The corners of the boxes that pairs have in common, whether there is one, and the new origin in it."""
    n = len(a.counts)
    low, high = np.full((2, n, 2), -np.inf), np.full((2, n, 2), np.inf)
    for side, e in enumerate((a, b)):
        top, bottom = np.full((n, 2), -np.inf), np.full((n, 2), np.inf)
        np.maximum.at(top, e.of, np.maximum(e.start, e.end))
        np.minimum.at(bottom, e.of, np.minimum(e.start, e.end))
        low[side], high[side] = bottom, top
    low, high = low.max(axis=0), high.min(axis=0)
    meets = (low < high).all(axis=1) & (a.counts > 0) & (b.counts > 0)
    return low, high, meets, np.where(meets[:, None], low, 0.0)


def _summed_areas(a: Edges, b: Edges) -> np.ndarray:
    low, high, meets, shift = _common(a, b)

    def near(e: Edges) -> Edges:
        # what is left or right of the common box, or upright, has nothing of it below
        right, left = np.maximum(e.start[:, 0], e.end[:, 0]), np.minimum(e.start[:, 0], e.end[:, 0])
        return e.chosen(meets[e.of] & (right > low[e.of, 0]) & (left < high[e.of, 0]) & (right > left), shift)

    return np.maximum(summed(near(a), near(b)), 0.0)


def _slab_areas(a: Edges, b: Edges) -> np.ndarray:
    n = len(a.counts)
    low, high, meets, shift = _common(a, b)

    def near(e: Edges) -> Edges:
        # what is above, below or left of the common box covers nothing of it; what is right of it bounds it
        up, down = np.maximum(e.start[:, 1], e.end[:, 1]), np.minimum(e.start[:, 1], e.end[:, 1])
        return e.chosen(meets[e.of] & (up > low[e.of, 1]) & (down < high[e.of, 1]) & (up > down), shift)

    a, b = near(a), near(b)
    tall = (high - shift)[:, 1]
    pair, height = crossings(a, b)
    at = np.concatenate([pair, a.of, a.of, b.of, b.of])
    y = np.concatenate([height, a.start[:, 1], a.end[:, 1], b.start[:, 1], b.end[:, 1]])
    inside = (y >= 0) & (y <= tall[at])
    order = np.lexsort((y[inside], at[inside]))
    at, y = at[inside][order], y[inside][order]
    rises = (at[1:] == at[:-1]) & (y[1:] > y[:-1])
    of, bottom, depth = at[:-1][rises], y[:-1][rises], (y[1:] - y[:-1])[rises]
    middle = bottom + depth / 2
    if not len(of):
        return np.zeros(n)
    slabs, xs, owners = [], [], []
    # slabs in one increasing sequence of whole numbers, in which two searches find those of an edge
    ranks = np.unique(bottom)
    line = of * (len(ranks) + 1) + np.searchsorted(ranks, bottom)
    for owner, e in enumerate((a, b)):
        place = lambda v: np.searchsorted(line, e.of * (len(ranks) + 1) + np.searchsorted(ranks, v))  # noqa: B023, E731
        lo, hi = place(np.minimum(e.start[:, 1], e.end[:, 1])), place(np.maximum(e.start[:, 1], e.end[:, 1]))
        i, number = spread(hi - lo)
        slab = lo[i] + number
        slope = (e.end[i, 0] - e.start[i, 0]) / (e.end[i, 1] - e.start[i, 1])
        xs.append(e.start[i, 0] + (middle[slab] - e.start[i, 1]) * slope)
        slabs.append(slab)
        owners.append(np.full(len(slab), owner))
    slab, x, owner = np.concatenate(slabs), np.concatenate(xs), np.concatenate(owners)
    order = np.lexsort((x, slab))
    slab, x, owner = slab[order], x[order], owner[order]
    # every line meets a polygon's outline an even number of times, so parity starts anew with each slab
    both = (np.cumsum(owner == 0) % 2 == 1) & (np.cumsum(owner == 1) % 2 == 1)
    wide = np.where(both[:-1], x[1:] - x[:-1], 0.0)
    return np.bincount(of[slab[:-1]], wide * depth[slab[:-1]], minlength=n)


def overlap_area(a: Sequence, b: Sequence) -> float:
    """``shared_areas`` of one pair."""
    return float(shared_areas(pa.array([a], GEOMETRY), pa.array([b], GEOMETRY))[0])
