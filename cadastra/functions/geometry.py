"""Polygons as nested lists, parts > rings > points > [x, y], and what the panel needs of them.

Numpy only. Rings may be closed or open; the first ring of a part is its shell, others are holes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import numpy as np

Polygon = Sequence[Sequence[Sequence[Sequence[float]]]]

GEOMETRY_TYPE = "array<array<array<array<double>>>>"


def ring_array(ring: Sequence[Sequence[float]]) -> np.ndarray:
    """An open ring as (n, 2)."""
    r = np.array([np.asarray(p, dtype=np.float64)[:2] for p in ring]).reshape(-1, 2)
    return r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r


def signed_area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    r = ring - ring[0]
    return float(0.5 * (r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum())


def oriented(polygon: Polygon) -> list[np.ndarray]:
    """All rings, shells counter-clockwise and holes clockwise."""
    out = []
    for part in polygon:
        for i, ring in enumerate(part):
            r = ring_array(ring)
            if len(r) >= 3:
                out.append(r if (signed_area(r) > 0) == (i == 0) else r[::-1])
    return out


def area(polygon: Polygon) -> float:
    return sum(map(signed_area, oriented(polygon)))


def bounds(polygon: Polygon) -> tuple[float, float, float, float]:
    points = np.concatenate([ring_array(r) for part in polygon for r in part])
    return (*points.min(axis=0).tolist(), *points.max(axis=0).tolist())


def contains(polygon: Polygon, x: float, y: float) -> bool:
    """Crossing parity over all rings; half-open, so a point on a shared edge is in one of two neighbours."""
    inside = False
    for part in polygon:
        for ring in part:
            r = ring_array(ring)
            x1, y1 = r[:, 0], r[:, 1]
            x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
            cut = (y1 > y) != (y2 > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                at = x1 + (y - y1) / (y2 - y1) * (x2 - x1)
            inside ^= bool((cut & (at > x)).sum() % 2)
    return inside


def representative_point(polygon: Polygon) -> tuple[float, float] | None:
    """A point inside: the middle of the widest interior span on a line half way between two vertex heights.

    The line is as near to mid-height as the vertices allow, so that it touches none of them. Of parts,
    the one with the widest span counts. Degenerate polygons give the mean of their points, empty ones null.
    """
    best: tuple[float, float, float] | None = None
    points: list[np.ndarray] = []
    for part in polygon:
        rings = [r for r in map(ring_array, part) if len(r)]
        if not rings:
            continue
        points += rings
        ys = np.unique(np.concatenate([r[:, 1] for r in rings]))
        if len(ys) < 2:
            continue
        mid = (ys[0] + ys[-1]) / 2
        below, above = ys[ys <= mid].max(), ys[ys > mid].min()
        y = (below + above) / 2
        xs: list[float] = []
        for r in rings:
            x1, y1 = r[:, 0], r[:, 1]
            x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
            cut = (y1 > y) != (y2 > y)
            xs += (x1[cut] + (y - y1[cut]) / (y2[cut] - y1[cut]) * (x2[cut] - x1[cut])).tolist()
        xs.sort()
        for a, b in zip(xs[::2], xs[1::2]):
            if best is None or b - a > best[0]:
                best = (b - a, (a + b) / 2, float(y))
    if best is not None:
        return best[1], best[2]
    if points:
        x, y = np.concatenate(points).mean(axis=0)
        return float(x), float(y)
    return None


def from_wkt(text: str | None) -> list | None:
    """POINT, POLYGON and MULTIPOLYGON text as nested lists; blank or null is null."""
    if text is None or not text.strip():
        return None
    kind, body = re.fullmatch(r"(?s)\s*([A-Za-z]+)\s*(?:Z\s*)?(\(.*\)|EMPTY)\s*", text).groups()
    if body == "EMPTY":
        return []
    if not re.fullmatch(r"[-+0-9.eE\s,()]*", body):
        raise ValueError(f"not a number in {text[:80]!r}")
    listed = re.sub(r"[^,()]+", lambda m: "[" + ",".join(m[0].split()[:2]) + "]" if m[0].strip() else "", body)
    nested = json.loads(listed.replace("(", "[").replace(")", "]"))
    return {"POINT": lambda: nested[0], "POLYGON": lambda: [nested], "MULTIPOLYGON": lambda: nested}[kind.upper()]()


def to_wkt(polygon: Polygon | None) -> str | None:
    if polygon is None:
        return None
    rings = lambda part: "(" + ", ".join("(" + ", ".join(f"{p[0]!r} {p[1]!r}" for p in ring) + ")" for ring in part) + ")"
    if len(polygon) == 1:
        return f"POLYGON {rings(polygon[0])}"
    return "MULTIPOLYGON (" + ", ".join(map(rings, polygon)) + ")" if len(polygon) else "POLYGON EMPTY"
